"""Queries over grammar rules, on sentences made of the words that the rules are about.

Every word of the documents becomes one of ``RULE_WORDS`` by its letters and length;
twelve words make a sentence. So every rule meets all of its cases, and both engines
have the same input.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions import spans
from loomwork.operators import corpus, grammar, sentence_rules
from loomwork.plans.catalog import register
from loomwork.plans.common import documents
from loomwork.plans.textual import FINAL_SQL
from loomwork.session import held
from loomwork.shared import cut

RULE_WORDS = [
    *dict.fromkeys([
        *grammar.ALL_PARTICLES, *grammar.DATIVE, *grammar.ASPECT_VERBS, *grammar.EXISTENTIAL, "དེང་སང", "དེ་རིང", *grammar.HONORIFIC, "ཁྱེད", "ཁོང", *grammar.COPULA, "ང་ཚོ", "ངས", "ཞེས",
        *grammar.NOMINALIZED, *grammar.MAY_REPEAT, "བོད", "བོད་པ", "དེབ", "དིབ", "དུས", "དོས", "སྐད", "ཡིག", "ཤིང", "ཞིང", "བདེ", "བདི", "ལས", "ཁང་པ", "སློབ་མ", "མི", "བྱིས", "ནམ་མཁའ", "རི", "ཆུ་བོ་", "ཤིས", "སེམས་",
    ])
]
CATEGORIES = ("NOUN", "VERB", "PARTICLE", "ADVERB", "PRONOUN", "PUNCTUATION", None)
RELATIONS = ("root", "arg2", "case", "mark", "aux", "dep", "arg1", "dep", "dep")
WIDTH = 12


def rule_words(df: DataFrame, words: list[str]) -> DataFrame:
    """Add ``words``: the text's words, each replaced by one of the list."""
    listed = F.array(*map(F.lit, words))
    place = lambda t: (F.ascii(t) * 7 + F.ascii(F.substring(t, -1, 1)) * 3 + F.char_length(t)) % len(words) + 1
    return held(df, {"words": F.transform(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda t: F.element_at(listed, place(t).cast("int")))})


def word_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sent_idx, w): the words of each sentence."""
    rows = rule_words(documents(spark, sf_dir), RULE_WORDS).where(F.size("words") > 0)
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / WIDTH).cast("int")), lambda g: F.slice("words", g * WIDTH + 1, F.lit(WIDTH)))
    return rows.select("doc_id", F.posexplode_outer(groups).alias("sent_idx", "w"))


def _told(batches, words: list[str], at_once: int = 4096):
    """Sentences of the documents' words, some thousands in a batch; letters a to z are bytes of their own in UTF-8."""
    texts, kinds, relations = (pa.array(x, pa.string()) for x in (words, CATEGORIES, RELATIONS))
    sizes = np.array([len(w) for w in words])
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        bounds = (offsets - offsets[0]).astype(np.int64)
        letter = (data >= ord("a")) & (data <= ord("z"))
        apart = np.zeros(len(data) + 1, bool)  # whether the byte before and this one cannot be of one word
        apart[1:-1] = ~(letter[:-1] & letter[1:])
        apart[bounds] = True
        first, last = np.flatnonzero(letter & apart[:-1]), np.flatnonzero(letter & apart[1:])
        number = (data[first].astype(np.int64) * 7 + data[last].astype(np.int64) * 3 + last - first + 1) % len(words)
        doc = np.searchsorted(bounds[1:], first, "right")
        counts = np.bincount(doc, minlength=len(ids))
        place = np.arange(len(doc)) - (np.cumsum(counts) - counts)[doc]
        heads = np.append(np.flatnonzero(place % WIDTH == 0), len(doc))
        for k in range(0, len(heads) - 1, at_once):
            cuts = heads[k : k + at_once + 1]
            part, own = slice(cuts[0], cuts[-1]), cuts[:-1]
            w, i = number[part], place[part] % WIDTH
            before = np.cumsum(sizes[w] + 1) - sizes[w] - 1
            start = before - np.repeat(before[own - cuts[0]], np.diff(cuts))
            named, lists = texts.take(pa.array(w)), pa.array((cuts - cuts[0]).astype(np.int32))
            fields = [
                named, pa.array(start.astype(np.int32)), pa.array((start + sizes[w]).astype(np.int32)),
                kinds.take(pa.array((w * 3 + i) % len(CATEGORIES))), relations.take(pa.array((w + 2 * i) % len(RELATIONS))),
            ]
            nodes = pa.ListArray.from_arrays(lists, pa.StructArray.from_arrays(fields, ["text", "start", "end", "category", "relation"]))
            text = pc.binary_join_element_wise(pc.binary_join(pa.ListArray.from_arrays(lists, named), "་"), "།", "")
            sent = place[own] // WIDTH
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[own])), pa.array(sent.astype(np.int32)), pa.array(sent * 1000), text, nodes], ["doc_id", "sent_idx", "sent_start", "text", "nodes"])


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sent_idx, sent_start, text, nodes)."""
    rows = documents(spark, sf_dir).select("doc_id", F.lower("text").alias("text"))
    kind = T.ArrayType(T.StructType().add("text", "string").add("start", "integer").add("end", "integer").add("category", "string").add("relation", "string"))
    schema = T.StructType().add("doc_id", rows.schema["doc_id"].dataType).add("sent_idx", "integer").add("sent_start", "long").add("text", "string").add("nodes", kind)
    return rows.mapInArrow(partial(_told, words=RULE_WORDS), schema)


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.neighbours(sentences(spark, sf_dir))


def listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def words_sql(words: list[str]) -> str:
    return f"""told AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda t: ([{listed(words)}])[((unicode(t) * 7 + unicode(right(t, 1)) * 3 + length(t)) % {len(words)} + 1)::INT]) AS ws
      FROM documents WHERE text IS NOT NULL AND text <> '')"""


NODES_SQL = f"""{words_sql(RULE_WORDS)},
every AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS p FROM told),
nodes AS (SELECT doc_id, p // {WIDTH} AS s, p % {WIDTH} AS i, w, list_position([{listed(RULE_WORDS)}], w) - 1 AS k FROM every),
placed AS (SELECT *, (coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id, s ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS a, count(*) OVER (PARTITION BY doc_id, s) AS n,
  ([{", ".join("NULL" if c is None else f"'{c}'" for c in CATEGORIES)}])[((k * 3 + i) % {len(CATEGORIES)} + 1)::INT] AS cat, ([{listed(RELATIONS)}])[((k + 2 * i) % {len(RELATIONS)} + 1)::INT] AS rel FROM nodes),
texts AS (SELECT doc_id, s, string_agg(w, '་' ORDER BY i) || '།' AS txt, list(trim(w, '་ །')) AS names FROM nodes GROUP BY 1, 2),
flat AS (SELECT p.*, t.txt, t.names, trim(w, '་ །') AS cur, lag(trim(w, '་ །')) OVER v AS l, lag(cat) OVER v AS lcat, lag(rel) OVER v AS lrel, lead(cat) OVER v AS rcat, s * 1000 + a AS char_start, s * 1000 + a + length(w) AS char_end
  FROM placed p JOIN texts t USING (doc_id, s) WINDOW v AS (PARTITION BY doc_id, s ORDER BY i))"""


def case_sql(column: str, table: dict[str, str], default: str | None = None) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + (f" ELSE '{default}'" if default else "") + " END"


def _particles_sql() -> str:
    closes = "(i = n - 1 OR coalesce(rcat = 'PUNCTUATION', false) OR coalesce(cat = 'PARTICLE', false)) AND NOT coalesce(cat IN ('NOUN', 'ADVERB'), false)"
    aspect = f"(cur = 'གི' AND (coalesce(lcat = 'VERB', false) OR coalesce(lrel IN ('root', 'aux'), false) OR l IN ({listed(grammar.ASPECT_VERBS)})))"
    families = [
        ("Genitive", grammar.ALL_GENITIVE, case_sql("f", grammar.GENITIVE, "གི"), f"NOT {aspect} AND cur NOT IN ('འི', 'ཡི')"),
        ("Ergative", grammar.ALL_ERGATIVE, case_sql("f", grammar.ERGATIVE, "གིས"), "cur NOT IN ('ས', 'ཡིས')"),
        ("Interrogative", grammar.ALL_INTERROGATIVE, case_sql("f", grammar.INTERROGATIVE, "འམ"), closes),
        ("Sentence-final", grammar.ALL_FINAL, case_sql("f", grammar.FINAL, "འོ"), closes),
    ]
    final = FINAL_SQL.replace("word", "syl")
    parts = [
        f"""SELECT doc_id, char_start, char_end, {wanted} AS replacement, 0.98::DOUBLE AS score, 'HIGH' AS priority,
        '{name} particle agreement error: "' || l || '" should take "' || {wanted} || '" instead of "' || cur || '"' AS message FROM closed WHERE cur IN ({listed(forms)}) AND {when} AND {wanted} <> cur"""
        for name, forms, wanted, when in families
    ]
    return f"""closed AS (SELECT *, {final} AS f FROM (SELECT *, string_split(l, '་')[-1] AS syl FROM flat WHERE l IS NOT NULL AND l <> '' AND cur <> '')),
    particles AS ({" UNION ALL ".join(parts)})"""


SIMPLE = "doc_id, char_start, char_end"


def _rules_sql() -> str:
    honored = " OR ".join(f"contains(txt, '{p}')" for p in grammar.HONORED)
    polite = "CASE " + " ".join(f"WHEN starts_with(cur, '{k}') THEN '{v}'" for k, v in grammar.HONORIFIC.items()) + " END"
    copula = case_sql("cur", grammar.COPULA)
    exist = case_sql("cur", grammar.EXISTENTIAL)
    nom = case_sql("cur", grammar.NOMINALIZED)
    return f"""WITH {NODES_SQL}, {_particles_sql()},
    others AS (
      SELECT {SIMPLE}, {exist} AS replacement, 0.95::DOUBLE AS score, 'HIGH' AS priority FROM flat WHERE {exist} IS NOT NULL
      UNION ALL SELECT {SIMPLE}, 'དེ་རིང', 0.85, 'MEDIUM' FROM flat WHERE cur = 'དེང་སང' AND (contains(txt, 'དེ་རིང') OR contains(txt, 'བྱུང་'))
      UNION ALL SELECT {SIMPLE}, {polite}, 0.60, 'LOW' FROM flat WHERE ({honored}) AND {polite} IS NOT NULL
      UNION ALL SELECT {SIMPLE}, {copula}, 0.55, 'LOW' FROM flat WHERE list_has_any(names, [{listed(grammar.FIRST_PERSON)}]) AND {copula} IS NOT NULL
      UNION ALL SELECT f.doc_id, f.char_start, f.char_end, f.w || ' ' || r.w, 0.50, 'LOW' FROM flat f JOIN flat r ON r.doc_id = f.doc_id AND r.s = f.s AND r.i < f.i AND r.rel = 'root'
        WHERE NOT contains(f.txt, 'ཅེས') AND NOT contains(f.txt, 'ཞེས') AND f.rel IN ({listed(grammar.OBJECTS)}) AND length(trim(f.w, '་ ')) > 1
      UNION ALL SELECT {SIMPLE}, {nom}, 0.90, 'HIGH' FROM flat WHERE i = n - 1 AND {nom} IS NOT NULL
      UNION ALL SELECT {SIMPLE}, NULL, 0.90, 'HIGH' FROM flat WHERE cur = l AND cur <> '' AND cur NOT IN ({listed(grammar.MAY_REPEAT)})
      UNION ALL SELECT {SIMPLE}, 'བོད་པ་', 0.90, 'HIGH' FROM flat WHERE (list_contains(names, 'ང་ཚོ') OR list_contains(names, 'ང')) AND list_contains(names, 'ཡིན') AND cur = 'བོད')
    SELECT {SIMPLE}, replacement, score, priority FROM particles UNION ALL SELECT * FROM others"""


@register("grammar_rules", _rules_sql())
def grammar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules that need no lexicon, in one pass."""
    return sentence_rules.findings(sentences(spark, sf_dir), demonyms=True).select("doc_id", "char_start", "char_end", "replacement", "score", "priority")


@register("particle_agreement", f"WITH {NODES_SQL}, {_particles_sql()} SELECT {SIMPLE}, replacement, message FROM particles")
def particle_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    only = grammar.Registry({k: False for k in grammar.Registry.DEFAULTS if k != "TIB-PART-001"})
    found = grammar.findings(flat(spark, sf_dir), only)
    return found.where(F.col("message").contains("particle agreement")).select("doc_id", "char_start", "char_end", "replacement", "message")


def one_rule(name: str, rule: str, where: str, replacement: str, message: str):
    """A query for a single rule, with its message."""
    off = {k: False for k in grammar.Registry.DEFAULTS if k != rule}

    @register(name, f"WITH {NODES_SQL} SELECT {SIMPLE}, {replacement} AS replacement, {message} AS message FROM flat WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = grammar.findings(flat(spark, sf_dir), grammar.Registry({"rules": off}))
        return found.where(F.col("message").startswith(f"[{rule}]")).select("doc_id", "char_start", "char_end", "replacement", "message")

    return run


POLITE = "CASE " + " ".join(f"WHEN starts_with(cur, '{k}') THEN '{v}'" for k, v in grammar.HONORIFIC.items()) + " END"
EXIST, COP, NOM = case_sql("cur", grammar.EXISTENTIAL), case_sql("cur", grammar.COPULA), case_sql("cur", grammar.NOMINALIZED)
one_rule("existential_rule", "TIB-EXIST-001", f"{EXIST} IS NOT NULL", EXIST, f"""'[TIB-EXIST-001] Invalid existential verb spelling "' || cur || '" -> suggest "' || {EXIST} || '"'""")
one_rule(
    "temporal_rule", "TIB-TEMP-001", "cur = 'དེང་སང' AND (contains(txt, 'དེ་རིང') OR contains(txt, 'བྱུང་'))", "'དེ་རིང'",
    """'[TIB-TEMP-001] Temporal adverb context check: "དེང་སང" means "nowadays"; suggest "དེ་རིང" for today'""",
)
one_rule(
    "honorific_rule", "TIB-HONOR-001", f"({' OR '.join(f'contains(txt, {p!r})' for p in grammar.HONORED)}) AND {POLITE} IS NOT NULL", POLITE,
    f"""'[TIB-HONOR-001] Honorific agreement suggestion: honorific subject present, consider "' || {POLITE} || '" instead of plain verb "' || cur || '" (depending on register)'""",
)
one_rule(
    "copula_rule", "TIB-COP-001", f"list_has_any(names, [{listed(grammar.FIRST_PERSON)}]) AND {COP} IS NOT NULL", COP,
    f"""'[TIB-COP-001] Copula agreement check: 1st person subject typically pairs with "' || {COP} || '" rather than "' || cur || '". Depending on dialect and register, this may be acceptable.'""",
)
one_rule(
    "nominalizer_rule", "TIB-NOM-001", f"i = n - 1 AND {NOM} IS NOT NULL", NOM,
    f"""'[TIB-NOM-001] Redundant nominalizer: sentence-final declarative clause should end with copula "' || {NOM} || '" instead of nominalized "' || cur || '".'""",
)


@register(
    "word_order_rule",
    f"""WITH {NODES_SQL} SELECT f.doc_id, f.char_start, f.char_end, f.w || ' ' || r.w AS replacement FROM flat f JOIN flat r ON r.doc_id = f.doc_id AND r.s = f.s AND r.i < f.i AND r.rel = 'root'
    WHERE NOT contains(f.txt, 'ཅེས') AND NOT contains(f.txt, 'ཞེས') AND f.rel IN ({listed(grammar.OBJECTS)}) AND length(trim(f.w, '་ ')) > 1""",
)
def word_order_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = {k: False for k in grammar.Registry.DEFAULTS if k != "TIB-SOV-001"}
    found = grammar.findings(flat(spark, sf_dir), grammar.Registry(off))
    return found.where(F.col("message").startswith("[TIB-SOV-001]")).select("doc_id", "char_start", "char_end", "replacement")


@register("repeated_words", f"""WITH {NODES_SQL} SELECT {SIMPLE}, 'Duplicate repeated word detected: "' || cur || '" is repeated sequentially.' AS message FROM flat WHERE cur = l AND cur <> '' AND cur NOT IN ({listed(grammar.MAY_REPEAT)})""")
def repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grammar.findings(flat(spark, sf_dir), grammar.Registry({k: False for k in grammar.Registry.DEFAULTS}))
    return found.select("doc_id", "char_start", "char_end", "message")


@register("rule_registry", """SELECT * FROM (VALUES ('TIB-CHAR-001', 'spelling', 0.85::DOUBLE, true), ('TIB-COP-001', 'verb', 0.55, false), ('TIB-EXIST-001', 'verb', 0.95, true), ('TIB-HONOR-001', 'honorific', 0.6, true),
  ('TIB-NOM-001', 'nominalizer', 0.9, true), ('TIB-PART-001', 'particle', 0.5, true), ('TIB-PART-OMIT-001', 'particle', 0.8, true), ('TIB-SOV-001', 'word_order', 0.5, true), ('TIB-TEMP-001', 'adverb', 0.85, true), ('TIB-VOWEL-001', 'spelling', 0.85, true)) t(rule_id, category, score, enabled)""")
def rule_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = {"rules": {"TIB-COP-001": False, "TIB-PART-001": {"confidence_baseline": 0.5}, "UNKNOWN": True}}
    return grammar.Registry(config).table(spark)


# The corpus of the lexical rules: the same words, counted; words of even number are the lexicon.
COUNTS_SQL = f"""{NODES_SQL}, words AS (SELECT trim(w, '་ །ཿ') AS word, w, k FROM nodes),
counts AS (SELECT word AS ngram, (count(*) * CASE WHEN min(k) % 3 = 0 THEN 40 ELSE 1 END)::BIGINT AS n FROM words GROUP BY 1),
freqs AS (SELECT ngram AS word, n FROM counts), lexicon AS (SELECT DISTINCT word FROM words)"""


def _counts(groups: DataFrame) -> DataFrame:
    """Counts of the words, those of every third number forty-fold, so that some dominate."""
    number = F.create_map(*(F.lit(x) for p in {w: k for k, w in enumerate(RULE_WORDS)}.items() for x in p))
    each = groups.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    told = each.select(grammar.stripped(F.col("word"), True).alias("ngram"), number[F.col("word")].alias("k"), "n")
    return told.groupBy("ngram").agg((F.sum("n") * F.when(F.min("k") % 3 == 0, 40).otherwise(1)).alias("n"))


def _variant_sql(table: dict[str, str], rule: str) -> str:
    pairs = ", ".join(f"('{a}', '{b}')" for a, others in table.items() for b in others)
    return f"""WITH {COUNTS_SQL}, swap(a, b) AS (VALUES {pairs}),
    asked AS (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM lexicon WHERE length(word) > 1 AND word NOT IN ({listed([*grammar.ALL_PARTICLES, *grammar.PRONOUNS, *grammar.EXCEPTIONS])})),
    made AS (SELECT DISTINCT word, substr(word, 1, (p - 1)::INT) || b || substr(word, (p + 1)::INT) AS variant FROM asked JOIN swap ON a = substr(word, p::INT, 1)),
    held AS (SELECT m.word, variant, coalesce(c.n, 0) AS f FROM made m JOIN lexicon x ON x.word = variant LEFT JOIN freqs c ON c.word = variant WHERE variant NOT IN ({listed([*grammar.ALL_PARTICLES, *grammar.DATIVE])})),
    ranked AS (SELECT *, coalesce(lead(f) OVER v, 0) AS nx, row_number() OVER v AS r FROM held WINDOW v AS (PARTITION BY word ORDER BY f DESC, variant DESC)),
    fix AS (SELECT r.word, variant FROM ranked r LEFT JOIN freqs c ON c.word = r.word WHERE r.r = 1 AND f >= 5 AND f >= 20 * greatest(coalesce(c.n, 0), 1) AND f >= 10 * nx)
    SELECT doc_id, char_start, char_end, variant || substr(w, length(word) + 1) AS replacement FROM flat JOIN fix ON word = trim(w, '་ །ཿ') WHERE NOT (contains(txt, 'བཀྲ་ཤིས') AND word = 'ཤིས')"""


def _variants(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    counts = cut(_counts(word_groups(spark, sf_dir)), "counts")
    registry = grammar.Registry({k: k == rule for k in ("TIB-VOWEL-001", "TIB-CHAR-001")})
    found = grammar.variant_findings(flat(spark, sf_dir), counts.select(F.col("ngram").alias("word")), counts, registry)
    return found.select("doc_id", "char_start", "char_end", "replacement")


@register("vowel_variants", _variant_sql(grammar.VOWELS, "TIB-VOWEL-001"))
def vowel_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir, "TIB-VOWEL-001")


@register("letter_variants", _variant_sql(grammar.LETTERS, "TIB-CHAR-001"))
def letter_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir, "TIB-CHAR-001")


GRAMS_SQL = f"""{NODES_SQL}, seq AS (SELECT doc_id, s, i, w, lead(w) OVER v AS w2, lead(w, 2) OVER v AS w3 FROM nodes WINDOW v AS (PARTITION BY doc_id, s ORDER BY i)),
two AS (SELECT w || ' ' || w2 AS g, count(*) AS n FROM seq WHERE w2 IS NOT NULL GROUP BY 1 ORDER BY n DESC, g LIMIT 2000), three AS (SELECT w || ' ' || w2 || ' ' || w3 AS g, count(*) AS n FROM seq WHERE w3 IS NOT NULL GROUP BY 1 ORDER BY n DESC, g LIMIT 20000)"""


def _omission_sql() -> str:
    a, b = "trim(l, '་ །ཿ')", "trim(w, '་ །ཿ')"
    final = FINAL_SQL.replace("word", "lst")
    clean = lambda t: f"regexp_replace({t}, '[་ །]+( |$)', '\\1', 'g')"
    return f"""WITH {GRAMS_SQL}, c2 AS (SELECT {clean("g")} AS g, n, (w1 + w2) AS mask FROM (SELECT g, n, CASE WHEN regexp_matches(g, '་ ') THEN 1 ELSE 0 END AS w1, CASE WHEN regexp_matches(g, '་$') THEN 2 ELSE 0 END AS w2 FROM two)),
    b2 AS (SELECT g, arg_min(n, mask) AS n FROM c2 GROUP BY 1), b3 AS (SELECT DISTINCT {clean("g")} AS g FROM three),
    rows_ AS (SELECT doc_id, s, i, char_start, char_end, w, {a} AS a, {b} AS b, cat, lcat FROM flat WHERE i > 0),
    good AS (SELECT *, string_split(a, '་')[-1] AS lst FROM rows_ WHERE a <> '' AND b <> '' AND a NOT IN ({listed([*grammar.ALL_PARTICLES, *grammar.NUMERALS])})
      AND b NOT IN ({listed([*grammar.ALL_PARTICLES, *grammar.PRONOUNS, *grammar.NUMERALS, *grammar.COPULAS])}) AND NOT regexp_matches(b, 'འོ$|འི$') AND NOT coalesce(cat IN ('ADVERB', 'PARTICLE'), false) AND NOT coalesce(lcat IN ('ADVERB', 'PARTICLE'), false)),
    part AS (SELECT *, {case_sql("fc", grammar.GENITIVE)} AS p FROM (SELECT *, {final} AS fc FROM good)),
    hit AS (SELECT * FROM part WHERE p IN ('གི', 'ཀྱི', 'གྱི') AND NOT EXISTS (SELECT 1 FROM b2 WHERE g = lst || ' ' || b) AND EXISTS (SELECT 1 FROM b2 WHERE g = lst || ' ' || p AND n >= 2)
      AND EXISTS (SELECT 1 FROM b2 WHERE g = p || ' ' || b AND n >= 2) AND EXISTS (SELECT 1 FROM b3 WHERE g = lst || ' ' || p || ' ' || b)),
    runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, s ORDER BY i) AS island FROM hit),
    kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, s, island ORDER BY i) AS r FROM runs)
    SELECT doc_id, char_start, char_end, p || '་' || w AS replacement FROM kept WHERE r % 2 = 1"""


@register("omitted_particles", _omission_sql())
def omitted_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against published n-gram tables: the most frequent n-grams."""
    told = word_groups(spark, sf_dir).select(F.col("w").alias("syllables"))
    lexicon = cut(corpus.ngrams(told, 1).select(grammar.stripped(F.col("ngram"), True).alias("word")).distinct(), "lexicon")
    two, three = (cut(corpus.most_common(corpus.ngrams(told, n), kept), "ngrams") for n, kept in ((2, 2000), (3, 20000)))
    found = grammar.omitted_particles(flat(spark, sf_dir), lexicon, two, three)
    return found.select("doc_id", "char_start", "char_end", "replacement")


@register(
    "node_at_place",
    f"WITH {NODES_SQL} SELECT doc_id, s AS sent_idx, 7 AS place, max(w) FILTER (WHERE a <= 7 AND 7 < a + length(w)) AS node, count(*) FILTER (WHERE a < 20 AND 5 < a + length(w)) AS touched FROM placed GROUP BY 1, 2",
)
def node_at_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point and range look-ups in the nodes of a sentence."""
    named = F.transform("nodes", lambda x: F.struct(x["text"].alias("text"), x["start"].alias("char_start"), x["end"].alias("char_end")))
    rows = sentences(spark, sf_dir).withColumn("spans", named)
    return rows.select(
        "doc_id", F.col("sent_idx").cast("long").alias("sent_idx"), F.lit(7).alias("place"), spans.at_char(F.col("spans"), F.lit(7))["text"].alias("node"), F.size(spans.overlapping(F.col("spans"), F.lit(5), F.lit(20))).cast("long").alias("touched")
    )
