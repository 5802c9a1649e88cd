"""Grammar rules over the nodes of sentences.

A sentence is one row: (doc_id, sent_idx, sent_start, text, nodes), nodes being an
array of (text, start, end, category, relation) in order. ``neighbours`` lays each
node beside those around it without a shuffle; every rule is then a conditional
expression over such a row, and all rules are told in one pass. Rules that ask a
lexicon or a corpus work on distinct words or pairs first and join them back.

All yield findings: (doc_id, source, char_start, char_end, replacement, score,
priority, message, error_type), places being those of the document. Rules are
switched and weighted by a ``Registry``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.script import final_consonant
from loomwork.operators.rules import COLUMNS
from loomwork.shared import cut

# Particle forms by the closing consonant before them.
GENITIVE = {"ག": "གི", "ང": "གི", "ད": "ཀྱི", "བ": "ཀྱི", "ས": "ཀྱི", "ན": "གྱི", "མ": "གྱི", "ར": "གྱི", "ལ": "གྱི", "འ": "འི", "open": "ཡི"}
ERGATIVE = {"ག": "གིས", "ང": "གིས", "ད": "ཀྱིས", "བ": "ཀྱིས", "ས": "ཀྱིས", "ན": "གྱིས", "མ": "གྱིས", "ར": "གྱིས", "ལ": "གྱིས", "འ": "འིས", "open": "ཡིས"}
INTERROGATIVE = {"ག": "གམ", "ང": "ངམ", "ད": "དམ", "ན": "ནམ", "བ": "བམ", "མ": "མམ", "ར": "རམ", "ལ": "ལམ", "ས": "སམ", "open": "འམ"}
FINAL = {"ག": "གོ", "ང": "ངོ", "ད": "དོ", "ན": "ནོ", "བ": "བོ", "མ": "མོ", "ར": "རོ", "ལ": "ལོ", "ས": "སོ", "open": "འོ"}
ALL_GENITIVE = ("གི", "ཀྱི", "གྱི", "ཡི", "འི")
ALL_ERGATIVE = ("གིས", "ཀྱིས", "གྱིས", "ཡིས", "ས")
ALL_INTERROGATIVE = ("གམ", "ངམ", "དམ", "ནམ", "བམ", "མམ", "འམ", "རམ", "ལམ", "སམ", "ཏམ")
ALL_FINAL = ("གོ", "ངོ", "དོ", "ནོ", "བོ", "མོ", "འོ", "རོ", "ལོ", "སོ", "ཏོ")
ALL_PARTICLES = ALL_GENITIVE + ALL_ERGATIVE + ALL_INTERROGATIVE + ALL_FINAL
DATIVE = ("རུ", "སུ", "ཏུ", "དུ", "ན", "ལ", "ར")
#: Verbs after which the genitive's form གི is a sign of aspect.
ASPECT_VERBS = ("འགྲོ", "བྱེད", "ཡོད", "མེད", "ཡིན", "རེད", "སླེབས", "བཞིན")
EXISTENTIAL = {"འདུགས": "འདུག", "ཡོདས": "ཡོད"}
NOWADAYS, TODAY, HAPPENED = "དེང་སང", "དེ་རིང", "བྱུང་"
HONORIFIC = {"སྡོད": "བཞུགས", "ཤོད": "ཞུས", "བྱེད": "མཛད", "ཟོ": "གསོལ", "འགྲོ": "ཕེབས"}
HONORED = ("ཁྱེད་", "ཁོང་", "སྤྱི་ཁྱབ", "སྐུ་ཞོགས")
COPULA = {"རེད": "ཡིན", "འདུག": "ཡོད"}
FIRST_PERSON = ("ང་ཚོ", "ངས")
REPORTED = ("ཅེས", "ཞེས")
NOMINALIZED = {"ཡིན་པ": "ཡིན", "རེད་པ": "རེད"}
MAY_REPEAT = ("ཡང", "ཧ", "ཀྱི", "གི")
OBJECTS = ("obj", "arg2", "dobj", "object")
PRONOUNS = ("ང", "ང་ཚོ", "ངས", "ཁོ", "ཁོང", "མོ", "མོང", "ཚོ", "ཁྱེད", "ཁྱོད", "དེ", "འདི", "ཕྱི", "གང", "གང་ཡིན", "སུ", "སུ་ཡིན")
NUMERALS = ("གཅིག", "གཉིས", "གསུམ", "བཞི", "ལྔ", "དྲུག", "བདུན", "བརྒྱད", "དགུ", "བཅུ", "བཅུ་གཅིག", "ཁྲི", "འབུམ", "སྟོང", "བྱ་", "ཕྲག")
COPULAS = ("ཡིན", "རེད", "ཡོད", "འདུག", "མེད", "སོང", "བྱུང", "བྱེད", "བྱས", "ཤོག", "ཅིང", "ཏེ", "སྟེ", "དེ", "ནི", "ཡང", "ཀྱང")
EXCEPTIONS = (
    "རྡོ་རྗེ", "ཆོས་ལུགས", "སངས་རྒྱས", "ཨོཾ", "པདྨ", "བཀྲ་ཤིས་བདེ་ལེགས", "ལྷ་ས", "ཏཱ་ལའི", "བླ་མ", "རིན་པོ་ཆེ", "འཕགས་པ", "དཔལ", "གཟིགས",
    "བོདི་སཏྡ", "མངོན་པོ", "དཀའ", "དཀའ་བརྩེགས", "བོདྷི་སཏྡ", "རྒྱ་ནག", "རྒྱ་གར",
)
#: A greeting and the word of it that is never questioned.
GREETING, GREETING_WORD = "བཀྲ་ཤིས", "ཤིས"
#: Vowel signs and letters that are taken for one another.
VOWELS = {"ི": "ེོུ", "ེ": "ིོ", "ོ": "ིེུ", "ུ": "ོིེ"}
LETTERS = {"ཤ": "ཞས", "ཞ": "ཤ", "ཏ": "ད", "ད": "ཏ", "ས": "ཤ", "བ": "ང", "ང": "བ"}
#: How often a variant must occur, how much more than the word, and than the next variant.
LEAST, OVER_WORD, OVER_NEXT = 5, 20, 10
PAIRS = 2
#: Demonym in a first-person sentence.
LAND, DEMONYM = "བོད", "བོད་པ་"


@dataclass(frozen=True)
class Rule:
    """A rule's category, score and switch."""

    category: str
    score: float
    enabled: bool = True


class Registry:
    """Rules by id; unknown ids are ignored by ``configure``, as are unknown settings."""

    DEFAULTS = {
        "TIB-PART-001": Rule("particle", 0.98), "TIB-EXIST-001": Rule("verb", 0.95), "TIB-TEMP-001": Rule("adverb", 0.85), "TIB-HONOR-001": Rule("honorific", 0.60),
        "TIB-COP-001": Rule("verb", 0.55), "TIB-SOV-001": Rule("word_order", 0.50), "TIB-NOM-001": Rule("nominalizer", 0.90), "TIB-VOWEL-001": Rule("spelling", 0.85),
        "TIB-PART-OMIT-001": Rule("particle", 0.80), "TIB-CHAR-001": Rule("spelling", 0.85),
    }

    def __init__(self, config: dict | None = None):
        self.rules = dict(self.DEFAULTS)
        self.configure(config or {})

    def configure(self, config: dict) -> None:
        """``{rule: bool}`` or ``{rule: {"enabled": ..., "confidence_baseline": ...}}``, also under the key ``rules``."""
        for rule_id, said in config.get("rules", config).items():
            if rule_id in self.rules and isinstance(said, bool):
                self.rules[rule_id] = replace(self.rules[rule_id], enabled=said)
            elif rule_id in self.rules and isinstance(said, dict):
                old = self.rules[rule_id]
                self.rules[rule_id] = replace(old, enabled=bool(said.get("enabled", old.enabled)), score=float(said.get("confidence_baseline", old.score)))

    def enabled(self, rule_id: str) -> bool:
        return rule_id in self.rules and self.rules[rule_id].enabled

    def score(self, rule_id: str) -> float:
        return self.rules[rule_id].score

    def table(self, spark) -> DataFrame:
        """(rule_id, category, score, enabled)."""
        return spark.createDataFrame([(k, r.category, r.score, r.enabled) for k, r in sorted(self.rules.items())], "rule_id string, category string, score double, enabled boolean")


def stripped(word: Column, visarga: bool = False) -> Column:
    """Without marks, spaces and shads at its ends (and without the sign ཿ for look-ups)."""
    marks = "་ །ཿ" if visarga else "་ །"
    return F.regexp_replace(word, f"^[{marks}]+|[{marks}]+$", "")


def neighbours(sentences: DataFrame) -> DataFrame:
    """A row for each node: its own fields, ``i``, ``n``, ``word``, ``left``, ``right``, ``after``, fields of the nodes beside it, and the sentence's."""
    kind = sentences.schema["nodes"].dataType
    none = F.array(F.lit(None).cast(kind.elementType))
    n = F.size("nodes")
    rest = lambda k: F.concat(F.slice("nodes", k + 1, F.greatest(n, F.lit(0))), *([none] * k))
    words = F.transform("nodes", lambda x: stripped(x["text"]))
    roots = F.filter(F.transform("nodes", lambda x, i: F.struct(i.alias("i"), x["text"].alias("text"), x["relation"].alias("relation"))), lambda r: r["relation"] == "root")
    zipped = F.arrays_zip(F.col("nodes").alias("node"), F.concat(none, "nodes").alias("before"), rest(1).alias("next"), rest(2).alias("third"))
    rows = sentences.withColumns({"names": words, "roots": roots, "__zipped": zipped})  # once for each sentence, below the generator, and only if asked for
    rows = rows.select("doc_id", "sent_idx", "sent_start", "text", "names", "roots", n.alias("n"), F.posexplode_outer("__zipped").alias("i", "z")).where("i < n")
    word = lambda f: stripped(F.col(f"z.{f}.text"))
    return rows.select(
        "doc_id", "sent_idx", "sent_start", "text", "names", "roots", "n", "i", F.col("z.node.text").alias("node_text"), F.col("z.node.start").alias("start"), F.col("z.node.end").alias("end"),
        F.col("z.node.category").alias("category"), F.col("z.node.relation").alias("relation"), word("node").alias("word"), word("before").alias("left"),
        F.col("z.before.category").alias("left_category"), F.col("z.before.relation").alias("left_relation"), F.col("z.next.category").alias("right_category"),
        F.col("z.next.text").alias("right_text"), word("next").alias("right"), word("third").alias("after"), F.col("z.next.start").alias("right_start"), F.col("z.next.end").alias("right_end"), F.col("z.third.end").alias("after_end"),
    )


def _table(entries: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for k, v in entries.items() for x in (k, v)))


def _finding(when: Column, replacement: Column, score: float, priority: str, message: Column) -> Column:
    return F.when(when, F.struct(replacement.cast("string").alias("replacement"), F.lit(float(score)).alias("score"), F.lit(priority).alias("priority"), message.alias("message")))


def particle_rule(score: float) -> Column:
    """The particle's form must follow from the closing consonant before it."""
    closing = final_consonant(F.col("left"))
    word = F.col("word")
    at_end = (F.col("i") == F.col("n") - 1) | F.coalesce(F.col("right_category") == "PUNCTUATION", F.lit(False))
    particle = F.coalesce(F.col("category") == "PARTICLE", F.lit(False))
    closes = (at_end | particle) & ~F.coalesce(F.col("category").isin("NOUN", "ADVERB"), F.lit(False))
    aspect = (word == "གི") & (
        F.coalesce(F.col("left_category") == "VERB", F.lit(False)) | F.coalesce(F.col("left_relation").isin("root", "aux"), F.lit(False)) | F.col("left").isin(*ASPECT_VERBS)
    )
    families = (
        ("Genitive", ALL_GENITIVE, GENITIVE, "གི", ~aspect & ~word.isin("འི", "ཡི")), ("Ergative", ALL_ERGATIVE, ERGATIVE, "གིས", ~word.isin("ས", "ཡིས")),
        ("Interrogative", ALL_INTERROGATIVE, INTERROGATIVE, "འམ", closes), ("Sentence-final", ALL_FINAL, FINAL, "འོ", closes),
    )
    wanted = name = None
    for title, forms, table, default, applies in families:
        form = F.when(applies, F.coalesce(F.try_element_at(_table(table), closing), F.lit(default)))
        wanted = F.when(word.isin(*forms), form) if wanted is None else wanted.when(word.isin(*forms), form)
        name = F.when(word.isin(*forms), title) if name is None else name.when(word.isin(*forms), title)
    message = F.concat(name, F.lit(' particle agreement error: "'), F.col("left"), F.lit('" should take "'), wanted, F.lit('" instead of "'), word, F.lit('"'))
    return _finding(F.col("left").isNotNull() & (F.col("left") != "") & (word != "") & (wanted != word), wanted, score, "HIGH", message)


def existential_rule(score: float) -> Column:
    fix = F.try_element_at(_table(EXISTENTIAL), F.col("word"))
    return _finding(fix.isNotNull(), fix, score, "HIGH", F.concat(F.lit('[TIB-EXIST-001] Invalid existential verb spelling "'), F.col("word"), F.lit('" -> suggest "'), fix, F.lit('"')))


def temporal_rule(score: float) -> Column:
    there = (F.col("word") == NOWADAYS) & (F.col("text").contains(TODAY) | F.col("text").contains(HAPPENED))
    return _finding(there, F.lit(TODAY), score, "MEDIUM", F.lit(f'[TIB-TEMP-001] Temporal adverb context check: "{NOWADAYS}" means "nowadays"; suggest "{TODAY}" for today'))


def honorific_rule(score: float) -> Column:
    honored = F.lit(False)
    for p in HONORED:
        honored = honored | F.col("text").contains(p)
    fix = None
    for plain, polite in HONORIFIC.items():
        fix = F.when(F.col("word").startswith(plain), polite) if fix is None else fix.when(F.col("word").startswith(plain), polite)
    said = F.concat(F.lit('[TIB-HONOR-001] Honorific agreement suggestion: honorific subject present, consider "'), fix, F.lit('" instead of plain verb "'), F.col("word"), F.lit('" (depending on register)'))
    return _finding(honored & fix.isNotNull(), fix, score, "LOW", said)


def copula_rule(score: float) -> Column:
    fix = F.try_element_at(_table(COPULA), F.col("word"))
    first = F.arrays_overlap("names", F.array(*map(F.lit, FIRST_PERSON)))
    said = F.concat(
        F.lit('[TIB-COP-001] Copula agreement check: 1st person subject typically pairs with "'), fix, F.lit('" rather than "'), F.col("word"),
        F.lit('". Depending on dialect and register, this may be acceptable.'),
    )
    return _finding(first & fix.isNotNull(), fix, score, "LOW", said)


def order_rules(score: float) -> Column:
    """Findings, as an array, of an object behind each root before it; none in reported speech."""
    reported = F.lit(False)
    for p in REPORTED:
        reported = reported | F.col("text").contains(p)
    late = ~reported & F.col("relation").isin(*OBJECTS) & (F.char_length(F.regexp_replace("node_text", "^[་ ]+|[་ ]+$", "")) > 1)
    before = F.filter("roots", lambda r: r["i"] < F.col("i"))

    def one(r: Column) -> Column:
        said = F.concat(F.lit('[TIB-SOV-001] SOV Word Order: Object "'), F.col("node_text"), F.lit('" appears after verb "'), r["text"], F.lit('". Consider placing object before verb.'))
        return _finding(F.lit(True), F.concat_ws(" ", F.col("node_text"), r["text"]), score, "LOW", said)

    return F.when(late, F.transform(before, one))


def nominalizer_rule(score: float) -> Column:
    fix = F.try_element_at(_table(NOMINALIZED), F.col("word"))
    said = F.concat(F.lit('[TIB-NOM-001] Redundant nominalizer: sentence-final declarative clause should end with copula "'), fix, F.lit('" instead of nominalized "'), F.col("word"), F.lit('".'))
    return _finding((F.col("i") == F.col("n") - 1) & fix.isNotNull(), fix, score, "HIGH", said)


def repeated_rule(score: float = 0.90) -> Column:
    twice = (F.col("word") == F.col("left")) & (F.col("word") != "") & ~F.col("word").isin(*MAY_REPEAT)
    return _finding(twice, F.lit(None), score, "HIGH", F.concat(F.lit('Duplicate repeated word detected: "'), F.col("word"), F.lit('" is repeated sequentially.')))


def demonym_rule(score: float = 0.90) -> Column:
    """A land's name where a first person says what they are; off unless asked for."""
    said = F.array_contains("names", "ང་ཚོ") | F.array_contains("names", "ང")
    there = said & F.array_contains("names", "ཡིན") & ~F.exists("names", lambda w: w.contains("ཆོས་སྒོར")) & (F.col("word") == LAND)
    return _finding(there, F.lit(DEMONYM), score, "HIGH", F.lit(f'Logical Mismatch: First-person subject "ང་" with "{LAND}་" requires demonym suffix "བོད་པ"'))


RULES = {
    "TIB-PART-001": particle_rule, "TIB-EXIST-001": existential_rule, "TIB-TEMP-001": temporal_rule, "TIB-HONOR-001": honorific_rule,
    "TIB-COP-001": copula_rule, "TIB-NOM-001": nominalizer_rule,
}


def findings(flat: DataFrame, registry: Registry | None = None, source: str = "grammar", demonyms: bool = False) -> DataFrame:
    """Findings of all rules that need no lexicon, from ``neighbours``."""
    registry = registry or Registry()
    told = [rule(registry.score(k)) for k, rule in RULES.items() if registry.enabled(k)] + [repeated_rule()] + ([demonym_rule()] if demonyms else [])
    every = F.filter(F.array(*told), lambda x: x.isNotNull())
    if registry.enabled("TIB-SOV-001"):
        every = F.concat(every, F.coalesce(order_rules(registry.score("TIB-SOV-001")), F.slice(every, 1, 0)))
    rows = flat.withColumn("__found", every).select("doc_id", "sent_start", "start", "end", F.explode_outer("__found").alias("f")).where("f is not null")
    return as_findings(rows.select("doc_id", (F.col("sent_start") + F.col("start")).alias("char_start"), (F.col("sent_start") + F.col("end")).alias("char_end"), "f.*"), source)


def as_findings(df: DataFrame, source: str, error_type: str = "GRAMMAR") -> DataFrame:
    longs = {c: F.col(c).cast("long") for c in ("char_start", "char_end")}
    return df.withColumns(longs | {"source": F.lit(source), "error_type": F.lit(error_type)}).select(*COLUMNS)


# -- rules that ask a lexicon and a corpus -------------------------------------


def frequency(words: DataFrame, counts: DataFrame, column: str = "word") -> DataFrame:
    """Add ``freq``: the count of the word itself, else without its end marks, else (up to four letters) with one."""
    table = counts.groupBy(F.col("ngram").alias("__key")).agg(F.max("n").alias("__n"))
    bare = F.regexp_replace(F.col(column), "[་ །]+$", "")
    keys = {"__one": F.col(column), "__two": bare, "__three": F.when(~F.col(column).endswith("་") & (F.char_length(bare) <= 4), F.concat(bare, F.lit("་")))}
    out = words.withColumns(keys)
    for name in keys:
        out = out.join(table.select(F.col("__key").alias(name), F.col("__n").alias(f"{name}_n")), name, "left")
    hit = [F.when(F.col(f"{k}_n") > 0, F.col(f"{k}_n")) for k in keys]
    return out.withColumn("freq", F.coalesce(*hit, F.lit(0)).cast("long")).drop(*keys, *(f"{k}_n" for k in keys))


def variants(words: DataFrame, table: dict[str, str]) -> DataFrame:
    """(word, variant): one character replaced by another that is taken for it; particles are no variants."""
    others = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    rows = words.select("word", F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("k")).withColumn("o", F.try_element_at(others, F.substring(F.col("word"), F.col("k"), F.lit(1))))
    rows = rows.where("o is not null").select("word", "k", F.explode("o").alias("c"))
    out = rows.select("word", F.expr("concat(substring(word, 1, k - 1), c, substring(word, k + 1))").alias("variant"))
    return out.where(~F.col("variant").isin(*ALL_PARTICLES, *DATIVE)).distinct()


def dominant(words: DataFrame, lexicon: DataFrame, counts: DataFrame, table: dict[str, str]) -> DataFrame:
    """(word, variant, freq): the known variant that is much more frequent than the word and than the next one; of equal ones the last.

    Particles, pronouns, listed names and single letters are never questioned.
    """
    asked = words.select("word").distinct().where((F.char_length("word") > 1) & ~F.col("word").isin(*ALL_PARTICLES, *PRONOUNS, *EXCEPTIONS))
    known = variants(asked, table).join(lexicon.select(F.col("word").alias("variant")).distinct(), "variant", "left_semi")
    order = Window.partitionBy("word").orderBy(F.desc("freq"), F.desc("variant"))
    ranked = frequency(known, counts, "variant").withColumn("next", F.coalesce(F.lead("freq").over(order), F.lit(0))).withColumn("__r", F.row_number().over(order)).where("__r = 1")
    own = frequency(ranked.withColumnRenamed("freq", "best"), counts, "word")
    sure = (F.col("best") >= LEAST) & (F.col("best") >= OVER_WORD * F.greatest(F.col("freq"), F.lit(1))) & (F.col("best") >= OVER_NEXT * F.col("next"))
    return own.where(sure).select("word", "variant", F.col("best").alias("freq"))


def variant_findings(flat: DataFrame, lexicon: DataFrame, counts: DataFrame, registry: Registry | None = None, source: str = "grammar") -> DataFrame:
    """Words written with a wrong vowel sign or a confusable letter.

    Distinct words and their fixes are tables of their own: the nodes are gone through twice,
    and meet the fixes without a shuffle as long as those are few.
    """
    registry = registry or Registry()
    nodes = flat.select("doc_id", "sent_start", "start", "end", "text", "node_text", stripped(F.col("node_text"), True).alias("word")).where(
        (F.col("word") != "") & ~(F.col("text").contains(GREETING) & (F.col("word") == GREETING_WORD))
    )
    asked = cut(nodes.select("word").distinct(), "asked")
    out = None
    for rule, table, said in (("TIB-VOWEL-001", VOWELS, ("Vowel mutation", "may be a mutated spelling of")), ("TIB-CHAR-001", LETTERS, ("Character confusion", "may be a misspelling of"))):
        if not registry.enabled(rule):
            continue
        fixes = cut(dominant(asked, lexicon, counts, table).select("word", "variant"), "fixes")
        hit = nodes.join(fixes, "word")
        tail = F.expr("substring(node_text, char_length(word) + 1)")
        message = F.concat(F.lit(f'[{rule}] {said[0]}: "'), "word", F.lit(f'" {said[1]} "'), "variant", F.lit('"'))
        one = hit.select(
            "doc_id", (F.col("sent_start") + F.col("start")).alias("char_start"), (F.col("sent_start") + F.col("end")).alias("char_end"), F.concat("variant", tail).alias("replacement"),
            F.lit(registry.score(rule)).alias("score"), F.lit("HIGH").alias("priority"), message.alias("message"),
        )
        out = one if out is None else out.unionByName(one)
    return as_findings(out, source)


def clean_ngrams(counts: DataFrame) -> DataFrame:
    """(key, n): n-grams with the marks taken off their words; of several spellings the one with marks on the fewest last words counts."""
    parts = F.split("ngram", " ")
    bare = F.transform(parts, lambda w: F.regexp_replace(w, "[་ །]+$", ""))
    marked = F.aggregate(F.transform(parts, lambda w, k: F.when(w.endswith("་"), F.pow(F.lit(2), k).cast("int")).otherwise(F.lit(0))), F.lit(0), lambda a, b: a + b)
    return counts.where("n > 0").select(F.array_join(bare, " ").alias("key"), marked.alias("mask"), "n").groupBy("key").agg(F.min_by("n", "mask").alias("n"))


def omitted_particles(flat: DataFrame, lexicon: DataFrame, bigrams: DataFrame, trigrams: DataFrame, registry: Registry | None = None, source: str = "grammar") -> DataFrame:
    """A genitive that is missing between two known words.

    The bare pair must be unattested, both pairs with the particle attested at least
    twice and the three together once. Distinct pairs are judged once and joined back.
    Of neighbouring places every other one is left out, from the first on.
    """
    registry = registry or Registry()
    if not registry.enabled("TIB-PART-OMIT-001"):
        return as_findings(flat.limit(0).select("doc_id", F.lit(0).alias("char_start"), F.lit(0).alias("char_end"), F.lit("").alias("replacement"), F.lit(0.0).alias("score"), F.lit("").alias("priority"), F.lit("").alias("message")), source)
    silent = lambda c: F.coalesce(F.col(c).isin("ADVERB", "PARTICLE"), F.lit(False))
    a, b = F.col("a"), F.col("b")
    last = F.element_at(F.filter(F.split(a, "་"), lambda s: s != ""), -1)
    rows = flat.select(
        "doc_id", "sent_idx", "sent_start", "i", "start", "end", "node_text", "category", "left_category",
        F.regexp_replace("left", "^[ཿ་ །]+|[ཿ་ །]+$", "").alias("a"), stripped(F.col("node_text"), True).alias("b"),
    ).where(F.col("i") > 0)
    open_pair = (a != "") & (b != "") & ~a.isin(*ALL_PARTICLES, *NUMERALS) & ~b.isin(*ALL_PARTICLES, *PRONOUNS, *NUMERALS, *COPULAS) & ~b.endswith("འོ") & ~b.endswith("འི")
    rows = rows.where(open_pair & F.concat("a", "b").rlike("[ཀ-ྼ]") & ~silent("category") & ~silent("left_category"))
    rows = rows.withColumn("last", last).withColumn("particle", F.try_element_at(_table(GENITIVE), final_consonant(F.col("last")))).where(F.col("particle").isin("གི", "ཀྱི", "གྱི"))
    known = lexicon.select(F.col("word").alias("__w")).distinct()
    pairs = cut(rows.select("a", "b", "last", "particle").distinct(), "pairs")
    pairs = pairs.join(known, a == F.col("__w"), "left_semi").join(known, b == F.col("__w"), "left_semi")
    two, three = clean_ngrams(bigrams), clean_ngrams(trigrams).select("key")
    often = two.where(F.col("n") >= PAIRS).select("key")
    pairs = pairs.join(two.select("key"), F.concat_ws(" ", "last", "b") == F.col("key"), "left_anti")
    for key, table in ((F.concat_ws(" ", "last", "particle"), often), (F.concat_ws(" ", "particle", "b"), often), (F.concat_ws(" ", "last", "particle", "b"), three)):
        pairs = pairs.join(table, key == F.col("key"), "left_semi")
    hit = rows.join(cut(pairs.select("a", "b"), "missing"), ["a", "b"])
    order = Window.partitionBy("doc_id", "sent_idx").orderBy("i")
    island = hit.withColumn("__island", F.col("i") - F.row_number().over(order))  # a run of neighbouring places
    kept = island.withColumn("__k", F.row_number().over(Window.partitionBy("doc_id", "sent_idx", "__island").orderBy("i"))).where("__k % 2 = 1")
    message = F.concat(F.lit('[TIB-PART-OMIT-001] Missing genitive particle: expected "'), "particle", F.lit('" between "'), "a", F.lit('" and "'), "b", F.lit('"'))
    out = kept.select(
        "doc_id", (F.col("sent_start") + F.col("start")).alias("char_start"), (F.col("sent_start") + F.col("end")).alias("char_end"), F.concat("particle", F.lit("་"), "node_text").alias("replacement"),
        F.lit(registry.score("TIB-PART-OMIT-001")).alias("score"), F.lit("HIGH").alias("priority"), message.alias("message"),
    )
    return as_findings(out, source)
