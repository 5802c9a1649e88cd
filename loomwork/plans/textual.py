"""Queries over text functions: normal forms, syllables, sentences, offsets, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import script as sc
from loomwork.functions import spans
from loomwork.operators import correction
from loomwork.plans.catalog import register
from loomwork.plans.common import SCRIPT_SQL, SQUEEZED_SQL, WHITE_SQL, documents, script_documents, table

DOCS = f"docs AS (SELECT doc_id, {SCRIPT_SQL} AS text FROM documents WHERE text IS NOT NULL AND text <> '')"
SYLLABLE_SQL = rf"regexp_extract_all(text, '[^{sc.TSHEGS}{sc.SHADS}{WHITE_SQL}]+')"
BREAKS_SQL = r"\n\r\x0b\f\x{85}\x{2028}\x{2029}"
SENTENCE_SQL = (
    rf"list_filter(list_transform(regexp_extract_all(text, '[^{sc.SHADS}{BREAKS_SQL}]+[{sc.SHADS}]*'), lambda s: regexp_replace(s, '^[{WHITE_SQL}]+|[{WHITE_SQL}]+$', '', 'g')), "
    rf"lambda s: NOT regexp_matches(s, '^[{sc.SHADS}{WHITE_SQL}]*$'))"
)


@register("text_squeeze", f"SELECT doc_id, length(s) AS n, md5(s) AS digest FROM (SELECT doc_id, {SQUEEZED_SQL} AS s FROM documents WHERE text IS NOT NULL AND text <> '')")
def text_squeeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = documents(spark, sf_dir).select("doc_id", sc.squeeze_space(F.col("text")).alias("s"))
    return s.select("doc_id", F.char_length("s").cast("long").alias("n"), F.md5("s").alias("digest"))


@register(
    "text_normalize",
    rf"""WITH c AS (SELECT doc_id, nfc_normalize(regexp_replace(text || chr(1) || chr(8203) || 'x', '[\x00-\x08\x0e-\x1f\x7f-\x{{84}}\x{{86}}-\x{{9f}}\x{{ad}}\x{{600}}-\x{{605}}\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2060}}-\x{{2064}}\x{{feff}}]', '', 'g')) AS text
    FROM documents WHERE text IS NOT NULL AND text <> '') SELECT doc_id, md5({SQUEEZED_SQL}) AS digest FROM c""",
)
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    soiled = documents(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\x01​x")))
    return soiled.select("doc_id", F.md5(sc.normalize(F.col("text"))).alias("digest"))


TIDY_SQL = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[{sc.TSHEGS}]+', '{sc.TSHEG}', 'g'), '[།༎༏༑]+', '{sc.SHAD}', 'g'), ' ([{sc.TSHEG}{sc.SHAD}])', '\1', 'g'), '([{sc.TSHEG}{sc.SHAD}]) ', '\1', 'g')"


@register("script_tidy", f"WITH {DOCS} SELECT doc_id, md5({TIDY_SQL}) AS digest, {TIDY_SQL} <> text AS changed FROM docs")
def script_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = script_documents(spark, sf_dir).withColumn("tidy", sc.tidy(F.col("text")))
    return t.select("doc_id", F.md5("tidy").alias("digest"), (F.col("tidy") != F.col("text")).alias("changed"))


@register("script_ratio", f"WITH {DOCS} SELECT doc_id, round(length(regexp_replace(text, '[^ༀ-࿿]', '', 'g')) / length(text), 9) AS ratio FROM docs")
def script_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return script_documents(spark, sf_dir).select("doc_id", F.round(sc.script_ratio(F.col("text")), 9).alias("ratio"))


@register("syllables", f"WITH {DOCS}, s AS (SELECT doc_id, {SYLLABLE_SQL} AS s FROM docs) SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM s")
def syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = script_documents(spark, sf_dir).select("doc_id", sc.syllables(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@register(
    "sentences",
    f"WITH {DOCS}, s AS (SELECT doc_id, {SENTENCE_SQL} AS s FROM docs), e AS (SELECT doc_id, unnest(s) AS sentence, unnest(range(0, len(s))) AS idx FROM s) "
    f"SELECT doc_id, idx, md5(sentence) AS digest, regexp_matches(sentence, '[{sc.SHADS}]$') AS terminated FROM e",
)
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = script_documents(spark, sf_dir).select("doc_id", F.posexplode(sc.sentences(F.col("text"))).alias("idx", "sentence"))
    return s.select("doc_id", F.col("idx").cast("long").alias("idx"), F.md5("sentence").alias("digest"), F.col("sentence").rlike(f"[{sc.SHADS}]$").alias("terminated"))


@register(
    "byte_offsets",
    f"WITH {DOCS} SELECT doc_id, list_transform([0, 1, 10, 100], lambda i: strlen(substr(text, 1, i::INT)))::INT[] AS offsets, strlen(text)::BIGINT AS n_bytes FROM docs",
)
def byte_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.array(*(sc.byte_offset(F.col("text"), F.lit(i)) for i in (0, 1, 10, 100)))
    return script_documents(spark, sf_dir).select("doc_id", at.alias("offsets"), F.octet_length("text").cast("long").alias("n_bytes"))


@register(
    "context_windows",
    "SELECT doc_id, substr(text, greatest(0, p - 1 - 20) + 1, least(length(text), p + 2 + 20) - greatest(0, p - 1 - 20)) AS around FROM (SELECT doc_id, text, strpos(text, 'the') AS p FROM documents) WHERE p > 0",
)
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(spark, sf_dir).withColumn("p", F.locate("the", "text")).where("p > 0")
    return found.select("doc_id", sc.context(F.col("text"), F.col("p") - 1, F.col("p") + 2).alias("around"))


@register(
    "occurrences_before",
    "SELECT doc_id, len(list_filter(range(1, least(50, length(text)) + 1), lambda j: substr(text, j::INT, 2) = 'th')) AS n FROM documents WHERE text IS NOT NULL AND text <> ''",
)
def occurrences_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", sc.occurrences_before(F.col("text"), "th", F.lit(50)).cast("long").alias("n"))


WORDS = f"words AS (SELECT DISTINCT unnest({SYLLABLE_SQL}) AS word FROM docs)"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct syllables of the transliterated documents."""
    return script_documents(spark, sf_dir).select(F.explode(sc.syllables(F.col("text"))).alias("word")).distinct()


@register(
    "canonical_swap",
    f"""WITH {DOCS}, {WORDS} SELECT word, CASE WHEN length(word) >= 3 AND regexp_matches(right(word, 1), '[ིེོུ]') AND NOT regexp_matches(substr(word, length(word) - 1, 1), '[ིེོུ]')
    THEN substr(word, 1, length(word) - 2) || right(word, 1) || substr(word, length(word) - 1, 1) ELSE word END AS canonical FROM words""",
)
def canonical_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("word", sc.vowel_before_consonant(F.col("word")).alias("canonical"))


FINAL_SQL = f"""CASE WHEN regexp_matches(word, 'འ$') THEN 'འ'
  WHEN length(regexp_replace(word, '[^ཀ-ཪ]', '', 'g')) <= 1 OR regexp_matches(word, '[ཱ-྇ྐ-ྼ]$') THEN 'open'
  WHEN regexp_matches(right(regexp_replace(word, '[^ཀ-ཪ]', '', 'g'), 1), '[{sc.FINALS}]') THEN right(regexp_replace(word, '[^ཀ-ཪ]', '', 'g'), 1) ELSE 'open' END"""


@register("final_consonants", f"WITH {DOCS}, {WORDS} SELECT word, {FINAL_SQL} AS final FROM words")
def final_consonants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("word", sc.final_consonant(F.col("word")).alias("final"))


@register(
    "shad_sentences",
    rf"WITH {DOCS}, s AS (SELECT doc_id, list_filter(list_transform(string_split(text, '།'), lambda x: regexp_replace(x, '^[{WHITE_SQL}]+|[{WHITE_SQL}]+$', '', 'g')), lambda x: length(x) > 5) AS s FROM docs) "
    "SELECT doc_id, len(s) AS n, md5(array_to_string(list_transform(s, lambda x: x || '།'), '|')) AS digest FROM s",
)
def shad_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = script_documents(spark, sf_dir).select("doc_id", sc.shad_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


SPANS_SQL = rf"""sp AS (SELECT doc_id, text, regexp_extract_all(text, '[^{sc.TSHEGS}{sc.SHADS}{WHITE_SQL}]+') AS ms, string_split_regex(text, '[^{sc.TSHEGS}{sc.SHADS}{WHITE_SQL}]+') AS bs FROM docs),
u AS (SELECT doc_id, text, unnest(ms) AS m, unnest(bs[1:len(ms)]) AS b, unnest(bs[2:len(ms) + 1]) AS nx, unnest(range(0, len(ms))) AS k FROM sp),
s AS (SELECT *, (sum(length(b) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) - length(m))::BIGINT AS a, (sum(strlen(b) + strlen(m)) OVER (PARTITION BY doc_id ORDER BY k) - strlen(m))::BIGINT AS ba FROM u)"""


@register(
    "syllable_spans",
    f"WITH {DOCS}, {SPANS_SQL} SELECT doc_id, k AS pos, a AS char_start, a + length(m) AS char_end, ba AS byte_start, ba + strlen(m) AS byte_end, regexp_matches(nx, '^[{sc.TSHEGS}]') AS has_tsheg, m || '་' AS written FROM s",
)
def syllable_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = script_documents(spark, sf_dir).select("doc_id", F.posexplode(spans.syllables_column(F.col("text"))).alias("pos", "s"))
    at = [F.col(f"s.{c}").cast("long").alias(c) for c in ("char_start", "char_end", "byte_start", "byte_end")]
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), *at, F.col("s.has_tsheg"), spans.with_tsheg(F.col("s.text")).alias("written"))


def _sentence_spans_sql(breaks: str) -> str:
    pattern = rf"[^{sc.SHADS}{breaks}]+[{sc.SHADS}]*"
    return rf"""sp AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS bs FROM docs),
    u AS (SELECT doc_id, unnest(ms) AS m, unnest(bs[1:len(ms)]) AS b, unnest(range(0, len(ms))) AS k FROM sp),
    v AS (SELECT *, (sum(length(b) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) - length(m))::BIGINT AS a, regexp_extract(m, '[{sc.SHADS}]*$') AS terminator FROM u),
    w AS (SELECT *, length(m) - length(regexp_replace(m, '^[{WHITE_SQL}]+', '')) AS lead_, regexp_replace(m[:length(m) - length(terminator)], '[{WHITE_SQL}]+$', '') AS body FROM v),
    x AS (SELECT doc_id, k, a + lead_ AS char_start, CASE WHEN terminator <> '' THEN a + length(m) ELSE a + length(body) END AS char_end, terminator, trim(regexp_replace(body, '^[{WHITE_SQL}]+', '')) AS content FROM w WHERE regexp_replace(body, '[{WHITE_SQL}]+', '', 'g') <> '')"""


def _sentence_rows(spark: SparkSession, sf_dir: str, breaks: bool) -> DataFrame:
    rows = script_documents(spark, sf_dir).select("doc_id", F.posexplode(spans.sentences_column(F.col("text"), breaks)).alias("idx", "s"))
    inside = spans.content(F.col("s.text"), F.col("s.terminator"))
    return rows.select(
        "doc_id", F.col("idx").cast("long").alias("idx"), F.col("s.char_start").cast("long").alias("char_start"), F.col("s.char_end").cast("long").alias("char_end"), (F.col("s.terminator") != "").alias("terminated"),
        F.md5(inside).alias("content"), spans.is_script(F.col("s.text")).alias("in_script"),
    )


SENTENCE_COLUMNS = f"""doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS idx, char_start, char_end, terminator <> '' AS terminated, md5(content) AS content"""


@register("sentence_spans", f"WITH {DOCS}, {_sentence_spans_sql(BREAKS_SQL)} SELECT {SENTENCE_COLUMNS} FROM x")
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentence_rows(spark, sf_dir, True).drop("in_script")


@register("sentence_spans_over_lines", f"WITH {DOCS}, {_sentence_spans_sql('')} SELECT {SENTENCE_COLUMNS} FROM x")
def sentence_spans_over_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line breaks are white space like other."""
    return _sentence_rows(spark, sf_dir, False).drop("in_script")


@register(
    "sentence_at_place",
    f"""WITH {DOCS}, {_sentence_spans_sql(BREAKS_SQL)}, y AS (SELECT {SENTENCE_COLUMNS} FROM x)
    SELECT d.doc_id, min(idx) FILTER (WHERE char_start <= 100 AND 100 < char_end) AS at_100, count(idx) FILTER (WHERE char_start < 200 AND 50 < char_end) AS touched, count(idx) FILTER (WHERE char_start <= 70 AND 70 < char_end) AS held FROM docs d LEFT JOIN y USING (doc_id) GROUP BY 1""",
)
def sentence_at_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence that holds a place, those that a range touches, and an empty one."""
    found = F.transform(spans.sentences_column(F.col("text")), lambda s, i: F.struct(i.cast("long").alias("idx"), s["char_start"].alias("char_start"), s["char_end"].alias("char_end")))
    rows = script_documents(spark, sf_dir).select("doc_id", found.alias("s"))
    n = lambda a, b: F.size(spans.overlapping(F.col("s"), F.lit(a), F.lit(b))).cast("long")
    return rows.select("doc_id", spans.at_char(F.col("s"), F.lit(100))["idx"].alias("at_100"), n(50, 200).alias("touched"), n(70, 70).alias("held"))


@register("ranker_syllables", f"WITH {DOCS} SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[་།འཡ \\t\\n]'), lambda x: trim(x)), lambda x: x <> '') AS s FROM docs)")
def ranker_syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = script_documents(spark, sf_dir).select("doc_id", spans.ranker_syllables(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


LETTER_SQL = "[ཀ-ཬཱ-྅ྐ-ྼ]"


@register("letter_counts", f"WITH {DOCS}, {WORDS} SELECT word, length(regexp_replace(word, '[^ཀ-ཬཱ-྅ྐ-ྼ]', '', 'g')) AS letters, regexp_matches(word, '{LETTER_SQL}') AS is_word, regexp_matches(word, '^[ཀ-ཬཱ-྅ྐ-ྼ་༌།༎༏]+$') AS only_script FROM words")
def letter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = words(spark, sf_dir)
    return rows.select("word", sc.letter_count(F.col("word")).alias("letters"), sc.has_letter(F.col("word")).alias("is_word"), sc.only_script(F.col("word")).alias("only_script"))


GRAPHEME_SQL = "regexp_extract_all(word, '.[ཱ-ཾྀ-྄྆-྇ྐ-ྼ༹༵༷]*')"


@register("grapheme_counts", f"WITH {DOCS}, {WORDS} SELECT original AS word, len({GRAPHEME_SQL}) AS n, array_to_string({GRAPHEME_SQL}, '|') AS parts FROM (SELECT word AS original, nfc_normalize(word) AS word FROM words) WHERE regexp_matches(original, '^[ཀ-ཬ]')")
def grapheme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters with their marks, of words that begin with a letter."""
    rows = words(spark, sf_dir).where(F.col("word").rlike("^[ཀ-ཬ]")).withColumn("g", correction.graphemes_column("word"))
    return rows.select("word", F.size("g").cast("long").alias("n"), F.array_join("g", "|").alias("parts"))


@register("tidy_changes", f"WITH {DOCS}, n AS (SELECT doc_id, text AS original, nfc_normalize(text) AS text FROM docs) SELECT doc_id, {TIDY_SQL} <> original AS changed, CASE WHEN {TIDY_SQL} <> original THEN 1 ELSE 0 END AS n_changes FROM n")
def tidy_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of a normalisation: whether and how the text changed."""
    rows = script_documents(spark, sf_dir).select("doc_id", sc.tidied(F.col("text")).alias("r"))
    return rows.select("doc_id", F.col("r.changed"), F.size("r.changes").alias("n_changes"))
