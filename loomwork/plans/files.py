"""Queries over readers and writers: tables are written as the engine's file formats into the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import corpus, lexicon, metrics, plugins
from loomwork.plans.catalog import register
from loomwork.plans.common import documents, table
from loomwork.shared import new_path
from loomwork.sources import sinks, tables

WORDS_SQL = "w AS (SELECT doc_id, unnest(list_slice(regexp_extract_all(lower(text), '[a-z]+'), 1, 20)) AS word, unnest(range(0, least(20, len(regexp_extract_all(lower(text), '[a-z]+'))))) AS pos FROM documents WHERE text <> '')"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, word): the first twenty words of each document."""
    listed = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), 1, 20)
    return documents(spark, sf_dir).select("doc_id", F.posexplode(listed).alias("pos", "word"))


def _json(spark: SparkSession, name: str, row: DataFrame) -> str:
    """One row as one JSON file."""
    path = new_path(spark, name)
    sinks.write_value(row.select(F.to_json(F.struct(*row.columns)).alias("value")), path)
    return path


@register("corpus_rows", "SELECT doc_id::VARCHAR AS id, nullif(source, '') AS collection, length(text) AS n FROM documents WHERE text IS NOT NULL AND text <> ''")
def corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "corpus")
    table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("collection"), "text").write.parquet(f"{path}/below/it")
    return tables.read_corpus(spark, path, id_col="doc_id").select("id", "collection", F.char_length("text").cast("long").alias("n"))


@register("document_source", "SELECT doc_id::VARCHAR AS id, CASE WHEN source <> '' THEN source END AS collection FROM documents WHERE text IS NOT NULL AND text <> ''")
def document_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with text; an empty collection is none."""
    rows = tables.read_corpus(spark, f"{sf_dir}/documents.parquet", id_col="doc_id")
    return rows.select("id", F.nullif(F.col("source"), F.lit("")).alias("collection"))


@register("corpus_first", "SELECT doc_id::VARCHAR AS id FROM documents WHERE text <> '' ORDER BY doc_id LIMIT 25")
def corpus_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus with a limit of rows: the feature."""
    return tables.read_corpus(spark, f"{sf_dir}/documents.parquet", id_col="doc_id", limit=25).select("id")


@register("corpus_total", "SELECT count(*) AS n FROM documents")
def corpus_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(tables.total_count(spark, f"{sf_dir}/documents.parquet"),)], "n long")


@register("text_file", "SELECT string_agg(item_id || ' ' || regexp_replace(text, '\\s+', ' ', 'g') || chr(10), '' ORDER BY item_id) AS text FROM benchmark WHERE text <> ''")
def text_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of lines, read as one value."""
    path = new_path(spark, "text")
    rows = table(spark, sf_dir, "benchmark").where("text <> ''").orderBy("item_id").select(F.concat(F.col("item_id").cast("string"), F.lit(" "), F.regexp_replace("text", "\\s+", " ")).alias("value"))
    sinks.write_value(rows, path)
    return tables.read_text(spark, path).select("text")


TAG = "CASE WHEN length(word) % 3 = 0 THEN 'n.count' WHEN length(word) % 3 = 1 THEN 'v.past' ELSE 'case.gen' END"


@register(
    "tag_model_file",
    f"""WITH {WORDS_SQL}, t AS (SELECT *, {TAG} AS tag, lag({TAG}) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM w)
    SELECT 'emission' AS part, word AS a, tag AS b, count(*) AS n FROM t GROUP BY 2, 3 UNION ALL SELECT 'transition', coalesce(prev, '<s>'), tag, count(*) FROM t GROUP BY 2, 3 UNION ALL SELECT 'count', tag, NULL, count(*) FROM t GROUP BY 2""",
)
def tag_model_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.operators.tagging import train

    n = F.char_length("surface") % 3
    tag = F.when(n == 0, "n.count").when(n == 1, "v.past").otherwise("case.gen")
    model = train(_words(spark, sf_dir).withColumnRenamed("word", "surface").withColumn("tag", tag), ["doc_id"])

    def nested(df: DataFrame, key: str, name: str) -> DataFrame:
        inner = df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("tag", "n"))).alias("m"))
        return sinks.as_map(inner, key, "m").withColumnRenamed("m", name)

    row = nested(model["emissions"], "surface", "emissions").join(nested(model["transitions"], "prev", "transitions")).join(sinks.as_map(model["tag_counts"], "tag", "n").withColumnRenamed("m", "tag_counts"))
    read = tables.read_tag_model(spark, _json(spark, "model", row.withColumn("tags", F.map_keys("tag_counts"))))
    three = lambda part, df, a, b: df.select(F.lit(part).alias("part"), F.col(a).alias("a"), (F.col(b) if b else F.lit(None).cast("string")).alias("b"), "n")
    return three("emission", read["emissions"], "surface", "tag").unionByName(three("transition", read["transitions"], "prev", "tag")).unionByName(three("count", read["tag_counts"], "tag", None))


ENTRIES_SQL = f"{WORDS_SQL}, e AS (SELECT doc_id, list(word ORDER BY pos) AS s FROM w WHERE pos < 1 + doc_id % 3 GROUP BY 1)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _words(spark, sf_dir).where("pos < 1 + doc_id % 3").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("s"))
    return rows.select("doc_id", F.col("s.word").alias("syllables"))


def _entries_file(spark: SparkSession, sf_dir: str) -> str:
    """Distinct entries are found before they become one row: ``array_distinct`` compares every array with every other."""
    rows = _entries(spark, sf_dir).select((F.col("doc_id") % 2).alias("odd"), "syllables").distinct()
    listed = lambda odd: F.sort_array(F.collect_list(F.when(F.col("odd") == odd, F.col("syllables"))))
    return _json(spark, "entries", rows.agg(listed(0).alias("entries"), listed(1).alias("ambiguous_entries")))


@register("gazetteer_file", f"WITH {ENTRIES_SQL} SELECT DISTINCT array_to_string(s, ' ') AS entry, CASE doc_id % 2 WHEN 0 THEN 'plain' ELSE 'ambiguous' END AS tier FROM e")
def gazetteer_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_entries(spark, _entries_file(spark, sf_dir)).select(F.array_join("syllables", " ").alias("entry"), "tier")


@register("longest_entry", f"WITH {ENTRIES_SQL} SELECT max(len(s)) AS longest FROM e")
def longest_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = tables.read_entries(spark, _entries_file(spark, sf_dir))
    return tables.longest(read.where("tier = 'plain'"), read.where("tier = 'ambiguous'"))


@register(
    "terminology_file",
    f"""WITH {ENTRIES_SQL}, u AS (SELECT DISTINCT array_to_string(s, ' ') AS term FROM e WHERE doc_id % 5 = 0 AND doc_id % 3 <> 0)
    SELECT term, 'user_dictionary' AS source FROM u UNION ALL SELECT DISTINCT array_to_string(s, ' '), 'glossary' FROM e WHERE len(s) >= 2 AND array_to_string(s, ' ') NOT IN (SELECT term FROM u)""",
)
def terminology_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glossary and a user's terms, which go before it; all are added, some taken back, and those of other documents added again."""
    own = _entries(spark, sf_dir).where("doc_id % 5 = 0")
    gone, stay = own.where("doc_id % 3 = 0").select("syllables"), own.where("doc_id % 3 <> 0").select("syllables")
    kept = sinks.user_terms(sinks.user_terms(own, removed=gone), stay)
    return tables.read_terms(spark, _entries_file(spark, sf_dir), kept).select(F.array_join("syllables", " ").alias("term"), "source")


FRAMES_SQL = f"""{WORDS_SQL}, f AS (SELECT word, min(doc_id) AS d, row_number() OVER (ORDER BY word) - 1 AS k FROM w WHERE pos = 0 GROUP BY 1),
frames AS (SELECT k, word AS lemma, CASE WHEN k % 3 = 0 THEN ['ergative', 'absolutive'] WHEN k % 3 = 1 THEN ['absolutive'] ELSE [] END AS slots, CASE k % 4 WHEN 0 THEN 'transitive' WHEN 1 THEN 'intransitive' ELSE 'unknown' END AS tr FROM f),
surfaces AS (SELECT lemma, k AS frame FROM frames UNION ALL SELECT lemma, (k * 7 + 1) % (SELECT count(*) FROM frames) FROM frames WHERE k % 2 = 0)"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _words(spark, sf_dir).where("pos = 0").select("word").distinct()
    numbered = first.agg(F.sort_array(F.collect_list("word")).alias("w")).select("w", F.size("w").alias("n"))
    slots = lambda k: F.when(k % 3 == 0, F.array(F.lit("ergative"), F.lit("absolutive"))).when(k % 3 == 1, F.array(F.lit("absolutive"))).otherwise(F.array().cast("array<string>"))
    kind = lambda k: F.when(k % 4 == 0, "transitive").when(k % 4 == 1, "intransitive").otherwise("unknown")
    lemma = lambda w, k: F.struct(w.alias("lemma"), F.lit("Erg-Abs").alias("frame"), slots(k).alias("slots"), kind(k).alias("transitivity"), F.lit("unknown").alias("volition"))
    surface = lambda w, k: F.struct(F.array(w).alias("syllables"), F.when(k % 2 == 0, F.array(k, ((k * 7 + 1) % F.col("n")))).otherwise(F.array(k)).alias("frames"))
    path = _json(spark, "frames", numbered.select(F.transform("w", lemma).alias("lemmas"), F.transform("w", surface).alias("surfaces")))
    return tables.read_verb_frames(spark, path)


@register("verb_frames_file", f"WITH {FRAMES_SQL} SELECT s.lemma AS surface, f.lemma, array_to_string(slots, '+') AS slots, tr AS transitivity, CASE WHEN len(slots) > 0 THEN list_contains(slots, 'ergative') WHEN tr = 'transitive' THEN true WHEN tr = 'intransitive' THEN false END AS is_transitive FROM surfaces s JOIN frames f ON f.k = s.frame")
def verb_frames_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frames(spark, sf_dir)
    return rows.select(F.array_join("syllables", " ").alias("surface"), "lemma", F.array_join("slots", "+").alias("slots"), "transitivity", lexicon.is_transitive(F.col("slots"), F.col("transitivity")).alias("is_transitive"))


@register(
    "verb_agreement",
    f"""WITH {FRAMES_SQL}, j AS (SELECT s.lemma AS surface, f.lemma, CASE WHEN len(slots) > 0 THEN list_contains(slots, 'ergative') WHEN tr = 'transitive' THEN true WHEN tr = 'intransitive' THEN false END AS t FROM surfaces s JOIN frames f ON f.k = s.frame)
    SELECT surface, CASE WHEN count(DISTINCT lemma) = 1 THEN min(lemma) END AS lemma, CASE WHEN count(DISTINCT t) = 1 AND count(t) = count(*) THEN bool_and(t) END AS is_transitive, count(*) > 1 AS is_ambiguous FROM j GROUP BY 1""",
)
def verb_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all frames of a verb agree on."""
    return lexicon.agreed(_frames(spark, sf_dir).withColumn("surface", F.array_join("syllables", " ")), "surface")


PAIR_SQL = f"{WORDS_SQL}, p AS (SELECT a.word AS w1, b.word AS w2, count(*) AS n FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.pos < 3 GROUP BY 1, 2)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _words(spark, sf_dir)
    one, two = rows.where("pos < 3").select("doc_id", F.col("pos").alias("p"), F.col("word").alias("w1")), rows.select("doc_id", (F.col("pos") - 1).alias("p"), F.col("word").alias("w2"))
    return one.join(two, ["doc_id", "p"]).groupBy("w1", "w2").agg(F.count("*").alias("n"))


@register("collocation_file", f"WITH {PAIR_SQL} SELECT w1, w2, (n % 9) / 2.0 AS mi, CASE WHEN n % 2 = 0 THEN n / 4.0 ELSE 0 END AS t, n::INT AS freq FROM p UNION ALL SELECT 'ང་', 'བདག', 4.12, 6.25, 8200")
def collocation_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs read from a file; the built-in ones that it lacks stay."""
    entry = F.struct(((F.col("n") % 9) / 2.0).alias("mi"), F.when(F.col("n") % 2 == 0, F.col("n") / 4.0).alias("t"), F.col("n").cast("int").alias("freq"))
    row = sinks.as_map(_pairs(spark, sf_dir).select(F.concat_ws(":", "w1", "w2").alias("k"), entry.alias("v")), "k", "v").withColumnRenamed("m", "collocations")
    every = lexicon.collocations(spark, tables.read_collocations(spark, _json(spark, "collocations", row)))
    return every.where("w1 rlike '^[a-z]' or (w1 = 'ང་' and w2 = 'བདག')")


@register(
    "collocation_strength",
    f"""WITH {PAIR_SQL}, t AS (SELECT w1 || CASE WHEN n % 3 = 0 THEN '་' ELSE '' END AS a, w2 AS b, CASE WHEN n % 2 = 0 THEN n / 4.0 END AS t, (n % 9) / 2.0 AS mi FROM p WHERE n >= 2),
    k AS (SELECT a || ':' || b AS k, coalesce(t, mi) AS v FROM t)
    SELECT w1, w2, coalesce(k1.v, k2.v, 0) AS strength FROM p LEFT JOIN k k1 ON k1.k = w1 || ':' || w2 LEFT JOIN k k2 ON k2.k = w1 || '་:' || w2""",
)
def collocation_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    held = pairs.where("n >= 2").select(F.when(F.col("n") % 3 == 0, F.concat("w1", F.lit("་"))).otherwise(F.col("w1")).alias("w1"), "w2", F.when(F.col("n") % 2 == 0, F.col("n") / 4.0).alias("t"), ((F.col("n") % 9) / 2.0).alias("mi"))
    return lexicon.collocation_strength(pairs.select("w1", "w2"), held).select("w1", "w2", "strength")


@register("confusion_file", f"WITH {PAIR_SQL}, r AS (SELECT w1, w2, row_number() OVER (PARTITION BY w1 ORDER BY n DESC, w2) - 1 AS rank FROM p) SELECT w1 AS wrong, rank, w2 AS \"right\" FROM r")
def confusion_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _pairs(spark, sf_dir).groupBy("w1").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "w2"))).alias("s")).select("w1", F.col("s.w2").alias("r"))
    return tables.read_confusions(spark, _json(spark, "confusions", sinks.as_map(listed, "w1", "r").withColumnRenamed("m", "confusion_dict")))


@register(
    "verb_file",
    f"""WITH {WORDS_SQL}, v AS (SELECT DISTINCT word FROM w WHERE pos = 1) SELECT word, CASE WHEN length(word) % 2 = 0 THEN 'INTRANS' ELSE 'TRANS' END AS transitivity, 'NEUT' AS honorific, CASE WHEN length(word) % 3 = 0 THEN 2 ELSE 1 END AS valency, 'present' AS tense FROM v
    UNION ALL SELECT 'ཞུས', 'TRANS', 'HON', 2, 'past'""",
)
def verb_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct(F.when(F.char_length("word") % 2 == 0, "INTRANS").alias("transitivity"), F.when(F.char_length("word") % 3 == 0, 2).alias("valency"))
    row = sinks.as_map(_words(spark, sf_dir).where("pos = 1").select("word").distinct().select("word", entry.alias("v")), "word", "v").withColumnRenamed("m", "verbs")
    every = lexicon.verbs(spark, tables.read_verbs(spark, _json(spark, "verbs", row)))
    return every.where("word rlike '^[a-z]' or word = 'ཞུས'")


@register("sanskrit_file", f"WITH {WORDS_SQL} SELECT DISTINCT word, length(word) % 2 = 0 AS valid FROM w WHERE pos = 2")
def sanskrit_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _words(spark, sf_dir).where("pos = 2").select("word").distinct()
    listed = lambda even: F.sort_array(F.collect_list(F.when((F.char_length("word") % 2 == 0) == F.lit(even), F.col("word"))))
    return tables.read_sanskrit(spark, _json(spark, "sanskrit", rows.agg(listed(True).alias("valid_words"), listed(False).alias("invalid_stacks"))))


@register("suffix_file", f"WITH {WORDS_SQL}, s AS (SELECT DISTINCT right(word, 2) AS suffix FROM w) SELECT suffix, 'suffix' AS category, length(suffix) * 10 AS priority, 0.85 AS confidence FROM s")
def suffix_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a JSON list; what is missing has its default."""
    path = new_path(spark, "suffixes")
    rows = _words(spark, sf_dir).select(F.expr("right(word, 2)").alias("suffix")).distinct().select("suffix", (F.char_length("suffix") * 10).alias("priority"))
    listed = rows.agg(F.sort_array(F.collect_list(F.struct("suffix", "priority"))).alias("r"))
    sinks.write_value(listed.select(F.to_json("r").alias("value")), path)
    return tables.read_suffix_rules(spark, path).select("suffix", "category", "priority", "confidence")


@register("irregular_file", f"WITH {PAIR_SQL}, f AS (SELECT w1 AS form, min(w2) AS stem FROM p GROUP BY 1) SELECT form, stem, CASE WHEN length(form) % 2 = 0 THEN 0.9 END AS confidence, NULL::VARCHAR AS rule FROM f")
def irregular_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = _pairs(spark, sf_dir).groupBy(F.col("w1").alias("form")).agg(F.min("w2").alias("stem"))
    entry = F.struct("stem", F.when(F.char_length("form") % 2 == 0, 0.9).alias("confidence"))
    path = new_path(spark, "irregular")
    sinks.write_value(sinks.as_map(forms.select("form", entry.alias("v")), "form", "v").select(F.to_json("m").alias("value")), path)
    return tables.read_irregular(spark, path).unionByName(tables.read_irregular(spark, f"{path}-missing"))


NGRAM_SQL = f"""{WORDS_SQL}, g1 AS (SELECT 1 AS o, word AS ngram, count(*) AS n FROM w GROUP BY 2), g2 AS (SELECT 2 AS o, a.word || ' ' || b.word AS ngram, count(*) AS n FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 GROUP BY 2),
g3 AS (SELECT 3 AS o, a.word || ' ' || b.word || ' ' || c.word AS ngram, count(*) AS n FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN w c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2 GROUP BY 2),
every AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n DESC, ngram) AS r FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3))"""


@register("ngram_file", f'WITH {NGRAM_SQL} SELECT o AS "order", ngram, n FROM every WHERE r <= 500')
def ngram_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published artefact: the most frequent n-grams of each order."""
    rows = _words(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("s")).select(F.col("s.word").alias("syllables"))
    path = new_path(spark, "ngrams")
    sinks.write_ngrams(path, *(corpus.ngrams(rows, n) for n in (1, 2, 3)), kept=500)
    return tables.read_ngrams(spark, path)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").where("text <> ''")
    return rows.select(F.concat(F.lit("err-"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("original_text"), F.replace(F.col("text"), F.lit("e"), F.lit("")).alias("corrupted_text"), F.when(F.col("item_id") % 2 == 0, "A").otherwise("B").alias("error_type"), F.lit(0).alias("char_start"), F.lit(1).alias("char_end"), F.lit("").alias("description"))


@register("synthetic_file", "SELECT 'err-' || item_id AS id, length(text) - length(replace(text, 'e', '')) AS lost, CASE WHEN item_id % 2 = 0 THEN 'A' ELSE 'B' END AS error_type FROM benchmark WHERE text <> ''")
def synthetic_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    path = _json(spark, "synthetic", rows.agg(F.lit("1.0.0").alias("version"), F.sort_array(F.collect_list(F.struct(*rows.columns))).alias("records")))
    read = tables.read_synthetic(spark, path)
    return read.select("id", (F.char_length("original_text") - F.char_length("corrupted_text")).cast("long").alias("lost"), "error_type")


@register("pairs_file", "WITH b AS (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark WHERE text <> '') SELECT md5(text) AS digest FROM b WHERE i % greatest(1, n // 6) = 0 AND i // greatest(1, n // 6) < 6")
def pairs_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six of the pairs of a file, at equal distances."""
    path = new_path(spark, "pairs")
    ordered = _records(spark, sf_dir).orderBy(F.expr("cast(substr(id, 5) as long)")).select(F.col("corrupted_text").alias("incorrect"), F.col("original_text").alias("correct"))
    sinks.write_json(ordered.coalesce(1), path)
    return tables.read_pairs(spark, path, 6).select(F.md5("correct").alias("digest"))


@register("tagged_file", f"WITH {WORDS_SQL} SELECT word AS surface, {TAG} AS tag, count(*) AS n FROM w GROUP BY 1, 2")
def tagged_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tagged")
    n = F.char_length("word") % 3
    word = F.concat_ws("|", "word", F.when(n == 0, "n.count").when(n == 1, "v.past").otherwise("case.gen"))
    lines = _words(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", word.alias("w")))).alias("s"))
    lines.select(F.array_join("s.w", " ").alias("value")).write.text(path)
    return tables.read_tagged(spark, path).groupBy("surface", "tag").agg(F.count("*").alias("n"))


@register("lexicon_file", f"WITH {WORDS_SQL} SELECT word AS surface, count(*) AS n FROM w GROUP BY 1")
def lexicon_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "lexicon")
    _words(spark, sf_dir).select(F.concat(F.lit(" "), "word", F.lit(" \t"), F.col("pos").cast("string"), F.lit("\tx")).alias("value")).write.text(path)
    return tables.read_lexicon(spark, path).groupBy("surface").agg(F.count("*").alias("n"))


FORMS_SQL = f"""{WORDS_SQL}, o AS (SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS pos, word, CASE (length(word) + pos) % 4 WHEN 0 THEN 'v.pres' WHEN 1 THEN 'v.past' WHEN 2 THEN 'v.fut' ELSE 'n.count' END AS tag FROM w WHERE pos < 6)"""


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _words(spark, sf_dir).where("pos < 6")
    k = (F.char_length("word") + F.col("pos")) % 4
    tagged = rows.withColumn("t", F.concat_ws("|", "word", F.when(k == 0, "v.pres").when(k == 1, "v.past").when(k == 2, "v.fut").otherwise("n.count")))
    path = new_path(spark, "forms")
    one = tagged.agg(F.sort_array(F.collect_list(F.struct("doc_id", "pos", "t"))).alias("s")).select(F.array_join("s.t", " ").alias("value"))
    sinks.write_value(one, path)
    return tables.read_verb_forms(spark, path)


@register("present_stems", f"WITH {FORMS_SQL} SELECT pos, word AS form, tag, last_value(CASE WHEN tag = 'v.pres' THEN word END IGNORE NULLS) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS stem FROM o")
def present_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each form with the last present form before it, carried over blocks of 64 places."""
    return lexicon.carried(_forms(spark, sf_dir), block=64).withColumn("pos", F.col("pos").cast("long"))


@register(
    "irregular_forms",
    f"""WITH {FORMS_SQL}, c AS (SELECT pos, word AS form, tag, last_value(CASE WHEN tag = 'v.pres' THEN word END IGNORE NULLS) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS stem FROM o),
    e AS (SELECT 'the' AS form, 'old' AS stem, 0.99 AS confidence, 'OLD' AS rule, 0 AS s, 0 AS p UNION ALL SELECT DISTINCT word, word, 0.90, 'VERB_LEXICON_PAST', 1, 0 FROM w WHERE pos = 7
      UNION ALL SELECT form, stem, 0.90, 'VERB_' || upper(replace(tag, '.', '_')), 2, pos FROM c WHERE tag IN ('v.past', 'v.fut') AND stem IS NOT NULL AND form <> stem UNION ALL SELECT DISTINCT word, word, 0.75, 'VERB_LEMMA_INFERRED', 3, 0 FROM w WHERE pos = 8),
    r AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY s, p, rule) AS k FROM e) SELECT form, stem, confidence, rule FROM r WHERE k = 1""",
)
def irregular_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _words(spark, sf_dir)
    existing = spark.createDataFrame([("the", "old", 0.99, "OLD")], "form string, stem string, confidence double, rule string")
    verbs = rows.where("pos = 7").select("word", F.lit("past").alias("tense")).distinct()
    lemmas = rows.where("pos = 8").select(F.concat(F.lit(" "), "word", F.lit("་√1")).alias("lemma")).distinct()
    return lexicon.irregular_forms(existing, verbs, _forms(spark, sf_dir), lemmas)


@register("store_tables", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {k}, '{c.split()[0]}')" for t, s in sinks.TABLES.items() for k, c in enumerate(s.split(", "))) + ") t(table_name, position, column_name)")
def store_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the store, made empty and read back."""
    path = new_path(spark, "store")
    sinks.create_tables(spark, path)
    rows = [(t, k, f) for t in sinks.TABLES for k, f in enumerate(spark.read.parquet(f"{path}/{t}").columns)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string")


@register("populated_once", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def populated_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is filled once: the second time leaves it as it is."""
    path = new_path(spark, "once")
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    assert sinks.populate(rows, path) and not sinks.populate(rows.limit(1), path)
    return spark.read.parquet(path)


@register("json_report", "SELECT doc_id, n_chars, 'document' || chr(10) || '  doc_id: ' || doc_id || chr(10) || '  lang: ' || coalesce(lang, '-') || chr(10) || '  n_chars: ' || coalesce(n_chars::VARCHAR, '-') AS report FROM documents")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON and as text, the JSON read back."""
    path = new_path(spark, "report")
    rows = table(spark, sf_dir, "documents").withColumn("report", sinks.report(F.lit("document"), ["doc_id", "lang", "n_chars"]))
    sinks.write_json(rows, path, ["doc_id", "n_chars", "report"])
    return spark.read.schema("doc_id long, n_chars long, report string").json(path)


@register("vocabulary_union", f"WITH {WORDS_SQL} SELECT DISTINCT word FROM w")
def vocabulary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _words(spark, sf_dir)
    return tables.vocabulary(rows.where("pos % 2 = 0"), rows.where("pos % 2 = 1"), rows)


@register("agreed_terms", f"WITH {WORDS_SQL} SELECT DISTINCT word FROM w WHERE pos = 0 AND word IN (SELECT word FROM w WHERE pos = 5) AND word NOT IN (SELECT word FROM w WHERE pos = 9)")
def agreed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _words(spark, sf_dir)
    return tables.agreed_terms(rows.where("pos = 0"), rows.where("pos = 5"), rows.where("pos = 9"))


@register("file_audit", "SELECT 'parquet' AS format, 4 AS files")
def file_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "audit")
    table(spark, sf_dir, "documents").select("doc_id").repartition(4).write.parquet(path)
    return tables.file_audit(spark, path).where("format = 'parquet'").select("format", F.col("files").cast("int").alias("files"))


@register("model_choice", "SELECT lang, arg_max(source, (n_chars::VARCHAR, source)) AS source FROM (SELECT lang, source, max(n_chars) AS n_chars FROM documents GROUP BY 1, 2) WHERE source IS NOT NULL GROUP BY 1")
def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version of each capability, versions compared as text."""
    rows = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.max("n_chars").alias("v")).where("source is not null")
    return plugins.newest(rows.select(F.col("lang").alias("capability"), F.col("source").alias("key"), F.col("v").cast("string").alias("version"))).select(F.col("capability").alias("lang"), F.col("key").alias("source"))


@register("request_metrics", "SELECT role, count(*) AS requests, sum(length(text)) AS total, round(avg(length(text)), 6) AS average FROM conversations GROUP BY 1")
def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("role"), F.char_length("text").alias("ms"))
    return metrics.running(rows, "role", "ms")
