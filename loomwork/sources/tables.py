"""Readers of the engine's inputs: corpora, lexicons, models, rules, pairs.

Every reader yields a table; JSON files are read with a fixed schema, so that a missing
part is an error where the format asks for it and an empty table where it does not.
Tables given by the user go before built-in defaults (``override``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_corpus(spark: SparkSession, *paths: str, text_col: str = "text", limit: int | None = None, id_col: str | None = None) -> DataFrame:
    """All Parquet files below the paths; the text column, or else the first.

    Rows without text, or with text that is no string, are left out; the id (``id`` or ``id_col``) becomes a
    string, empty metadata null. With a limit, the first rows by id, or by text where there is none.
    """
    df = spark.read.option("recursiveFileLookup", "true").parquet(*paths)
    text = text_col if text_col in df.columns else df.columns[0]
    if not isinstance(df.schema[text].dataType, T.StringType):
        df = df.limit(0).withColumn(text, F.lit(None).cast("string"))
    df = df.withColumnRenamed(text, "text").where("text is not null and text <> ''")
    key = id_col or ("id" if "id" in df.columns else None)
    if key:
        df = df.withColumn("id", F.col(key).cast("string"))
    for c in ("collection", "filename"):
        if c in df.columns:
            df = df.withColumn(c, F.nullif(F.col(c), F.lit("")))
    return df if limit is None else df.orderBy(key or "text", "text").limit(limit)


def total_count(spark: SparkSession, *paths: str) -> int:
    """Rows of the files, those without text too; read from the files' footers."""
    return spark.read.option("recursiveFileLookup", "true").parquet(*paths).count()


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as one value each."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_tag_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Emissions (surface, tag, n), transitions (prev, tag, n) and tag counts of a model's JSON file; all four parts must be there."""
    root = spark.read.json(path, multiLine=True)
    missing = {"tags", "tag_counts", "emissions", "transitions"} - set(root.columns)
    if missing:
        raise ValueError(f"the model lacks {sorted(missing)}")
    counts = "map<string,bigint>"
    raw = _json(spark, path, f"tags array<string>, tag_counts {counts}, emissions map<string,{counts}>, transitions map<string,{counts}>")
    two = lambda c, a: raw.select(F.explode(c).alias(a, "m")).select(a, F.explode("m").alias("tag", "n"))
    return {"emissions": two("emissions", "surface"), "transitions": two("transitions", "prev"), "tag_counts": raw.select(F.explode("tag_counts").alias("tag", "n"))}


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(syllables, tier) of a gazetteer or glossary: plain and ambiguous entries."""
    raw = _json(spark, path, "entries array<array<string>>, ambiguous_entries array<array<string>>")
    plain = raw.select(F.explode("entries").alias("syllables"), F.lit("plain").alias("tier"))
    return plain.unionByName(raw.select(F.explode_outer("ambiguous_entries").alias("syllables"), F.lit("ambiguous").alias("tier")).where("syllables is not null"))


def read_terms(spark: SparkSession, path: str, user: DataFrame | None = None) -> DataFrame:
    """(syllables, source): a glossary's terms of two syllables and more, and the user's; a term of both is the user's."""
    glossary = read_entries(spark, path).where("size(syllables) >= 2").select("syllables", F.lit("glossary").alias("source")).distinct()
    if user is None:
        return glossary
    own = user.select("syllables", F.lit("user_dictionary").alias("source")).distinct()
    return own.unionByName(glossary.join(own.select("syllables"), "syllables", "left_anti"))


def read_verb_frames(spark: SparkSession, path: str) -> DataFrame:
    """(syllables, frame_id, lemma, frame, slots, transitivity, volition): surfaces joined to frames by position."""
    raw = _json(spark, path, "lemmas array<struct<lemma:string,frame:string,slots:array<string>,transitivity:string,volition:string>>, surfaces array<struct<syllables:array<string>,frames:array<int>>>")
    frames = raw.select(F.posexplode("lemmas").alias("frame_id", "f")).select("frame_id", "f.*")
    surfaces = raw.select(F.explode("surfaces").alias("s")).select("s.syllables", F.explode("s.frames").alias("frame_id"))
    return surfaces.join(frames, "frame_id")


def read_collocations(spark: SparkSession, path: str) -> DataFrame:
    """(w1, w2, mi, t, freq) of a JSON map from ``w1:w2``."""
    raw = _json(spark, path, "collocations map<string,struct<mi:double,t:double,freq:int>>")
    rows = raw.select(F.explode("collocations").alias("key", "v"))
    return rows.select(F.substring_index("key", ":", 1).alias("w1"), F.expr("substr(key, instr(key, ':') + 1)").alias("w2"), *(F.coalesce(f"v.{c}", F.lit(0)).alias(c) for c in ("mi", "t", "freq")))


def read_confusions(spark: SparkSession, path: str) -> DataFrame:
    """(wrong, rank, right) of a JSON map from a spelling to its right ones, the first going first."""
    raw = _json(spark, path, "confusion_dict map<string,array<string>>")
    rows = raw.select(F.explode("confusion_dict").alias("wrong", "r")).select("wrong", F.posexplode("r").alias("rank", "right"))
    return rows.where("wrong <> '' and right <> ''")


def read_verbs(spark: SparkSession, path: str) -> DataFrame:
    """(word, transitivity, honorific, valency, tense) of a JSON map; what is missing has its default."""
    raw = _json(spark, path, "verbs map<string,struct<transitivity:string,honorific:string,valency:int,tense:string>>")
    rows = raw.select(F.explode("verbs").alias("word", "v"))
    defaults = {"transitivity": "TRANS", "honorific": "NEUT", "valency": 1, "tense": "present"}
    return rows.select("word", *(F.coalesce(f"v.{c}", F.lit(d)).alias(c) for c, d in defaults.items()))


def read_sanskrit(spark: SparkSession, path: str) -> DataFrame:
    """(word, valid) of a JSON file's valid words and invalid stacks."""
    raw = _json(spark, path, "valid_words array<string>, invalid_stacks array<string>")
    one = raw.select(F.explode("valid_words").alias("word"), F.lit(True).alias("valid"))
    return one.unionByName(raw.select(F.explode_outer("invalid_stacks").alias("word"), F.lit(False).alias("valid")).where("word is not null"))


def read_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """(suffix, category, priority, applies_to, confidence) of a JSON list, by priority."""
    raw = spark.read.schema("suffix string, category string, priority int, applies_to array<string>, confidence double").json(path, multiLine=True)
    filled = raw.where("suffix <> ''").withColumns({"category": F.coalesce("category", F.lit("suffix")), "priority": F.coalesce("priority", F.lit(0)), "confidence": F.coalesce("confidence", F.lit(0.85))})
    return filled.orderBy(F.desc("priority"), "suffix")


def read_irregular(spark: SparkSession, path: str) -> DataFrame:
    """(form, stem, confidence, rule) of a JSON map; a file that is not there gives an empty table."""
    schema = "map<string,struct<stem:string,confidence:double,rule:string>>"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "form string, stem string, confidence double, rule string")
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("m"))
    return raw.select(F.explode("m").alias("form", "v")).select("form", "v.stem", "v.confidence", "v.rule")


def read_ngrams(spark: SparkSession, path: str) -> DataFrame:
    """(order, ngram, n) of an artefact's syllable frequencies, bigrams and trigrams, as far as it has them."""
    counts = "map<string,bigint>"
    raw = _json(spark, path, f"syllable_frequencies {counts}, bigrams {counts}, trigrams {counts}")
    parts = [raw.select(F.lit(k).alias("order"), F.explode(c).alias("ngram", "n")) for k, c in enumerate(("syllable_frequencies", "bigrams", "trigrams"), 1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


RECORD = "struct<id:string,original_text:string,corrupted_text:string,error_type:string,char_start:int,char_end:int,description:string>"


def read_synthetic(spark: SparkSession, path: str) -> DataFrame:
    """Records of synthetic errors; a file without records is an error."""
    if "records" not in spark.read.json(path, multiLine=True).columns:
        raise ValueError("the dataset has no records")
    return _json(spark, path, f"records array<{RECORD}>").select(F.explode("records").alias("r")).select("r.*")


def read_pairs(spark: SparkSession, path: str, sample: int | None = None) -> DataFrame:
    """(id, incorrect, correct) of a file with one JSON object per line, numbered in order; with ``sample``, so many at equal distances.

    Numbers are made within the file's splits and over them.
    """
    from loomwork.operators.metrics import stride

    lines = spark.read.schema("incorrect string, correct string").json(path).withColumn("place", F.monotonically_increasing_id()).where("incorrect is not null and correct is not null")
    return lines if sample is None else stride(lines, "place", sample)


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, pos, surface, tag) of lines of ``surface|tag`` words."""
    lines = spark.read.text(path).withColumn("line_id", F.monotonically_increasing_id())
    words = lines.select("line_id", F.posexplode(F.filter(F.split("value", "\\s+"), lambda w: w.contains("|"))).alias("pos", "w"))
    return words.select("line_id", "pos", F.substring_index("w", "|", 1).alias("surface"), F.expr("substr(w, instr(w, '|') + 1)").alias("tag"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(surface) of the first fields of tab-separated lines, stripped; empty ones are left out."""
    return spark.read.text(path).select(F.trim(F.substring_index("value", "\t", 1)).alias("surface")).where("surface <> ''")


def read_verb_forms(spark: SparkSession, path: str) -> DataFrame:
    """(pos, word, tag) of a text of ``word|tag`` tokens, in order."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.filter(F.split("value", "\\s+"), lambda w: w.contains("|"))).alias("pos", "w")).select(
        "pos", F.substring_index("w", "|", 1).alias("word"), F.expr("substr(w, instr(w, '|') + 1)").alias("tag")
    )


def override(defaults: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Defaults where the given table has no such key."""
    return given.unionByName(defaults.join(given.select(key), key, "left_anti"))


def merge_vocabulary(*tables: DataFrame) -> DataFrame:
    """(surface, freq, origin) tables merged: the larger frequency, all origins."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("surface").agg(F.max("freq").alias("freq"), F.array_join(F.sort_array(F.collect_set("origin")), ",").alias("origins"))


def vocabulary(*tables: DataFrame) -> DataFrame:
    """Distinct words of several tables (word)."""
    out = tables[0].select("word")
    for t in tables[1:]:
        out = out.union(t.select("word"))
    return out.distinct()


def agreed_terms(lexicon: DataFrame, corpus: DataFrame, known: DataFrame) -> DataFrame:
    """Words that a lexicon and a corpus both have and that are not known yet."""
    return lexicon.join(corpus, "word", "left_semi").join(known, "word", "left_anti").select("word").distinct()


def longest(*tables: DataFrame, column: str = "syllables") -> DataFrame:
    """One row: the length of the longest key of several tables; 0 for none."""
    every = tables[0].select(F.size(column).alias("n"))
    for t in tables[1:]:
        every = every.union(t.select(F.size(column).alias("n")))
    return every.agg(F.coalesce(F.max("n"), F.lit(0)).alias("longest"))


def file_audit(spark: SparkSession, path: str) -> DataFrame:
    """(format, files, bytes) of the files below a path, by the ends of their names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1))
    return files.groupBy(name.alias("format")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
