"""Writers: artefacts, tables that are filled once, user dictionaries, reports.

Artefacts of bounded size (published n-grams, a user's dictionary, a report) are one
JSON value; everything else is Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators.corpus import KEPT_NGRAMS, most_common

#: Tables of the engine's store and their columns (fixed values of the format).
TABLES = {
    "dictionary_tags": "tag string", "dictionary_tag_counts": "tag string, count bigint", "dictionary_emissions": "surface string, tag string, count bigint",
    "dictionary_transitions": "prev_tag string, tag string, count bigint", "gazetteer_entries": "syllables array<string>", "gazetteer_ambiguous": "syllables array<string>",
    "terminology_glossary": "syllables array<string>", "terminology_user_terms": "syllables array<string>",
    "verb_frames": "id int, lemma string, frame string, slots array<string>, transitivity string, volition string", "verb_surfaces": "syllables array<string>, frame_id int",
    "fingerprint_documents": "document_id string, source string, collection string, filename string, parent_doc_id string, chunk_index int, char_start int, char_end int",
    "fingerprint_hashes": "hash bigint, document_id string",
}


def table_schemas(spark: SparkSession) -> DataFrame:
    """(table_name, position, column_name, type) of all tables of the store."""
    rows = []
    for name, schema in TABLES.items():
        fields = spark.createDataFrame([], schema).schema.fields
        rows += [(name, k, f.name, f.dataType.simpleString()) for k, f in enumerate(fields)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, type string")


def create_tables(spark: SparkSession, path: str) -> None:
    """Empty tables of the store where there are none."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{name}")


def is_empty(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return not there or spark.read.parquet(path).isEmpty()


def populate(df: DataFrame, path: str) -> bool:
    """Fill a table if it has no rows yet; whether it was filled. A failed write leaves no rows."""
    if not is_empty(df.sparkSession, path):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def write_json(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """One JSON object per row."""
    df.select(F.to_json(F.struct(*(columns or df.columns))).alias("value")).write.text(path)


def write_value(df: DataFrame, path: str) -> None:
    """A table of one text value as one file."""
    df.coalesce(1).write.text(path)


def as_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row with a map; for tables of bounded size."""
    return df.agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("m"))


def write_ngrams(path: str, unigrams: DataFrame, bigrams: DataFrame, trigrams: DataFrame, kept: int = KEPT_NGRAMS) -> None:
    """The published artefact: the ``kept`` most frequent n-grams of each order, as one JSON value."""
    parts = {"syllable_frequencies": unigrams, "bigrams": bigrams, "trigrams": trigrams}
    rows = None
    for name, table in parts.items():
        one = as_map(most_common(table, kept), "ngram", "n").withColumnRenamed("m", name)
        rows = one if rows is None else rows.join(one)  # one row each
    write_value(rows.select(F.to_json(F.struct(*parts)).alias("value")), path)


def user_terms(terms: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """A user's terms (syllables) with some added and some removed; doing so again changes nothing."""
    out = terms.select("syllables")
    if added is not None:
        out = out.unionByName(added.select("syllables"))
    if removed is not None:
        out = out.join(removed.select("syllables").distinct(), "syllables", "left_anti")
    return out.distinct()


def report(kind: Column, fields: list[str]) -> Column:
    """A text of lines ``name: value``."""
    return F.concat_ws("\n", kind, *(F.concat(F.lit(f"  {f}: "), F.coalesce(F.col(f).cast("string"), F.lit("-"))) for f in fields))


def payload(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, payload): each document's findings as the JSON that an editor shows, in order of ``position``."""
    from loomwork.functions.script import byte_offset

    at = lambda c: F.col(c).cast("int")
    joined = findings.join(texts.select("doc_id", "text"), "doc_id")
    one = F.struct(
        "position", F.concat_ws(":", "source", F.col("char_start").cast("string"), F.col("char_end").cast("string")).alias("id"), "source",
        F.struct(at("char_start").alias("char_start"), at("char_end").alias("char_end"), byte_offset(F.col("text"), at("char_start")).alias("byte_start"), byte_offset(F.col("text"), at("char_end")).alias("byte_end")).alias("range"),
        "replacement", F.when(F.coalesce(F.col("replacement"), F.lit("")) != "", F.array("replacement")).otherwise(F.array().cast("array<string>")).alias("suggestions"), "score", F.lower("priority").alias("priority"), "error_type", "message",
    )
    grouped = joined.select("doc_id", F.char_length("text").alias("n"), one.alias("s")).groupBy("doc_id", "n").agg(F.sort_array(F.collect_list("s")).alias("s"))
    every = texts.select("doc_id", F.char_length("text").alias("n")).join(grouped.drop("n"), "doc_id", "left")
    none = F.array().cast(grouped.schema["s"].dataType)
    whole = F.struct(F.lit(True).alias("ok"), F.col("n").alias("char_count"), F.transform(F.coalesce("s", none), lambda x: x.dropFields("position")).alias("suggestions"))
    return every.select("doc_id", F.to_json(whole).alias("payload"))
