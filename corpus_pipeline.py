"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
its result is written to the shared folder and read again for the next one.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import bpe, mixing, neardup, pii, ppm, queries
from loomwork.session import read_table
from loomwork.shared import cut

#: No stage but the last is plain SQL, so there is none for the whole.
ORACLE_SQL = None


#: Bits a byte from which even the best language's code is no shorter than the text itself.
NO_LANGUAGE = 8.0
#: Pre-tokens a worker remembers within a task: few, as executors' heaps have grown full in the stages before.
MEMO_WORDS = 200_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; where ``lang`` is null, the predicted one is written.

    A text has none if it is null, has no letter, or if its code in the best language
    is longer than ``NO_LANGUAGE`` bits a byte: the frozen statistics then say less than
    none. Repeated rows fare alike; columns of any name are kept. Where nothing can be
    learnt (no labelled row) nothing can be rejected but texts without a letter; empty
    tables stay empty.
    """
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4) == 2
    model = ppm.fit(docs.where(~held), "doc_id", "text", "lang")
    if not model.languages:
        return docs.where(F.col("text").rlike("\\p{L}"))
    found = ppm.identify(docs.select(F.struct(*docs.columns).alias("row"), "text"), model, bits="bits")
    kept = found.where((F.col("lang_pred") != ppm.UNKNOWN) & (F.col("bits") < NO_LANGUAGE))
    told = lambda c: F.coalesce(F.col("row.lang"), F.col("lang_pred")).alias("lang") if c == "lang" else F.col("row")[c].alias(c)
    return kept.select(*(told(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or similar texts stays: that of the least doc_id.

    Similar are texts whose sets of five-word shingles have a Jaccard similarity of 0.8
    or more; groups are what such links reach. Null is the empty text; null ids come
    first, ties go by the text's hash, and of repeated rows one stays. All columns are kept.
    """
    return neardup.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; where that changes a text, n_chars is counted anew.

    Null texts stay null; no row goes; repeated rows fare alike; other columns are kept.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    hidden = pii.redact(rows)
    same = F.col("text").eqNullSafe(F.col("row.text"))
    n_chars = F.when(same, F.col("row.n_chars")).otherwise(F.char_length("text").cast("long"))
    new = {"text": F.col("text"), "n_chars": n_chars}
    return hidden.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it: none, once, or up to three times.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Null and empty texts have
    no words and are taken with their source's share of documents; of equal rows some may
    be taken once more than others. All columns are kept.
    """
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix; none for null and empty texts. Other columns than these are left out."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), queries.tokenizer_path(), memo_words=MEMO_WORDS, forget=True)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
