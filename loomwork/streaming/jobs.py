"""Structured Streaming: indexes and analyses kept up to date by micro-batches.

Each batch is compared with the table by a left anti join, so a replayed batch
adds nothing and a restart resumes where the checkpoint stands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwork.operators import fingerprints, snapshot


def _table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    try:
        return spark.read.schema(like.schema).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return like.limit(0)
        raise


def index_documents(stream: DataFrame, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text") -> StreamingQuery:
    """Append the fingerprints of documents that the index at ``path`` lacks."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        prints = fingerprints.fingerprints(df.dropDuplicates([id_col]), id_col, text_col)
        known = _table(spark, path, prints).select(id_col).distinct()
        fresh = df.dropDuplicates([id_col]).join(known, id_col, "left_anti")
        fingerprints.fingerprints(fresh, id_col, text_col).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def analyze_documents(stream: DataFrame, path: str, checkpoint: str, stage: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Append the analyses of sentences whose hash the table at ``path`` lacks."""

    def batch(df: DataFrame, _: int) -> None:
        rows = snapshot.sentence_rows(df)
        empty = stage(rows.select("hash", "sentence").limit(0))
        known = _table(df.sparkSession, path, empty)
        _, new = snapshot.reanalyze(rows, known, stage)
        new.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and kind, late ones up to a watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
