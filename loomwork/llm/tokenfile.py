"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are counted over all documents and ranked, the most frequent first; a rank
takes one to four bytes. Of every four ranks the lengths stand in one control
byte, two bits each, and control bytes are kept apart from data bytes, so that a
reader finds all lengths by one table look-up per control byte and gathers the
values without a loop.

A token file is a folder of the shared store: ``docs`` holds Parquet files in
ascending id order with (id, place, n_tokens, control, data) per document, and
``ranks`` the ids by rank. Texts are encoded and their ids counted once, into a compact table; the
shuffle that puts documents in order carries that, never texts.

Defined results: a null or empty text has only the end id; null document ids come
first; rows with equal ids are ordered by the bytes of their tokens; an empty table gives an
empty file. Place grows with the order; a document's start is the number of ids of
all documents before it.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm import bpe
from loomwork.session import prepare
from loomwork.shared import cut, drop_table, new_path

#: Lengths of the four values of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)


def _flat(arrays: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary array in one piece, and where each value ends."""
    values = [v or b"" for v in arrays.to_pylist()]
    return np.frombuffer(b"".join(values), dtype=np.uint8), np.cumsum([0, *map(len, values)])


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    body = np.ascontiguousarray(data).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(body)])


def _used(sizes: np.ndarray, control_ends: np.ndarray) -> np.ndarray:
    """Which of the four lanes of each control byte hold a value: all but the last ones of a document."""
    out = np.ones(4 * int(control_ends[-1]), dtype=bool)
    idle = -sizes % 4
    for k in (1, 2, 3):
        out[4 * control_ends[1:][idle >= k] - k] = False
    return out


def code(ranks: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control and data bytes of many documents, and the ends of each in both.

    ``ends``: where each document's ranks end, with a leading 0.
    """
    wide = 4 if len(ranks) and ranks.max() >= 1 << 16 else 2  # bytes that any rank takes at most
    lengths = np.ones(len(ranks), dtype=np.uint8)
    for k in range(1, wide):
        lengths += ranks >= 1 << 8 * k
    data = ranks.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide)[np.arange(wide, dtype=np.uint8) < lengths[:, None]]
    data_ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[ends]
    sizes = np.diff(ends)
    control_ends = np.concatenate([[0], np.cumsum((sizes + 3) // 4)])
    lanes = np.zeros(4 * int(control_ends[-1]), dtype=np.uint8)
    lanes[_used(sizes, control_ends)] = lengths - 1
    four = lanes.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control, control_ends, data, data_ends


def uncode(control: np.ndarray, control_ends: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranks of many documents again."""
    lengths = LENGTHS[control].ravel()[_used(sizes, control_ends)]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    out = padded[at].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        more = np.flatnonzero(lengths > k)
        out[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _encoded(batches, path: str, end_id: int, kind: str):
    """(id, ids, counts): ids with the end id as little-endian integers of two bytes, or of four for large
    vocabularies; and, as a last row without ids, how often the task has written each of them."""
    encoder = bpe.loaded(path)
    total = np.zeros(max(len(encoder.tokens), end_id + 1), dtype=np.int64)
    end = np.array([end_id], dtype=kind).tobytes()
    names = []
    for batch in batches:
        names = batch.schema.names
        coded = [np.frombuffer(c, dtype="<i4").astype(kind) for c in encoder.encode_batch(batch.column(1).to_pylist())]
        if coded:
            total += np.bincount(np.concatenate(coded), minlength=len(total))
            total[end_id] += len(coded)
        ids = pa.array([c.tobytes() + end for c in coded], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.nulls(len(coded), pa.binary())], ["id", "ids", "counts"])
    if names:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, batch.column(0).type), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], ["id", "ids", "counts"])


def _counted(batches):
    """(token, n) of the tasks' counts."""
    for batch in batches:
        total = sum((np.frombuffer(c, dtype=np.int64) for c in batch.column(0).to_pylist()), np.zeros(1, dtype=np.int64))
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["token", "n"])


def write_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, path: str | None = None) -> str:
    """Encode every whole text and write the token file; returns its folder."""
    spark = prepare(df.sparkSession)
    path = path or new_path(spark, "tokens")
    kind = "<u2" if len(bpe.loaded(tokenizer).tokens) <= 65536 else "<u4"
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType().add("id", df.schema[id_col].dataType).add("ids", "binary").add("counts", "binary")
    encoded = cut(texts.mapInArrow(partial(_encoded, path=tokenizer, end_id=end_id, kind=kind), schema), "encoded", "snappy")
    rows = encoded.where("ids is not null").select("id", "ids")
    counts = encoded.where("counts is not null").select("counts").mapInArrow(_counted, T.StructType().add("token", "long").add("n", "long"))
    ranked = counts.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").select("token").collect()  # at most the vocabulary
    by_rank = [r["token"] for r in ranked]
    spark.createDataFrame([(r, t) for r, t in enumerate(by_rank)], T.StructType().add("rank", "long").add("token", "long")).coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max(by_rank, default=0) + 1, dtype=np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank_of)

    @F.arrow_udf(T.StructType().add("n_tokens", "long").add("control", "binary").add("data", "binary"))
    def coded(ids: pa.Array) -> pa.Array:
        data, ends = _flat(ids)
        values = data.view(kind)
        ends = ends // np.dtype(kind).itemsize
        control, control_ends, body, data_ends = code(ranks.value[values], ends)
        return pa.StructArray.from_arrays([pa.array(np.diff(ends), pa.int64()), _binary(control, control_ends), _binary(body, data_ends)], ["n_tokens", "control", "data"])

    # coded behind the shuffle: the ranges are found by a pass over its input, which would run it twice
    ordered = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "ids").withColumn("place", F.monotonically_increasing_id())
    ordered.select("id", "place", coded("ids").alias("c")).select("id", "place", "c.*").write.option("compression", "zstd").parquet(f"{path}/docs")
    drop_table(encoded)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, place, n_tokens, ids) of a token file; ids are little-endian 32-bit integers."""
    prepare(spark)
    docs = spark.read.parquet(f"{path}/docs")
    by_rank = spark.sparkContext.broadcast(np.array([r["token"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], dtype="<u4"))

    @F.arrow_udf(T.BinaryType())
    def ids(n_tokens: pa.Array, control: pa.Array, data: pa.Array) -> pa.Array:
        lanes, control_ends = _flat(control)
        sizes = n_tokens.to_numpy(zero_copy_only=False).astype(np.int64)
        tokens = by_rank.value[uncode(lanes, control_ends, _flat(data)[0], sizes)]
        return _binary(tokens.astype("<u4").view(np.uint8), 4 * np.concatenate([[0], np.cumsum(sizes)]))

    return docs.select("id", "place", "n_tokens", ids("n_tokens", "control", "data").alias("ids"))


def with_starts(rows: DataFrame) -> DataFrame:
    """Add ``start``, the number of ids before each document: sums within the files' parts, and over the parts."""
    part = F.shiftright("place", 33)  # the writing task's number
    rows = rows.withColumn("part", part)
    before = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each written file
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return inside.join(parts, inside["part"] == parts["p"]).withColumn("start", (F.col("offset") + F.col("inside")).cast("long")).drop("p", "offset", "inside", "part")
