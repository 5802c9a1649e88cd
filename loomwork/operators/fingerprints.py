"""Winnowed fingerprints, their index, and containment search.

A text is stripped at its ends and brought to a Unicode normal form. Its k-grams
are hashed by powers of 131 modulo 2^64; of every w neighbouring hashes the least
is kept (the leftmost of equal ones). Documents share a passage if they share
fingerprints: containment is the share of the query's distinct ones. Positions are
those of the normalised text.

Hashes are made by numpy in Arrow batches, ``BLOCK`` characters at a time, so that
no text needs more memory than its own. All of a document's fingerprints are made
in its row, and its number of distinct ones with them: indexing shuffles nothing.

Defined results: null texts, and texts shorter than k, have no fingerprints; hashes
are stored as signed longs of the same 64 bits.
"""

from __future__ import annotations

import unicodedata
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.script import byte_offset
from loomwork.session import prepare
from loomwork.shared import cut

BASE = 131
K, W = 6, 4
FORM = "NFC"
#: Characters of a chunk: longer documents are indexed in parts.
CHUNK = 100_000
#: Hashes made at a time.
BLOCK = 1 << 20


def kgram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-gram, by doubling: that of 2m characters is two of m."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, done = np.zeros(n, dtype=np.uint64), 0
    part, size = codes, 1
    rest = k
    while rest:
        if rest & 1:
            out = out * np.uint64(pow(BASE, size, 1 << 64)) + part[done : done + n]
            done += size
        rest >>= 1
        if rest:
            part = part[: len(part) - size] * np.uint64(pow(BASE, size, 1 << 64)) + part[size:]
            size *= 2
    return out


def winnowed(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least hash of every w neighbours, each once."""
    n = len(hashes)
    w = min(w, n)
    if w < 2:
        return np.arange(n)
    least = np.lib.stride_tricks.sliding_window_view(hashes, w).argmin(axis=1) + np.arange(n - w + 1)
    return least[np.concatenate([[True], least[1:] != least[:-1]])]


def normalized(text: str | None, form: str = FORM) -> str:
    return unicodedata.normalize(form, (text or "").strip())


def prints(text: str | None, k: int = K, w: int = W, form: str = FORM) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a whole text's fingerprints."""
    codes = np.frombuffer(normalized(text, form).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found, w = [], min(w, n)
    for low in range(0, n - w + 1, BLOCK):  # a block's last windows reach into the next
        hashes = kgram_hashes(codes[low : low + BLOCK + w - 1 + k - 1], k)
        at = winnowed(hashes, w)
        found.append((hashes[at], at + low))
    hashes, at = (np.concatenate(c) for c in zip(*found, strict=True))
    fresh = np.concatenate([[True], at[1:] > at[:-1]])
    return hashes[fresh], at[fresh]


def _each(batches, k: int, w: int, form: str, distinct: bool):
    for batch in batches:
        ids, columns = [], ([], [], [], [])
        for row, text in enumerate(batch.column(1).to_pylist()):
            hashes, at = prints(text, k, w, form)
            kinds, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            if distinct:
                last = np.zeros(len(kinds), dtype=np.int64)
                np.maximum.at(last, back, at)
                hashes, at = kinds, at[first]
            else:
                last = at
            ids.append(np.full(len(hashes), row))
            for column, values in zip(columns, (hashes.view(np.int64), at, last, np.full(len(hashes), len(kinds))), strict=True):
                column.append(values)
        if ids:
            arrays = [batch.column(0).take(pa.array(np.concatenate(ids))), *(pa.array(np.concatenate(c).astype(np.int64)) for c in columns)]
            yield pa.RecordBatch.from_arrays(arrays, [batch.schema.names[0], "hash", "pos", "last", "total"])


def _mapped(df: DataFrame, id_col: str, text_col: str, k: int, w: int, form: str, distinct: bool) -> DataFrame:
    if not 2 <= k <= 100 or not 1 <= w <= 50:
        raise ValueError("k must be 2 to 100 and w 1 to 50")
    prepare(df.sparkSession)
    schema = T.StructType().add(id_col, df.schema[id_col].dataType).add("hash", "long").add("pos", "long").add("last", "long").add("total", "long")
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(partial(_each, k=k, w=w, form=form, distinct=distinct), schema)


def fingerprints(df: DataFrame, id_col: str, text_col: str, k: int = K, w: int = W, form: str = FORM) -> DataFrame:
    """(id, hash, pos) of every kept k-gram."""
    return _mapped(df, id_col, text_col, k, w, form, False).select(id_col, "hash", "pos")


def _summed(batches, k: int, w: int, form: str):
    for batch in batches:
        rows, told = [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            hashes, at = prints(text, k, w, form)
            if len(hashes):
                rows.append(row)
                told.append((len(hashes), len(np.unique(hashes)), int(hashes.view(np.int64).min()), int(at.sum())))
        columns = zip(*told, strict=True) if told else [[]] * 4
        arrays = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(list(c), pa.int64()) for c in columns)]
        yield pa.RecordBatch.from_arrays(arrays, [batch.schema.names[0], "n_prints", "n_hashes", "least_hash", "positions"])


def summaries(df: DataFrame, id_col: str, text_col: str, k: int = K, w: int = W, form: str = FORM) -> DataFrame:
    """(id, n_prints, n_hashes, least_hash, positions) of every id that has fingerprints, summed up in its row.

    Only ids are shuffled, to find those that stand in several rows: their fingerprints are grouped.
    """
    prepare(df.sparkSession)
    schema = T.StructType().add(id_col, df.schema[id_col].dataType).add("n_prints", "long").add("n_hashes", "long").add("least_hash", "long").add("positions", "long")
    once = lambda rows: rows.select(id_col, F.col(text_col).cast("string")).mapInArrow(partial(_summed, k=k, w=w, form=form), schema)
    several = cut(df.groupBy(F.col(id_col).alias("__id")).count().where("count > 1").select("__id"), "several")
    if several.isEmpty():
        return once(df)
    among = F.col(id_col).eqNullSafe(F.col("__id"))
    grouped = fingerprints(df.join(several, among, "left_semi"), id_col, text_col, k, w, form).groupBy(id_col).agg(
        F.count("*").alias("n_prints"), F.count_distinct("hash").alias("n_hashes"), F.min("hash").alias("least_hash"), F.sum("pos").alias("positions")
    )
    return once(df.join(several, among, "left_anti")).unionByName(grouped)


def index_entries(df: DataFrame, id_col: str, text_col: str, k: int = K, w: int = W, form: str = FORM) -> DataFrame:
    """(id, hash, pos, last, total): each distinct hash of a document once, its first and last place, and the document's number of them."""
    return _mapped(df, id_col, text_col, k, w, form, True)


def containment(queries: DataFrame, corpus: DataFrame, query_id: str, doc_id: str, k: int = K, least: float = 0.1) -> DataFrame:
    """Matches of query entries in corpus entries (``index_entries``): similarity, coverage and span."""
    asked = queries.select(query_id, "hash", F.col("pos").alias("first"), "last", F.col("total").alias("query_total"))
    held = corpus.select(doc_id, "hash", F.col("total").alias("doc_total"))
    shared = (
        asked.join(held, "hash")
        .groupBy(query_id, doc_id, "query_total", "doc_total")
        .agg(F.count("*").alias("overlap"), F.min("first").alias("span_start"), (F.max("last") + k).alias("span_end"))
    )
    scored = shared.withColumns({"similarity": F.col("overlap") / F.col("query_total"), "coverage": F.col("overlap") / F.col("doc_total")})
    return scored.where(F.col("similarity") >= least)


def with_byte_spans(matches: DataFrame, queries: DataFrame, query_id: str, text_col: str = "text") -> DataFrame:
    """Add byte_start and byte_end: the span's bytes in the raw query text."""
    raw = queries.select(query_id, F.col(text_col).alias("__raw"))
    offset = lambda c: byte_offset(F.col("__raw"), F.col(c).cast("int")).cast("long")
    return matches.join(raw, query_id).withColumns({"byte_start": offset("span_start"), "byte_end": offset("span_end")}).drop("__raw")


def with_metadata(matches: DataFrame, documents: DataFrame, doc_id: str, *columns: str) -> DataFrame:
    """The matches with columns of the documents they were found in."""
    return matches.join(documents.select(doc_id, *columns).dropDuplicates([doc_id]), doc_id)


def build(documents: DataFrame, index: DataFrame, id_col: str, text_col: str = "text", force: bool = False, size: int = CHUNK, k: int = K, w: int = W) -> tuple[DataFrame, DataFrame]:
    """(new entries, one row of statistics) of indexing in chunks what the index lacks, or all with ``force``.

    ``index`` has the id column as text and ``parent_id``; the new entries have the same,
    with the chunk's number and span.
    """
    todo = documents if force else unseen(documents, index, id_col)
    parts = line_chunks(todo.where(F.col(text_col) != ""), id_col, text_col, size)
    entries = index_entries(parts.select(F.struct("chunk_id", "parent", "chunk_index", "char_start", "char_end").alias("c"), "text"), "c", "text", k, w)
    new = entries.select(F.col("c.chunk_id").alias(id_col), F.col("c.parent").alias("parent_id"), "c.chunk_index", "c.char_start", "c.char_end", "hash", "pos", "last", "total")
    stats = documents.agg(F.count("*").alias("total_documents")).join(todo.agg(F.count("*").alias("indexed_documents"))).join(new.agg(F.count("*").alias("total_fingerprints")))
    return new, stats.withColumn("skipped_documents", F.col("total_documents") - F.col("indexed_documents"))


def totals(index: DataFrame, id_col: str) -> DataFrame:
    """One row: documents, fingerprints (distinct ones of each document), distinct hashes."""
    return index.agg(F.count_distinct(id_col).alias("documents"), F.count("*").alias("total_fingerprints"), F.count_distinct("hash").alias("distinct_hashes"))


def chunks(df: DataFrame, id_col: str, text_col: str, size: int = CHUNK) -> DataFrame:
    """Fixed windows of long texts: (chunk_id, parent, chunk_index, char_start, char_end, text).

    A text of one chunk keeps its id. Only the pieces leave a row, never the whole text again.
    """
    n = F.greatest(F.lit(1), F.ceil(F.char_length(text_col) / size).cast("int"))
    piece = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(text_col), i * size + 1, F.lit(size)))
    rows = df.select(F.col(id_col).cast("string").alias("parent"), n.alias("n"), F.posexplode(piece).alias("chunk_index", "text"))
    start = F.col("chunk_index") * size
    return rows.select(
        F.when(F.col("n") == 1, F.col("parent")).otherwise(F.concat("parent", F.lit("#chunk_"), F.col("chunk_index").cast("string"))).alias("chunk_id"),
        "parent", "chunk_index", start.alias("char_start"), (start + F.char_length("text")).alias("char_end"), "text",
    )


def unseen(documents: DataFrame, index: DataFrame, id_col: str) -> DataFrame:
    """Documents that the index has neither under their id nor as the parent of a chunk."""
    known = index.select(F.col(id_col).cast("string").alias("k")).union(index.select(F.col("parent_id").cast("string"))).where("k is not null").distinct()
    return documents.join(known, documents[id_col].cast("string") == known["k"], "left_anti")


def upsert(index: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """Replace all fingerprints of the documents in ``new``."""
    kept = index.join(new.select(id_col).distinct(), id_col, "left_anti")
    return kept.unionByName(new).dropDuplicates([id_col, "hash"])


def add_missing(index: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """Add documents that are not in the index yet; the first write wins."""
    return index.unionByName(new.join(index.select(id_col).distinct(), id_col, "left_anti"))


def remove(index: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    return index.join(ids.select(id_col).distinct(), id_col, "left_anti")


def advisories(matches: DataFrame, query_id: str, top: int = 10) -> DataFrame:
    """The best matches of each query with a priority by similarity."""
    order = Window.partitionBy(query_id).orderBy(F.desc("similarity"), F.desc("coverage"), "doc_id")
    level = F.when(F.col("similarity") >= 0.5, "HIGH").when(F.col("similarity") >= 0.1, "MEDIUM").otherwise("LOW")
    return matches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("priority", level)


def pack_lines(text: str, size: int) -> list[tuple[int, int]]:
    """Spans of whole lines that fit ``size`` together, line feeds counted; a longer line is cut into windows.

    The line feed between two spans belongs to neither. A text that fits is one span.
    """
    if len(text) <= size:
        return [(0, len(text))]
    spans: list[tuple[int, int]] = []
    begin = 0
    room = False  # whether the last span may grow
    for line in text.split("\n"):
        end = begin + len(line)
        if len(line) > size:
            spans += [(a, min(a + size, end)) for a in range(begin, end, size)]
            room = False
        elif room and min(end + 1, len(text)) - spans[-1][0] <= size:
            spans[-1] = (spans[-1][0], end)
        else:
            spans.append((begin, end))
            room = True
        begin = end + 1
    return [s for s in spans if s[0] < s[1]] or [(0, len(text))]


def _line_pieces(batches, size: int):
    for batch in batches:
        rows = []
        for parent, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            spans = pack_lines(text or "", size)
            for k, (a, b) in enumerate(spans):
                rows.append((parent if len(spans) == 1 or parent is None else f"{parent}#chunk_{k}", parent, k, a, b, (text or "")[a:b]))
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], ["chunk_id", "parent", "chunk_index", "char_start", "char_end", "text"])


def line_chunks(df: DataFrame, id_col: str, text_col: str, size: int = CHUNK) -> DataFrame:
    """``chunks`` along lines: (chunk_id, parent, chunk_index, char_start, char_end, text)."""
    prepare(df.sparkSession)
    schema = "chunk_id string, parent string, chunk_index int, char_start int, char_end int, text string"
    return df.select(F.col(id_col).cast("string").alias("parent"), F.col(text_col).cast("string")).mapInArrow(partial(_line_pieces, size=size), schema)
