"""SimHash near-duplicates, linked by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, in a ring.
Where two fingerprints differ in at most two bits, some segment agrees exactly and
the next one in the ring differs in at most one bit (pigeonhole: with both errors
in one segment, the two behind it agree; with errors in two, the third agrees and
its next has one). So three keys are made, each of a segment's bits and a Golay
codeword index of the next one, seen as a word of 23 bits. The binary Golay code (23, 12, 7) is
perfect: each word has one codeword within 3 bits. A fingerprint asks with that
one and is entered under all codewords within 4 bits (one, or six where the
nearest is 3 away); a word that differs in one bit is then met for certain.
Pairs with a common key are verified by their exact distance. No side of a join is
sent to the driver: a fingerprint has up to 18 entries, which the optimizer takes for one.

Only distinct fingerprints take part, so copies never make pairs. Where more than
``CROWD`` fingerprints share a key they are not paired: they are linked exactly by
midpoints instead. Each is entered under itself and its 64 neighbours at one bit;
those that meet lie within two bits of each other, at most 65 of them, and are
linked to the least one. No pair is lost, and no group is paired in full.

Defined results: texts are taken whole; null and empty texts and those of white
space alone have fingerprint 0 and are linked like any other; fewer words than a
shingle make one shingle of what there is. A bit is set if more than half of the
shingles, repeats included, have it. The component's id is the least id in it
(null ids are ignored for that). Repeated rows and ids keep one result row each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.components import components
from loomwork.session import prepare
from loomwork.shared import cut

SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Entries under one key beyond which midpoints take over.
CROWD = 64
#: Generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of a whole text's word shingles as a signed 64-bit integer."""
    import xxhash

    parts = (text or "").encode("utf-8").translate(LOWER).split()  # at the six ASCII white-space bytes
    if not parts:
        return 0
    joined = b" ".join(parts)
    digest = xxhash.xxh64_digest
    if len(parts) <= words:
        hashes = digest(joined, SEED)
    else:
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        begins = [0, *(ends[:-words] + 1).tolist()]
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(begins, ends[words - 1 :].tolist(), strict=True)])
    return majority(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8))


def majority(rows: np.ndarray) -> int:
    """The bits that more than half of the hashes (rows of eight bytes) have, as a signed integer."""
    if len(rows) < 512:
        counts = np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(rows[:, k], minlength=256) @ BITS for k in range(8)])
    return int(np.packbits(counts * 2 > len(rows)).view(">i8")[0])


def fingerprint_column(text: Column, words: int = 3) -> Column:
    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, words) for t in texts.to_pylist()], pa.int64())

    return run(text)


def _remainder(word: int) -> int:
    for k in range(22, 10, -1):
        if word >> k & 1:
            word ^= GOLAY << (k - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each 23-bit word's upper 12 bits; and for each syndrome the
    error patterns of at most 4 bits (the one of at most 3 first, then -1s)."""
    upper = np.array([_remainder(u << 11) for u in range(4096)], dtype=np.int64)
    single = [_remainder(1 << k) for k in range(23)]
    found: list[list[int]] = [[] for _ in range(2048)]
    patterns = [(0, 0)]
    for weight in range(5):
        for syndrome, pattern in patterns:
            found[syndrome].append(pattern)
        patterns = [(s ^ single[k], p | 1 << k) for s, p in patterns for k in range(p.bit_length(), 23)] if weight < 4 else []
    return upper, np.array([p + [-1] * (6 - len(p)) for p in found], dtype=np.int64)


_GOLAY: list[np.ndarray] = []


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key each fingerprint asks with per pair of segments (n, 3), and those it
    is entered under (n, 3, 6; -1 where there is none)."""
    if not _GOLAY:
        _GOLAY.extend(_tables())
    upper, patterns = _GOLAY
    raw = [(prints.view(np.uint64) >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = []
    for word in raw:
        error = patterns[upper[word >> 11] ^ (word & 2047)]
        near.append(np.where(error >= 0, (word[:, None] ^ error) >> 11, -1))
    pairs = [(i, (i + 1) % 3) for i in range(3)]
    stored = [np.where(near[j] >= 0, (p << 40) | (raw[i][:, None] << 12) | near[j], -1) for p, (i, j) in enumerate(pairs)]
    entered = np.stack(stored, axis=1)
    return entered[:, :, 0], entered


@F.arrow_udf(T.StructType().add("ask", T.ArrayType(T.LongType())).add("entered", T.ArrayType(T.LongType())))
def _keys(prints: pa.Array) -> pa.Array:
    ask, entered = keys(prints.to_numpy(zero_copy_only=False).astype(np.int64))
    flat = entered.reshape(len(entered), -1)
    has = flat >= 0
    return pa.StructArray.from_arrays(
        [
            pa.ListArray.from_arrays(pa.array(np.arange(0, ask.size + 1, ask.shape[1]), pa.int32()), pa.array(ask.ravel())),
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has.sum(axis=1))]), pa.int32()), pa.array(flat[has])),
        ],
        ["ask", "entered"],
    )


def near_links(prints: DataFrame, column: str = "fp", crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints at most two bits apart, but
    for crowded keys, whose fingerprints are linked to the least near one."""
    keyed = prints.select(F.col(column).alias("x"), _keys(F.col(column)).alias("k"))
    entered = keyed.select("x", F.explode("k.entered").alias("key"))
    crowded = cut(entered.groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowded")
    ask = keyed.select("x", F.explode("k.ask").alias("key"))
    links = None
    if crowded.isEmpty():
        rest = ask
    else:
        rest = ask.join(crowded.hint("merge"), "key", "left_anti")
        members = entered.join(crowded.hint("merge"), "key", "left_semi").select("x").distinct()
        flips = F.array(F.col("x"), *(F.col("x").bitwiseXOR(F.lit((1 << k) - (1 << 64) * (k == 63))) for k in range(64)))
        met = members.select("x", F.explode(flips).alias("middle")).groupBy("middle").agg(F.sort_array(F.collect_list("x")).alias("xs"))
        links = met.where(F.size("xs") > 1).select(F.col("xs")[0].alias("a"), F.explode(F.expr("slice(xs, 2, size(xs) - 1)")).alias("b"))
    verified = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    found = (
        rest.withColumnRenamed("x", "a")
        .join(entered.withColumnRenamed("x", "b").hint("merge"), (rest["key"] == entered["key"]) & (F.col("a") < F.col("b")) & verified)
        .select("a", "b")
    )
    return (found if links is None else found.unionByName(links)).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, crowd: int = CROWD) -> DataFrame:
    """(id, fingerprint, component_id) for each row; fingerprint as signed long.

    The shuffles carry ids and fingerprints, never texts.
    """
    prepare(df.sparkSession)
    marked = cut(df.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col).cast("string"), words).alias("fingerprint")), "fingerprints")
    least = cut(marked.groupBy("fingerprint").agg(F.min("id").alias("least")), "distinct")
    found = components(near_links(least.select(F.col("fingerprint").alias("fp")), crowd=crowd), "a", "b")
    rooted = least.join(found.hint("merge"), least["fingerprint"] == found["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(ids.hint("merge"), "root").select("fingerprint", "component_id"), "components")
    return marked.join(named.hint("merge"), "fingerprint").select("id", "fingerprint", "component_id")
