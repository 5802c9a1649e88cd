"""Near copies of whole texts: SimHash groups, completed by an exact join of shingle sets.

The similarity of two texts is the Jaccard similarity of their sets of five-word
shingles, compared as 64-bit hashes. Two ways propose pairs, and only exact
similarity accepts them; what is linked becomes one group.

First, the SimHashes of the shingles are linked by Golay keys (``simhash``): most
edited copies meet there.

Second, since SimHashes of 64 bits miss some pairs at the threshold, a prefix filter
proposes the rest. Two sets of similarity t or more share a shingle among the first
n - ceil(t n) + 1 of each, in any order common to all texts. So a text is entered under
these shingles only, and no pair at or above t is missed, whatever its words look
like. The order puts shingles first that a sample does not show to be common, and the
common ones last, by their number; the sample decides the order, never a result. An
entry carries the shingle's rank and the set's size: a pair is a candidate where what
is left behind both ranks can reach t (position filter; it holds at the first common
shingle of every pair at or above t).

Before any text is moved, a candidate is tested by odd sketches: a bit set of about as
many bits as the set has shingles, in which each shingle flips one. Two sketches
differ in no more bits than the sets differ in shingles, so what they rule out cannot
be similar, and nothing else is ruled out.

Candidates are verified in two rounds, so that a group of m copies costs about m
verifications and not their square. In the first, the texts under a key are compared
with its hub, the text that has least in front of the shingle (an original has less
of its own than its edited copies); large keys have several hubs. What is
linked is joined to groups. In the second, all pairs of a key that lie in different groups,
that short sketches do not rule out and that were not compared yet are verified; a pair
within one group can change nothing.

Defined results: texts are compared lower-cased (A-Z); null is the empty text;
equal texts are always one group; fewer than five words make one shingle of what
there is. Of each group one row stays: the one of the least (doc_id, text hash),
null ids first; of repeated rows any one. All columns are kept. An empty table gives
an empty one.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm import caches, simhash
from loomwork.llm.components import components
from loomwork.llm.simhash import LOWER
from loomwork.session import prepare
from loomwork.shared import cut, drop_table

WORDS = 5
SIMILARITY = 0.8
#: Texts under one key beyond which it has several hubs, and their number.
CROWD = 32
HUBS = 3
#: Texts that the order of shingles is learnt from, sightings that make a shingle
#: common, and how many common ones are told to the tasks.
SAMPLE = 8_000
COMMON = 4
MOST_COMMON = 100_000
#: Entries and pairs that a task holds at a time, beyond the entries of one key;
#: bytes of text hashed together; texts a task remembers having entered.
AT_ONCE = 1 << 16
BYTES_AT_ONCE = 1 << 17
REMEMBERED = 200_000
#: Bits of the short sketches.
SHORT = 512
EPS = 1e-9

#: The six ASCII white-space bytes; a random number for each byte; odd multipliers.
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_DRAWN = np.random.default_rng(20240607)
BYTE_VALUES = _DRAWN.integers(1, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
PLACES = _DRAWN.integers(1, 1 << 64, 16, dtype=np.uint64) | np.uint64(1)
MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the number."""
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and hash of each word of a byte array, a piece up to some white space at a time."""
    found, low = [], 0
    while low < len(data):
        high = low + BYTES_AT_ONCE
        while high < len(data) and not SPACES[data[high : high + BYTES_AT_ONCE]].any():
            high += BYTES_AT_ONCE
        high = min(len(data), high + int(SPACES[data[high : high + BYTES_AT_ONCE]].argmax()) + 1) if high < len(data) else len(data)
        begins, hashes = _hashes_of_piece(data[low:high])
        found.append((begins + low, hashes))
        low = high
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _hashes_of_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.flatnonzero(~SPACES[data])
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(np.diff(inside, prepend=-2) != 1)
    lengths = np.diff(first, append=len(inside))
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), STEP), dtype=np.uint64)
    sums = np.add.reduceat(BYTE_VALUES[data[inside]] * powers[place], first)
    return inside[first], _mixed(sums + lengths.astype(np.uint64))


def shingle_batch(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The hashes of all shingles of each text, repeats included, in their order."""
    caches.use("neardup")
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0

    def told() -> None:
        ends = np.cumsum([len(h) + 1 for h in held])
        begins, hashes = _word_hashes(np.frombuffer(b"\n".join(held) + b"\n", dtype=np.uint8))
        n = max(0, len(hashes) - words + 1)
        whole = _mixed(sum((hashes[k : k + n] * PLACES[k % 16] for k in range(words)), np.zeros(n, np.uint64)))
        edges = np.searchsorted(begins, np.concatenate([[0], ends]))
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if z - a >= words:
                out.append(whole[a : z - words + 1])
            else:  # one shingle of what there is
                few = sum((hashes[a + k] * PLACES[k % 16] for k in range(z - a)), np.zeros(1, np.uint64))
                out.append(_mixed(few + np.uint64(words - z + a)))
        held.clear()

    with np.errstate(over="ignore"):
        for text in texts:
            held.append((text or "").encode("utf-8").translate(LOWER))
            size += len(held[-1])
            if size >= BYTES_AT_ONCE:
                told()
                size = 0
        if held:
            told()
    return out


def shingle_hashes(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted signed hashes."""
    return [np.unique(h.view(np.int64)) for h in shingle_batch(texts, words)]


def odd_sketch(hashes: np.ndarray) -> bytes:
    """Parity of the number of a set's hashes in each of 2^k >= n buckets, at least ``SHORT``, as bits."""
    buckets = max(SHORT, 1 << (len(hashes) - 1).bit_length())
    at = (hashes & np.int64(buckets - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=buckets) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch of fewer buckets: those of the upper half fall on those of the lower."""
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def may_be_similar(size_a: int, a: bytes, size_b: int, b: bytes, similarity: float) -> bool:
    """False only if sets with these sketches cannot have the similarity."""
    x, y = (np.frombuffer(s, dtype=np.uint64) for s in (a, b))
    words = min(len(x), len(y))
    differing = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
    return differing <= (1 - similarity) / (1 + similarity) * (size_a + size_b) + EPS


def prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """The first shingles of a set in the order of all: those not in ``common``, then those in it as listed there."""
    n = len(hashes)
    taken = n - math.ceil(similarity * n - EPS) + 1
    listed, rank = common
    if not len(listed):
        return hashes[:taken]
    at = np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)
    late = np.where(listed[at] == hashes, rank[at], -1)
    return hashes[np.argsort(late, kind="stable")[:taken]]


def _told(common: list[int]) -> tuple[np.ndarray, np.ndarray]:
    listed = np.array(common, dtype=np.int64)
    rank = np.argsort(listed)
    return listed[rank], rank


def _hashes_column(text: Column, words: int) -> Column:
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(shingle_hashes(texts.to_pylist(), words), pa.list_(pa.int64()))

    return run(text)


MARKS = T.StructType().add("fp", "long").add("size", "integer").add("sketch", "binary").add("short", "binary")


def _marks_column(text: Column, words: int) -> Column:
    """SimHash of the shingles (repeats included), number of distinct ones, and their odd sketches."""

    @F.arrow_udf(MARKS)
    def run(texts: pa.Array) -> pa.Array:
        every = shingle_batch(texts.to_pylist(), words)
        sets = [np.unique(h.view(np.int64)) for h in every]
        prints = [simhash.majority(h.astype(">u8").view(np.uint8).reshape(-1, 8)) for h in every]
        sketches = [odd_sketch(s) for s in sets]
        short = [folded(np.frombuffer(s, dtype=np.uint64), SHORT // 64).tobytes() for s in sketches]
        columns = [pa.array(prints, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(sketches, pa.binary()), pa.array(short, pa.binary())]
        return pa.StructArray.from_arrays(columns, MARKS.names)

    return run(text)


def _possible_column(similarity: float, *columns: str) -> Column:
    @F.arrow_udf(T.BooleanType())
    def run(size_a: pa.Array, a: pa.Array, size_b: pa.Array, b: pa.Array) -> pa.Array:
        rows = zip(size_a.to_pylist(), a.to_pylist(), size_b.to_pylist(), b.to_pylist(), strict=True)
        return pa.array([may_be_similar(*r, similarity) for r in rows], pa.bool_())

    return run(*map(F.col, columns))


def _entries(batches, common, similarity: float, words: int):
    """(key, node, place) of each text's prefix; place holds the set's size and the rank. Texts just entered are left out."""
    entered: set[int] = set()
    for batch in batches:
        nodes, texts = [], []
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node not in entered:
                if len(entered) >= REMEMBERED:
                    entered.clear()
                entered.add(node)
                nodes.append(node)
                texts.append(text)
        sets = shingle_hashes(texts, words)
        keys = [prefix(h, common.value, similarity) for h in sets]
        if keys:
            sizes = [len(k) for k in keys]
            place = np.repeat([len(h) << 32 for h in sets], sizes) + np.concatenate([np.arange(n) for n in sizes])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(nodes, sizes)), pa.array(place)], ["key", "node", "place"])


def common_shingles(hashed: DataFrame, words: int = WORDS, sample: int = SAMPLE) -> list[int]:
    """Shingles seen ``COMMON`` times or more in about ``sample`` texts, the most frequent last."""
    total = hashed.count()
    drawn = hashed.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < math.ceil(min(1.0, sample / max(1, total)) * 1_000_000))
    seen = drawn.select(F.explode_outer(_hashes_column(F.col("text"), words)).alias("key")).groupBy("key").count()
    most = seen.where(F.col("count") >= COMMON).orderBy(F.desc("count"), "key").limit(MOST_COMMON).collect()
    return [r["key"] for r in reversed(most)]


def reaches(size_a, at_a, size_b, at_b, similarity: float):
    """Whether two sets can have ``similarity`` if the shingles at these ranks are their first common ones."""
    need = similarity / (1 + similarity) * (size_a + size_b) - EPS
    return np.minimum(size_a - at_a, size_b - at_b) >= need


def _runs(batches):
    """Columns of whole keys, from batches sorted by key (the first column)."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows += batch.num_rows
        if rows >= AT_ONCE:
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = int(np.searchsorted(whole[0], whole[0][-1]))  # the last key may go on
            if last:
                yield [c[:last] for c in whole]
            held, rows = [[c[last:] for c in whole]], len(whole[0]) - last
    if rows:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _bounds(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return starts, np.diff(np.concatenate([starts, [len(key)]]))


def _met(batches):
    """The entries, sorted by key and node, of keys that several texts have, with the key's hubs.

    Hubs stand in the column ``hubs``, least in front first.
    """
    for key, node, place in _runs(batches):
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])  # copies of a text
        key, node, place = key[fresh], node[fresh], place[fresh]
        starts, lengths = _bounds(key)
        shared = np.repeat(lengths > 1, lengths)
        if not shared.any():
            continue
        key, node, place = key[shared], node[shared], place[shared]
        size, at = place >> 32, place & 0xFFFFFFFF
        starts, lengths = _bounds(key)
        run = np.repeat(np.arange(len(starts)), lengths)
        order = np.lexsort((node, -size, at, run))
        ranked = np.empty(len(order), dtype=np.int64)
        ranked[order] = np.arange(len(order)) - np.repeat(starts, lengths)
        hub = ranked < np.repeat(np.where(lengths > CROWD, HUBS, 1), lengths)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(place), pa.array(hub)], ["key", "node", "place", "hub"])


def _pairs_with_hubs(batches, similarity: float):
    """Candidates (a, b) of the hubs, from met entries in order of their keys."""
    for key, node, place, hub in _runs(batches):
        size, at = place >> 32, place & 0xFFFFFFFF
        starts, lengths = _bounds(key)
        run = np.repeat(np.arange(len(starts)), lengths)
        centres = np.flatnonzero(hub)
        repeats = lengths[run[centres]]
        one = np.repeat(centres, repeats)
        two = np.arange(len(one)) - np.repeat(np.cumsum(repeats) - repeats, repeats) + starts[run[one]]
        ok = (node[one] != node[two]) & reaches(size[one], at[one], size[two], at[two], similarity)
        yield _told_pairs(node[one[ok]], node[two[ok]])


def _told_pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _across(batches, similarity: float):
    """Candidates (a, b) of each key that lie in different groups and whose short sketches allow it."""
    share = (1 - similarity) / (1 + similarity)
    for key, node, place, root, short in _runs(batches):
        size, at = place >> 32, place & 0xFFFFFFFF
        sketch = np.frombuffer(b"".join(short), dtype=np.uint64).reshape(len(key), -1)
        starts, lengths = _bounds(key)
        mixed = np.minimum.reduceat(root, starts) < np.maximum.reduceat(root, starts)
        found, held = [], 0
        for a, length in zip(starts[mixed].tolist(), lengths[mixed].tolist(), strict=True):
            z = a + length
            rows = max(1, AT_ONCE // length)
            for low in range(a, z, rows):
                x, y = slice(low, min(low + rows, z)), slice(low, z)
                ok = reaches(size[x, None], at[x, None], size[None, y], at[None, y], similarity) & (root[x, None] != root[None, y])
                i, j = (k + low for k in np.nonzero(ok))
                near = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64) <= share * (size[i] + size[j]) + EPS
                found.append((node[i[near]], node[j[near]]))
                held += int(near.sum())
                if held >= AT_ONCE:
                    yield _told_pairs(*(np.concatenate(c) for c in zip(*found, strict=True)))
                    found, held = [], 0
        if held:
            yield _told_pairs(*(np.concatenate(c) for c in zip(*found, strict=True)))


def similar(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> list[bool]:
    """Whether the pairs of sets (sorted hashes) have the Jaccard similarity."""
    out = []
    for s, t in zip(left, right, strict=True):
        both = np.concatenate([s, t])
        both.sort(kind="stable")  # of two runs: a merge
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        out.append(common >= similarity * (len(s) + len(t) - common) - EPS)
    return out


def similar_column(a: Column, b: Column, similarity: float, words: int = WORDS) -> Column:
    """Whether two texts are similar; each text of a batch is hashed once."""

    @F.arrow_udf(T.BooleanType())
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        left, right = left.to_pylist(), right.to_pylist()
        every = list(dict.fromkeys([*left, *right]))
        sets = dict(zip(every, shingle_hashes(every, words), strict=True))
        return pa.array(similar([sets[x] for x in left], [sets[x] for x in right], similarity), pa.bool_())

    return run(a, b)


def _verified(hashed: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float, words: int) -> DataFrame:
    """The ``pairs`` (a table; a, b) of texts at or above ``similarity``, as a table."""
    one = nodes.select(F.col("node").alias("a"), F.col("size").alias("sa"), F.col("sketch").alias("x"))
    two = nodes.select(F.col("node").alias("b"), F.col("size").alias("sb"), F.col("sketch").alias("y"))
    possible = cut(pairs.join(one, "a").join(two, "b").where(_possible_column(similarity, "sa", "x", "sb", "y")).select("a", "b"), "possible")
    # tables, so that their size is known: a small one is broadcast, and then no text is moved but those wanted
    wanted = cut(possible.select("a").union(possible.select("b")).distinct().withColumnRenamed("a", "node"), "wanted")
    texts = cut(hashed.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("x")), texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    links = cut(possible.join(left, "a").join(right, "b").where(similar_column(F.col("x"), F.col("y"), similarity, words)).select("a", "b"), "verified")
    for spent in (possible, wanted, texts):
        drop_table(spent)
    return links


def near_links(hashed: DataFrame, nodes: DataFrame, entries: DataFrame, proposed: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """(node, root) for every text with a near copy.

    ``nodes`` is (node, size, sketch, short), ``entries`` (key, node, place); ``proposed`` (a, b) are pairs found in another way.
    """
    dealt = entries.repartition("key").sortWithinPartitions("key", "node")
    met = cut(dealt.mapInArrow(_met, "key long, node long, place long, hub boolean"), "met")
    sorted_met = met.repartition("key").sortWithinPartitions("key")
    stars = sorted_met.mapInArrow(partial(_pairs_with_hubs, similarity=similarity), "a long, b long")
    ordered = proposed.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = cut(stars.unionByName(ordered).distinct(), "pairs")
    links = _verified(hashed, nodes, pairs, similarity, words)
    roots = cut(components(links, "a", "b"), "roots")
    named = nodes.select("node", "short").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "short")
    grouped = met.select("key", "node", "place").join(named, "node").select("key", "node", "place", "root", "short")
    across = grouped.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_across, similarity=similarity), "a long, b long")
    more = cut(across.distinct().join(pairs, ["a", "b"], "left_anti"), "across")
    for spent in (met, pairs):
        drop_table(spent)
    if more.isEmpty():
        return roots
    again = _verified(hashed, nodes, more, similarity, words)
    return cut(components(again.unionByName(roots.toDF("a", "b")), "a", "b"), "roots")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """(node, root, keeper_node, keeper_id, rows, texts) for every distinct text; node is its 64-bit
    hash, rows the number of rows with the keeper's text and id, texts the group's distinct texts."""
    spark = prepare(df.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("node"), text.alias("text"))
    marked = cut(hashed.select("id", "node", _marks_column(F.col("text"), words).alias("m")).select("id", "node", "m.*"), "marked")
    counted = marked.groupBy("node", "id").agg(F.count("*").alias("n"), F.first(F.struct("fp", "size", "sketch", "short")).alias("m"))
    least = F.min(F.struct(F.col("id").isNotNull().alias("has"), "id", "n"))
    nodes = cut(counted.groupBy("node").agg(F.first("m").alias("m"), least.alias("least")).select("node", "m.*", "least"), "nodes")
    # texts of one SimHash meet its least text, and the least texts of near SimHashes each other
    firsts = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    near = simhash.near_links(firsts.select("fp")).toDF("x", "y")
    one, two = firsts.toDF("x", "a"), firsts.toDF("y", "b")
    proposed = near.join(one, "x").join(two, "y").select("a", "b")
    proposed = proposed.unionByName(nodes.join(firsts, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")))
    common = spark.sparkContext.broadcast(_told(common_shingles(hashed, words)))  # bounded by MOST_COMMON
    entries = hashed.select("node", "text").mapInArrow(partial(_entries, common=common, similarity=similarity, words=words), "key long, node long, place long")
    roots = near_links(hashed, nodes, entries, proposed, similarity, words).select(F.col("node").alias("n"), "root")
    rooted = nodes.join(roots, nodes["node"] == roots["n"], "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    keepers = rooted.groupBy("root").agg(F.min(F.struct("least", "node")).alias("keeper"), F.count("*").alias("texts"))
    out = rooted.join(keepers, "root").select(
        "node", "root", F.col("keeper.node").alias("keeper_node"), F.col("keeper.least.id").alias("keeper_id"), F.col("keeper.least.n").alias("rows"), "texts"
    )
    out = cut(out, "groups")
    for spent in (marked, nodes, firsts):
        drop_table(spent)
    return out


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """``df`` with one row of each group of equal or similar texts."""
    groups = near_groups(df, id_col, text_col, similarity, words)
    keep = cut(groups.where("node = keeper_node").select(F.col("keeper_node").alias("__node"), F.col("keeper_id").alias("__id"), F.col("rows").alias("__rows")), "keep")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    same = (F.xxhash64(text) == F.col("__node")) & df[id_col].eqNullSafe(F.col("__id"))
    columns = [df[c] for c in df.columns]
    kept = df.join(keep.where("__rows = 1"), same).select(*columns)
    repeated = keep.where("__rows > 1")
    if repeated.isEmpty():
        return kept
    return kept.unionByName(df.join(repeated, same).dropDuplicates(["__node"]).select(*columns))
