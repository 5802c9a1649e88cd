"""Mixing sources to target weights by cube-method balanced sampling.

Targets share the total size by source weights; a source's target stops at
``cap`` times its size and the excess is shared again. A target of r times the
source's size takes every document floor(r) times; the fraction p that is left is
each document's inclusion probability for one copy more. The cube method's flight
moves these probabilities along the null space of the two balancing constraints
(documents and words), three units at a time, until all but two of a block are 0
or 1: both totals stay as they were. What each block leaves over meets in
further, much smaller rounds, and the last two units of a source are landed by
the least error in words.

Rows of equal id, source, size and content are one unit of n rows: together they are
taken floor(n p) times more for certain, and only the fraction that is left flies,
as one copy of one row. So repeated rows, ids and null ids come as near the target
as others do.

Blocks are cut by a hash of the unit within each source, so that a source with
any share of the rows is many tasks; a block holds about ``BLOCK`` units and no
text. Random numbers come from the block's own units: reruns agree, whatever the
partitioning.

Defined results: ids may be of any type that casts to a string and back; a null or
empty text has size 0 and takes part in the count of documents alone; sources go by
code point with null last; a source without words has target 0 and takes nothing; of
n equal rows the first ones, in any order, are taken once more than the rest. The
sources' totals (a row per source, not per document) are gathered on the driver.
"""

from __future__ import annotations

import math
import random

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.session import prepare
from loomwork.shared import cut

WEIGHTS = (1, 2, 3)
CAP = 3
BLOCK = 4096
#: Sources up to which their table is broadcast (below 1 MB); more are joined.
BROADCAST_SOURCES = 10_000
#: Copies of one row that a task writes before another takes over.
PIECE = 4096
CLOSE = 1e-9


def word_count(text: Column) -> Column:
    """Number of runs of characters other than the six ASCII white-space ones (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> list[float]:
    """Share the total by weight; none gets more than ``cap`` times its size."""
    left, out = set(range(len(sizes))), [0.0] * len(sizes)
    rest = float(sum(sizes))
    while left:
        unit = rest / sum(weights[k % len(weights)] for k in left)
        full = [k for k in left if unit * weights[k % len(weights)] > cap * sizes[k]]
        if not full:
            for k in left:
                out[k] = unit * weights[k % len(weights)]
            break
        for k in full:
            out[k] = float(cap * sizes[k])
            rest -= out[k]
            left.discard(k)
    return out


def flight(p: list[float], n: list[int], words: list[float], rng: random.Random) -> list[int]:
    """Move ``p`` in place, keeping sum(p * n) and sum(p * words); the units left between 0 and 1."""
    todo = [k for k in range(len(p)) if CLOSE < p[k] < 1 - CLOSE][::-1]
    hand: list[int] = []
    while True:
        while len(hand) < 3 and todo:
            hand.append(todo.pop())
        if len(hand) < 2:
            return hand
        if len(hand) == 3:
            (a, b, c), (x, y, z) = [n[k] for k in hand], [words[k] for k in hand]
            u = [b * z - c * y, c * x - a * z, a * y - b * x]
            if not any(u):
                u = [float(b), -float(a), 0.0]
        elif n[hand[0]] * words[hand[1]] == n[hand[1]] * words[hand[0]]:
            u = [float(n[hand[1]]), -float(n[hand[0]])]
        else:
            return hand
        scale = max(map(abs, u))
        u = [v / scale for v in u]
        up = min((1 - p[k]) / v if v > 0 else -p[k] / v for k, v in zip(hand, u, strict=True) if v)
        down = min(p[k] / v if v > 0 else (p[k] - 1) / v for k, v in zip(hand, u, strict=True) if v)
        step = up if rng.random() * (up + down) < down else -down
        for k, v in zip(hand, u, strict=True):
            p[k] += step * v
            p[k] = 0.0 if p[k] < CLOSE else 1.0 if p[k] > 1 - CLOSE else p[k]
        hand = [k for k in hand if 0 < p[k] < 1]


def land(p: list[float], n: list[int], words: list[float], open_units: list[int]) -> None:
    """Set the last units (two at most) to 0 or 1 by the least error in words, then in documents."""
    best = None
    for choice in range(1 << len(open_units)):
        moved = [(choice >> j & 1) - p[k] for j, k in enumerate(open_units)]
        error = (abs(sum(m * words[k] for m, k in zip(moved, open_units, strict=True))), abs(sum(m * n[k] for m, k in zip(moved, open_units, strict=True))), choice)
        best = min(best or error, error)
    for j, k in enumerate(open_units):
        p[k] = float(best[2] >> j & 1)


UNITS = T.StructType().add("id", "string").add("source", "string").add("size", "long").add("row", "long").add("n", "long").add("base", "long").add("p", "double").add("blocks", "long")


def _balance(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["row", "id", "size"], kind="stable", na_position="first")
    p = group["p"].tolist()
    words = [float(a) for a in group["size"].tolist()]
    first = group.iloc[0]
    order = list(range(len(p)))
    rng = random.Random(f"{first['source']}|{first['row']}|{len(p)}|{first['blocks']}")
    rng.shuffle(order)
    q, m, w = [p[k] for k in order], [1] * len(p), [words[k] for k in order]
    rest = flight(q, m, w, rng)
    if first["blocks"] == 1 and rest:
        land(q, m, w, rest)
    for k, value in zip(order, q, strict=True):
        p[k] = 0.0 if value < CLOSE else 1.0 if value > 1 - CLOSE else value
    group["p"] = p
    return group[UNITS.names]


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row."""
    plain = lambda f: F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f.name)
    return F.xxhash64(*(plain(f) for f in df.schema.fields))


def decide(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(id, source, size, row, n, source_size, target, base, copies) for each unit.

    ``n`` rows make the unit, ``row`` is the hash of their columns; each is taken
    ``base`` times and ``copies`` is the number of times they are taken together.
    """
    spark = prepare(df.sparkSession)
    units = cut(
        df.select(
            F.col(id_col).cast("string").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), row_hash(df).alias("row")
        )
        .groupBy("id", "source", "size", "row")
        .agg(F.count("*").alias("n")),
        "units",
    )
    rows = units.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.count("*").alias("units")).collect()
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    plan = []
    for r, target in zip(rows, targets([r["words"] for r in rows], weights, cap), strict=True):
        ratio = target / r["words"] if r["words"] else 0.0
        base = min(math.floor(ratio + CLOSE), math.floor(cap))
        share = ratio - base if ratio - base > CLOSE else 0.0
        plan.append((r["source"], r["words"], target, base, share, max(1, math.ceil(r["units"] / BLOCK))))
    kinds = {"of": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "each": pa.int64(), "share": pa.float64(), "blocks": pa.int64()}
    columns = [pa.array([row[k] for row in plan], kind) for k, kind in enumerate(kinds.values())]
    sources = spark.createDataFrame(pa.table(columns, names=list(kinds)))  # as Arrow it needs no Python worker
    sources = F.broadcast(sources) if len(plan) <= BROADCAST_SOURCES else sources
    extra = F.col("n") * F.col("share")
    sure = F.floor(extra + CLOSE)
    part = F.when(extra - sure > CLOSE, extra - sure).otherwise(0.0)
    started = units.join(sources, units["source"].eqNullSafe(sources["of"])).select(
        "id", "source", "size", "row", "n", (F.col("n") * F.col("each") + sure).cast("long").alias("base"), part.alias("p"), "blocks"
    )
    between = (F.col("p") > 0) & (F.col("p") < 1)
    done = [started.where(~between)]
    level = started.where(between)
    most = max((r[5] for r in plan), default=1)
    while True:
        block = F.pmod(F.xxhash64("row", "size"), F.col("blocks")).alias("block")
        level = cut(level.groupBy("source", "blocks", block).applyInPandas(_balance, UNITS), "balanced")
        done.append(level.where(~between))
        if most == 1:
            break
        most = max(1, math.ceil(2 * most / BLOCK))
        fewer = F.greatest(F.lit(1), F.ceil(2 * F.col("blocks") / BLOCK)).cast("long")
        level = level.where(between).withColumn("blocks", fewer)
    decided = done[0]
    for d in done[1:]:
        decided = decided.unionByName(d)
    return decided.join(sources, decided["source"].eqNullSafe(sources["of"])).select(
        F.col("id").cast(df.schema[id_col].dataType).alias("id"), "source", "size", "row", "n", "source_size", "target", F.col("each").alias("base"), (F.col("base") + F.col("p").cast("long")).alias("copies")
    )


def per_row(decided: DataFrame) -> DataFrame:
    """One row per input row, ``copies`` being its own: equal rows are told out again, many at a time."""
    step = 65536
    parts = decided.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / step))))
    begin = F.col("part") * step
    each = parts.withColumn("k", F.explode(F.sequence(begin + 1, F.least(begin + step, F.col("n")))))
    more = (F.col("k") <= F.col("copies") - F.col("n") * F.col("base")).cast("long")
    return each.withColumn("copies", F.col("base") + more).drop("part", "row", "n", "k", "base")


def _told_out(rows: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    every = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return every.select(*(F.col(n).alias(c) for n, c in zip(names, columns, strict=True)))


def mixed(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """The mix itself: every row of ``df`` as many times as it is taken.

    Rows that come once meet their number in a join. Equal rows are brought down to
    one before they are moved, and dealt out again in pieces of ``PIECE`` copies.
    """
    decided = decide(df, id_col, source_col, text_col, weights, cap).where("copies > 0")
    told = decided.select(F.col("id").cast("string").alias("__id"), F.col("source").alias("__source"), F.col("row").alias("__of"), F.col("n").alias("__n"), F.col("copies").alias("__copies"))
    names = [f"__c{k}" for k in range(len(df.columns))]
    rows = df.select(
        row_hash(df).alias("__row"), F.col(id_col).cast("string").alias("__i"), F.col(source_col).cast("string").alias("__s"), *(F.col(c).alias(n) for c, n in zip(df.columns, names, strict=True))
    )
    same = rows["__row"].eqNullSafe(F.col("__of")) & rows["__i"].eqNullSafe(F.col("__id")) & rows["__s"].eqNullSafe(F.col("__source"))
    several = told.where("__n > 1")
    single = rows.join(told.where("__n = 1"), same).select("__copies", *names)
    if several.isEmpty():  # one pass over the rows where all differ
        return _told_out(single, names, df.columns)
    one = rows.join(several, same).groupBy("__of", "__id", "__source", "__copies").agg(F.first(F.struct(*names)).alias("r"))
    pieces = one.select("r.*", "__of", "__copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__copies") - 1) / PIECE))).alias("__piece"))
    pieces = pieces.repartition("__of", "__piece").withColumn("__copies", F.least(F.lit(PIECE).cast("long"), F.col("__copies") - F.col("__piece") * PIECE))
    return _told_out(single.unionByName(pieces.select("__copies", *names)), names, df.columns)
