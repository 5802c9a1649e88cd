"""Connected components of an undirected link table, by alternating stars.

Each round first contracts what a task reads, ``AT_ONCE`` links at a time, to
stars of its own by union-find, without a shuffle. Then every node's larger
neighbours, and after that its smaller ones, are pointed at the least node seen
(large star, small star). This goes on until no link changes: a few rounds, with a
table in the shared folder between them and nothing on the driver but a count and
a checksum. Minima are aggregated before the shuffle; joins on a hub's key are
ordinary joins that adaptive execution may split.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.session import prepare
from loomwork.shared import cut, drop_table

#: Links that a task contracts together: bounds its memory.
AT_ONCE = 400_000


def stars(us: list[int], vs: list[int]) -> tuple[list[int], list[int]]:
    """The same components as (node, least node), by union-find with path halving."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            z = up.get(y, y)
            up[x] = z
            x = z
        return x

    for u, v in zip(us, vs, strict=True):
        a, b = find(u), find(v)
        if a < b:
            up[b] = a
        elif b < a:
            up[a] = b
    nodes = list(up)
    roots = [find(x) for x in nodes]
    kept = [k for k, (x, r) in enumerate(zip(nodes, roots, strict=True)) if x != r]
    return [nodes[k] for k in kept], [roots[k] for k in kept]


def _contract(batches):
    us: list[int] = []
    vs: list[int] = []

    def told():
        a, b = stars(us, vs)
        us.clear()
        vs.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])

    for batch in batches:
        us += batch.column(0).to_pylist()
        vs += batch.column(1).to_pylist()
        if len(us) >= AT_ONCE:
            yield told()
    if us:
        yield told()


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links``: (u, v) with u > v. Large: larger neighbours go to the least of all; small: the rest do."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least.hint("merge"), "u")  # never by way of the driver
    moved = joined.where("v > u") if large else joined
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node (a long) that has a link; root is the least node of its component.

    Null ends and links of a node to itself are ignored; an empty table gives an
    empty one.
    """
    prepare(links.sparkSession)
    now = cut(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "links",
    )
    state = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == state or not mark[0]:
            break
        state = mark
        contracted = cut(now.mapInArrow(_contract, "u long, v long"), "contracted")  # read several times below
        after = cut(_star(_star(contracted, True), False), "links")
        drop_table(contracted)
        drop_table(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
