"""Fusing findings of many rules into one conflict-free list of edits per document.

Validation, ranking and merging are relational. Only the greedy choice among
overlapping edits is sequential: it runs per cluster of overlapping spans, which
gaps-and-islands find first, so a document of any length is many small groups.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRIORITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def confidence(weights: dict[str, float] | None = None) -> Column:
    """Score times the source's weight, inside 0 to 1."""
    weight = F.lit(1.0)
    for source, w in (weights or {}).items():
        weight = F.when(F.col("source") == source, F.lit(w)).otherwise(weight)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") * weight))


def validated(suggestions: DataFrame, texts: DataFrame) -> DataFrame:
    """Add ``rejection``: INVALID_RANGE, NO_OP or DUPLICATE, or null. Of equal edits the surest stays."""
    joined = suggestions.join(texts.select("doc_id", "text"), "doc_id")
    original = F.substring(F.col("text"), F.col("char_start").cast("int") + 1, (F.col("char_end") - F.col("char_start")).cast("int"))
    outside = (F.col("char_start") < 0) | (F.col("char_end") < F.col("char_start")) | (F.col("char_end") > F.char_length("text"))
    first = F.when(outside, "INVALID_RANGE").when(F.col("replacement").isNotNull() & (F.col("replacement") == original), "NO_OP")
    marked = joined.withColumn("rejection", first).drop("text")
    same = Window.partitionBy("doc_id", "char_start", "char_end", "source", "replacement", F.col("rejection").isNull()).orderBy("message", F.desc("score"))
    again = F.when(F.col("rejection").isNull() & (F.row_number().over(same) > 1), "DUPLICATE").otherwise(F.col("rejection"))
    return marked.withColumn("rejection", again)


def rank_order() -> list[Column]:
    """Order of findings: priority, confidence, place, source, edits before advice."""
    level = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority"))
    return [level, F.desc("confidence"), F.col("char_start"), F.col("char_end"), F.col("source"), F.col("replacement").isNull().cast("int"), F.col("replacement"), F.col("message")]


def clustered(edits: DataFrame) -> DataFrame:
    """Add ``cluster``: islands of touching or overlapping spans of a document."""
    order = Window.partitionBy("doc_id").orderBy("char_start", "char_end")
    until = F.max("char_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(until.isNull() | (F.col("char_start") > until), 1).otherwise(0)
    return edits.withColumn("__new", fresh).withColumn("cluster", F.sum("__new").over(order)).drop("__new")


def conflicts(a_start: int, a_end: int, b_start: int, b_end: int) -> bool:
    """Overlap of half-open spans; an insertion clashes with one at the same place, and with a span that holds its place."""
    if a_start == a_end and b_start == b_end:
        return a_start == b_start
    if a_start == a_end:
        return b_start <= a_start < b_end
    if b_start == b_end:
        return a_start <= b_start < a_end
    return a_start < b_end and b_start < a_end


def chosen(starts: list[int], ends: list[int]) -> list[int]:
    """Greedy choice in rank order: for each edit -1 if it is clear of all that were taken before it, else the first of those it clashes with.

    Taken spans clash with none of each other, so those that may clash with an edit are
    the one that starts before it and those that start inside it.
    """
    taken: list[tuple[int, int, int]] = []
    out = []
    for k, (start, end) in enumerate(zip(starts, ends, strict=True)):
        at = bisect_left(taken, (start, -1, -1))
        near = taken[max(0, at - 1) : at]
        while at < len(taken) and taken[at][0] <= end:
            near.append(taken[at])
            at += 1
        clashes = [p for a, b, p in near if conflicts(start, end, a, b)]
        if not clashes:
            insort(taken, (start, end, k))
        out.append(min(clashes, default=-1))
    return out


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _chosen(starts: pa.Array, ends: pa.Array) -> pa.Array:
    return pa.array([chosen(a, b) for a, b in zip(starts.to_pylist(), ends.to_pylist(), strict=True)], pa.list_(pa.int32()))


def resolved(suggestions: DataFrame) -> DataFrame:
    """The valid findings with ``rejection`` SUPERSEDED where a better edit overlaps, and ``superseded_by``, that edit's position; advice never clashes."""
    order = Window.partitionBy("doc_id").orderBy(*rank_order())
    rows = suggestions.where("rejection is null").withColumn("position", F.row_number().over(order))
    edits = clustered(rows.where("replacement is not null"))
    names = [c for c in rows.columns if c not in ("position", "rejection")]
    islands = edits.groupBy("doc_id", "cluster").agg(F.sort_array(F.collect_list(F.struct("position", *names))).alias("e"))
    judged = islands.select("e", _chosen(F.col("e.char_start"), F.col("e.char_end")).alias("by"))
    winner = F.when(F.col("z.by") >= 0, F.element_at("e", F.col("z.by") + 1)["position"])
    told = judged.select("e", F.explode_outer(F.arrays_zip("e", "by")).alias("z")).select("z.e.*", F.when(F.col("z.by") >= 0, "SUPERSEDED").alias("rejection"), winner.alias("superseded_by"))
    advice = rows.where("replacement is null").withColumn("superseded_by", F.lit(None).cast("int"))
    return told.select(*rows.columns, "superseded_by").unionByName(advice)


def fuse(suggestions: DataFrame, texts: DataFrame, weights: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranked, rejected, operations): the findings that stand in order of ``position``, the others with the reason, and the edits of each document."""
    valid = validated(suggestions, texts).withColumn("confidence", confidence(weights))
    judged = resolved(valid)
    stand = judged.where("rejection is null")
    columns = [c for c in valid.columns if c != "rejection"]
    gone = valid.where("rejection is not null").select(*columns, "rejection", F.lit(None).cast("int").alias("superseded_by"))
    return stand.drop("rejection", "superseded_by"), gone.unionByName(judged.where("rejection is not null").select(*columns, "rejection", "superseded_by")), merged(stand.where("replacement is not null"))


def merged(edits: DataFrame) -> DataFrame:
    """Edits of which one ends where the next starts become one; pure insertions stay apart."""
    order = Window.partitionBy("doc_id").orderBy("char_start", "char_end")
    joins = (F.lag("char_end").over(order) == F.col("char_start")) & (F.col("char_end") > F.col("char_start")) & (F.lag("char_start").over(order) < F.lag("char_end").over(order))
    rows = edits.withColumn("__run", F.when(joins, 0).otherwise(1)).withColumn("run", F.sum("__run").over(order))
    parts = F.sort_array(F.collect_list(F.struct("char_start", "char_end", "replacement", "source")))
    out = rows.groupBy("doc_id", "run").agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), parts.alias("p"))
    return out.select("doc_id", "char_start", "char_end", F.array_join("p.replacement", "").alias("replacement"), F.array_join(F.array_distinct("p.source"), "+").alias("sources"))


def applied(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """The documents with their (disjoint) edits spliced in."""
    grouped = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("char_start", "char_end", "replacement"))).alias("ops"))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, op: Column) -> Column:
        kept = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (op["char_start"] - acc["at"]).cast("int"))
        return F.struct(F.concat(acc["out"], kept, F.coalesce(op["replacement"], F.lit(""))).alias("out"), op["char_end"].alias("at"))

    none = F.array().cast(grouped.schema["ops"].dataType)
    joined = texts.join(grouped, "doc_id", "left").withColumn("ops", F.coalesce("ops", none))
    spliced = F.aggregate("ops", begin, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.char_length("text"))))
    return joined.select("doc_id", spliced.alias("text"))


def conflict_pairs(edits: DataFrame) -> DataFrame:
    """(doc_id, a, b): findings that overlap within a document, by id."""
    rows = clustered(edits)  # spans that overlap lie in one island
    one = rows.select("doc_id", "cluster", F.col("edit_id").alias("a"), F.col("char_start").alias("a_start"), F.col("char_end").alias("a_end"))
    two = rows.select("doc_id", "cluster", F.col("edit_id").alias("b"), F.col("char_start").alias("b_start"), F.col("char_end").alias("b_end"))
    return one.join(two, ["doc_id", "cluster"]).where("a < b and a_start < b_end and b_start < a_end and a_start < a_end and b_start < b_end").select("doc_id", "a", "b")
