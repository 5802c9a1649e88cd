"""Quality metrics: confusion matrices, summaries, samples, text scores."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def confusion(df: DataFrame, wanted: str, said: str) -> DataFrame:
    """One row of counts and rates; a rate over nothing is null."""
    w, s = F.col(wanted), F.col(said)
    out = df.agg(F.count_if(w & s).alias("tp"), F.count_if(~w & s).alias("fp"), F.count_if(w & ~s).alias("fn"), F.count_if(~w & ~s).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    rate = lambda a, b: F.round(F.try_divide(a, b), 6)
    agreed = F.try_divide(tp + tn, n)
    chance = F.try_divide(tp + fp, n) * F.try_divide(tp + fn, n) + F.try_divide(fn + tn, n) * F.try_divide(fp + tn, n)
    return out.withColumns(
        {
            "accuracy": rate(tp + tn, n), "prec": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "f1": rate(2 * tp, 2 * tp + fp + fn), "specificity": rate(tn, tn + fp), "fpr": rate(fp, fp + tn),
            "fnr": rate(fn, fn + tp), "mcc": rate(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), "kappa": rate(agreed - chance, 1 - chance),
        }
    )


def by_kind(df: DataFrame, kind: str, wanted: str, said: str) -> DataFrame:
    """Counts of each kind: rows, said, wanted, and where both agree."""
    return df.groupBy(kind).agg(F.count("*").alias("total"), F.count_if(said).alias("emitted"), F.count_if(wanted).alias("gold"), F.count_if(F.col(wanted) == F.col(said)).alias("exact"))


def summary(df: DataFrame, group: str, value: str, trim: bool = True) -> DataFrame:
    """Mean, quantiles, spread and confidence interval of each group, from five values on without its least and its greatest.

    Values are counted first, so that a group of any size is a row for each distinct value.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    order = Window.partitionBy(group).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumn("until", F.sum("c").over(order)).withColumn("all", F.sum("c").over(Window.partitionBy(group)))
    cut = F.when((F.col("all") >= 5) & F.lit(trim), 1).otherwise(0)
    low = F.greatest(F.col("until") - F.col("c"), cut)
    high = F.least(F.col("until"), F.col("all") - cut)
    kept = rows.withColumns({"cut": cut, "low": low - cut, "high": high - cut, "n": F.col("all") - 2 * cut, "c": high - low}).where("c > 0")
    at = lambda place: F.max(F.when((F.col("low") <= place) & (place < F.col("high")), F.col("v")))
    n = F.col("n")
    half = F.floor(n / 2)
    share = lambda q: F.least(F.floor(n * q), n - 1)
    out = kept.groupBy(group, "n").agg(
        F.min("v").alias("least"), F.max("v").alias("most"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"),
        F.when(n % 2 == 1, at(half).cast("double")).otherwise((at(half) + at(half - 1)) / 2).alias("median"), at(share(0.95)).alias("p95"), at(share(0.99)).alias("p99"),
        (at(F.floor(3 * n / 4)) - at(F.floor(n / 4))).alias("iqr"), F.collect_list(F.struct("v", "c")).alias("values"),
    )
    square = F.aggregate("values", F.lit(0.0), lambda s, x: s + (x["v"] - F.col("mean")) * (x["v"] - F.col("mean")) * x["c"])
    deviation = F.when(n > 1, F.sqrt(square / (n - 1))).otherwise(0.0)
    margin = 1.96 * F.col("deviation") / F.sqrt(n)
    return out.withColumn("deviation", deviation).select(
        group, "n", "least", "most", F.round("mean", 6).alias("mean"), "median", "p95", "p99", F.round("deviation", 4).alias("deviation"), "iqr",
        F.round(F.col("mean") - margin, 4).alias("ci_lower"), F.round(F.col("mean") + margin, 4).alias("ci_upper"),
    )


def running(df: DataFrame, group: str, value: str) -> DataFrame:
    """Requests of each group: their number, sum and mean."""
    return df.groupBy(group).agg(F.count("*").alias("requests"), F.sum(value).alias("total"), F.round(F.avg(value), 6).alias("average"))


def stride(df: DataFrame, order: str, n: int) -> DataFrame:
    """``n`` rows at equal distances in an order.

    Places are counted within ranges and over the ranges, so that no task sees all rows.
    """
    total = df.count()
    step = max(1, total // n)
    dealt = df.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id())
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = sizes.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__part").orderBy(order)
    placed = dealt.withColumn("__i", F.row_number().over(inside) - 1).join(F.broadcast(offsets), F.col("__part") == F.col("__p"))
    place = F.col("__i") + F.col("__offset")
    return placed.where((place % step == 0) & (place < step * n)).drop("__part", "__p", "__offset", "__i")


def edits(a: list, b: list) -> int:
    """Insertions, deletions and replacements between two sequences, a diagonal-free row at a time by numpy."""
    kinds = {x: k for k, x in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.array([kinds[v] for v in s], dtype=np.int64) for s in (a, b))
    row = np.arange(len(y) + 1)
    places = np.arange(len(y) + 1)
    for i, v in enumerate(x, 1):
        fresh = np.empty(len(y) + 1, dtype=np.int64)
        fresh[0] = i
        np.minimum(row[:-1] + (y != v), row[1:] + 1, out=fresh[1:])
        row = np.minimum.accumulate(fresh - places) + places  # insertions run along the row
    return int(row[-1])


def subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    kinds = {x: k for k, x in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.array([kinds[v] for v in s], dtype=np.int64) for s in (a, b))
    row = np.zeros(len(y) + 1, dtype=np.int64)
    for v in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], (row[:-1] + 1) * (y == v)))
    return int(row[-1])


def tokens(text: str) -> list[str]:
    """Words between white space and marks; marks are tokens themselves."""
    return [t for t in re.split(r"([་\s\n།])", text) if t and t.strip()] or ([text] if text else [])


def _shared(a: list, b: list, n: int) -> tuple[int, int, int]:
    x, y = (Counter(tuple(s[k : k + n]) for k in range(len(s) - n + 1)) for s in (a, b))
    return sum((x & y).values()), sum(x.values()), sum(y.values())


def chrf(ref: str, said: str, most: int = 6, beta: float = 2.0) -> float:
    if ref == said or not ref or not said:
        return float(ref == said)
    p, r = [], []
    for n in range(1, most + 1):
        hit, a, b = _shared(list(ref), list(said), n)
        if a and b:
            p.append(hit / b)
            r.append(hit / a)
    precision, recall = (sum(s) / len(s) if s else 0.0 for s in (p, r))
    return (1 + beta**2) * precision * recall / (beta**2 * precision + recall) if precision + recall else 0.0


def bleu(ref: str, said: str, most: int = 4, smooth: float = 0.1) -> float:
    a, b = tokens(ref), tokens(said)
    if not a or not b or ref == said:
        return float(bool(a and b))
    logs = 0.0
    for n in range(1, most + 1):
        hit, x, y = _shared(a, b, n)
        logs += math.log((hit + smooth) / (y + smooth) if x and y else smooth / max(1, y))
    short = 1.0 if len(b) > len(a) else math.exp(1 - len(a) / len(b))
    return short * math.exp(logs / most)


def edit_scores(orig: str, ref: str, said: str) -> tuple[float, float, float]:
    """Precision, recall and F1 of the edits made towards the reference."""
    if orig == ref:
        return (1.0, 1.0, 1.0) if said == orig else (0.0, 1.0, 0.0)
    wanted, made, left = edits(list(orig), list(ref)), edits(list(orig), list(said)), edits(list(said), list(ref))
    good = max(0, wanted - left)
    p, r = min(1.0, good / made) if made else 0.0, min(1.0, good / wanted)
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def text_scores(orig: str, ref: str, said: str) -> dict[str, float]:
    """All scores of a correction ``said`` of ``orig`` against ``ref``."""
    a, b = tokens(ref), tokens(said)
    common = subsequence(list(ref), list(said))
    p, r, f = edit_scores(orig, ref, said)
    return {
        "cer": edits(list(said), list(ref)) / len(ref) if ref else float(bool(said)), "wer": edits(b, a) / len(a) if a else float(bool(b)),
        "rouge_l": 2 * common / (len(ref) + len(said)) if ref or said else 1.0, "chrf": chrf(ref, said), "bleu": bleu(ref, said),
        "edit_precision": p, "edit_recall": r, "edit_f1": f, "changed": float(edits(list(orig), list(ref))), "left": float(edits(list(said), list(ref))),
    }


SCORES = T.StructType()
for _name in ("cer", "wer", "rouge_l", "chrf", "bleu", "edit_precision", "edit_recall", "edit_f1", "changed", "left"):
    SCORES.add(_name, "double")


@F.arrow_udf(SCORES)
def text_scores_column(orig: pa.Array, ref: pa.Array, said: pa.Array) -> pa.Array:
    """Scores of corrections; null texts are empty."""
    rows = [text_scores(*(x or "" for x in r)) for r in zip(orig.to_pylist(), ref.to_pylist(), said.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([r[f] for r in rows], pa.float64()) for f in SCORES.names], SCORES.names)


def outcome(orig: Column, ref: Column, said: Column, changed: Column, left: Column) -> Column:
    """What became of an error."""
    return (
        F.when(said == ref, "EXACT_CORRECTION").when(left < changed, "PARTIAL_CORRECTION").when(F.trim(said) == F.trim(orig), "MISSED_ERROR").when(left > changed, "FALSE_CORRECTION").otherwise("OVERCORRECTION")
    )


def correction_scores(df: DataFrame, orig: str, ref: str, said: str) -> DataFrame:
    """Add ``scores``, ``exact`` and ``outcome``."""
    out = df.withColumn("scores", text_scores_column(orig, ref, said)).withColumn("exact", F.col(said) == F.col(ref))
    return out.withColumn("outcome", outcome(F.col(orig), F.col(ref), F.col(said), F.col("scores.changed"), F.col("scores.left")))
