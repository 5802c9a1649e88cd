"""Quality rules: learned decision lists over text statistics, by Spark SQL alone.

``with_stats`` counts words, symbols, repeated lines and repeated windows of every
whole text with built-in functions. ``learn`` fits a decision list by sequential
covering: a rule grows from nothing by the threshold condition of largest
information gain, all midpoints between neighbouring values being tried, until it
covers no good document of the grow set; it is pruned from its end for the best
precision on the prune set, and kept if it is precise enough there and covers
enough bad documents of the grow set; covered documents leave, and the next rule
grows from the rest, as long as one is kept. ``verdict`` turns the list into one
ordered Spark conditional expression.

Only a bounded sample of labelled rows is gathered (``MAX_LABELLED``, chosen by a
hash of the id), as numbers, never as texts. Rules and their conditions have no
other bound.

Defined results: a null or empty text has no words and all counts 0; ratios over
nothing are 0. Windows are compared by 64-bit hashes. With no labels, or labels
of one kind only, there are no rules and only the base rule rejects. Existing
columns with the name of an output column are replaced, others kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows used for learning, least precision and cover of a kept rule.
MAX_LABELLED = 6000
MIN_PRECISION = 0.97
MIN_COVER = 4

WINDOW = 8
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]"


def _pairs(windows: Column) -> Column:
    """(hash, start) of every window in order of the hash, if any hash comes twice; else nothing.

    A column of its own: inside a lambda the sort would run once per element.
    """
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(repeats, pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def _starts(pairs: Column) -> Column:
    """Starts of the windows that occur twice, in order."""
    same = lambda p, k: p["h"].eqNullSafe(F.get(pairs, k)["h"])
    marked = F.transform(pairs, lambda p, k: F.when(((k > 0) & same(p, k - 1)) | same(p, k + 1), p["i"]).otherwise(F.lit(-1)))
    return F.sort_array(F.filter(marked, lambda i: i >= 0))


def _covered(starts: Column) -> Column:
    """Words inside the windows: each adds what it does not share with the one before."""
    begin = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("sum"))
    add = lambda s, i: F.struct(i.alias("last"), (s["sum"] + F.least(F.lit(WINDOW), i - s["last"])).cast("long").alias("sum"))
    return F.aggregate(starts, begin, add, lambda s: s["sum"])


def with_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the features."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    out = (
        df.withColumn("__words", F.filter(F.split(text, SPACE), lambda w: w != ""))
        .withColumn("__lines", lines)
        .withColumn("n_symbols", count("[#*$%&|<>]"))
        .withColumn("__upper", count("\\p{Lu}"))
        .withColumn("__marks", count("[!?|=_~^]"))
    )
    hashes = F.transform("__words", lambda w: F.xxhash64(w))
    out = out.withColumn("__hashes", hashes)
    at = F.sequence(F.lit(0), F.size("__hashes") - WINDOW)
    window = lambda i: F.xxhash64(*(F.get("__hashes", i + k) for k in range(WINDOW)))
    none = F.array().cast("array<bigint>")
    out = (
        out.withColumn("n_words", F.size("__words").cast("long"))
        .withColumn("word_chars", F.char_length(F.array_join("__words", "")).cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn("__again", F.size(F.filter("__hashes", lambda h, i: (i > 0) & (h == F.get("__hashes", i - 1)))))
        .withColumn("__n_lines", F.size("__lines"))
        .withColumn("__windows", F.when(F.size("__hashes") >= WINDOW, F.transform(at, window)).otherwise(none))
    )
    out = out.withColumn("__pairs", _pairs(F.col("__windows")))
    out = out.withColumn("n_repeat_words", _covered(_starts(F.col("__pairs"))))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    features = F.struct(
        F.col("n_words").cast("double").alias("words"), ratio("word_chars", "n_words").alias("word_length"),
        ratio("n_symbols", "word_chars").alias("symbols"), ratio("n_dup_lines", "__n_lines").alias("repeated_lines"),
        ratio("n_repeat_words", "n_words").alias("repeated_words"), ratio("__upper", "word_chars").alias("upper"),
        ratio("__marks", "word_chars").alias("marks"), ratio("__again", "n_words").alias("stutter"),
    )
    return out.withColumn("features", features).drop("__words", "__lines", "__upper", "__marks", "__hashes", "__again", "__n_lines", "__windows", "__pairs")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """feature >= threshold if ``above``, else feature <= threshold."""

    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.feature] >= self.threshold if self.above else values[self.feature] <= self.threshold

    def column(self, features: str) -> Column:
        c = F.col(f"{features}.{self.feature}")
        return c >= self.threshold if self.above else c <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, values: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(values.values()))), dtype=bool)
    for c in rule:
        out &= c.holds(values)
    return out


def _best_condition(values: dict[str, np.ndarray], bad: np.ndarray) -> Condition | None:
    """The condition of largest gain (bad left x bits won); of equal ones the first by feature, side and threshold."""
    before = math.log2(bad.mean())
    best, found = 1e-9, None
    for f in sorted(values):
        order = np.argsort(values[f], kind="stable")
        x, y = values[f][order], bad[order]
        step = np.flatnonzero(x[1:] > x[:-1])
        if not len(step):
            continue
        p_below, n_below = np.cumsum(y)[step], np.cumsum(~y)[step]
        for above in (True, False):
            p, n = (y.sum() - p_below, (~y).sum() - n_below) if above else (p_below, n_below)
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / (p + n)) - before), 0.0)
            k = int(gain.argmax())
            if gain[k] > best + 1e-12:
                best, found = float(gain[k]), Condition(f, above, float((x[step[k]] + x[step[k] + 1]) / 2))
    return found


def _grow(values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: list[Condition] = []
    live = np.ones(len(bad), dtype=bool)
    while (live & bad).any() and (live & ~bad).any():
        best = _best_condition({f: v[live] for f, v in values.items()}, bad[live])
        if best is None:
            break
        rule.append(best)
        live &= best.holds(values)
    return tuple(rule)


def _prune(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> tuple[float, int]:
        hit = covers(r, values)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return ((p - n) / (p + n) if p + n else -1.0, len(r))

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)


def learn_list(rows: list[tuple[dict, bool, bool]]) -> list[Rule]:
    """rows: (features, is bad, belongs to the prune set). The rules of bad documents, in order."""
    if not rows:
        return []
    values = {f: np.array([r[0][f] for r in rows], dtype=float) for f in sorted(rows[0][0])}
    bad, side = np.array([r[1] for r in rows], dtype=bool), np.array([r[2] for r in rows], dtype=bool)
    left = np.ones(len(rows), dtype=bool)
    part = lambda mask: ({f: v[mask] for f, v in values.items()}, bad[mask])
    out: list[Rule] = []
    while (left & ~side & bad).sum() >= MIN_COVER:
        rule = _grow(*part(left & ~side))
        if not rule:
            break
        rule = _prune(rule, *part(left & side)) if (left & side).any() else rule
        hit = covers(rule, values) & left
        judged = hit & side
        if (hit & bad & ~side).sum() < MIN_COVER or not judged.any() or (judged & bad).sum() < MIN_PRECISION * judged.sum():
            break
        out.append(rule)
        left &= ~hit
    return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bad_label: int = 0, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """The decision list of documents with ``bad_label``, from a bounded sample of the labelled ones.

    Documents that the base rule rejects anyway teach nothing.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("__label"))
    total = known.count()
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1_000_000))
    share = int(min(1.0, max_labelled / max(1, total)) * 1_000_000)
    sample = F.broadcast(known.where(draw < share))  # about max_labelled rows of two numbers
    joined = docs.select(id_col, F.col(text_col).alias("text")).join(sample, id_col)
    side = F.pmod(F.xxhash64(F.lit("side"), F.col(id_col)), F.lit(3)) == 0
    # the base rule's verdict is a column, not a filter: a filter would be pushed below the statistics and repeat them
    rows = with_stats(joined).select("features", (F.col("__label") == bad_label).alias("bad"), side.alias("side"), base_failed().alias("failed"), id_col).collect()
    rows = sorted((r for r in rows if not r["failed"]), key=lambda r: (r[id_col], tuple(r["features"])))
    return learn_list([(r["features"].asDict(), r["bad"], r["side"]) for r in rows])


def verdict(rules: list[Rule], features: str = "features") -> Column:
    """True unless a rule holds: one ordered conditional expression."""
    out = None
    for rule in rules:
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.column(features)
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))
