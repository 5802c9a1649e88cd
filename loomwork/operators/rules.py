"""Findings: their schema, typography, words with their neighbours, panels.

Findings of all rules are one table:
(doc_id, source, char_start, char_end, replacement, score, priority, message, error_type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.script import TIBETAN
from loomwork.functions.spans import matches_column

#: Pattern, replacement, score, priority of typographic slips.
TYPOGRAPHY = (("་{2,}", "་", 0.95, "HIGH"), ("།{3,}", "༎", 0.90, "MEDIUM"), ("\\s+་", "་", 0.85, "MEDIUM"))

COLUMNS = ("doc_id", "source", "char_start", "char_end", "replacement", "score", "priority", "message", "error_type")


def matches(df: DataFrame, *patterns: str, text_col: str = "text") -> DataFrame:
    """(…, rule, char_start, char_end, matched) of every match of each pattern, found in the row."""
    kept = [c for c in df.columns if c != text_col]
    rows = df.select(*kept, F.explode_outer(matches_column(F.col(text_col), *patterns)).alias("__m")).where("__m is not null")
    return rows.select(*kept, "__m.*")


def suggestion(df: DataFrame, source: str, replacement: Column, score: Column | float, priority: str, message: Column | str, error_type: str) -> DataFrame:
    asked = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return df.select(
        "doc_id", F.lit(source).alias("source"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"),
        replacement.cast("string").alias("replacement"), asked(score, "double").alias("score"), F.lit(priority).alias("priority"), asked(message, "string").alias("message"), F.lit(error_type).alias("error_type"),
    )


def typography(df: DataFrame) -> DataFrame:
    """Doubled syllable marks, three and more shads, space before a mark: all patterns in one pass."""
    found = matches(df.select("doc_id", "text"), *(p for p, *_ in TYPOGRAPHY))
    pick = lambda k: F.element_at(F.array(*(F.lit(rule[k]) for rule in TYPOGRAPHY)), F.col("rule") + 1)
    return found.select(
        "doc_id", F.lit("typography").alias("source"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), pick(1).alias("replacement"),
        pick(2).alias("score"), pick(3).alias("priority"), F.concat(F.lit("matches "), pick(0)).alias("message"), F.lit("TYPOGRAPHY").alias("error_type"),
    )


def tokens(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, pos, word, char_start, char_end, left, right): syllables with their neighbours, found in the row."""
    inside = f"[^{TIBETAN.syllable_marks}{TIBETAN.sentence_marks}\\s]+"
    rows = df.select("doc_id", matches_column(F.col(text_col), inside).alias("m"))
    none = F.array(F.lit(None).cast(rows.schema["m"].dataType.elementType))
    n = F.size("m")
    zipped = F.arrays_zip(F.col("m").alias("at"), F.concat(none, "m").alias("before"), F.concat(F.slice("m", 2, F.greatest(n, F.lit(0))), none).alias("next"))
    out = rows.select("doc_id", n.alias("n"), F.posexplode_outer(zipped).alias("pos", "z")).where("pos < n")
    return out.select("doc_id", "pos", F.col("z.at.matched").alias("word"), "z.at.char_start", "z.at.char_end", F.col("z.before.matched").alias("left"), F.col("z.next.matched").alias("right"))


def panel(source: Column, error_type: Column) -> Column:
    """The panel of an editor in which a finding is shown: by its type's name, then by its source."""
    kind = F.upper(error_type)
    out = None
    for part, name in (("SPELL", "Spelling"), ("GRAMMAR", "Grammar"), ("TYPO", "Typography"), ("PLAG", "Plagiarism")):
        out = F.when(kind.contains(part), name) if out is None else out.when(kind.contains(part), name)
    for key, name in (("spelling", "Spelling"), ("grammar", "Grammar"), ("typography", "Typography"), ("plagiarism", "Plagiarism")):
        out = out.when(source == key, name)
    return out.otherwise("Style")
