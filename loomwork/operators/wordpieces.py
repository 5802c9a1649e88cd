"""WordPiece tokens by greedy longest match, with a vocabulary as parameter."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.script import normalize
from loomwork.session import prepare

UNKNOWN, CONTINUES = "[UNK]", "##"


def pieces(word: str, vocabulary: set[str], longest: int = 100) -> list[str]:
    """Pieces of a word, all but the first marked; one unknown token if it cannot be cut up."""
    out, at = [], 0
    if len(word) > longest:
        return [UNKNOWN]
    while at < len(word):
        mark = CONTINUES if at else ""
        end = next((e for e in range(len(word), at, -1) if mark + word[at:e] in vocabulary), None)
        if end is None:
            return [UNKNOWN]
        out.append(mark + word[at:end])
        at = end
    return out


def joined(tokens: list[str]) -> str:
    return " ".join(tokens).replace(f" {CONTINUES}", "")


def tokenize(df: DataFrame, vocabulary: list[str], text_col: str = "text", out: str = "tokens") -> DataFrame:
    """Add the tokens of the normalised text."""
    spark = prepare(df.sparkSession)
    shared = spark.sparkContext.broadcast(set(vocabulary))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[p for w in (t or "").split() for p in pieces(w, shared.value)] for t in texts.to_pylist()], pa.list_(pa.string()))

    return df.withColumn(out, run(normalize(F.col(text_col))))
