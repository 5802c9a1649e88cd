"""Models behind operators: a registry, models that stay loaded under a budget, batch inference.

A model is a loader that every worker process calls once and an inference function over a
list of inputs. Workers keep the models used last, as many as the budget of bytes
allows. Without a model, operators that need one leave their input as it is.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.operators.rules import suggestion
from loomwork.session import prepare

#: What models can be asked for (fixed values).
CAPABILITIES = ("spelling", "grammar", "embedding", "translation", "summarization", "ocr", "speech")
BUDGET = 2 << 30


@dataclass(frozen=True)
class Model:
    """``load()`` gives what ``infer(loaded, inputs)`` works with; ``size`` is in bytes."""

    key: str
    capability: str
    version: str
    load: Callable[[], Any]
    infer: Callable[[Any, list], list]
    size: int = 0


class Registry:
    """Models by capability: the preferred key, else the greatest version, compared as text, then the greatest key."""

    def __init__(self):
        self.models: dict[str, Model] = {}

    def register(self, model: Model) -> None:
        if model.capability not in CAPABILITIES:
            raise ValueError(f"no capability is called {model.capability}")
        self.models[model.key] = model

    def unregister(self, key: str) -> None:
        self.models.pop(key, None)

    def resolve(self, capability: str, preferred: str | None = None) -> Model:
        found = [m for m in self.models.values() if m.capability == capability]
        if not found:
            raise LookupError(f"no model for {capability}")
        return max([m for m in found if m.key == preferred] or found, key=lambda m: (m.version, m.key))

    def table(self, spark: SparkSession) -> DataFrame:
        """(capability, key, version, size)."""
        rows = sorted((m.capability, m.key, m.version, m.size) for m in self.models.values())
        return spark.createDataFrame(rows, "capability string, key string, version string, size long")


class Residency:
    """Loaded models, the one used longest ago leaving first when they are larger than the budget."""

    def __init__(self, budget: int = BUDGET):
        self.budget = budget
        self.held: OrderedDict[str, tuple[Any, int]] = OrderedDict()

    def get(self, model: Model) -> Any:
        if model.key not in self.held:
            if model.size > self.budget:
                raise MemoryError(f"{model.key} is larger than the budget")
            while self.held and sum(n for _, n in self.held.values()) + model.size > self.budget:
                self.held.popitem(last=False)
            self.held[model.key] = model.load(), model.size
        self.held.move_to_end(model.key)
        return self.held[model.key][0]

    def unload(self, key: str) -> None:
        self.held.pop(key, None)


_RESIDENT = Residency()


def infer(df: DataFrame, model: Model, column: str, out: str, kind: T.DataType | str = "string", budget: int = BUDGET) -> DataFrame:
    """Add the model's answers to a column, a batch at a time; a batch that fails gives nulls and its fault in ``<out>_fault``."""
    prepare(df.sparkSession)
    answer = kind if isinstance(kind, T.DataType) else T._parse_datatype_string(kind)
    result = T.StructType().add("value", answer).add("fault", "string")

    @F.arrow_udf(result)
    def run(inputs: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        _RESIDENT.budget = budget
        values, said = inputs.to_pylist(), None
        try:
            found = list(model.infer(_RESIDENT.get(model), values))
            if len(found) != len(values):
                raise ValueError(f"{len(found)} answers to {len(values)} inputs")
        except Exception as e:  # noqa: BLE001
            found, said = [None] * len(values), f"{type(e).__name__}: {e}"
        return pa.StructArray.from_arrays([pa.array(found, to_arrow_type(answer)), pa.array([said] * len(values), pa.string())], ["value", "fault"])

    rows = df.withColumn("__answer", run.asNondeterministic()(F.col(column)))
    return rows.withColumn(out, F.col("__answer.value")).withColumn(f"{out}_fault", F.col("__answer.fault")).drop("__answer")


def rewritten(df: DataFrame, model: Model | None, column: str = "text", out: str = "corrected") -> DataFrame:
    """Add the model's rewriting of each text; the text itself without a model, or where it fails. Equal texts are rewritten once."""
    if model is None:
        return df.withColumn(out, F.col(column))
    once = infer(df.select(F.col(column).alias("__text")).distinct(), model, "__text", "__new").select("__text", F.coalesce("__new", "__text").alias(out))
    return df.join(once, df[column].eqNullSafe(once["__text"]), "left").drop("__text").withColumn(out, F.coalesce(out, column))


def rewriting_findings(sentences: DataFrame, model: Model | None, source: str = "grammar_correction") -> DataFrame:
    """Whole sentences (doc_id, char_start, char_end, text) of five characters and more that a model writes otherwise; none without a model."""
    long = sentences.where(F.char_length(F.trim("text")) >= 5)
    new = rewritten(long, model).where((F.col("corrected") != F.col("text")) & (F.char_length(F.trim("corrected")) >= 2))
    return suggestion(new, source, F.col("corrected"), 0.85, "MEDIUM", F.concat(F.lit("AI Grammar Correction: '"), "text", F.lit("' → '"), "corrected", F.lit("'")), "GRAMMAR_AI")


#: Log-probability of a piece that a model does not know.
UNKNOWN_SCORE = -100.0


def masked_scores(df: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """(…, score) of rows (sentence, char_start, char_end, candidate): how well a candidate stands in its place.

    The model is asked for the log-probabilities of the candidate's pieces, each with all of
    them masked, as ``(before, candidate, behind)``; null stands for a piece it does not know. No pieces score 0.
    """
    asked = F.struct(
        F.substring(F.col("sentence"), F.lit(1), F.col("char_start").cast("int")).alias("before"), "candidate",
        F.substring(F.col("sentence"), F.col("char_end").cast("int") + 1, F.char_length("sentence")).alias("behind"),
    )
    rows = infer(df.withColumn("__asked", asked), model, "__asked", "__pieces", "array<double>")
    total = F.aggregate("__pieces", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(UNKNOWN_SCORE)))
    mean = F.when(F.size("__pieces") > 0, total / F.size("__pieces")).otherwise(-10.0)
    return rows.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 + mean / 10))).drop("__asked", "__pieces", "__pieces_fault")
