"""Feature plugins: functions from documents to findings, isolated from each other's faults."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.rules import COLUMNS
from loomwork.shared import cut

Plugin = Callable[[DataFrame], DataFrame]


@dataclass
class Outcome:
    """Findings of the plugins that ended well, in order of their names, and the faults of the others by name."""

    findings: DataFrame | None = None
    failures: dict[str, str] = field(default_factory=dict)


def fault(error: BaseException) -> str:
    """A fault's code and text: a code of its own, CONTRACT for a wrong value, EXECUTION_FAILED for all else."""
    code = getattr(error, "code", None)
    if not isinstance(code, str):
        code = "CONTRACT" if isinstance(error, ValueError) else "EXECUTION_FAILED"
    return f"{code}: {error}"


def _checked(found: DataFrame) -> DataFrame:
    if list(found.columns) != list(COLUMNS):
        raise ValueError(f"columns are {found.columns}")
    return found


def dispatch(documents: DataFrame, plugins: dict[str, Plugin], run: bool = True, timeout: float | None = None) -> Outcome:
    """Run plugins side by side, their results in order of their names.

    A result without the schema of findings is a fault. With ``run`` each result is written as a
    table, so that a fault while it is computed touches no other plugin; with a
    timeout in seconds, a plugin that takes longer is cancelled.
    """
    context = documents.sparkSession.sparkContext
    out = Outcome()

    def work(plugin: Plugin, tag: str) -> DataFrame:
        context.addJobTag(tag)
        try:
            found = _checked(plugin(documents))
            return cut(found, "findings") if run else found
        finally:
            context.removeJobTag(tag)

    waiting: dict[str, tuple[Future, str]] = {}
    pool = ThreadPoolExecutor(max(1, len(plugins)))
    for name in sorted(plugins):
        tag = f"plugin-{uuid.uuid4().hex}"
        waiting[name] = pool.submit(work, plugins[name], tag), tag
    for name, (job, tag) in waiting.items():
        try:
            found = job.result(timeout)
            out.findings = found if out.findings is None else out.findings.unionByName(found)
        except Late:
            context.cancelJobsWithTag(tag)
            out.failures[name] = f"TIMEOUT: not done within {timeout} s"
        except Exception as e:  # noqa: BLE001
            out.failures[name] = fault(e)
    pool.shutdown(wait=False)
    return out


def newest(models: DataFrame) -> DataFrame:
    """(capability, key, version): of each capability the greatest version, compared as text, then the greatest key."""
    return models.groupBy("capability").agg(F.max(F.struct("version", "key")).alias("m")).select("capability", "m.key", "m.version")
