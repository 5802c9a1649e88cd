"""Tables in the folder that all executors share.

Lineage is cut by writing a table there and reading it again, so a lost
executor costs a re-read and never a recomputation of earlier stages.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a temporary folder of its own; on
    a cluster there is no folder that all executors are known to share, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomwork-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomwork/{uuid.uuid4().hex}/{name}"


#: Whether the files of a query's shuffles go when it has ended; else they stay until the driver collects its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str = "table", codec: str = "zstd", tidy: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return it read back (same schema). With ``tidy``, its shuffles' files go at once."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(TIDY, "false")
    if tidy:
        spark.conf.set(TIDY, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if tidy:
            spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`cut` that nothing needs any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/loomwork/" in folder.toString():
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
