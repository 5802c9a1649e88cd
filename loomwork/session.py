"""Session factory and per-session preparation."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: Rows and bytes of one Arrow batch handed to Python: bounds a worker's memory
#: whatever the length of the texts.
ARROW_ROWS = 1000
ARROW_BYTES = 2 << 20
#: Workers give memory back to the system when a batch is done (allocators' own settings).
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_TRIM_THRESHOLD_": "131072"}
#: Bytes up to which a table of one file is dealt out before it is worked on.
SMALL_FILE = 64 << 20


def create(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session with adaptive execution and Arrow on, for tests and benches."""
    spark = (
        SparkSession.builder.master(master)
        .appName("loomwork")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. One small file, often a single row group that one task would read, is dealt over all cores.

    Whatever reads a table may hand it to Python, so batches are bounded from here on (``prepare``).
    """
    df = prepare(spark).read.parquet(path)
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(file)
    small = status.isFile() and status.getLen() <= SMALL_FILE
    return df.repartition(spark.sparkContext.defaultParallelism) if small else df


def held(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once for each row.

    The optimizer puts a column's expression where it is used, inside a lambda once per
    element; it does not look through a generator.
    """
    one = F.explode_outer(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))).alias("__held")
    return df.select(*(c for c in df.columns if c not in columns), one).select("*", "__held.*").drop("__held")


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and let Python workers import this package.

    On a cluster the package is installed on the nodes or shipped with
    ``--py-files``; the path set here then names nothing and is skipped.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    env.update(WORKER_ENV)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark
