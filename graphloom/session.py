"""Tables in the shared folder: how iterative plans cut their lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


#: Spark's setting that drops the shuffle files of a query when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _held(spark: SparkSession, setting: str, value: str) -> Iterator[None]:
    """A session setting for the length of a block."""
    old = spark.conf.get(setting, None)
    spark.conf.set(setting, value)
    try:
        yield
    finally:
        spark.conf.unset(setting) if old is None else spark.conf.set(setting, old)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only where that is unset (tests, local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    known = getattr(spark, "_graphloom_dir", None)
    if known is None:
        known = spark._graphloom_dir = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return known


def stage(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back, which cuts the lineage.

    Files in the shared folder outlive executors; with ``free`` Spark removes the shuffle files of what was
    written as soon as the write is over.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with _held(spark, _CLEAN, "true") if free else nullcontext():
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def counted(df: DataFrame, name: str, free: bool = False) -> tuple[DataFrame, int]:
    """A staged table and its number of rows, which the write itself counts."""
    seen = Observation()
    out = stage(df.observe(seen, F.count(F.lit(1)).alias("rows")), name, free)
    return out, seen.get["rows"]


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
