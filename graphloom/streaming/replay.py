"""Structured Streaming over the mutation log: each micro-batch is folded into a table of current entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mutation_log import SCHEMA

#: Versions that stay: the newest, and the one that a batch that runs again starts from.
KEPT = 2
_STATE = "entity string, kind string, lsn long, op string, labels array<string>, src string, dst string, type string, props string"


def stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def fold(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Current record of each entity: the one of the highest lsn, so batches may come in any order and again."""
    rows = batch.where(~F.col("op").isin("begin", "commit", "abort", "checkpoint"))
    rows = rows.select("entity", F.element_at(F.split("op", "_"), -1).alias("kind"), "lsn", "op", "labels", "src", "dst", "type", "props")
    both = rows if state is None else state.unionByName(rows)
    others = ["lsn", "op", "labels", "src", "dst", "type", "props"]
    return both.groupBy("entity", "kind").agg(F.max_by(F.struct(*others), "lsn").alias("r")).select("entity", "kind", *[F.col(f"r.{c}").alias(c) for c in others])


def maintain(source: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep ``target`` (versioned folders, the newest complete one counts) as the fold of all batches so far.

    The batch id names the folder, so a batch that runs again overwrites its own work; the newest ``KEPT`` folders stay.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = current(spark, target, below=epoch)
        fold(before, batch).write.mode("overwrite").parquet(f"{target}/batch={epoch:012d}")
        _drop(spark, target, _complete(spark, target)[:-KEPT])

    writer = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _complete(spark: SparkSession, target: str) -> list[str]:
    """The names of the complete folders under ``target``, oldest first."""
    from ..sources.store import _exists, _file_system

    fs, p = _file_system(spark, target)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in names if n.startswith("batch=") and _exists(spark, f"{target}/{n}/_SUCCESS"))


def _drop(spark: SparkSession, target: str, names: list[str]) -> None:
    from ..sources.store import _file_system

    for name in names:
        fs, p = _file_system(spark, f"{target}/{name}")
        fs.delete(p, True)


def current(spark: SparkSession, target: str, below: int | None = None) -> DataFrame | None:
    """The newest complete table under ``target``; None if there is none."""
    done = [n for n in _complete(spark, target) if below is None or int(n[6:]) < below]
    return spark.read.schema(_STATE).parquet(f"{target}/{done[-1]}") if done else None
