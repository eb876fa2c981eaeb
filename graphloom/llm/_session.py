"""Session helpers of the corpus operators."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import counted as _counted
from ..session import shared_dir, unstage
from ..session import stage as _stage

__all__ = ["ARROW_ROWS", "counted", "in_one_task", "numbered", "sampled", "shared_dir", "stage", "tune", "unstage"]

#: Rows an Arrow batch carries at most; texts are long, so batches are kept short.
ARROW_ROWS = 1000


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds; the setting stays, as plans are run after the operators return."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def stage(df: DataFrame, name: str, free: bool = True) -> DataFrame:
    """Write and read back; shuffle files go at once unless the caller knows that they are few."""
    return _stage(df, name, free)


def counted(df: DataFrame, name: str, free: bool = True) -> tuple[DataFrame, int]:
    """``stage``, and the number of rows that it wrote."""
    return _counted(df, name, free)


def numbered(docs: DataFrame, name: str, **columns: str) -> DataFrame:
    """``row`` and the named columns (new name = old one), written, so that each row keeps its own number whatever its key."""
    return stage(docs.select(F.monotonically_increasing_id().alias("row"), *[F.col(old).alias(new) for new, old in columns.items()]), name)


def sampled(docs: DataFrame, keys: DataFrame, rows: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """At most ``rows`` rows (k, the other columns of ``keys``, t): whole texts of the keys with the smallest hash.

    ``keys`` has ``k`` and any labels.  The keys are picked before any text is read, and rows that share a key are
    bounded after it, so neither many keys nor a key of many rows makes the sample larger."""
    keys = keys.where(F.col("k").isNotNull())
    picked = keys.orderBy(F.xxhash64("k"), *keys.columns).limit(rows).distinct()
    texts = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return texts.join(F.broadcast(picked), "k").orderBy(F.xxhash64("k"), *keys.columns, F.xxhash64("t")).limit(rows)


def in_one_task(rows: DataFrame, work: Callable[[list[dict]], object]) -> object:
    """``work`` on the rows of a bounded sample, run by one task; only its pickled result reaches the driver."""
    tune(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [row for batch in batches for row in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(work(found)), 1)], pa.binary())], ["result"])

    result = rows.repartition(1).mapInArrow(run, "result binary").first()
    return work([]) if result is None else pickle.loads(zlib.decompress(result["result"]))
