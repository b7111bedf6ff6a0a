"""Reading the given tables, and small DataFrame helpers shared by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.session import materialise, ship_package

__all__ = ["batches", "documents", "hand_back", "materialise", "of_rest", "ship_package", "shards", "table"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def of_rest(id_col: str, modulus: int, rest: int):
    """Whether crc32 of the id as text leaves ``rest``: the fixed split of a fold.  Null ids are in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def shards(spark: SparkSession) -> int:
    """Shards that packed postings are dealt into: the session's shuffle partitions, so it follows the cluster's settings."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hand_back() -> None:
    """Give freed memory of this Python worker back to the machine: workers are kept between tasks, and others need it meanwhile."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""
    def run(it):
        for batch in it:
            yield from fn(batch)
        batch = None
        hand_back()

    return df.mapInArrow(run, schema)
