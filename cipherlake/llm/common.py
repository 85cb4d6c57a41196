"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import gc
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.session import checkpoint


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table of the data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Store df in the shared checkpoint folder and go on from the stored rows."""
    return checkpoint(df)


def release(spark: SparkSession) -> None:
    """Have Spark remove shuffle files that nothing can read any more. It does so when the driver's garbage is collected,
    which on a driver with memory to spare may be much later than a large lineage was cut."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold(doc_id: Column, parts: int, held: int) -> Column:
    """True where crc32 of the id as text has remainder `held`; false for null ids."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == held, F.lit(False))


def bucket(unit: str, bits: int) -> int:
    """Stable hash of a string into 2**bits buckets."""
    return (zlib.crc32(unit.encode()) * 2654435761 & 0xFFFFFFFF) >> (32 - bits)


class Memo(dict):
    """A dict that computes missing values and starts anew when it holds `limit` of them, so that a long-lived
    worker stays small whatever its texts hold."""

    def __init__(self, make: Callable, limit: int = 200_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value
