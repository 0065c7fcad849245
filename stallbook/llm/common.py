"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallbook.session import ship_package

__all__ = ["WORD", "lean", "pick", "ship_package", "table", "text_or_empty", "uniform"]

#: A word, as every operator here reads it: no ASCII white space inside.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only these columns, so that further ones of any name do no harm."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that hands memory it no longer needs back to the system as it ends: the
    worker waits for its next task beside the executor's JVM, and both count."""

    @functools.wraps(run)
    def ended(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return ended


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def uniform(*columns: Column, seed: int) -> Column:
    """A number in [0, 1) that only the columns' values and the seed decide."""
    mask = (1 << 52) - 1
    return F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit(mask)) / F.lit(float(mask + 1))
