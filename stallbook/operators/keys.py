"""Joins on keys in which null equals null, and ids that travel as bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def match_keys(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys; rows with a null key meet as others do.  The keys of
    ``df`` stay."""
    renamed = other.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return df.join(renamed, same, how).drop(*[f"_of_{k}" for k in keys])


def pack_ids(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Texts of lower-case hexadecimal digits, as hashes are, become their bytes, half as long, for
    the way through a shuffle; any other text stays as it is.  :func:`unpack_ids` gives the texts back."""
    for c in columns:
        if df.schema[c].dataType == T.StringType():
            digits = F.lower(F.hex(F.unhex(c))) == F.col(c)
            df = df.withColumns({_bytes(c): F.when(digits, F.unhex(c)), c: F.when(~F.coalesce(digits, F.lit(False)), F.col(c))})
    return df


def unpack_ids(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        if _bytes(c) in df.columns:
            df = df.withColumn(c, F.coalesce(F.lower(F.hex(_bytes(c))), F.col(c))).drop(_bytes(c))
    return df


def _bytes(column: str) -> str:
    return f"_bytes_of_{column}"
