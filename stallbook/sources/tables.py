"""Catalog tables: filtered reads, SQL with bound parameters, inventory."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def matching(df: DataFrame, filters: Mapping[str, Any] | None) -> DataFrame:
    """AND of ``column == value`` or ``column IN values``; ``None`` means null."""
    for column, value in (filters or {}).items():
        if value is None:
            df = df.filter(F.col(column).isNull())
        elif isinstance(value, (list, tuple, set)):
            df = df.filter(F.col(column).isin(list(value)))
        else:
            df = df.filter(F.col(column) == value)
    return df


def read_table(
    spark: SparkSession,
    name: str,
    filters: Mapping[str, Any] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """A table with optional filters (pushed to the scan) and row limit."""
    df = matching(spark.table(name), filters)
    return df if limit is None else df.limit(limit)


def run_sql(spark: SparkSession, query: str, args: Mapping[str, Any] | None = None) -> DataFrame:
    """SQL with named parameters (``:name``) instead of values in the text."""
    return spark.sql(query, args=dict(args or {}))


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def list_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Names only; a catalog listing, no data is read."""
    return [t.name for t in spark.catalog.listTables(database)]


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: name, rows, columns.  One job for all tables."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def table_stats(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """Row and column counts of catalog tables; a missing table has null counts."""
    present = {n: spark.table(n) for n in names if table_exists(spark, n)}
    absent = [(n, None, None) for n in names if n not in present]
    missing = spark.createDataFrame(absent, "table_name string, row_count bigint, column_count int")
    return table_counts(present).unionByName(missing) if present else missing
