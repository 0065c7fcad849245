"""Table writes, upsert into a stored table, log rows, chunk files."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from contextlib import contextmanager
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallbook import schemas
from stallbook.operators.changes import append_evolving, one_of_each, replace_rows
from stallbook.operators.keys import match_keys
from stallbook.session import settle

RESPONSE_LENGTH = 500  # characters of an answer kept in the chat log
DROP_AT_ONCE = 200  # partitions dropped by one statement


def write_table(
    df: DataFrame,
    name: str,
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
    keys: Sequence[str] = (),
    location: str | None = None,
    order: Sequence[str] = (),
) -> None:
    """Overwrite or append to a table, or ``merge`` rows into it by ``keys``; of rows with the
    same key the last by ``order`` is merged, without one they are refused.

    ``location`` places the files of a new table outside the warehouse.

    Appending rows with new columns adds the columns to the table first; the
    stored rows read as null there and are not rewritten.
    """
    spark = df.sparkSession
    if mode == "merge":
        merge_table(df, name, keys, partition_by, order)
        return
    if mode == "append" and spark.catalog.tableExists(name):
        add_columns(spark, name, df.schema)
        append_evolving(spark.table(name).limit(0), df).write.insertInto(name)
        return
    _save(df, name, mode, partition_by, location)


def _save(
    df: DataFrame, name: str, mode: str, partition_by: Sequence[str], location: str | None = None
) -> None:
    if partition_by:
        # few, even files per partition instead of one per task and partition;
        # the adaptive plan splits a partition value that holds most rows
        df = df.hint("rebalance", *partition_by)
    writer = df.write.format("parquet").mode(mode)
    if location:
        writer = writer.option("path", location)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def add_columns(spark: SparkSession, name: str, schema: T.StructType) -> None:
    """Add the columns of ``schema`` that a stored table does not have yet."""
    known = set(spark.table(name).columns)
    for field in schema.fields:
        if field.name not in known:
            spark.sql(f"ALTER TABLE {name} ADD COLUMNS (`{field.name}` {field.dataType.simpleString()})")


def comment_table(spark: SparkSession, name: str, text: str) -> None:
    spark.sql(f"COMMENT ON TABLE {name} IS '{_escaped(text)}'")


def merge_table(
    new: DataFrame,
    name: str,
    keys: Sequence[str],
    partition_by: Sequence[str] = (),
    order: Sequence[str] = (),
) -> None:
    """Upsert into a stored table, which keeps its location, format and partitioning.

    A partitioned table is rewritten only where it changes: in the partitions of the
    new rows and of the old rows they replace, the one of null included.  For a
    new table ``partition_by`` says how to partition it; for a stored one it may be
    left out, and must not contradict the table.
    """
    if not keys:
        raise ValueError("merge needs key columns")
    spark = new.sparkSession
    new = one_of_each(new, keys, order)
    if not spark.catalog.tableExists(name):
        write_table(new, name, "overwrite", partition_by)
        return
    parts = partition_columns(spark, name)
    if partition_by and list(partition_by) != parts:
        raise ValueError(f"{name} is partitioned by {parts}, not by {list(partition_by)}")
    add_columns(spark, name, new.schema)
    old = spark.table(name)
    if not parts:
        settle(replace_rows(old, new, keys), "merged").select(*old.columns).write.insertInto(name, overwrite=True)
        return
    replaced = old.join(new.select(*keys), list(keys), "left_semi").select(*parts)
    touched = settle(new.select(*parts).union(replaced).distinct(), "touched")
    merged = settle(replace_rows(match_keys(old, touched, parts, "left_semi"), new, keys), "merged")
    with _dynamic_overwrite(spark):
        merged.select(*old.columns).hint("rebalance", *parts).write.insertInto(name, overwrite=True)
    # a partition all of whose rows moved elsewhere is not overwritten, so drop it;
    # the catalog takes many partitions in one statement
    gone = match_keys(touched, merged.select(*parts).distinct(), parts, "left_anti").toLocalIterator()
    for some in iter(lambda: list(islice(gone, DROP_AT_ONCE)), []):
        specs = ", ".join(f"PARTITION ({', '.join(f'`{p}` = {_literal(row[p])}' for p in parts)})" for row in some)
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {specs}")


def partition_columns(spark: SparkSession, name: str) -> list[str]:
    """The columns a stored table is partitioned by, in order."""
    parts = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    return [c for c in spark.table(name).columns if c in parts]


@contextmanager
def _dynamic_overwrite(spark: SparkSession):
    """Replace only the partitions that receive rows.  ``insertInto`` takes the
    mode from the session, not from a write option."""
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value}'"
    if isinstance(value, dt.date):
        return f"DATE '{value}'"
    return "'" + _escaped(str(value)) + "'"


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def create_log_tables(spark: SparkSession, database: str = "default") -> None:
    """The three log tables, empty, unless they exist."""
    for name, schema in schemas.LOGS.items():
        empty = spark.createDataFrame([], schema)
        empty.write.format("parquet").mode("ignore").saveAsTable(f"{database}.{name}")


def _or(df: DataFrame, column: str, default: str | float | int) -> Column:
    if column not in df.columns:
        return F.lit(default)
    return F.coalesce(F.col(column), F.lit(default))


def disease_log_rows(results: DataFrame) -> DataFrame:
    """Log rows from a table of label predictions with treatments."""
    return results.select(
        F.uuid().alias("prediction_id"),
        F.current_timestamp().alias("timestamp"),
        _or(results, "label", "").alias("predicted_disease"),
        _or(results, "crop", "").alias("predicted_crop"),
        _or(results, "score", 0.0).cast("double").alias("confidence"),
        _or(results, "treatment", "").alias("treatment"),
        _or(results, "model_version", "latest").alias("model_version"),
        _or(results, "language", "en").alias("user_language"),
    )


def price_log_rows(forecasts: DataFrame) -> DataFrame:
    """Log rows from a table of forecast days."""
    return forecasts.select(
        F.uuid().alias("prediction_id"),
        F.current_timestamp().alias("timestamp"),
        *[_or(forecasts, c, "").alias(c) for c in ("commodity", "market", "state")],
        _or(forecasts, "predicted_price", 0.0).cast("double").alias("predicted_price"),
        _or(forecasts, "day", 7).cast("int").alias("days_ahead"),
        _or(forecasts, "model_version", "latest").alias("model_version"),
    )


def chat_log_rows(routed: DataFrame, text: str = "text", answer: str = "answer") -> DataFrame:
    """Log rows from a table of classified (and possibly answered) questions."""
    return routed.select(
        F.uuid().alias("session_id"),
        F.current_timestamp().alias("timestamp"),
        _or(routed, text, "").alias("user_query"),
        _or(routed, "intent", "").alias("intent"),
        F.substring(_or(routed, answer, ""), 1, RESPONSE_LENGTH).alias("response_summary"),
        _or(routed, "language", "en").alias("language"),
        _or(routed, "feature", "").alias("feature_used"),
    )


def append_log(rows: DataFrame, name: str) -> None:
    write_table(rows, name, mode="append")


def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Chunks as JSON lines next to the vectors."""
    chunks.write.mode(mode).json(path)
