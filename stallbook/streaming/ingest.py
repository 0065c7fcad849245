"""Incremental file ingest: every new file once, then stop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stallbook.operators.keys import pack_ids, unpack_ids
from stallbook.session import freed
from stallbook.sinks.tables import add_columns
from stallbook.sources.files import FILE_PATTERNS, FILE_SCHEMAS, PROJECTIONS


def file_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    file_format: str = "json",
    pattern: str | None = None,
    multi_line: bool = True,
    max_files: int | None = None,
) -> DataFrame:
    """Stream over the files of a folder, optionally filtered by file name."""
    reader = spark.readStream.schema(schema).format(file_format)
    if file_format == "json":
        reader = reader.option("multiLine", multi_line)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def source_stream(
    spark: SparkSession,
    kind: str,
    folder: str,
    pattern: str | None = None,
    multi_line: bool = True,
    max_files: int | None = None,
) -> DataFrame:
    """One of the four JSON sources (prices, schemes, knowledge, guide) as a stream."""
    raw = file_stream(
        spark,
        folder,
        FILE_SCHEMAS[kind],
        pattern=pattern or FILE_PATTERNS[kind],
        multi_line=multi_line,
        max_files=max_files,
    )
    return PROJECTIONS[kind](raw)


def table_stream(spark: SparkSession, name: str) -> DataFrame:
    """Rows appended to a table, as a stream."""
    return spark.readStream.table(name)


def drain(
    stream: DataFrame,
    checkpoint: str,
    table: str | None = None,
    path: str | None = None,
    partition_by: Sequence[str] = (),
    ids: Sequence[str] = (),
) -> StreamingQuery:
    """Process everything available, append it exactly once, and stop.

    Columns the target table does not have yet are added to it first.  A target
    belongs to one checkpoint: its file log remembers the batch numbers, so a
    second stream into the same place would have its first batches skipped.

    A partitioned target gets few files per batch and partition, not one from every
    task, so that who follows it has files as many as batches, however large they are.
    ``ids`` are columns of hashes, which go there as bytes; its files are packed closely.
    """
    if (table is None) == (path is None):
        raise ValueError("give either table or path")
    spark = stream.sparkSession
    if table and spark.catalog.tableExists(table):
        add_columns(spark, table, stream.schema)
    if partition_by:
        stream = unpack_ids(pack_ids(stream, ids).hint("rebalance", *partition_by), ids)
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("compression", "zstd")
    with freed(spark):
        query = writer.toTable(table) if table else writer.start(path)
        query.awaitTermination()
    return query


def ingest(spark: SparkSession, kind: str, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Drain one JSON source into a table."""
    return drain(source_stream(spark, kind, folder), checkpoint, table=table)
