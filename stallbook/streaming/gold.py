"""Monthly analytics kept up to date from a stream-fed silver table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stallbook.operators.summaries import monthly_analytics
from stallbook.session import freed

MONTH = ("year", "month")


def refresh_months(spark: SparkSession, silver_path: str, gold_path: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that recomputes the months a batch touches.

    Both tables are partitioned by month: the recomputation reads and replaces
    whole partitions, and repeating a batch after a failure gives the same files.
    The list of months is bounded by the calendar.
    """

    def refresh(batch: DataFrame, _: int) -> None:
        months = batch.select(*MONTH).distinct().collect()
        if not months:
            return
        touched = reduce(
            lambda a, b: a | b,
            [(F.col("year") == m["year"]) & (F.col("month") == m["month"]) for m in months],
        )
        silver = spark.read.schema(batch.schema).parquet(silver_path).filter(touched)
        (
            # rows, narrow here, go by month and commodity once; they are summed up where they
            # come and written from there, so a month has as many files as commodities at most
            monthly_analytics(silver.repartition(*MONTH, "commodity"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "zstd")
            .partitionBy(*MONTH)
            .parquet(gold_path)
        )

    return refresh


def drain_gold(
    spark: SparkSession, silver_stream: DataFrame, silver_path: str, gold_path: str, checkpoint: str
) -> StreamingQuery:
    """Follow the silver table and refresh the touched months, then stop."""
    with freed(spark):
        query = (
            silver_stream.writeStream.foreachBatch(refresh_months(spark, silver_path, gold_path))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return query
