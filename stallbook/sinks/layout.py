"""Tables laid out so that windows, deduplication and merges by their keys need no exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallbook.operators.changes import upsert
from stallbook.session import settle

#: Bytes of a bucket: a task reads one bucket, sorted.
BUCKET_BYTES = 256 << 20
#: Spark asks for bucketed reads to keep their order by this setting; each bucket here is one file.
KEEP_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def buckets_for(total_bytes: int, least: int = 1) -> int:
    """A power of two, so that tables of different sizes still meet bucket by bucket."""
    wanted = max(least, -(-total_bytes // BUCKET_BYTES))
    return 1 << (int(wanted) - 1).bit_length()


def write_bucketed(
    df: DataFrame,
    name: str,
    keys: Sequence[str],
    order: Sequence[str] = (),
    buckets: int = 8,
    location: str | None = None,
    mode: str = "overwrite",
) -> None:
    """Store ``df`` in buckets of ``keys``, each one file sorted by ``keys`` and ``order``.

    Rows of a key share a bucket; what then groups, ranks or joins by the keys reads it in
    place.  Keys should be many more than buckets: a key that holds a large part of the table
    makes its bucket large, and ``windows.over_series`` cuts such series.
    """
    # dealt as the buckets are, so that a bucket is written by one task
    dealt = df.repartition(buckets, *keys).sortWithinPartitions(*keys, *order)
    writer = dealt.write.format("parquet").mode(mode).bucketBy(buckets, *keys).sortBy(*keys, *order)
    if location:
        writer = writer.option("path", location)
    writer.saveAsTable(name)


def bucketing(spark: SparkSession, name: str) -> tuple[int, list[str]] | None:
    """Number of buckets and their keys, as the catalog has them."""
    about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    if "Num Buckets" not in about or about["Num Buckets"] in ("", "0"):
        return None
    columns = [c.strip(" `") for c in about["Bucket Columns"].strip("[]").split(",")]
    return int(about["Num Buckets"]), columns


def merge_bucketed(new: DataFrame, name: str, keys: Sequence[str], order: Sequence[str], into: str, location: str | None = None) -> None:
    """The table with rows of ``new`` in place of those of equal keys, stored as ``into`` in the same buckets.

    Only ``new`` is shuffled: old rows stay in their buckets.
    """
    spark = new.sparkSession
    found = bucketing(spark, name)
    if found is None:
        raise ValueError(f"{name} is not bucketed")
    buckets, by = found
    if not set(by) <= set(keys):
        raise ValueError(f"{name} is bucketed by {by}, which are not among the keys {list(keys)}")
    merged = upsert(spark.table(name), settle(new, "new"), keys)
    write_bucketed(merged, into, by, order, buckets, location)


def exchanges(df: DataFrame) -> int:
    """Shuffles in the plan of ``df``, reads of stored tables included."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange" in line and "BroadcastExchange" not in line for line in plan.splitlines())


def key_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key, largest first: whether keys suit as buckets."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), *keys)
