"""Silver prices as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stallbook.operators.keys import pack_ids, unpack_ids
from stallbook.operators.quality import PRICE_IDENTITY, dedupe
from stallbook.plans.prices import silver
from stallbook.session import freed

#: Parts that the keys of a batch are dealt over, for each task: uneven ones then even out.
PLACES = 4
#: Keys of a month that may be found to have very many copies, keys that the sketch counts at once,
#: and copies that are not very many.
OFTEN, SKETCH, HOT_ROWS = 256, 4096, 10_000
HELD, PLACE = "_held", "_place"

silver_stream = silver  # the batch projection and rules apply to a stream unchanged


def dedupe_stream(
    stream: DataFrame,
    keys: Sequence[str] = PRICE_IDENTITY,
    day: str = "arrival_date",
    delay: str = "30 days",
) -> DataFrame:
    """Drop repeats of a key that arrive within ``delay`` of each other.

    State is kept per key until the watermark passes it, so it is bounded by the
    keys of one delay.  Rows later than the watermark are dropped, and a repeat
    later than that passes: equal to the batch form only within the delay.  All
    copies of a key meet in one task; where a key may hold a large part of a
    batch, use :func:`drain_unique`.
    """
    timed = stream.withColumn("_event_time", F.col(day).cast("timestamp"))
    return (
        timed.withWatermark("_event_time", delay)
        .dropDuplicatesWithinWatermark(list(keys))
        .drop("_event_time")
    )


def drain_unique(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str] = PRICE_IDENTITY,
    order: Sequence[str] = ("price_id",),
) -> StreamingQuery:
    """Append only rows whose key the target has not seen, however long ago.

    The target itself is the state.  Rows and the keys that the target holds of the
    same months go by month and key once: there copies and known keys are dropped,
    and from there a month is written in few files.  Keys with very many copies, as a
    sketch of the batch finds them, go on as one row per key and task before, so they
    do not gather in one task.  A batch writes to partitions of its own number, so a
    repeated batch replaces its files.  Rows need ``year`` and ``month``, derived from
    a date among the keys.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        key = F.xxhash64(*keys)
        often = F.call_function("approx_top_k", key, F.lit(OFTEN), F.lit(SKETCH)).alias("often")
        months = batch.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"), often).collect()  # bounded by the calendar
        if not months and number > 0:
            return
        # a first batch without a row still makes the target
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        hot = _hot(months, tasks)
        if hot:
            batch = batch.filter(~key.isin(hot)).unionByName(dedupe(batch.filter(key.isin(hot)), keys, order))
        both = batch.withColumn(HELD, F.lit(False))
        if number > 0:
            schema = batch.select(*keys, "year", "month").schema.add("batch", T.LongType())
            inside = F.struct("year", "month").isin(
                *[F.struct(F.lit(m["year"]), F.lit(m["month"])) for m in months]
            )
            stored = spark.read.schema(schema).parquet(path).filter((F.col("batch") < number) & inside)
            both = both.unionByName(stored.drop("batch").withColumn(HELD, F.lit(True)), allowMissingColumns=True)
        ids = [c for c in order if c not in keys]
        place = F.pmod(key, _places(months, tasks))
        near = pack_ids(both, ids).withColumn(PLACE, place).repartition("year", "month", PLACE)
        first = dedupe(unpack_ids(near, ids), ["year", "month", PLACE, *keys], [F.desc(HELD), *order])
        (
            first.filter(~F.col(HELD))
            .drop(HELD, PLACE)
            .withColumn("batch", F.lit(number).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "zstd")
            .partitionBy("batch", "year", "month")
            .parquet(path)
        )

    with freed(stream.sparkSession):
        query = (
            stream.writeStream.foreachBatch(append)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return query


def _hot(months: Sequence[Row], tasks: int) -> list[int]:
    """Hashes of keys with more copies than a place has rows, about, and than are worth the step."""
    most = max(HOT_ROWS, sum(m["n"] for m in months) // (PLACES * tasks))
    return [x["item"] for m in months for x in m["often"] if x["count"] > most]


def _places(months: Sequence[Row], tasks: int) -> Column:
    """Places that a month's keys are dealt over: by its share of the rows, ``PLACES`` for each task in all."""
    known = [m for m in months if m["year"] is not None and m["month"] is not None]
    if not known:
        return F.lit(1)
    whole, first = sum(m["n"] for m in months), min(m["year"] for m in known)
    many = [1] * (12 * (max(m["year"] for m in known) - first + 1))
    for m in known:
        many[12 * (m["year"] - first) + m["month"] - 1] = -(-m["n"] * PLACES * tasks // whole)
    # looked up by number: a chain of conditions would make a method too long for the JVM to compile
    number = 12 * (F.col("year") - first) + F.col("month") - 1
    return F.coalesce(F.get(F.array(*map(F.lit, many)), number), F.lit(1))
