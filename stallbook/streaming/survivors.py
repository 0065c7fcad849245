"""One row per key from a stream, the same one as in the batch form.

The survivor of a key is the row of the smallest id, whenever it comes.  State per key is
the smallest id so far: a row is passed on if it is smaller, so what is written holds the
survivor and those it superseded, and a reader keeps the smallest.  What was passed on in the
last ``keep`` is the state: a repeat that comes later is passed on again and lost to the
survivor when it is read.  So what a batch reads is bounded by the keys of one ``keep``, and
rows late by any time are neither lost nor doubled.

Copies of a key meet in steps: a task first keeps the smallest of each Arrow batch, so a key
that holds most rows sends one from each such batch, and these meet in the key's task.

Time is that of arrival, so no row is late, and a stream that has read what there is ends.
Any state store serves, since none is used.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stallbook.operators.keys import pack_ids, unpack_ids
from stallbook.operators.quality import PRICE_IDENTITY, dedupe
from stallbook.session import freed, ship_package

KEEP_MS = 30 * 24 * 3600 * 1000
SEEN = "_seen"
BATCH = "_batch"


def smallest_of_batches(stream: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of each Arrow batch the row of the smallest id of every key; without state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = pc.sort_indices(batch.column(order))
            columns = [batch.column(k).take(places) for k in keys]
            named = pa.table([*columns, pa.array(range(len(places)), pa.int64())], [*map(str, range(len(keys))), "at"])
            first = named.group_by([*map(str, range(len(keys)))], use_threads=False).aggregate([("at", "min")])
            chosen = places.take(first.column("at_min").combine_chunks())
            yield batch.take(chosen.take(pc.sort_indices(chosen)))

    return stream.mapInArrow(run, stream.schema)


def survivors(batch: DataFrame, held: DataFrame | None, keys: Sequence[str] = PRICE_IDENTITY, order: str = "price_id") -> DataFrame:
    """Rows that are the smallest of their key, and smaller than any of ``held`` (``keys`` and ``order``).
    ``order`` is a text that no row lacks.  Rows and what is held go by key once, ids as bytes."""
    ship_package(batch.sparkSession)
    both = smallest_of_batches(batch.filter(f"`{order}` IS NOT NULL"), keys, order).withColumn(SEEN, F.lit(False))
    if held is not None:
        both = both.unionByName(held.select(*keys, order).withColumn(SEEN, F.lit(True)), allowMissingColumns=True)
    # of equal ids the one that is held wins
    return dedupe(_by_key(both, keys, order), keys, [order, F.desc(SEEN)]).filter(~F.col(SEEN)).drop(SEEN)


def _by_key(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows where their key's others are."""
    ids = [order] if order not in keys else []
    return unpack_ids(pack_ids(rows, ids).repartition(*[F.col(k) for k in keys]), ids)


def drain_survivors(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str] = PRICE_IDENTITY,
    order: str = "price_id",
    keep_ms: int = KEEP_MS,
) -> StreamingQuery:
    """Append what passes to ``path``, exactly once, and stop: a batch has a folder of its own
    number there, so a repeated batch replaces its files."""
    schema = stream.select(*keys, order).schema.add(SEEN, T.LongType()).add(BATCH, T.LongType())

    def append(batch: DataFrame, number: int) -> None:
        spark, now = batch.sparkSession, int(time.time() * 1000)
        held = None
        if number > 0:
            stored = spark.read.schema(schema).parquet(path)
            held = stored.filter((F.col(BATCH) < number) & (F.col(SEEN) >= now - keep_ms))
        passed = survivors(batch, held, keys, order).withColumn(SEEN, F.lit(now))
        passed.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{BATCH}={number}")

    with freed(stream.sparkSession):
        query = (
            stream.writeStream.foreachBatch(append)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return query


def read_survivors(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str] = PRICE_IDENTITY, order: str = "price_id") -> DataFrame:
    """One row per key of all that was passed on so far, where a key has one row a batch at most."""
    return dedupe(_by_key(spark.read.schema(schema).parquet(path).select(*schema.names), keys, order), keys, [order])
