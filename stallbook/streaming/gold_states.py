"""Monthly analytics kept by increments: each batch adds its states, no row is read again.

A batch writes one state per group it touches, into a folder of its own number, so a
repeated batch replaces them.  Every ``COMPACT_EVERY`` batches all states so far are merged
to a base, which later readers and compactions start from.  What a batch costs follows the
batch; what a reader reads, the groups and the batches since the last base.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stallbook.operators.price_states import finished, merge_states, price_states

COMPACT_EVERY = 20
MONTH = ("year", "month")


def _folders(spark: SparkSession, path: str, name: str) -> dict[int, str]:
    """Numbered folders that were written to their end."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.globStatus(hadoop.Path(f"{path}/{name}=*/_SUCCESS")) or []
    folders = [status.getPath().getParent() for status in found]
    return {int(re.sub(r"\D", "", f.getName().split("=")[1])): f.toString() for f in folders}


def _current(spark: SparkSession, path: str, before: int | None = None) -> list[str]:
    """The folders of the newest base and of all later batches (those below ``before``)."""
    bases = {n: f for n, f in _folders(spark, path, "base").items() if before is None or n < before}
    through = max(bases, default=-1)
    batches = {n: f for n, f in _folders(spark, path, "batch").items() if n > through and (before is None or n < before)}
    chosen = [bases[through]] if bases else []
    return chosen + [batches[n] for n in sorted(batches)]


def stored_states(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest base and all later batches' states (those below ``before``), several per group."""
    chosen = _current(spark, path, before)
    return spark.read.parquet(*chosen) if chosen else None


def add_batch(batch: DataFrame, number: int, path: str, compact_every: int = COMPACT_EVERY) -> None:
    """Writes the states of a batch; then, at the end of a period, the base of all so far."""
    spark = batch.sparkSession
    price_states(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
    if (number + 1) % compact_every == 0:
        merge_states(stored_states(spark, path, number + 1)).write.mode("overwrite").parquet(f"{path}/base={number}")


def drain_states(silver_stream: DataFrame, path: str, checkpoint: str, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Follow a silver stream, adding the states of each batch, then stop."""
    query = (
        silver_stream.writeStream.foreachBatch(lambda batch, number: add_batch(batch, number, path, compact_every))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def read_gold(spark: SparkSession, path: str, **month: int) -> DataFrame:
    """Monthly analytics of all rows so far, of one month only if ``year`` and ``month`` are given."""
    folders = _current(spark, path)
    if not folders:
        raise FileNotFoundError(f"no states in {path}")
    states = spark.read.parquet(*folders)
    for column, value in month.items():
        states = states.filter(F.col(column) == value)
    # one base or batch by itself has one state per group
    return finished(merge_states(states) if len(folders) > 1 else states)
