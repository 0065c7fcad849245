"""Range shards from sampled splitters, by DataFrame operations only.

1. A hash-seeded sample draws rows with a probability that grows with their
   size; quantiles of the sampled keys are the splitters of the ranges.  A key
   that fills more than one quantile gets a range of its own.
2. Sizes and rows of each range are counted over all rows.  A range with more
   bytes than its due, as that of a hot key, is divided by the hash of a second
   key into as many parts as it needs.
3. Each part is sorted by itself; running sums over the parts (of which there
   are few) turn places in a part into places in the whole, and those into
   shards of nearly equal bytes with gapless slots.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallbook.llm.common import table, uniform
from stallbook.session import settle

SHARDS = 16
#: Ranges that the splitters bound; those of hot keys come on top.
RANGES = 512
#: Rows that the sample holds on average; its quantiles are all that leaves Spark.
SAMPLE_ROWS = 20_000
#: Bytes beyond which a range is divided at any rate.
RANGE_BYTES = 64 << 20
LAW = "bytes"



def splitters(
    sized: DataFrame, total: int, ranges: int = RANGES, sample_rows: int = SAMPLE_ROWS, seed: int = 7
) -> list[int]:
    """Boundaries of ``key`` with about equal ``size`` between them.

    Every row is drawn once for each ``total / sample_rows`` of its size, the rest
    of the division being a chance that its hash decides.  Keys are whole numbers
    below 2 ** 53.
    """
    step = max(1.0, total / sample_rows)
    draws = F.floor(F.col("size") / F.lit(step) + uniform(F.col("key"), F.col("doc_id"), seed=seed))
    points = ", ".join(f"{i / ranges!r}D" for i in range(1, ranges))
    drawn = sized.select("key", draws.cast("long").alias("draws")).where("draws > 0")
    at = drawn.agg(F.expr(f"percentile(key, array({points}), draws)").alias("at")).first()["at"]
    times = Counter(int(x) for x in at or [])
    return sorted({*times, *(key + 1 for key, n in times.items() if n > 1)})


def range_of(key: str, bounds: list[int]) -> Column:
    """How many boundaries are at or below the key, found by halving."""
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    if not steps:
        return F.lit(0)
    held = ", ".join(f"{b}L" for b in bounds)
    return F.expr(
        f"aggregate(array({', '.join(map(str, steps))}), 0, (at, step) -> "
        f"if(at + step <= {len(bounds)} and get(array({held}), at + step - 1) <= {key}, at + step, at))"
    )


def at_index(values: list[int], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), index)


def range_shards(
    sized: DataFrame,
    shards: int = SHARDS,
    ranges: int = RANGES,
    sample_rows: int = SAMPLE_ROWS,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows (``doc_id``, ``size``, ``key``, ``spread`` and others).

    Rows are ordered by ``key``; the shards are runs of that order, and their sums of
    ``size`` differ by less than two rows' sizes.  Within a hot key the order goes
    by the hash of ``spread`` first.  ``slot`` counts the rows of a shard from 0.
    ``sized`` is read several times, so it should be a stored table.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    total = sized.agg(F.sum("size")).first()[0] or 0
    bounds = splitters(sized, total, ranges, sample_rows) if total else []
    ranged = sized.withColumn("_range", range_of("key", bounds))
    held = {r["_range"]: r for r in ranged.groupBy("_range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    b = [held[i]["b"] if i in held else 0 for i in range(len(bounds) + 1)]
    n = [held[i]["n"] if i in held else 0 for i in range(len(bounds) + 1)]
    due = max(1, min(range_bytes, 2 * total // ranges))
    parts = [max(1, -(-x // due)) if x > 2 * due else 1 for x in b]
    placed = ranged.withColumn(
        "_part", F.pmod(F.xxhash64(F.col("spread")), at_index(parts, F.col("_range"))).cast("long")
    )
    earlier = Window.partitionBy("_range").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        placed.groupBy("_range", "_part")
        .agg(F.sum("size").alias("b"), F.count("*").alias("n"))
        .select(
            "_range",
            "_part",
            (at_index([0, *accumulate(b)], F.col("_range")) + F.coalesce(F.sum("b").over(earlier), F.lit(0))).alias("_bytes"),
            (at_index([0, *accumulate(n)], F.col("_range")) + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("_rows"),
        )
    )
    order = Window.partitionBy("_range", "_part").orderBy("key", "doc_id", "size")
    running = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        placed.withColumn("_row", F.row_number().over(order) - 1)
        .withColumn("_upto", F.coalesce(F.sum("size").over(running), F.lit(0)))
        .join(before, ["_range", "_part"])
        .withColumn("_row", F.col("_rows") + F.col("_row"))
        .withColumn("shard", F.expr(f"cast(floor((_bytes + _upto) * {shards} / {max(1, total)}D) as int)"))
        .withColumn("shard", F.least("shard", F.lit(shards - 1)))
        .drop("_range", "_part", "_bytes", "_rows", "_upto")
    )
    placed = settle(placed, "placed")
    counts = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    first = [0, *accumulate(counts.get(s, 0) for s in range(shards))]
    return placed.withColumn("slot", F.col("_row") - at_index(first, F.col("shard"))).drop("_row", "key", "spread")


def shard_documents(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Where every row of ``documents`` (``doc_id``, ``text``) goes.

    The key is a hash of the text, so copies of a text are neighbours and only
    meet a boundary where a shard ends, unless they are more than a range holds.
    A null text has size 1 and the CRC of no bytes, as an empty one.  Repeated
    rows get a slot each; a null ``doc_id`` sorts first; further columns are
    ignored; an empty table gives an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).bitwiseAND(F.lit((1 << 52) - 1)).alias("key"),
        # rows without an id are told apart by a number that is stored with them, so that
        # very many copies of one text are spread as others are
        F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id()).alias("spread"),
    )
    placed = range_shards(settle(sized, "sized"), shards)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_sampled_splitters(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    return shard_documents(table(spark, folder, "documents"))
