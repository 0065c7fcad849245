"""Mixing sources to target weights, by DataFrame operations only.

Words are counted per source; targets follow from the weights; a source's
repetition rate is its target over its size.  A document is emitted floor(rate)
times, and once more with the fraction as probability: if its hash-seeded draw
falls below a threshold.  The threshold isn't the fraction itself but the draw
below which that fraction of the source's words lies (to one of ``BINS``), which
takes the noise of independent draws out of the source's sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallbook.llm.common import WORD, table, uniform
from stallbook.session import settle

WEIGHTS = (1.0, 2.0, 3.0)
MAX_REPEATS = 3
SEED = 11
#: Equal parts of the draws' range in which a source's words are counted.
BINS = 1024
#: Parts in which rows of equal id and text are numbered.
SALTS = 64


def word_count(text: Column) -> Column:
    """Words of the whole text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """Targets of the sources (``source``, ``source_size``): they share all sizes by
    weight, the weights repeating in the order of the names by code point, null
    last, and stop at ``max_repeats`` times the source; what is over is shared by
    weight among the others until none is above.

    Sharing again and again ends where one price per weight holds for all sources
    that aren't capped.  Sorted by the price at which a source is full, running sums
    give that price directly, without a loop.  One row per source is all this
    step holds, and a source has many documents.
    """
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights))
    cap = F.col("source_size") * F.lit(float(max_repeats))
    full = Window.orderBy(F.col("_full"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        sizes.withColumn("_weight", weight)
        .withColumn("_full", cap / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_capped", F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        # the price if exactly the sources before this one are capped
        .withColumn("_price", (F.col("_total") - F.col("_capped")) / F.sum("_weight").over(after))
        .withColumn("_holds", F.when(F.col("_price") <= F.col("_full"), F.col("_price")))
        .withColumn("_price", F.max("_holds").over(everything))
        .withColumn("target", F.least(cap, F.coalesce(F.col("_price") * F.col("_weight"), cap)))
        .select("source", "source_size", "target")
    )


def thresholds(sized: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """For every source the bin below which documents get one more copy, so that
    the words of these come nearest to what whole copies leave of the target."""
    bins = sized.groupBy("source", draw_bin(seed).alias("_bin")).agg(F.sum("size").alias("_words"))
    upto = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rate = F.when(F.col("_size_of_source") > 0, F.col("_target") / F.col("_size_of_source")).otherwise(F.lit(0.0))
    edges = (
        bins.withColumn("_upto", F.sum("_words").over(upto))
        .join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_rate", rate)
        .withColumn("_want", (F.col("_rate") - F.floor("_rate")) * F.col("_size_of_source"))
        .select(
            "_source",
            "_size_of_source",
            "_target",
            F.floor("_rate").cast("long").alias("_whole"),
            F.least(
                F.struct(F.abs(F.col("_upto") - F.col("_words") - F.col("_want")).alias("off"), F.col("_bin").alias("edge")),
                F.struct(F.abs(F.col("_upto") - F.col("_want")).alias("off"), (F.col("_bin") + 1).alias("edge")),
            ).alias("_near"),
        )
    )
    return edges.groupBy("_source", "_size_of_source", "_target", "_whole").agg(F.min("_near").getField("edge").alias("_edge"))


def draw_bin(seed: int) -> Column:
    return F.floor(uniform(F.col("doc_id").cast("long"), F.col("_text"), F.col("_place"), seed=seed) * BINS)


def with_places(documents: DataFrame) -> DataFrame:
    """Adds ``_text``, a hash of the text, and ``_place``: from 0 among rows of equal id and text.

    Rows that come once, nearly all, stay where they are.  The others are numbered in two
    steps, in salted parts and then part by part, so very many equal rows don't meet in one
    task; which of them has which number makes no difference.
    """
    keyed = documents.withColumn("_text", F.xxhash64("text"))
    keyed = keyed.withColumn("_equal", F.xxhash64(F.col("doc_id").cast("long"), F.col("_text")))
    counts = keyed.groupBy("_equal").agg(F.count(F.lit(1)).alias("_n"))
    several = settle(counts.where(F.col("_n") > 1).select("_equal"), "repeated")
    if several.isEmpty():
        return keyed.withColumn("_place", F.lit(0).cast("long")).drop("_equal")
    once = keyed.join(several, "_equal", "left_anti").withColumn("_place", F.lit(0).cast("long"))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))
    salted = settle(keyed.join(several, "_equal", "left_semi").withColumn("_salt", salt), "repeated")
    earlier = Window.partitionBy("_equal").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("_equal", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_equal", "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_equal", "_salt").orderBy("doc_id"))
    numbered = salted.withColumn("_in", inside).join(starts, ["_equal", "_salt"])
    placed = numbered.withColumn("_place", F.col("_before") + F.col("_in") - 1)
    return once.unionByName(placed.select(*once.columns)).drop("_equal")


def copies(
    documents: DataFrame, sized: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = SEED
) -> DataFrame:
    """Adds ``_size_of_source``, ``_target`` and ``_copies`` to rows with ``doc_id`` and ``source``."""
    targets = settle(source_targets(source_sizes(sized), weights), "targets").select(
        F.col("source").alias("_source"), F.col("source_size").alias("_size_of_source"), F.col("target").alias("_target")
    )
    edges = settle(thresholds(sized, targets, seed), "thresholds")
    return (
        documents.join(edges, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_copies", F.col("_whole") + (draw_bin(seed) < F.col("_edge")).cast("long"))
        .drop("_source", "_whole", "_edge")
    )


def sizes(documents: DataFrame) -> DataFrame:
    words = word_count(F.col("text")).alias("size")
    placed = with_places(documents.select("doc_id", "text", "source"))
    return settle(placed.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "_text", "_place", words), "sized")


def source_sizes(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"))


def mixture(documents: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """What the mix takes of every row of ``documents`` (``doc_id``, ``text``, ``source``).

    ``taken`` is the document's words times its copies: 0 to 3 of them, as the rate
    is at most 3.  A null or empty text has size 0 and takes nothing; a source
    without words has the target 0; null is a source of its own.  The id, the text and, among
    rows that agree in both, a number decide the draw, so reruns agree in any order and
    layout and rows without an id are drawn apart.  Further
    columns are ignored; an empty table gives an empty table.
    """
    sized = sizes(documents)
    return copies(sized, sized, weights, seed).select(
        "doc_id",
        "size",
        F.col("_size_of_source").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("size") * F.col("_copies")).alias("taken"),
    )


def mixed_documents(documents: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, all columns kept."""
    # the row travels whole, so that no column of it can clash with those added here
    whole = documents.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"))
    drawn = copies(with_places(whole), sizes(documents), weights, seed)
    repeated = drawn.withColumn("_copy", F.explode(F.expr("array_repeat(0, cast(_copies as int))")))
    return repeated.select("_row.*")


def op4_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed by source, weights 1, 2, 3 in turn."""
    return mixture(table(spark, folder, "documents"))
