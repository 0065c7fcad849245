"""Rankings over the most recent days of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallbook.functions.numeric import avg_price, mean_price, money
from stallbook.operators.keys import match_keys
from stallbook.session import settle


def recent_days(
    df: DataFrame, keys: Sequence[str], days: int = 30, date: str = "arrival_date"
) -> DataFrame:
    """Rows within ``days`` of the last date of their own key.

    The last dates come from a narrow aggregate, combined on the map side, and
    are joined back, so only rows that pass the cut reach a later shuffle.  (A
    window ``max`` would move every row and gather each key in one task.)  They
    are stored first: Spark then knows how many bytes they have and broadcasts
    them only if that is under its threshold.
    """
    last = settle(df.groupBy(*keys).agg(F.max(date).alias("_last")), "last_days")
    return (
        match_keys(df, last, keys)
        .filter(F.col(date) >= F.date_sub("_last", days))
        .drop("_last")
    )


def newest_rows(
    df: DataFrame, keys: Sequence[str], per_key: int, date: str = "arrival_date"
) -> DataFrame:
    """All rows of the newest days that together hold at least ``per_key`` rows.

    Rows without a date count as the oldest.  Counting by day is a hash aggregate
    over two or three columns and leaves few rows to sort, where ranking the whole
    table would sort all of it.
    """
    by_day = df.groupBy(*keys, date).agg(F.count(F.lit(1)).alias("n"))
    newest = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(date))
    since = (
        by_day.withColumn("later", F.sum("n").over(newest) - F.col("n"))
        .filter(F.col("later") < per_key)
        .groupBy(*keys)
        .agg(F.min(date).alias("_since"), F.bool_or(F.col(date).isNull()).alias("_undated"))
    )
    return (
        match_keys(df, settle(since, "newest_days"), keys)
        .filter((F.col(date) >= F.col("_since")) | (F.col(date).isNull() & F.col("_undated")))
        .drop("_since", "_undated")
    )


def latest_prices(
    prices: DataFrame,
    per_key: int = 15,
    keys: Sequence[str] = ("commodity",),
    tie: Sequence[str] = ("price_id",),
) -> DataFrame:
    """The newest rows of each key.  The rank filter is planned as a group limit
    before the shuffle: every task sends at most ``per_key`` rows per key."""
    newest = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("arrival_date"), *tie)
    return (
        newest_rows(prices, keys, per_key)
        .withColumn("rank", F.row_number().over(newest))
        .filter(F.col("rank") <= per_key)
        .select(
            "market", "state", "commodity", "modal_price", "min_price", "max_price",
            "arrival_date", "rank",
        )
    )


def _mean(price: str) -> Column:
    """Unrounded mean to rank by: two groups may differ by less than a hundredth."""
    return mean_price(price)


def best_markets(prices: DataFrame, per_key: int = 10, days: int = 30) -> DataFrame:
    """Best paying markets per commodity and state over its last days."""
    keys = ("commodity", "state")
    markets = (
        recent_days(prices.select(*keys, "market", "arrival_date", "modal_price", "max_price"), keys, days)
        .groupBy(*keys, "market")
        .agg(
            _mean("modal_price").alias("_mean"),
            avg_price("modal_price").alias("avg_price"),
            money(F.max("max_price")).alias("max_price"),
            F.count("modal_price").alias("data_points"),
        )
    )
    best = Window.partitionBy(*keys).orderBy(F.desc("_mean"), "market")
    ranked = markets.withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= per_key).drop("_mean")


def state_comparison(prices: DataFrame, top: int = 5, days: int = 30) -> DataFrame:
    """The states with the highest mean price per commodity; ``position`` counts
    upwards from the lowest of them, the order in which they are presented."""
    states = (
        recent_days(
            prices.select("commodity", "state", "arrival_date", "modal_price"), ["commodity"], days
        )
        .groupBy("commodity", "state")
        .agg(_mean("modal_price").alias("_mean"), avg_price("modal_price").alias("avg_price"))
    )
    highest = Window.partitionBy("commodity").orderBy(F.desc("_mean"), F.desc("state"))
    ranked = states.withColumn("_rank", F.row_number().over(highest)).filter(F.col("_rank") <= top)
    lowest = Window.partitionBy("commodity").orderBy(F.desc("_rank"))
    return ranked.withColumn("position", F.row_number().over(lowest)).drop("_rank", "_mean")
