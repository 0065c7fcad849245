"""Grouped price summaries.

All of them are plain hash aggregates: partial results are built on the map
side, so one very frequent commodity reaches the shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.functions.numeric import avg_price, half_up, money, price_count, price_total, rounded_mean

MONTH_KEYS = ("commodity", "market", "state", "year", "month")


def monthly_analytics(prices: DataFrame) -> DataFrame:
    """Price statistics per commodity, market, state and month.

    Trading days are counted as set bits of a day-of-month mask.  That is exact,
    since a group never spans more than one month, and needs one shuffle where
    ``count(DISTINCT)`` needs two.
    """
    day_bit = F.expr("shiftleft(1L, day(arrival_date))")
    return prices.groupBy(*MONTH_KEYS).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.coalesce(F.bit_count(F.bit_or(day_bit)), F.lit(0)).cast("bigint").alias("trading_days"),
        avg_price("modal_price").alias("avg_modal_price"),
        money(F.min("modal_price")).alias("min_modal_price"),
        money(F.max("modal_price")).alias("max_modal_price"),
        half_up(F.stddev("modal_price")).alias("price_stddev"),
        avg_price("min_price").alias("avg_min_price"),
        avg_price("max_price").alias("avg_max_price"),
    )


def commodity_summary(prices: DataFrame, top: int = 20) -> DataFrame:
    """Size, price range and date span of the most frequent commodities."""
    return (
        prices.groupBy("commodity")
        .agg(
            F.count(F.lit(1)).alias("records"),
            avg_price("modal_price").alias("avg_price"),
            money(F.min("modal_price")).alias("min_price"),
            money(F.max("modal_price")).alias("max_price"),
            F.min("arrival_date").alias("earliest"),
            F.max("arrival_date").alias("latest"),
        )
        .orderBy(F.desc("records"), "commodity")
        .limit(top)
    )


def commodity_analytics(prices: DataFrame, more_than: int = 100, top: int = 10) -> DataFrame:
    """Breadth and price level of commodities with enough records.

    Two distinct counts in one aggregate would make Spark expand every row
    threefold.  Folding the rows per commodity, state and market first leaves
    the distinct counts to a small table.  The spread is put together from the
    spread within and between the groups.
    """
    groups = prices.groupBy("commodity", "state", "market").agg(
        F.count(F.lit(1)).alias("rows"),
        price_count("modal_price").alias("n"),
        price_total("modal_price").alias("sum"),
        F.avg("modal_price").alias("mean"),
        F.var_pop("modal_price").alias("within"),
        F.max("modal_price").alias("highest"),
        F.min("arrival_date").alias("first"),
        F.max("arrival_date").alias("last"),
    )
    total, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    squares = F.sum(F.col("n") * (F.col("within") + F.col("mean") * F.col("mean")))
    variance = F.when(total > 1, F.greatest(squares - total * mean * mean, F.lit(0.0)) / (total - 1))
    return (
        groups.groupBy("commodity")
        .agg(
            F.sum("rows").alias("total_records"),
            F.countDistinct("market").alias("num_markets"),
            F.countDistinct("state").alias("num_states"),
            rounded_mean(F.sum("sum"), total).alias("avg_price"),
            money(F.max("highest")).alias("max_price"),
            half_up(F.sqrt(variance)).alias("price_stddev"),
            F.min("first").alias("data_from"),
            F.max("last").alias("data_until"),
        )
        .filter(F.col("total_records") > more_than)
        .orderBy(F.desc("avg_price"), "commodity")
        .limit(top)
    )


def top_commodities(prices: DataFrame, top: int = 10) -> DataFrame:
    """Most frequent commodities with their mean price."""
    return (
        prices.groupBy("commodity")
        .agg(F.count(F.lit(1)).alias("records"), avg_price("modal_price").alias("avg_price"))
        .orderBy(F.desc("records"), "commodity")
        .limit(top)
    )


def commodity_counts(prices: DataFrame, top: int = 20) -> DataFrame:
    """Row count per commodity, largest first."""
    return (
        prices.groupBy("commodity")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "commodity")
        .limit(top)
    )


def daily_trend(enriched: DataFrame) -> DataFrame:
    """Per commodity and day: mean price, mean of both moving averages, rows."""
    return enriched.groupBy("commodity", "arrival_date").agg(
        avg_price("modal_price").alias("avg_price"),
        avg_price("moving_avg_7d").alias("ma_7d"),
        avg_price("moving_avg_30d").alias("ma_30d"),
        F.count(F.lit(1)).alias("records"),
    )


def trend_overview(trend: DataFrame) -> DataFrame:
    """Per commodity: data points, date range and mean of the daily averages."""
    return trend.groupBy("commodity").agg(
        F.count(F.lit(1)).alias("data_points"),
        F.min("arrival_date").alias("first_day"),
        F.max("arrival_date").alias("last_day"),
        avg_price("avg_price").alias("avg_price"),
    )


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct combinations without nulls or empty texts in the last column."""
    last = columns[-1]
    return df.select(*columns).filter(F.col(last).isNotNull() & (F.col(last) != "")).distinct()


def value_lists(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key, the sorted list of distinct values of a dimension column.

    The list is as long as the dimension (markets, states, growth stages), not
    as the table; ``distinct`` runs before the lists are collected.
    """
    return (
        distinct_values(df, *keys, value)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(value)).alias(f"{value}_list"))
    )


def first_commodities(prices: DataFrame, top: int = 100) -> DataFrame:
    """Alphabetically first commodities."""
    return distinct_values(prices, "commodity").orderBy("commodity").limit(top)
