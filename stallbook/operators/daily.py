"""Daily price series for every key at once.

The raw rows are folded to one row per key and day with map-side combining;
everything after that runs over days, of which a key has a bounded number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallbook.functions.numeric import price_count, price_total

KEYS = ("commodity", "state", "market")


def choose(df: DataFrame, **wanted: str | Sequence[str] | None) -> DataFrame:
    """Equality filters on optional keys; empty ones are skipped."""
    for column, value in wanted.items():
        if value is None or value == "" or value == []:
            continue
        several = isinstance(value, (list, tuple, set))
        df = df.filter(F.col(column).isin(list(value)) if several else F.col(column) == value)
    return df


def daily_prices(prices: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean modal, min and max price and the number of rows per key and day.

    Means are decimals with ten digits, so that means of them stay exact.
    """

    def mean(column: str):
        return F.round(F.try_divide(price_total(column), price_count(column)), 10).cast("decimal(32,10)")

    return prices.groupBy(*keys, "arrival_date").agg(
        mean("modal_price").alias("avg_price"),
        mean("min_price").alias("min_price"),
        mean("max_price").alias("max_price"),
        F.count("modal_price").alias("volume"),
    )


def last_days(daily: DataFrame, keys: Sequence[str] = KEYS, days: int = 90) -> DataFrame:
    """Cut a series to its last ``days`` days, but only if it has more points."""
    # ordered like the rolling means that follow, so that one sort serves both
    key = Window.partitionBy(*keys).orderBy("arrival_date").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return (
        daily.withColumns(
            {
                "_points": F.count(F.lit(1)).over(key),
                "_last": F.max("arrival_date").over(key),
            }
        )
        .filter((F.col("_points") <= days) | (F.col("arrival_date") >= F.date_sub("_last", days)))
        .drop("_points", "_last")
    )


def price_trend(
    prices: DataFrame, keys: Sequence[str] = KEYS, days: int | None = 90
) -> DataFrame:
    """Daily series with 7 and 30 point rolling means, taken after the cut."""
    series = daily_prices(prices, keys)
    if days:
        series = last_days(series, keys, days)
    by_day = Window.partitionBy(*keys).orderBy("arrival_date")

    def mean_over(rows):
        return F.try_divide(F.sum("avg_price").over(rows), F.count("avg_price").over(rows))

    return series.withColumns(
        {
            "ma_7d": mean_over(by_day.rowsBetween(-6, 0)),
            "ma_30d": mean_over(by_day.rowsBetween(-29, 0)),
        }
    ).withColumns(
        {
            c: F.round(c, 4).cast("double")
            for c in ("avg_price", "min_price", "max_price", "ma_7d", "ma_30d")
        }
    )
