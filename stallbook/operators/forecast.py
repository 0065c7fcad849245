"""Trend label and short forecast for every series at once.

The level is an exponentially weighted mean and the forecast multiplies it by
a daily factor with a floor.  Both recursions have closed forms, so a series is
one aggregate and a forecast one expression per day; nothing loops.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallbook.functions.numeric import half_up, mean_price
from stallbook.operators.daily import KEYS

ALPHA = 0.3  # smoothing weight of the newest point
FLOOR = 0.7  # lowest forecast as a share of the last price
MIN_ROWS = 10  # fewer price rows: no forecast
SWING_PCT = 3  # change that counts as rising or falling


def series_state(prices: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per key: rows, points, last day and price, trend in percent, level."""
    daily = prices.groupBy(*keys, "arrival_date").agg(
        mean_price("modal_price").alias("price"),
        F.count(F.lit(1)).alias("rows"),
    )
    newest = Window.partitionBy(*keys).orderBy(F.desc("arrival_date"))
    numbered = daily.withColumns(
        {
            "back": F.row_number().over(newest),
            "points": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
        }
    )
    # the oldest point carries the whole remaining weight (1 - ALPHA)^(n - 1)
    decay = F.pow(F.lit(1 - ALPHA), F.col("back") - 1)
    weight = F.when(F.col("back") == F.col("points"), decay).otherwise(ALPHA * decay)
    state = numbered.groupBy(*keys).agg(
        F.sum("rows").alias("records"),
        F.max("points").alias("points"),
        F.max("arrival_date").alias("last_day"),
        F.max_by("price", "arrival_date").alias("last_price"),
        F.avg(F.when(F.col("back") <= 7, F.col("price"))).alias("mean_7"),
        F.avg(F.when(F.col("back") <= 30, F.col("price"))).alias("mean_30"),
        F.sum(F.col("price") * weight).alias("level"),
    )
    shift = (F.col("mean_7") - F.col("mean_30")) / F.col("mean_30") * 100
    return state.withColumn(
        "shift_pct",
        F.when((F.col("points") >= 7) & (F.col("mean_30") > 0), shift).otherwise(0.0),
    ).withColumn(
        "trend",
        F.when(F.col("shift_pct") > SWING_PCT, "rising")
        .when(F.col("shift_pct") < -SWING_PCT, "falling")
        .otherwise("stable"),
    )


def _price_on(day: Column) -> Column:
    """Unrounded forecast ``day`` days after the last one."""
    factor = 1 + F.col("shift_pct") / 100 / 30
    least = F.col("last_price") * FLOOR
    falling = F.greatest(F.col("level") * F.pow(factor, day), least)
    rising = F.greatest(F.col("level") * factor, least) * F.pow(factor, day - 1)
    return F.when(factor < 1, falling).otherwise(rising)


def gaussian(seed: int, *values: Column) -> Column:
    """A normal number that only the seed and the values decide (Box-Muller)."""

    def uniform(which: int) -> Column:
        bits = F.xxhash64(F.lit(seed), F.lit(which), *values).bitwiseAND(F.lit((1 << 52) - 1))
        return (bits + 1) / float((1 << 52) + 1)

    return F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * math.pi * uniform(1))


def _noisy_path(keys: Sequence[str], days: int, seed: int) -> Column:
    """Prices of the days ahead, each from the one before it."""
    factor = 1 + F.col("shift_pct") / 100 / 30
    last = F.col("last_price")

    def next_day(path: Column, day: Column) -> Column:
        before = F.coalesce(F.get(path, F.size(path) - 1), F.col("level"))
        noise = gaussian(seed, *[F.col(k) for k in keys], day) * last * 0.01
        return F.concat(path, F.array(F.greatest(before * factor + noise, last * FLOOR)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(days)), F.array().cast("array<double>"), next_day)


def price_forecast(
    prices: DataFrame,
    keys: Sequence[str] = KEYS,
    days: int = 7,
    noise_seed: int | None = None,
) -> DataFrame:
    """One row per key and future day; series that are too short have none.

    ``noise_seed`` adds noise of 1 % of the last price to each day, and the next day
    goes on from there.  Seed, key and day decide it, so it repeats.
    """
    if noise_seed is None:
        path = F.transform(F.sequence(F.lit(1), F.lit(days)), _price_on)
    else:
        path = _noisy_path(keys, days, noise_seed)
    return (
        series_state(prices, keys)
        .filter(F.col("records") >= MIN_ROWS)
        .select("*", F.posexplode(path).alias("_before", "_price"))
        .withColumn("day", F.col("_before") + 1)
        .select(
            *keys,
            "day",
            F.date_add("last_day", F.col("day")).alias("date"),
            half_up("_price").alias("predicted_price"),
            "trend",
        )
    )


def price_outlook(prices: DataFrame, keys: Sequence[str] = KEYS, days: int = 7) -> DataFrame:
    """One row per key: last price, mean forecast, shift and trend, or the
    reason why there is no forecast."""
    enough = F.col("records") >= MIN_ROWS
    horizon = F.transform(F.sequence(F.lit(1), F.lit(days)), lambda d: F.floor(_price_on(d) * 100 + 0.5))
    # the days are forecast to the hundredth, so the mean is over hundredths
    total = F.aggregate(horizon, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return series_state(prices, keys).select(
        *keys,
        F.when(enough, "ok").otherwise("insufficient data").alias("status"),
        "records",
        F.when(enough, F.col("points")).alias("points"),
        F.when(enough, F.col("last_day")).alias("last_day"),
        F.when(enough, half_up("last_price")).alias("current_price"),
        F.when(enough, half_up(total / days / 100)).alias("forecast_avg"),
        F.when(enough, half_up("shift_pct")).alias("pct_change"),
        F.when(enough, F.col("trend")).otherwise("unknown").alias("trend"),
    )
