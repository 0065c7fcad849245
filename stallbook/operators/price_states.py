"""Monthly price statistics as states that can be merged.

A state holds what statistics of a group need of any part of its rows: counts, exact sums
in parts, extremes, a mask of days, and mean and second moment.  States of disjoint parts
merge to the state of all, in any order and any number of steps, and the finished state
gives the columns of ``summaries.monthly_analytics``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallbook.functions.numeric import MILLION, WIDE, half_up, millionths, money, number, price_count, rounded_mean, wide
from stallbook.operators.summaries import MONTH_KEYS

PRICES = ("modal_price", "min_price", "max_price")


def price_states(prices: DataFrame) -> DataFrame:
    """One state per commodity, market, state and month of these rows."""
    sums: list[Column] = []
    for price in PRICES:
        small = millionths(price)
        sums += [
            price_count(price).alias(f"{price}_n"),
            F.sum(F.floor(small / MILLION)).alias(f"{price}_units"),
            F.sum(F.pmod(small, F.lit(MILLION))).alias(f"{price}_rest"),
            F.sum(wide(price)).alias(f"{price}_wide"),
        ]
    modal = number("modal_price")
    return prices.groupBy(*MONTH_KEYS).agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_or(F.expr("shiftleft(1L, day(arrival_date))")).alias("days"),
        *sums,
        F.min(modal).alias("lowest"),
        F.max(modal).alias("highest"),
        F.avg(modal).alias("mean"),
        (F.var_pop(modal) * F.count(modal)).alias("moment"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """One state per group from any number of states of its disjoint parts.

    Most groups have few parts, so states are shuffled as they are and merged where they come."""
    sums = [F.sum(f"{p}_{part}").alias(f"{p}_{part}") for p in PRICES for part in ("n", "units", "rest", "wide")]
    pieces = F.collect_list(F.struct(F.col("modal_price_n").alias("n"), "mean", "moment"))
    merged = states.repartition(*MONTH_KEYS).groupBy(*MONTH_KEYS).agg(
        F.sum("rows").alias("rows"),
        F.bit_or("days").alias("days"),
        *sums,
        F.min("lowest").alias("lowest"),
        F.max("highest").alias("highest"),
        _combined(pieces).alias("_m"),
    )
    return merged.withColumns({"mean": F.col("_m.mean"), "moment": F.col("_m.moment")}).select(*states.columns)


def _combined(pieces: Column) -> Column:
    """Mean and second moment of all parts, two at a time: no difference of large squares.

    The parts are as many as batches between two compactions."""
    order = F.array_sort(F.filter(pieces, lambda p: p["n"] > 0))

    def both(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        apart = b["mean"] - a["mean"]
        return F.struct(
            n.alias("n"),
            (a["mean"] + apart * b["n"] / n).alias("mean"),
            (a["moment"] + b["moment"] + apart * apart * a["n"] * b["n"] / n).alias("moment"),
        )

    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("moment"))
    found = F.aggregate(order, none, both)
    return F.when(F.size(order) > 0, found)


def finished(states: DataFrame) -> DataFrame:
    """The columns of ``monthly_analytics`` from one state per group."""

    def mean(price: str) -> Column:
        none = F.lit(0).cast("bigint")
        units = F.coalesce(F.col(f"{price}_units"), none).cast("decimal(20,0)")
        rest = F.coalesce(F.col(f"{price}_rest"), none).cast("decimal(20,0)") / F.lit(MILLION).cast("decimal(7,0)")
        total = units + rest + F.coalesce(F.col(f"{price}_wide"), F.lit(0).cast(WIDE))
        return F.when(F.col(f"{price}_n") > 0, rounded_mean(total, F.col(f"{price}_n")))

    n = F.col("modal_price_n")
    return states.select(
        *MONTH_KEYS,
        F.col("rows").alias("total_records"),
        F.coalesce(F.bit_count("days"), F.lit(0)).cast("bigint").alias("trading_days"),
        mean("modal_price").alias("avg_modal_price"),
        money("lowest").alias("min_modal_price"),
        money("highest").alias("max_modal_price"),
        half_up(F.when(n > 1, F.sqrt(F.col("moment") / (n - 1)))).alias("price_stddev"),
        mean("min_price").alias("avg_min_price"),
        mean("max_price").alias("avg_max_price"),
    )
