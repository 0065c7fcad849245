"""Row rules, deduplication and key checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

Rules = Mapping[str, Column]


def price_rules() -> dict[str, Column]:
    """Rules a cleaned price row has to meet."""
    return {
        "valid_price": F.col("modal_price") > 0,
        "valid_date": F.col("arrival_date").isNotNull(),
        "valid_commodity": F.col("commodity").isNotNull() & (F.length(F.trim("commodity")) > 0),
    }


def _holds(rule: Column) -> Column:
    # an unknown answer (null operand) counts as a violation
    return F.coalesce(rule, F.lit(False))


def _failed(rules: Rules) -> Column:
    names = [F.when(~_holds(rule), F.lit(name)) for name, rule in rules.items()]
    return F.array_compact(F.array(*names))


def keep_valid(df: DataFrame, rules: Rules) -> DataFrame:
    """Rows that meet every rule.

    A filter drops rows whose answer is unknown by itself; the bare conditions
    can be pushed to the scan.
    """
    for rule in rules.values():
        df = df.filter(rule)
    return df


def quarantine(df: DataFrame, rules: Rules) -> DataFrame:
    """Rows that break a rule, with the names of the rules they break."""
    return df.withColumn("failed_rules", _failed(rules)).filter(F.size("failed_rules") > 0)


def violations(rules: Rules) -> list[Column]:
    """Aggregates: how many rows break each rule."""
    return [F.count_if(~_holds(rule)).alias(name) for name, rule in rules.items()]


def rule_counts(df: DataFrame, rules: Rules) -> DataFrame:
    """One row per rule: rows seen, rows that hold, rows that fail.  One pass."""
    total = df.agg(F.count(F.lit(1)).alias("rows"), *violations(rules))
    per_rule = F.array(
        *[F.struct(F.lit(name).alias("rule"), F.col(name).alias("failed")) for name in rules]
    )
    return (
        total.select("rows", F.explode(per_rule).alias("r"))
        .select("r.rule", "rows", (F.col("rows") - F.col("r.failed")).alias("passed"), "r.failed")
    )


def keep_valid_observed(df: DataFrame, rules: Rules) -> tuple[DataFrame, Observation]:
    """Like :func:`keep_valid`, counting failures per rule in the same job."""
    seen = Observation("row_rules")
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *violations(rules))
    return keep_valid(watched, rules), seen


def valid_prices(df: DataFrame) -> DataFrame:
    """Positive price and a known date."""
    return df.filter((F.col("modal_price") > 0) & F.col("arrival_date").isNotNull())


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))


PRICE_IDENTITY = ("arrival_date", "market", "commodity", "variety")


def dedupe(
    df: DataFrame,
    keys: Sequence[str] = PRICE_IDENTITY,
    order: Sequence[str | Column] = ("price_id",),
) -> DataFrame:
    """Keep the first row per key in a fixed order.

    ``row_number() <= 1`` is planned with a group limit on the map side, so each
    task ships at most one row per key: a key with very many copies costs no
    more after the shuffle than any other.
    """
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")


def key_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, rows with a null key, keys held by several rows, and surplus rows."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    has_null = F.lit(False)
    for key in keys:
        has_null = has_null | F.col(key).isNull()
    repeated = ~has_null & (F.col("n") > 1)
    none = F.lit(0).cast("bigint")
    return groups.agg(
        F.coalesce(F.sum("n"), none).alias("rows"),
        F.coalesce(F.sum(F.when(has_null, F.col("n"))), none).alias("null_keys"),
        F.count_if(repeated).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(repeated, F.col("n") - 1)), none).alias("surplus_rows"),
    )


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys held by more than one row."""
    return not_null(df, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
