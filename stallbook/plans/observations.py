"""Price observations derived from order lines.

Maps the star schema (lineitem, part, supplier, nation) to the raw price table:
brand = commodity, supplier = market, nation = state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _money(value: Column) -> Column:
    return F.floor(value * 100 + 0.5) / 100


def from_lines(
    lines: DataFrame, part: DataFrame, supplier: DataFrame, nation: DataFrame, *also: str
) -> DataFrame:
    """Join and rename.  No join is hinted: Spark broadcasts a dimension only
    while its size is under ``spark.sql.autoBroadcastJoinThreshold``."""
    day = F.to_date("l_shipdate")
    identity = F.concat_ws(
        "-",
        *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
        day.cast("string"),
    )
    return (
        lines.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .join(
            supplier.select("s_suppkey", "s_name", "s_nationkey"),
            F.col("l_suppkey") == F.col("s_suppkey"),
        )
        .join(nation.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.sha2(identity, 256).alias("price_id"),
            F.col("n_name").alias("state"),
            F.concat(F.lit("D"), (F.col("s_suppkey") % 10).cast("string")).alias("district"),
            F.col("s_name").alias("market"),
            F.col("p_brand").alias("commodity"),
            F.col("l_returnflag").alias("variety"),
            F.col("l_linestatus").alias("grade"),
            day.alias("arrival_date"),
            _money(F.col("l_extendedprice") - F.col("l_quantity")).alias("min_price"),
            _money(F.col("l_extendedprice") + F.col("l_quantity")).alias("max_price"),
            _money(F.col("l_extendedprice")).alias("modal_price"),
            *also,
        )
    )


def per_unit(observations: DataFrame, quantity: str = "l_quantity") -> DataFrame:
    """The same rows with prices of one unit, in four decimals."""

    def price(column: str) -> Column:
        hundredths = F.floor(F.col(column) * 100 + 0.5).cast("bigint")
        return F.floor(hundredths * 100 / F.col(quantity).cast("bigint")) / 10000

    prices = {c: price(c) for c in ("min_price", "max_price", "modal_price")}
    return observations.withColumns(prices).drop(quantity)


def unit_prices(spark: SparkSession, folder: str) -> DataFrame:
    names = ("lineitem", "part", "supplier", "nation")
    return per_unit(from_lines(*[table(spark, folder, n) for n in names], "l_quantity"))


def price_observations(spark: SparkSession, folder: str) -> DataFrame:
    names = ("lineitem", "part", "supplier", "nation")
    return from_lines(*[table(spark, folder, n) for n in names])
