"""JSON lines read so that nothing is lost: broken lines and strange columns are kept.

A line that is no JSON object of the schema, or that can't be read whole, is a broken
one.  Columns that the schema does not name stay with their row as a map.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROKEN, STRANGE = "broken_line", "unexpected_column"
_RAW = "_corrupt_record"


def read_lines(spark: SparkSession, path: str, schema: T.StructType, pattern: str | None = None) -> DataFrame:
    """Every line that isn't blank: the schema's columns, ``unexpected`` (a map of the other
    columns, null if there are none), ``broken_line`` (the line, null if it could be read) and
    ``source_file``.

    One pass over the files, no inference.  Types of the schema are kept; a value that does
    not fit its type makes the line a broken one, as Spark's permissive mode has it.
    """
    reader = spark.read
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("source_file"))
    lines = lines.filter(F.length(F.trim("value")) > 0)
    wide = T.StructType([*schema.fields, T.StructField(_RAW, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAW}
    row = F.from_json("value", wide, options)
    parsed = lines.select("value", "source_file", row.alias("row"), F.from_json("value", "map<string,string>").alias("pairs"))
    # an array or a bare value parses to a row of nulls without being marked
    is_object = F.substring(F.ltrim("value"), 1, 1) == "{"
    broken = F.when(~is_object | F.col("row").isNull() | F.col(f"row.{_RAW}").isNotNull(), F.col("value"))
    known = F.array(*[F.lit(n) for n in schema.names])
    strange = F.map_filter("pairs", lambda name, _: ~F.array_contains(known, name))
    return parsed.select(
        *[F.when(broken.isNull(), F.col(f"row.`{n}`")).alias(n) for n in schema.names],
        F.when(broken.isNull() & (F.size(strange) > 0), strange).alias("unexpected"),
        broken.alias(BROKEN),
        "source_file",
    )


def loaded(lines: DataFrame) -> DataFrame:
    """The rows that could be read, with their unexpected columns."""
    return lines.filter(F.col(BROKEN).isNull()).drop(BROKEN)


def rescued(lines: DataFrame) -> DataFrame:
    """What needs a look, a row for each rule it meets: ``rule``, ``column`` (of an unexpected one),
    ``content`` (the line or the value) and ``source_file``."""
    broken = lines.filter(F.col(BROKEN).isNotNull()).select(
        F.lit(BROKEN).alias("rule"), F.lit(None).cast("string").alias("column"), F.col(BROKEN).alias("content"), "source_file"
    )
    strange = lines.filter(F.col("unexpected").isNotNull()).select(
        F.lit(STRANGE).alias("rule"), F.explode("unexpected").alias("column", "content"), "source_file"
    )
    return broken.unionByName(strange)


def rescue_counts(lines: DataFrame) -> DataFrame:
    """One row per file: ``lines`` in all, ``loaded`` ones, and how many each rule holds."""
    return lines.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col(BROKEN).isNull()).alias("loaded"),
        F.count_if(F.col(BROKEN).isNotNull()).alias(BROKEN),
        F.count_if(F.col("unexpected").isNotNull()).alias(STRANGE),
    )
