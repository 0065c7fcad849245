"""Price, scheme, knowledge and guide files: headers, types, lineage.

The same projections serve batch reads and file streams.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallbook import schemas
from stallbook.functions.dates import parse_date
from stallbook.functions.texts import ingest_crop, ingest_disease, unambiguous

# The headers found in price files and the columns they stand for.
PRICE_HEADERS: dict[str, tuple[str, ...]] = {
    "state": ("State", "state"),
    "district": ("District Name", "District", "district"),
    "market": ("Market Name", "Market", "market"),
    "commodity": ("Commodity", "commodity"),
    "variety": ("Variety", "variety"),
    "grade": ("Grade", "grade"),
    "arrival_date": ("Price Date", "Arrival_Date", "arrival_date"),
    "min_price": ("Min Price (Rs./Quintal)", "Min_Price", "min_price"),
    "max_price": ("Max Price (Rs./Quintal)", "Max_Price", "max_price"),
    "modal_price": ("Modal Price (Rs./Quintal)", "Modal_Price", "modal_price"),
}

# The file name patterns of the four sources.
FILE_PATTERNS = {
    "prices": "*prices*.json",
    "schemes": "*schemes*.json",
    "knowledge": "*crop_knowledge*.json",
    "guide": "*pesticide*.json",
}


# Everything is read as text; casts happen in the projection, where bad values
# become null instead of failing the file.  Spark cannot hold two columns that
# differ only in case, so files with lower-case headers bring their own schema.
PRICE_FILE = T.StructType(
    [T.StructField(h, T.StringType()) for hs in PRICE_HEADERS.values() for h in hs[:-1]]
)
SCHEME_FILE = T.StructType([f for f in schemas.SCHEMES.fields if f.name != "source_file"])
GUIDE_FILE = T.StructType([f for f in schemas.GUIDE.fields if f.name != "source_file"])
KNOWLEDGE_FILE = T.StructType(
    [f for f in schemas.KNOWLEDGE.fields if f.name not in ("crop", "disease_name", "source_file")]
)
FILE_SCHEMAS = {
    "prices": PRICE_FILE,
    "schemes": SCHEME_FILE,
    "knowledge": KNOWLEDGE_FILE,
    "guide": GUIDE_FILE,
}


def inferred_schema(spark: SparkSession, path: str, multi_line: bool = True) -> T.StructType:
    """Infer a JSON schema once, to be passed on explicitly afterwards."""
    return spark.read.option("multiLine", multi_line).json(path).schema


def remembered_schema(
    spark: SparkSession, path: str, memory: str, multi_line: bool = True
) -> T.StructType:
    """The schema inferred on the first call, kept as a small file at ``memory``
    and read back from there afterwards, so that later files cannot change it."""
    try:
        return T.StructType.fromJson(json.loads(spark.read.text(memory, wholetext=True).first()[0]))
    except AnalysisException:
        schema = inferred_schema(spark, path, multi_line)
        spark.createDataFrame([(schema.json(),)], "value string").coalesce(1).write.text(memory)
        return schema


def read_json(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    pattern: str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """JSON files with a given schema.

    A multi-line array is read by one task per file; large inputs should come
    as many files, or as JSON lines with ``multi_line=False``.
    """
    reader = spark.read.schema(schema).option("multiLine", multi_line)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header line, all columns as text.  Files whose header differs
    from the first one fail instead of being read by position."""
    return spark.read.option("header", True).option("enforceSchema", False).csv(path)


def read_parquet(spark: SparkSession, path: str, merge_schema: bool = True) -> DataFrame:
    """Parquet files written over time; columns added later are null in older files."""
    return spark.read.option("mergeSchema", merge_schema).parquet(path)


def _found(df: DataFrame, headers: tuple[str, ...]) -> Column:
    present = {c.lower(): c for c in df.columns}
    names = list(dict.fromkeys(present[h.lower()] for h in headers if h.lower() in present))
    if not names:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.col(f"`{n}`").cast("string") for n in names])


def finite(column: str) -> Column:
    """The text as a double; null if it is none, or not finite."""
    value = F.col(column).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def price_key() -> Column:
    """Repeatable key: the same row gets the same id on every read and retry."""
    parts = [
        F.col(c).cast("string")
        for c in (
            "state", "district", "market", "commodity", "variety", "grade", "arrival_date",
            "min_price", "max_price", "modal_price",
        )
    ]
    return F.sha2(unambiguous(*parts), 256)


def price_rows(raw: DataFrame) -> DataFrame:
    """Raw headers to the price schema; unusable numbers and dates become null."""
    return price_columns(raw.withColumn("source_file", F.col("_metadata.file_path")))


def price_columns(raw: DataFrame) -> DataFrame:
    """The same for rows that bring their ``source_file``."""
    named = raw.select(*[_found(raw, headers).alias(c) for c, headers in PRICE_HEADERS.items()], "source_file")
    typed = named.withColumns(
        {
            "arrival_date": parse_date("arrival_date"),
            # "NaN" and "Infinity" are doubles for Spark, but not prices
            **{c: finite(c) for c in ("min_price", "max_price", "modal_price")},
        }
    )
    return typed.select(price_key().alias("price_id"), *typed.columns)


def scheme_rows(raw: DataFrame) -> DataFrame:
    return raw.select(*SCHEME_FILE.names, F.col("_metadata.file_path").alias("source_file"))


def knowledge_rows(raw: DataFrame) -> DataFrame:
    return raw.select(
        "disease_class",
        ingest_crop("disease_class").alias("crop"),
        ingest_disease("disease_class").alias("disease_name"),
        "treatment",
        "prevention",
        "organic",
        F.col("_metadata.file_path").alias("source_file"),
    )


def guide_rows(raw: DataFrame) -> DataFrame:
    return raw.select(*GUIDE_FILE.names, F.col("_metadata.file_path").alias("source_file"))


PROJECTIONS = {
    "prices": price_rows,
    "schemes": scheme_rows,
    "knowledge": knowledge_rows,
    "guide": guide_rows,
}


def load(spark: SparkSession, kind: str, path: str, pattern: str | None = None) -> DataFrame:
    """Batch read of one of the four sources from JSON files."""
    return PROJECTIONS[kind](read_json(spark, path, FILE_SCHEMAS[kind], pattern))


def price_objects(spark: SparkSession, path: str) -> DataFrame:
    """The objects of JSON lines under the first header of each price column, as texts.

    A header is found in any case; of several for one column the first that is listed and
    has a value counts.  What can't be read has no values.
    """
    file = F.col("_metadata.file_path").alias("source_file")
    objects = spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("pairs"), file)
    pairs = F.map_entries("pairs")

    def under(name: str) -> Column:
        return F.get(F.filter(pairs, lambda p: F.lower(p["key"]) == name), F.lit(0))["value"]

    def value(headers: tuple[str, ...]) -> Column:
        return F.coalesce(*[under(name) for name in dict.fromkeys(h.lower() for h in headers)])

    return objects.select(*[value(headers).alias(headers[0]) for headers in PRICE_HEADERS.values()], "source_file")


def load_prices(
    spark: SparkSession,
    path: str,
    file_format: str = "json",
    headers: list[str] | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Price files in JSON or CSV, usable rows only (price present and positive).

    JSON lines are read once, whatever headers their objects have and in whatever case.  The
    headers of multi-line files are looked up by one inference pass unless they are given.
    """
    if file_format == "json" and (headers or multi_line):
        headers = headers or inferred_schema(spark, path, multi_line).names
        schema = T.StructType([T.StructField(h, T.StringType()) for h in headers])
        raw = read_json(spark, path, schema, multi_line=multi_line)
    elif file_format == "json":
        return price_columns(price_objects(spark, path)).filter(F.col("modal_price") > 0)
    elif file_format == "csv":
        raw = read_csv(spark, path)
    else:
        raise ValueError(f"unknown price file format {file_format!r}")
    return price_rows(raw).filter(F.col("modal_price") > 0)
