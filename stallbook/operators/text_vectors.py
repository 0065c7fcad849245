"""Texts as fixed-length vectors: hashed term weights, scaled to length one."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.session import settle

DIMENSIONS = 384


def fit_text_vectors(texts: DataFrame, text: str = "text", dimensions: int = DIMENSIONS) -> PipelineModel:
    """Learn document frequencies: one pass that merges one vector per task."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_terms", pattern=r"(?U)\W+", toLowercase=True),
        HashingTF(inputCol="_terms", outputCol="_counts", numFeatures=dimensions),
        IDF(inputCol="_counts", outputCol="_weights"),
        Normalizer(inputCol="_weights", outputCol="_vector", p=2.0),
    ]
    return Pipeline(stages=stages).fit(texts.filter(F.col(text).isNotNull()))


def with_text_vectors(df: DataFrame, model: PipelineModel, text: str = "text") -> DataFrame:
    """Add ``embedding``; rows without text are dropped."""
    vectors = model.transform(df.filter(F.col(text).isNotNull()))
    return vectors.withColumn("embedding", vector_to_array("_vector", "float32")).drop(
        "_terms", "_counts", "_weights", "_vector"
    )


def term_weights(
    texts: DataFrame, key: str = "chunk_id", text: str = "text", dimensions: int = DIMENSIONS
) -> DataFrame:
    """(key, place, weight): the vectors' non-zero places, scaled to length one.

    Terms are runs of letters and digits in lower case.  The first eight digits of a
    term's MD5 give its place, which any engine can follow; a place weighs its count
    times ln((texts + 1) / (texts with the place + 1)).
    """
    known = texts.filter(F.col(text).isNotNull())
    terms = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    digits = F.substring(F.md5(F.col("term")), 1, 8)
    place = (F.conv(digits, 16, 10).cast("bigint") % dimensions).cast("int")
    counts = (
        # texts go by key before they are counted: a task holds the places of its partition of
        # them, not of a whole file, and the counts need no other exchange
        known.select(key, text)
        .repartition(key)
        .select(key, F.explode(terms).alias("term"))
        .groupBy(key, place.alias("place"))
        .agg(F.count(F.lit(1)).alias("times"))
    )
    counts = settle(counts, "term_counts")
    total = known.count()
    rarity = counts.groupBy("place").agg(F.log((total + 1) / (F.count(F.lit(1)) + 1)).alias("rarity"))
    weighed = counts.join(settle(rarity, "rarity"), "place").select(
        key, "place", (F.col("times") * F.col("rarity")).alias("weight")
    )
    length = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    return weighed.join(length, key).filter("weight <> 0").select(key, "place", (F.col("weight") / F.col("length")).alias("weight"))
