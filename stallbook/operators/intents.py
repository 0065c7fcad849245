"""Question routing by keyword lexicons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.functions import lexicon as lx
from stallbook.functions.numeric import half_up
from stallbook.functions.texts import strip

PREVIEW_LENGTH = 100


def classify(
    df: DataFrame,
    text: str = "text",
    lexicon: Mapping[str, Sequence[str]] = lx.INTENT_KEYWORDS,
    whole_word: bool = False,
) -> DataFrame:
    """Add intent and confidence.

    Most hits win, ties go to the intent listed first; confidence is the share
    of the winner in all hits.  Blank text is (general, 0), no hit (general, 0.3).
    The lexicon is part of the program and planned as literals of one projection.
    """
    clean = strip(F.coalesce(text, F.lit("")))
    hits = [lx.keyword_hits(F.col("_text"), words, whole_word) for words in lexicon.values()]
    scored = (
        df.withColumns({"_text": lx.searchable(clean, whole_word), "_blank": clean == ""})
        .withColumn("_hits", F.array(*hits))
        .withColumn("_best", F.array_max("_hits"))
    )
    best, total = F.col("_best"), F.aggregate("_hits", F.lit(0), lambda a, b: a + b)
    winner = F.element_at(
        F.array(*map(F.lit, lexicon)), F.array_position("_hits", best).cast("int")
    )
    return scored.withColumns(
        {
            "intent": F.when(F.col("_blank") | (best == 0), "general").otherwise(winner),
            "confidence": F.when(F.col("_blank"), 0.0)
            .when(best == 0, 0.3)
            .otherwise(half_up(F.least(best / total, F.lit(1.0)))),
        }
    ).drop("_text", "_blank", "_hits", "_best")


def extract_names(
    df: DataFrame,
    text: str = "text",
    commodities: Sequence[str] = lx.COMMODITY_NAMES,
    crops: Sequence[str] = lx.CROP_NAMES,
) -> DataFrame:
    """Add the first commodity named in the text (or null) and the first crop
    (or ``General``)."""
    lowered = F.col("_text")
    return (
        df.withColumn("_text", lx.searchable(text))
        .withColumns(
            {
                "commodity": lx.first_name(lowered, commodities),
                "crop": F.coalesce(lx.first_name(lowered, crops), F.lit("General")),
            }
        )
        .drop("_text")
    )


def with_feature(df: DataFrame) -> DataFrame:
    """Add the feature that answers a classified question."""
    features = F.create_map(*[F.lit(x) for pair in lx.INTENT_FEATURES.items() for x in pair])
    return df.withColumn("feature", F.coalesce(features[F.col("intent")], "intent"))


def with_preview(df: DataFrame, text: str = "answer") -> DataFrame:
    """Add the first characters of a text, as kept in a history of answers."""
    return df.withColumn("preview", F.substring(F.coalesce(text, F.lit("")), 1, PREVIEW_LENGTH))


def routing_counts(routed: DataFrame) -> DataFrame:
    """Questions and mean confidence per intent and feature."""
    cents = F.floor(F.col("confidence") * 100 + 0.5)
    return routed.groupBy("intent", "feature").agg(
        F.count(F.lit(1)).alias("questions"),
        half_up(F.sum(cents) / F.count(F.lit(1)) / 100, 4).alias("avg_confidence"),
    )
