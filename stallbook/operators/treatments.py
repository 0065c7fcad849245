"""Treatment lookup for predicted class labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallbook.functions import texts
from stallbook.functions.numeric import half_up
from stallbook.session import settle

# Texts used when the knowledge base has no entry.
DEFAULT_TEXTS = {
    "treatment": "Consult a local agriculture expert.",
    "prevention": "Practice good farm hygiene.",
    "organic": "Use neem-based sprays.",
}


def last_entries(knowledge: DataFrame, position: str | None) -> DataFrame:
    """One entry per label; the one at the highest position wins.

    Without a position column that is the last one of the last file by name
    (``source_file``), however files are packed into tasks.  Rows in an array are in its
    order; files of JSON lines that are read in several splits need a position.  A frame
    without ``source_file`` counts in the order of its partitions.
    """
    rows = knowledge.filter(F.length("disease_class") > 0)
    if position is None:
        # stored with the entries' numbers, which the plan of a later step could change
        rows = settle(rows.withColumn("_read", F.monotonically_increasing_id()), "entries")
        order = [F.desc(c) for c in ("source_file", "_read") if c in rows.columns]
    else:
        order = [F.desc(position)]
    last = Window.partitionBy("disease_class").orderBy(*order)
    kept = rows.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1")
    return kept.drop("_nth", "_read", *([position] if position else []))


def parse_labels(predictions: DataFrame, label: str = "label") -> DataFrame:
    """Add crop, disease, is_healthy and status."""
    return predictions.withColumns(
        {"crop": texts.label_crop(label), "disease": texts.label_disease(label)}
    ).withColumns(
        {
            "is_healthy": texts.is_healthy("disease"),
            "status": texts.health_status("disease"),
        }
    )


def with_treatments(
    predictions: DataFrame,
    knowledge: DataFrame,
    label: str = "label",
    position: str | None = None,
) -> DataFrame:
    """Parsed labels with treatment, prevention and organic option, defaults
    where the label is unknown.

    The entries are stored first, so that Spark knows their size: it broadcasts
    them while they are under its threshold, otherwise the adaptive skew join
    splits the rows of a very frequent label.
    """
    entries = last_entries(knowledge, position).select("disease_class", *DEFAULT_TEXTS)
    entries = settle(entries, "knowledge")
    joined = parse_labels(predictions, label).join(
        entries, F.col(label) == F.col("disease_class"), "left"
    )
    return joined.withColumns(
        {c: F.coalesce(c, F.lit(text)) for c, text in DEFAULT_TEXTS.items()}
    ).drop("disease_class")


def top_predictions(
    scores: DataFrame, item: str = "image_id", label: str = "label", score: str = "score", k: int = 5
) -> DataFrame:
    """The k best labels per item, scores rounded to four decimals."""
    best = Window.partitionBy(item).orderBy(F.desc(score), label)
    return (
        scores.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select(item, "rank", label, half_up(score, 4).alias("score"))
    )


def with_confidence(predictions: DataFrame, score: str = "score") -> DataFrame:
    """Add the score as text in percent with one decimal."""
    return predictions.withColumn("confidence", texts.percent_text(half_up(score, 4)))
