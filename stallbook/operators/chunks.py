"""Labelled text chunks for retrieval."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallbook.functions.texts import labelled, preview, text_or_empty, unambiguous


# The line labels of each kind of chunk and the columns behind them.
OVERVIEW_LINES = {
    "Scheme": "name",
    "Category": "category",
    "Description": "description",
    "Benefits": "benefits",
    "Coverage": "coverage",
}
APPLICATION_LINES = {
    "Scheme": "name",
    "Eligibility": "eligibility",
    "How to Apply": "how_to_apply",
    "Documents Required": "documents_required",
    "Helpline": "helpline",
    "Official URL": "official_url",
}
GUIDE_LINES = {
    "Crop": "crop",
    "Growth Stage": "growth_stage",
    "Category": "category",
    "Problem": "problem",
    "Product": "product_name",
    "Dosage": "dosage",
    "Application Method": "application_method",
    "Timing": "timing",
    "Precautions": "precautions",
    "Organic Alternative": "organic_alternative",
    "Cost Estimate": "cost_estimate",
}
LIST_SEPARATORS = {"eligibility": "; ", "documents_required": ", "}


def chunk_rows(df: DataFrame, ids: list[str], texts: Mapping[str, Column]) -> DataFrame:
    """One row per source row and chunk type.  The source is scanned once; both
    kinds of chunk leave the same projection."""
    kinds = F.array(
        *[F.struct(F.lit(kind).alias("chunk_type"), t.alias("text")) for kind, t in texts.items()]
    )
    return df.select(*ids, F.explode(kinds).alias("c")).select(*ids, "c.chunk_type", "c.text")


def scheme_chunks(schemes: DataFrame, list_style: str = "joined") -> DataFrame:
    """Two chunks per scheme: overview and application.

    ``list_style="joined"`` writes lists as ``a; b`` and ``a, b``;
    ``"bracketed"`` writes them as ``[a, b]``.
    """
    if list_style == "joined":
        lists = {c: F.array_join(c, separator) for c, separator in LIST_SEPARATORS.items()}
    elif list_style == "bracketed":
        lists = {c: F.col(c).cast("string") for c in LIST_SEPARATORS}
    else:
        raise ValueError(f"unknown list_style {list_style!r}")
    rows = (
        schemes.filter(F.col("scheme_id").isNotNull())
        .withColumn("name", F.coalesce("name_en", "name", F.lit("")))
        .withColumns(lists)
    )
    return chunk_rows(
        rows,
        ["scheme_id", "name", "category"],
        {"overview": labelled(OVERVIEW_LINES), "application": labelled(APPLICATION_LINES)},
    )


def guide_chunks(guide: DataFrame) -> DataFrame:
    """One chunk per product entry."""
    return guide.select(
        *[text_or_empty(c).alias(c) for c in ("crop", "growth_stage", "category")],
        labelled(GUIDE_LINES).alias("text"),
    )


def with_chunk_id(chunks: DataFrame, *parts: str) -> DataFrame:
    """A repeatable chunk id from the columns that make up a chunk.  Equal chunks
    share an id and are kept once, combined on the map side."""
    key = unambiguous(*[F.col(p) for p in parts])
    return chunks.withColumn("chunk_id", F.sha2(key, 256)).dropDuplicates(["chunk_id"])


def scheme_list(schemes: DataFrame) -> DataFrame:
    """Summary per scheme: id, names, category and the start of the benefits."""
    return schemes.select(
        text_or_empty("scheme_id").alias("scheme_id"),
        F.coalesce("name_en", "name", F.lit("")).alias("name"),
        text_or_empty("name").alias("short_name"),
        text_or_empty("category").alias("category"),
        preview("benefits").alias("benefits_summary"),
    )


def scheme_detail(schemes: DataFrame, scheme_id: str) -> DataFrame:
    return schemes.filter(F.col("scheme_id") == scheme_id)
