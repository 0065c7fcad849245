"""Search in one of two modes, retrieval texts, and context assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallbook.functions.texts import text_or_empty
from stallbook.operators.matching import keyword_top_k
from stallbook.operators.vectors import cosine_top_k
from stallbook.session import settle

# How retrieved texts are joined, and the answers built from them.
SEPARATOR = "\n\n---\n\n"
SCHEME_PREFIX = "Based on available information:\n\n"
GUIDE_PREFIX = "Based on available guidance:\n\n"
NO_SCHEME = (
    "I couldn't find specific scheme information for your question. "
    "Please try asking about a specific scheme like PM-KISAN, PMFBY, "
    "KCC, e-NAM, or Soil Health Card."
)
ORGANIC_WORDS = "organic biological natural"
NO_GUIDE_START = "No specific recommendation found for "
NO_GUIDE_STAGE = (" at ", " stage")
NO_GUIDE_END = (
    ". Please consult your nearest Krishi Vigyan Kendra (KVK) or "
    "agriculture department for personalized advice."
)


def search(queries: DataFrame, chunks: DataFrame, k: int = 5, mode: str = "auto") -> DataFrame:
    """(query_id, rank, chunk_id, score) by ``mode``: ``vector`` compares the
    ``embedding`` columns, ``keyword`` the ``text`` columns, ``auto`` takes
    vectors when both sides have them and keywords otherwise."""
    if mode == "auto":
        both = "embedding" in queries.columns and "embedding" in chunks.columns
        mode = "vector" if both else "keyword"
    if mode == "vector":
        hits = cosine_top_k(queries, chunks, k, vector_id="chunk_id")
        return hits.withColumnRenamed("vector_id", "chunk_id")
    if mode == "keyword":
        return keyword_top_k(queries, chunks, k)
    raise ValueError(f"unknown mode {mode!r}")


def guide_query(requests: DataFrame) -> DataFrame:
    """Add the retrieval text of a request: crop, stage, problem and, if wanted,
    the organic words; empty parts are skipped."""
    organic = F.when(F.col("prefer_organic"), F.lit(ORGANIC_WORDS))
    parts = [F.nullif(text_or_empty(c), F.lit("")) for c in ("growth_stage", "problem")]
    return requests.withColumn("text", F.concat_ws(" ", text_or_empty("crop"), *parts, organic))


def contexts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, context): the texts of the hits in rank order.

    A group holds the k hits of one query, so collecting it is bounded by k; a
    chunk id that occurs more than once gives one text.  The hits are stored first: Spark then sees how few they are and looks them up
    while scanning the chunk texts, instead of shuffling the texts.
    """
    hits = settle(hits, "hits")
    texts = hits.join(chunks.select("chunk_id", "text"), "chunk_id")
    texts = texts.dropDuplicates(["query_id", "rank"])
    ranked = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return texts.groupBy("query_id").agg(
        F.array_join(F.transform(ranked, lambda r: r["text"]), SEPARATOR).alias("context")
    )


def no_guide_text() -> Column:
    """Fixed answer for a request without a hit."""
    stage = F.nullif(text_or_empty("growth_stage"), F.lit(""))
    before, after = map(F.lit, NO_GUIDE_STAGE)
    at_stage = F.coalesce(F.concat(before, stage, after), F.lit(""))
    return F.concat(F.lit(NO_GUIDE_START), text_or_empty("crop"), at_stage, F.lit(NO_GUIDE_END))


def answers(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 5,
    mode: str = "auto",
    prefix: str = SCHEME_PREFIX,
    no_hit: Column | None = None,
) -> DataFrame:
    """Add ``answer``: the assembled context behind ``prefix``, or ``no_hit``."""
    found = contexts(search(queries, chunks, k, mode), chunks)
    answer = F.concat(F.lit(prefix), F.col("context"))
    return queries.join(found, "query_id", "left").withColumn(
        "answer", F.coalesce(answer, F.lit(NO_SCHEME) if no_hit is None else no_hit)
    )
