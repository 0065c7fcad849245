"""Question answering over scheme and product texts, for tables of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.operators import chunks as ck
from stallbook.operators import intents, retrieval
from stallbook.operators.text_vectors import fit_text_vectors, with_text_vectors
from stallbook.session import settle
from stallbook.sinks.tables import chat_log_rows


def scheme_texts(schemes: DataFrame, list_style: str = "joined") -> DataFrame:
    return ck.with_chunk_id(ck.scheme_chunks(schemes, list_style), "scheme_id", "chunk_type", "text")


def guide_texts(guide: DataFrame) -> DataFrame:
    chunks = ck.guide_chunks(guide)
    return ck.with_chunk_id(chunks, "crop", "growth_stage", "category", "text")


def with_vectors(questions: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add vectors of the same text model to questions and chunks."""
    model = fit_text_vectors(chunks)
    return with_text_vectors(questions, model), with_text_vectors(chunks, model)


def ask_schemes(questions: DataFrame, schemes: DataFrame, k: int = 5, mode: str = "keyword") -> DataFrame:
    """Questions (query_id, text) with the retrieved context as answer."""
    texts = scheme_texts(schemes)
    if mode == "vector":
        questions, texts = with_vectors(questions, texts)
    return retrieval.answers(questions, texts, k, mode)


def recommend(requests: DataFrame, guide: DataFrame, k: int = 5, mode: str = "keyword") -> DataFrame:
    """Requests (query_id, crop, growth_stage, problem, prefer_organic) with the
    retrieved product texts as answer."""
    questions, texts = retrieval.guide_query(requests), guide_texts(guide)
    if mode == "vector":
        questions, texts = with_vectors(questions, texts)
    return retrieval.answers(
        questions, texts, k, mode, retrieval.GUIDE_PREFIX, retrieval.no_guide_text()
    )


def route(questions: DataFrame, schemes: DataFrame, guide: DataFrame) -> DataFrame:
    """Classify questions and answer the scheme and product ones."""
    routed = intents.with_feature(intents.extract_names(intents.classify(questions)))
    routed = settle(routed, "routed")
    about_schemes = ask_schemes(routed.filter(F.col("intent") == "scheme"), schemes)
    about_products = recommend(
        routed.filter(F.col("intent") == "pesticide").select(
            "query_id",
            "crop",
            F.lit("").alias("growth_stage"),
            F.col("text").alias("problem"),
            F.lit(False).alias("prefer_organic"),
        ),
        guide,
    )
    found = about_schemes.select("query_id", "answer").unionByName(
        about_products.select("query_id", "answer")
    )
    return intents.with_preview(routed.join(found, "query_id", "left"))


def chat_log(routed: DataFrame) -> DataFrame:
    return chat_log_rows(routed)
