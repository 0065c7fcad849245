"""From raw documents to packed training sequences, in five stages.

``STAGES`` lists (name, function); each function takes the session, what the stage
before it kept, and the folder of the tables, and returns a frame that is written
and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stallbook.llm import language, mixing, near_duplicates, packing, quality
from stallbook.llm.common import table
from stallbook.session import settle


#: Of words that a worker of the last stage remembers: the stages before leave the executors'
#: JVMs grown, so there is less room beside them than where packing runs alone.
WORD_BYTES = 32 << 20


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose language stays in doubt."""
    return language.in_known_language(docs, language.fit(language.labelled_rows(docs)))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the trees go."""
    return quality.good_documents(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def one_of_each_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the smallest id stays."""
    return near_duplicates.one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.digest(packing.pack(docs, memory=WORD_BYTES))


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_duplicates", one_of_each_text),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: Trees, a classifier and hash-seeded draws have no SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
