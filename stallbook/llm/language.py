"""Language of texts: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and everything but letters becomes a gap; its pairs and
triples of characters are hashed into ``BUCKETS``.  Counts per language come from a
bounded sample of labelled rows, spread over the languages; the matrix of log
probabilities is what is broadcast (``BUCKETS`` numbers a language).  Scoring
gathers its rows for a whole batch of texts and adds them up text by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallbook.llm.common import lean, ship_package, table, text_or_empty, uniform

BUCKETS = 1 << 15
#: Labelled rows of each language that the model is fitted on, on average.
TRAIN_ROWS = 4_000
SMOOTHING = 0.5
#: Characters that are scored together.
CHUNK = 1 << 20
UNKNOWN = "und"
#: Documents with a lower posterior are rejected by :func:`in_known_language`.
LEAST_SCORE = 0.5

_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Every code point that is a letter maps to itself, any other to 0."""
    codes = np.arange(0x110000, dtype=np.uint32)
    keep = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(keep, codes, np.uint32(0))


def code_points(text: str) -> np.ndarray:
    return letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")]


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the triple and the pair that end at each place from the third.

    Bucket 0 stands for none: a triple needs a letter in the middle, a pair one at
    its end.
    """
    a, b, c = (np.uint32(m) for m in _MULTIPLIERS)
    last, middle, first = codes[2:], codes[1:-1], codes[:-2]
    pair = (middle * b) ^ (last * c)
    triple = pair ^ (first * a) ^ np.uint32(0x5BD1E995)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    triples = np.where(middle > 0, np.maximum((triple ^ (triple >> np.uint32(13))) * a >> shift, 1), 0)
    pairs = np.where(last > 0, np.maximum((pair ^ (pair >> np.uint32(15))) * a >> shift, 1), 0)
    return triples, pairs


def batches_of(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For about ``CHUNK`` characters at a time: the texts' positions, where each
    begins, and the letters of all, gaps between them.  A long text comes in
    several parts that overlap by the two characters a triple looks back to."""
    gap = np.zeros(2, dtype=np.uint32)
    where, begins, parts, held = [], [], [], 0
    for i, text in enumerate(texts):
        codes = np.concatenate([gap, code_points(text), gap[:1]])
        for start in range(2, len(codes), CHUNK):
            part = codes[start - 2 : start + CHUNK]
            where.append(i)
            begins.append(held)
            parts.append(part)
            held += len(part)
            if held >= CHUNK:
                yield np.array(where), np.array(begins), np.concatenate(parts)
                where, begins, parts, held = [], [], [], 0
    if parts:
        yield np.array(where), np.array(begins), np.concatenate(parts)


def totals(texts: list[str], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``matrix`` rows over the n-grams of each text, and its letters."""
    out = np.zeros((len(texts), matrix.shape[1]))
    n_letters = np.zeros(len(texts), dtype=np.int64)
    for where, begins, codes in batches_of(texts):
        triples, pairs = grams(codes)
        # each part's own places: the next part's two gaps look back to nothing
        part = np.add.reduceat(matrix[triples] + matrix[pairs], begins, axis=0, dtype=np.float64)
        np.add.at(out, where, part)
        np.add.at(n_letters, where, np.add.reduceat((codes[2:] > 0).astype(np.int64), begins))
    return out, n_letters


class Model:
    """Languages in order, and their log probabilities by bucket and before any text."""

    def __init__(self, languages: list[str], matrix: np.ndarray, prior: np.ndarray):
        self.languages, self.matrix, self.prior = languages, matrix, prior

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        sums, n_letters = totals(texts, self.matrix)
        sums += self.prior
        best = sums.argmax(axis=1)
        top = sums[np.arange(len(texts)), best] if len(texts) else np.zeros(0)
        score = 1.0 / np.exp(sums - top[:, None]).sum(axis=1)
        names = [self.languages[b] if n else UNKNOWN for b, n in zip(best, n_letters)]
        return names, np.where(n_letters > 0, score, 0.0)


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS, seed: int = 5) -> Model:
    """A model from rows (``doc_id``, ``text``, ``lang``), ``lang`` not null.

    The prior counts all rows; n-grams are counted over a hash-drawn sample of
    about ``train_rows`` per language, all of a rarer one.
    """
    spark = labelled.sparkSession
    ship_package(spark)
    rows = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(rows)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), dtype=np.float32), np.zeros(0))
    chance = F.lit(1.0)
    for name, n in rows.items():
        if n > train_rows:
            chance = F.when(F.col("lang") == name, F.lit(train_rows / n)).otherwise(chance)
    sample = labelled.where(uniform(F.col("doc_id"), F.col("lang"), seed=seed) < chance)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, names = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for where, begins, codes in batches_of(texts):
                triples, pairs = grams(codes)
                ends = [*(begins[1:]), len(codes)]
                for i, b, e in zip(where, begins, ends):
                    own = np.concatenate([triples[b : e - 2], pairs[b : e - 2]])
                    held = counts.setdefault(names[i], np.zeros(BUCKETS, dtype=np.int64))
                    held += np.bincount(own, minlength=BUCKETS)
        for name, held in counts.items():
            at = np.flatnonzero(held[1:]) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(held[at], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    counted = (
        sample.select("text", "lang")
        .mapInArrow(lean(count), "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    matrix = np.full((BUCKETS, len(languages)), SMOOTHING)
    if len(counted):
        column = pc.index_in(counted["lang"], pa.array(languages)).to_numpy()
        matrix[counted["bucket"].to_numpy(), column] += counted["n"].to_numpy()
    matrix = np.log(matrix / matrix[1:].sum(axis=0)).astype(np.float32)
    matrix[0] = 0
    prior = np.log(np.array([rows[name] for name in languages]) / sum(rows.values()))
    return Model(languages, matrix, prior)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def labelled_rows(documents: DataFrame) -> DataFrame:
    """Rows that may teach: with a language, and not held out."""
    return documents.where(F.col("lang").isNotNull() & ~F.coalesce(held_out(), F.lit(False))).select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), "lang"
    )


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred`` and its posterior probability ``score`` for every row
    (``doc_id``, ``text``).

    A text that is null or has no letter gets ``und`` and 0.0, as does any text if
    nothing was learned.  Ties go to the language that sorts first.  Repeated rows
    are predicted each, a null ``doc_id`` stays, further columns are ignored, an empty
    table gives an empty table.
    """
    ship_package(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast((model.languages, model.matrix, model.prior))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            names, score = own.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(predict, "doc_id long, lang_pred string, score double")


def in_known_language(documents: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The rows, with all their columns, whose language is known with at least this
    probability; rows without a letter go."""
    ship_package(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast((model.languages, model.matrix, model.prior))
    at = documents.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            names, score = own.predict([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array((np.array(names) != UNKNOWN) & (score >= least), pa.bool_()))

    return documents.mapInArrow(lean(keep), documents.schema)


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of all documents, learned from those that aren't held out."""
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = identify(documents, fit(labelled_rows(documents)))
    return found.withColumn("held_out", F.coalesce(held_out(), F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")
