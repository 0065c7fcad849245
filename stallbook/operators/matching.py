"""Keyword retrieval: the k chunks that contain most words of a query.

A query word counts when it is a *substring* of the lower-cased chunk.  The words of
a block of queries make one automaton, and a chunk's words are found in one pass over
its distinct tokens (a word has no white space, so any occurrence lies inside one).

Blocks of queries meet strips of chunks in cells (``operators/blocks.py``): a task
builds the automaton of its block once, adds up the words each chunk has, and keeps k
candidates per query.  No postings are written, and nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from stallbook.functions.texts import words
from stallbook.operators.blocks import cells, in_cells, strips_for
from stallbook.session import settle, ship_package

BLOCK_WORDS = 200_000  # query words that travel together, on average
STRIP_ROWS, LEAST_ROWS = 200_000, 64  # chunks of a strip
STEP_SCORES = 1 << 17  # scores of chunks times queries at a time: bounds the score matrix of a task


def query_words(queries: DataFrame, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, word, times) of every query."""
    return (
        queries.select(F.col(query_id).alias("query_id"), F.explode(words(text)).alias("word"))
        .groupBy("query_id", "word")
        .agg(F.count(F.lit(1)).alias("times"))
    )


class WordHits:
    """Which of a block's words a text holds, and which queries ask for them."""

    def __init__(self, asked: list[tuple], whole_word: bool):
        self.query_ids = sorted({q for q, _, _ in asked})
        place = {q: i for i, q in enumerate(self.query_ids)}
        number = {word: i for i, word in enumerate(dict.fromkeys(w for _, w, _ in asked))}
        rows = sorted((number[word], place[query], times) for query, word, times in asked)
        of_word, self.queries, times = (np.array(c, dtype=np.int64) for c in zip(*rows))
        self.times = times.astype(np.float64)
        self.first = np.searchsorted(of_word, np.arange(len(number) + 1))
        self.whole_word = whole_word
        if whole_word:
            self.number = number
        else:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for word, i in number.items():
                self.automaton.add_word(word, i)
            self.automaton.make_automaton()

    def held(self, text: str) -> set[int]:
        """The numbers of the words in a text."""
        tokens = set(text.split())
        if self.whole_word:
            return {self.number[t] for t in tokens & self.number.keys()}
        return {i for _, i in self.automaton.iter(" ".join(tokens))}

    def scores(self, text: str) -> np.ndarray:
        """Of one chunk, for every query."""
        own = np.fromiter(self.held(text), dtype=np.int64)
        sizes = self.first[own + 1] - self.first[own]
        ends = np.cumsum(sizes)
        # the places of all words' queries, one word after the other
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[own] - ends + sizes, sizes)
        return np.bincount(self.queries[at], self.times[at], len(self.query_ids))


class _Best:
    """The k best (score, id) above zero of every query, ties by id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores: list[np.ndarray] = [np.empty(0)] * queries
        self.ids: list = [None] * queries
        self.least = np.zeros(queries)

    def take(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` has a line for each id and a column for each query."""
        able = (scores >= np.maximum(self.least, 1)[None, :]).any(axis=0)
        for i in np.flatnonzero(able):
            mine = scores[:, i]
            near = np.flatnonzero(mine >= max(self.least[i], 1))
            found = ids[near] if self.ids[i] is None else np.concatenate([self.ids[i], ids[near]])
            score = np.concatenate([self.scores[i], mine[near]])
            order = np.lexsort((found, -score))[: self.k]
            self.scores[i], self.ids[i] = score[order], found[order]
            if len(order) == self.k:
                self.least[i] = score[order[-1]]


def _searcher(k: int, whole_word: bool, query_type: pa.DataType, chunk_type: pa.DataType):
    """Reads cells, words of queries before chunks, and gives each cell's best."""

    def found(hits: WordHits, best: _Best) -> Iterator[pa.RecordBatch]:
        for query, ids, scores in zip(hits.query_ids, best.ids, best.scores):
            if len(scores):
                columns = [pa.array([query] * len(scores), query_type), pa.array(ids, chunk_type, from_pandas=True)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(scores.astype(np.int64))], ["query_id", "chunk_id", "score"]
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, asked, hits, best = None, [], None, None
        for cell, is_row, part in cells(batches):
            if cell != present:
                if hits:
                    yield from found(hits, best)
                present, asked, hits, best = cell, [], None, None
            if not is_row:
                asked += zip(*[part.column(c).to_pylist() for c in ("query_id", "word", "times")])
                continue
            if hits is None and asked:
                hits = WordHits(asked, whole_word)
                best, asked = _Best(len(hits.query_ids), k), []
            if hits is None:
                continue
            ids = part.column("chunk_id").to_numpy(zero_copy_only=False)
            step = max(1, STEP_SCORES // len(hits.query_ids))
            for start in range(0, part.num_rows, step):
                texts = part.column("text").slice(start, step)
                best.take(ids[start : start + step], np.stack([hits.scores(t.as_py()) for t in texts]))
        if hits:
            yield from found(hits, best)

    return run


def keyword_top_k(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 5,
    query_id: str = "query_id",
    chunk_id: str = "chunk_id",
    query_text: str = "text",
    chunk_text: str = "text",
    whole_word: bool = False,
) -> DataFrame:
    """(query_id, rank, chunk_id, score) of the k best chunks with a score above
    zero; ties go to the lower chunk id.  Chunk ids are unique."""
    spark = chunks.sparkSession
    ship_package(spark)
    # equal texts are answered once, under the lowest id among them
    named = queries.select(F.col(query_id).alias("query_id"), F.lower(query_text).alias("text"))
    texts = settle(
        named.filter(F.col("text").isNotNull()).groupBy("text").agg(F.min("query_id").alias("first_id")),
        "query_texts",
    )
    asked = settle(query_words(texts, "first_id"), "query_words")
    stored = chunks.select(F.col(chunk_id).alias("chunk_id"), F.lower(chunk_text).alias("text"))
    stored = stored.filter(F.col("chunk_id").isNotNull() & F.col("text").isNotNull())
    schema = T.StructType(
        [
            T.StructField("query_id", asked.schema["query_id"].dataType),
            T.StructField("chunk_id", stored.schema["chunk_id"].dataType),
            T.StructField("score", T.LongType()),
        ]
    )
    blocks = max(1, -(-asked.count() // BLOCK_WORDS))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    dealt = in_cells(
        asked.withColumn("block", block), stored, blocks, strips_for(stored, chunks.count(), STRIP_ROWS, LEAST_ROWS)
    )
    types = [to_arrow_type(schema[c].dataType) for c in ("query_id", "chunk_id")]
    pairs = dealt.mapInArrow(_searcher(k, whole_word, *types), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    best = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return (
        named.join(texts, "text")
        .select("query_id", "first_id")
        .join(best.withColumnRenamed("query_id", "first_id"), "first_id")
        .select("query_id", "rank", "chunk_id", "score")
    )
