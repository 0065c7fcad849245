"""Exact cosine top-k of query vectors over a table of vectors.

Blocks of queries meet strips of vectors in cells (``operators/blocks.py``): a task
multiplies the Arrow batches of its strip with its block and keeps k candidates per
query.  Nothing but counts passes through the driver.  ``operators/vector_index.py``
has the form that reads a stored index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from stallbook.operators.blocks import cells, in_cells, strips_for
from stallbook.session import settle, ship_package

BLOCK_BYTES = 16 << 20  # queries that travel together
STRIP_ROWS, LEAST_ROWS = 1 << 20, 256  # vectors of a strip
STEP_PAIRS = 1 << 21  # scored at a time: bounds the score matrix of a batch
FOUND_QUERIES = 1024  # whose candidates leave a task together
#: Matrix products may differ in the last digits with the size of the batch.  What
#: lies this close to the k-th score is scored again, one by one.
DOUBT = 1e-9
DIGITS = 6  # of the scores that are returned; ranks come from unrounded ones


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero stays zero."""
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of a list array as float64, scaled to length one."""
    if not len(vectors):
        return np.zeros((0, 0))
    lengths = np.diff(vectors.offsets.to_numpy())
    if lengths.min() != lengths.max():
        raise ValueError("vectors differ in length")
    rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(rows.reshape(len(vectors), -1))


class _Best:
    """The k best (score, id) of every query, ties by id.

    ``least`` are scores known to be reached by k rows elsewhere (-inf: none); what lies below
    is not kept.  Products in single precision find what may be kept, with their rounding left
    as doubt; what they find is scored again, one by one."""

    def __init__(self, queries: np.ndarray, k: int, least: np.ndarray | None = None):
        self.queries, self.k = queries, k
        self.coarse = queries.astype(np.float32)
        self.doubt = DOUBT + (queries.shape[1] + 2) * 2.0**-23
        self.least = np.full(len(queries), -np.inf) if least is None else least
        self.scores: list = [np.empty(0)] * len(queries)
        self.ids: list = [None] * len(queries)

    def take(self, ids: np.ndarray, rows: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Rows for all queries, or for those at the places ``asked``."""
        if not len(ids):
            return
        if rows.shape[1] != self.queries.shape[1]:
            raise ValueError("queries and vectors differ in length")
        across = rows.astype(np.float32).T
        step = max(1, STEP_PAIRS // len(ids))
        places = np.arange(len(self.queries)) if asked is None else asked
        for start in range(0, len(places), step):
            at = places[start : start + step]
            about = self.coarse[at] @ across
            least = self.least[at]
            fresh = np.flatnonzero(np.isneginf(least))
            if len(fresh) and about.shape[1] > self.k:
                least[fresh] = np.partition(about[fresh], -self.k, axis=1)[:, -self.k]
            found, near = np.nonzero(about >= (least - self.doubt)[:, None])
            if not len(found):
                continue
            for one in np.split(np.arange(len(found)), np.flatnonzero(np.diff(found)) + 1):
                self._keep(int(at[found[one[0]]]), ids, rows, near[one])

    def _keep(self, i: int, ids: np.ndarray, rows: np.ndarray, near: np.ndarray) -> None:
        score = (rows[near] * self.queries[i]).sum(axis=1)
        found = ids[near] if self.ids[i] is None else np.concatenate([self.ids[i], ids[near]])
        score = np.concatenate([self.scores[i], score])
        order = np.lexsort((found, -score))[: self.k]
        self.scores[i], self.ids[i] = score[order], found[order]
        if len(order) == self.k:
            self.least[i] = max(self.least[i], self.scores[i][-1])


def found_rows(names: list, best: _Best, types: tuple[pa.DataType, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The candidates (query_id, vector_id, score) that a task keeps."""
    some = [i for i, scores in enumerate(best.scores) if len(scores)]
    for start in range(0, len(some), FOUND_QUERIES):
        part = some[start : start + FOUND_QUERIES]
        yield from pa.Table.from_arrays(
            [
                pa.array([names[i] for i in part for _ in best.scores[i]], type=types[0]),
                pa.array(np.concatenate([best.ids[i] for i in part]), type=types[1], from_pandas=True),
                pa.array(np.concatenate([best.scores[i] for i in part]), type=pa.float64()),
            ],
            ["query_id", "vector_id", "score"],
        ).to_batches()


def _searcher(k: int, types: tuple[pa.DataType, pa.DataType]):
    """Reads cells, queries before vectors, and gives each cell's best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, names, parts, best = None, [], [], None
        for cell, is_row, part in cells(batches):
            if cell != present:
                if best:
                    yield from found_rows(names, best, types)
                present, names, parts, best = cell, [], [], None
            if not is_row:
                names += part.column("query_id").to_pylist()
                parts.append(_matrix(part.column("query")))
                continue
            if parts:
                widths = {p.shape[1] for p in parts}
                if len(widths) > 1:
                    raise ValueError("queries differ in length")
                best, parts = _Best(np.concatenate(parts), k), []
            if best:
                best.take(part.column("vector_id").to_numpy(zero_copy_only=False), _matrix(part.column("embedding")))
        if best:
            yield from found_rows(names, best, types)

    return run


def whole_vectors(df: DataFrame, key: str, name: str, embedding: str, kind: str) -> DataFrame:
    """Key and vector; a vector that is null or has a null or NaN in it is left out."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    return df.select(F.col(key).alias(name), F.col(embedding).cast(kind).alias("embedding")).filter(
        F.col("embedding").isNotNull() & whole
    )


def cosine_top_k(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    query_id: str = "query_id",
    vector_id: str = "vector_id",
    embedding: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(query_id, rank, vector_id, score): exact cosine, ranked unrounded, ties by
    vector id.  A vector that is null or has a null or NaN in it takes no part; a zero
    vector scores 0."""
    ship_package(vectors.sparkSession)

    asked = settle(whole_vectors(queries, query_id, "query_id", embedding, "array<double>"), "query_vectors")
    stored = whole_vectors(vectors, vector_id, "vector_id", embedding, "array<float>")
    schema = T.StructType(
        [
            T.StructField("query_id", asked.schema["query_id"].dataType),
            T.StructField("vector_id", stored.schema["vector_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    size = asked.agg(F.sum(F.size("embedding") * 8).alias("bytes")).first()["bytes"] or 0
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    asked = asked.select("query_id", F.col("embedding").alias("query"), block.alias("block"))
    dealt = in_cells(asked, stored, blocks, strips_for(stored, vectors.count(), STRIP_ROWS, LEAST_ROWS))
    types = tuple(to_arrow_type(schema[c].dataType) for c in ("query_id", "vector_id"))
    pairs = dealt.mapInArrow(_searcher(k, types), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vector_id")
    return (
        pairs.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vector_id", F.round("score", DIGITS).alias("score"))
    )


def normalised(embedding: str | Column) -> Column:
    """The vector scaled to length one, in double; a zero vector stays zero."""
    v = (F.col(embedding) if isinstance(embedding, str) else embedding).cast("array<double>")
    squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    norm = F.when(squares > 0, F.sqrt(squares)).otherwise(1.0)
    return F.transform(v, lambda x: x / norm)


def centroids(vectors: DataFrame, group: str, embedding: str = "embedding") -> DataFrame:
    """Mean vector per group.  Values are averaged by position with map-side
    combining; an array as long as the vector is assembled per group."""
    return (
        vectors.select(group, F.posexplode(embedding).alias("pos", "value"))
        .groupBy(group, "pos")
        .agg(F.avg(F.col("value").cast("double")).alias("value"))
        .groupBy(group)
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"]
            ).alias(embedding)
        )
    )
