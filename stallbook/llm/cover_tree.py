"""Exact largest inner products by a dual-tree search over cover trees.

Queries come in blocks of about ``QUERY_BLOCK`` and vectors in strips, and each pair of
both is one task's cell (``operators/blocks.py``): nothing but counts passes through the
driver.  A task indexes its block in one tree, the vectors of its strip in trees of at most
``TREE_ROWS``, and walks both trees together: a pair of nodes is left out if no inner
product inside their covering radii, or inside their angles, can reach the worst k-th score
of the query node's group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallbook.llm.common import ship_package, table
from stallbook.operators.blocks import cells, in_cells, strips_for

QUERY_BLOCK = 8192
TREE_ROWS = 8192
LEAF = 32
#: After so many children a node is looked at: if they hold fewer than two points each,
#: its points lie too far apart to be told by halved radii, and it is a leaf.
TRIED = 32
#: Vectors of a strip at most, and at least where there are few.
STRIP_ROWS, LEAST_ROWS = 1 << 20, 256
#: Vectors that a block is scored against before trees are walked; they set the first k-th scores.
FIRST_ROWS = 128
SCALE = 1024
#: Points that are scored at once against a group of queries.
BATCH = 512
_LONG = 2**63 - 1


class CoverTree:
    """Nodes in arrays: centre, covering radius, children, and the points below.

    A node's children are centred on points of it that lie more than half its radius
    apart, and each holds points within that half; the first has the node's own centre.
    A node of few or equal points is a leaf, and one whose children would be single points.
    ``angle`` is the widest between a node's centre and its points, ``longest`` their length.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x
        self.squares = np.einsum("ij,ij->i", x, x)
        centre, radius, first, last, children, order = [], [], [], [], [], []
        stack: list[tuple[int, np.ndarray, np.ndarray]] = []

        def add(c: int, rows: np.ndarray, away: np.ndarray) -> int:
            centre.append(c)
            # squares beyond the whole numbers that doubles hold are rounded
            most = float(self.squares[rows].max())
            far = np.sqrt(float(away.max()) ** 2 + (1e-11 * most if most >= 2.0**50 else 0.0))
            radius.append(far * (1 + 1e-9) + 1e-6 if len(rows) > 1 else 0.0)
            first.append(0)
            last.append(0)
            children.append(None)
            stack.append((len(centre) - 1, rows, away))
            return len(centre) - 1

        if len(x):
            rows = np.arange(len(x))
            add(0, rows, self._away(0, rows))
        while stack:
            node, rows, away = stack.pop()
            reach = away.max() / 2
            if len(rows) <= leaf or reach <= 0:
                first[node] = len(order)
                order.extend(rows.tolist())
                last[node] = len(order)
                continue
            own, at, left = [], centre[node], rows
            while len(left):
                near = away <= reach
                own.append((at, left[near], away[near]))
                left = left[~near]
                if len(left):
                    if len(own) % TRIED == 0 and len(rows) - len(left) < 2 * len(own):
                        break
                    at = int(left[0])
                    away = self._away(at, left)
            if len(left):
                first[node] = len(order)
                order.extend(rows.tolist())
                last[node] = len(order)
            else:
                children[node] = np.array([add(*child) for child in own])
        self.order = np.array(order, dtype=np.int64)
        self.centre, self.radius = np.array(centre, dtype=np.int64), np.array(radius)
        self.first, self.last, self.children = np.array(first), np.array(last), children
        self.norm = np.sqrt(self.squares[self.centre]) if len(x) else np.zeros(0)
        self.angle, self.longest = np.zeros(len(centre)), np.zeros(len(centre))
        for node in range(len(centre) - 1, -1, -1):
            rows = self.points(node) if children[node] is None else None
            if rows is not None:
                lengths = np.sqrt(self.squares[rows])
                self.longest[node] = lengths.max()
                self.angle[node] = self._angles(centre[node], rows, lengths).max() if len(rows) > 1 else 0.0
            else:
                below = children[node]
                self.longest[node] = self.longest[below].max()
                # the first child has the same centre; others' angles are added to the way there
                middles = self.centre[below]
                way = self._angles(centre[node], middles, np.sqrt(self.squares[middles]))
                self.angle[node] = (way + self.angle[below]).max()

    def _angles(self, at: int, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Angles at zero, a bit too wide rather than too narrow; a right one and more for the zero vector."""
        length = np.sqrt(self.squares[at])
        if not length:
            return np.full(len(rows), np.pi)
        cosine = (self.x[rows] @ self.x[at]) / (np.where(lengths > 0, lengths, 1) * length)
        return np.where(lengths > 0, np.arccos(np.clip(cosine - 1e-9, -1, 1)) * (rows != at), np.pi)

    def _away(self, at: int, rows: np.ndarray) -> np.ndarray:
        away = np.sqrt(np.maximum(self.squares[rows] + self.squares[at] - 2 * (self.x[rows] @ self.x[at]), 0))
        away[rows == at] = 0
        return away

    def points(self, node: int) -> np.ndarray:
        """Rows below a leaf."""
        return self.order[self.first[node] : self.last[node]]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of whole numbers in doubles, a line for each of ``a``: by
    doubles if they hold every sum, else by 64-bit integers."""
    longest = np.sqrt(np.einsum("ij,ij->i", a, a).max(initial=0.0)) * np.sqrt(np.einsum("ij,ij->i", b, b).max(initial=0.0))
    if longest < 2.0**52:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """The k best (score, id) of every query so far; ties go to the smaller id."""

    def __init__(self, queries: np.ndarray, k: int, least: np.ndarray):
        self.queries, self.k, self.least = queries, k, least.copy()
        self.score = [np.zeros(0, dtype=np.int64)] * len(queries)
        self.id = [np.zeros(0, dtype=np.int64)] * len(queries)

    def take(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` has a line for each of ``rows`` and a column for each of ``ids``."""
        good = (scores >= self.least[rows][:, None]) & (ids[None, :] != self.queries[rows][:, None])
        for i in np.flatnonzero(good.any(axis=1)):
            row, mine = int(rows[i]), good[i]
            score = np.concatenate([self.score[row], scores[i, mine]])
            found = np.concatenate([self.id[row], ids[mine]])
            order = np.lexsort((found, -score))[: self.k]
            self.score[row], self.id[row] = score[order], found[order]
            if len(order) == self.k:
                self.least[row] = max(self.least[row], score[order[-1]])


def search(queries: CoverTree, data: CoverTree, ids: np.ndarray, best: Best) -> int:
    """Walks both trees together, leaves in ``best`` what they hold, and tells how many pairs were scored."""
    if not len(queries.centre) or not len(data.centre):
        return 0
    scored = 0
    stack = [(0, np.zeros(1, dtype=np.int64))]
    rows_below: dict[int, np.ndarray] = {}

    def below(node: int) -> np.ndarray:
        if node not in rows_below:
            own = queries.children[node]
            rows_below[node] = queries.points(node) if own is None else np.concatenate([below(int(c)) for c in own])
        return rows_below[node]

    def able(node: int, others: np.ndarray) -> np.ndarray:
        """Data nodes that may still matter to a query node, the most promising first."""
        inner = data.x[data.centre[others]] @ queries.x[queries.centre[node]]
        reach = queries.norm[node] * data.radius[others] + queries.radius[node] * (data.norm[others] + data.radius[others])
        rounding = np.abs(inner) + reach + queries.norm[node] * data.norm[others]
        bound = inner + reach + 1e-9 * rounding + 1e-6
        lengths = queries.norm[node] * data.norm[others]
        between = np.arccos(np.clip(inner / np.where(lengths > 0, lengths, 1), -1, 1))
        least = np.where(lengths > 0, between - queries.angle[node] - data.angle[others] - 1e-7, 0)
        longest = queries.longest[node] * data.longest[others]
        by_angle = longest * np.cos(np.clip(least, 0, np.pi / 2)) + 1e-9 * longest + 1e-6
        bound = np.minimum(bound, by_angle)
        keep = bound >= best.least[below(node)].min()
        return others[keep][np.argsort(-bound[keep], kind="stable")]

    while stack:
        node, others = stack.pop()
        others = able(node, others)
        if not len(others):
            continue
        if queries.children[node] is not None:
            inner = [o for o in others if data.children[o] is not None]
            widest = max((data.radius[o] for o in inner), default=-1.0)
            if widest > queries.radius[node]:
                others = np.concatenate([data.children[o] if data.children[o] is not None else np.array([o]) for o in others])
                stack.append((node, others))
            else:
                stack.extend((int(c), others) for c in queries.children[node][::-1])
            continue
        rows = queries.points(node)
        while len(others):
            leaves = [o for o in others if data.children[o] is None]
            inner = [o for o in others if data.children[o] is not None]
            if inner:
                others = able(node, np.concatenate([np.array(leaves, dtype=np.int64), *[data.children[o] for o in inner]]))
                continue
            taken, size = 0, 0
            while taken < len(others) and size < BATCH:
                size += data.last[others[taken]] - data.first[others[taken]]
                taken += 1
            points = np.concatenate([data.points(o) for o in others[:taken]])
            for some in (points[a : a + BATCH] for a in range(0, len(points), BATCH)):
                best.take(rows, ids[some], products(queries.x[rows], data.x[some]))
            scored += len(rows) * len(points)
            others = able(node, others[taken:])
    return scored


def whole_numbers(column: str, scale: int = SCALE) -> Column:
    """Each component times ``scale``, rounded down; null if any is null or not finite,
    if there is none, or if a score could leave the 64 bits it has (components whose
    squares reach 2 ** 63 / dimensions)."""
    scaled = F.transform(F.col(column), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    limit = F.sqrt(F.lit(float(2**63)) / F.size(column)) - 1
    fine = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * F.lit(float(scale))) < limit))
    return F.when((F.size(column) > 0) & F.coalesce(fine, F.lit(False)), scaled)


def top_inner_products(queries: DataFrame, vectors: DataFrame, k: int = 10, seed: int = 13) -> DataFrame:
    """For every query the ``k`` vectors (``id``, ``vector``) with the largest inner
    product: ``query_id``, ``rank``, ``vec_id``, ``score``.

    A query isn't its own candidate, nor is a vector of another dimension.  Vectors
    that are null, or rows without an id, take no part.  Of a query id that comes
    twice the smaller vector counts; repeated candidates are candidates each.  Fewer
    than ``k`` candidates all come back; no queries or no vectors give no rows.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    vectors = vectors.select("id", "vector").where("id is not null and vector is not null")
    queries = queries.where("id is not null and vector is not null").groupBy("id").agg(F.min("vector").alias("vector"))
    blocks = -(-queries.count() // QUERY_BLOCK)
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    block = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(blocks)).cast("int")
    strips = strips_for(vectors, vectors.count(), STRIP_ROWS, LEAST_ROWS)
    dealt = in_cells(queries.withColumn("block", block), vectors, blocks, strips)
    found = dealt.mapInArrow(_searcher(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def by_dimension(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a batch, apart for each dimension."""
    ids, lists = batch.column("id").to_numpy(), batch.column("vector")
    offsets, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
    sizes = np.diff(offsets)
    groups = ((int(d), np.flatnonzero(sizes == d)) for d in np.unique(sizes))
    return {d: (ids[own], flat[offsets[own][:, None] + np.arange(d)]) for d, own in groups}


def _searcher(k: int):
    """Reads cells, queries before vectors, and gives each cell's best."""

    def found(index: dict[int, tuple[CoverTree, Best]]) -> Iterator[pa.RecordBatch]:
        for _, best in index.values():
            times = [len(i) for i in best.id]
            if sum(times):
                columns = [np.repeat(best.queries, times), np.concatenate(best.id), np.concatenate(best.score)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, asked, index = None, [], {}
        for cell, is_row, part in cells(batches):
            if cell != present:
                yield from found(index)
                present, asked, index = cell, [], {}
            if not is_row:
                asked.append(part)
                continue
            if asked:
                whole = pa.Table.from_batches(asked).combine_chunks().to_batches()[0]
                index = {
                    d: (CoverTree(x), Best(ids, k, np.full(len(ids), -_LONG, dtype=np.int64)))
                    for d, (ids, x) in by_dimension(whole).items()
                }
                asked = []
            for d, (ids, x) in by_dimension(part).items():
                if d not in index:
                    continue
                queries, best = index[d]
                at = 0
                if not any(len(s) for s in best.score):
                    at = FIRST_ROWS
                    best.take(np.arange(len(queries.x)), ids[:at], products(queries.x, x[:at]))
                for first in range(at, len(ids), TREE_ROWS):
                    search(queries, CoverTree(x[first : first + TREE_ROWS]), ids[first : first + TREE_ROWS], best)
        yield from found(index)

    return run


def op6_cover_tree_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest by inner product for every hundredth vector among all others."""
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"), whole_numbers("embedding").alias("vector")
    )
    return top_inner_products(vectors.where("id % 100 = 0"), vectors)


#: Rounded components as whole numbers in lists, every query against every vector.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""
