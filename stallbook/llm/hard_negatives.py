"""Hard negatives by summaries of vector segments.

A vector is cut into segments of neighbouring components, and each segment's mean and
deviation are stored beside it.  The product of two segments lies within the product of
their deviations around the product of their means, so the sums over segments bound a
score from both sides.  Halves merge to the segment above, hence bounds of few long
segments come first, and pairs they can't decide are bounded again by shorter ones; only
what is left is scored, in whole numbers.

Before the cut vectors are turned: means of long segments then hold the directions in
which a bounded sample of vectors varies most.  The turn decides how much is left out,
never what is found.

Anchors are stored in blocks, vectors in strips.  Spark brings each block to each strip
by a shuffle (a row goes out once for each block or strip), so neither passes through the
driver, and a task holds one block and one batch of its strip.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallbook.llm.common import ship_package, table, uniform
from stallbook.llm.cover_tree import products, whole_numbers
from stallbook.session import settle

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these tenths of the positive's.
LEAST_TENTHS, MOST_TENTHS = 3, 9
#: Anchors in a block, by components; vectors in a strip, at most.
BLOCK_COMPONENTS = 1 << 18
STRIP_ROWS = 1 << 20
#: Components of a stored segment, and segments of the first bounds.
SHORTEST = 2
FEWEST = 4
#: Vectors that the turn is fitted on, on average.
TURN_ROWS = 2048
#: Pairs bounded at once: anchors times vectors; a strip's first vectors set the first limits.
ANCHORS, VECTORS, FIRST_VECTORS = 256, 1024, 256
#: Pairs are bounded one by one instead of in a matrix when so few are left.
FEW = 1 / 16
_LONG = 2**63 - 1


def width_of(dimensions: int) -> int:
    """The power of two that vectors are filled up to with zeros."""
    return max(SHORTEST, 1 << max(0, dimensions - 1).bit_length())


def haar(size: int) -> np.ndarray:
    """The orthonormal Haar basis: its first lines are means of the longest segments."""
    lines = np.ones((1, 1))
    while lines.shape[1] < size:
        n = lines.shape[1]
        lines = np.concatenate([np.kron(lines, [1, 1]), np.kron(np.eye(n), [1, -1])]) / np.sqrt(2)
    return lines


def turn_for(sample: np.ndarray) -> np.ndarray:
    """An orthonormal matrix that takes the sample's main directions to the first Haar lines."""
    size = width_of(sample.shape[1])
    spread = np.eye(size) * 1e-9
    own = sample / (np.abs(sample).max(initial=0) or 1.0)
    spread[: sample.shape[1], : sample.shape[1]] += own.T @ own / len(own)
    directions = np.linalg.eigh(spread)[1][:, ::-1]
    return haar(size).T @ directions.T


def summaries(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations (roots of sums of squares) of the shortest segments."""
    turned = (x @ turn[:, : x.shape[1]].T).reshape(len(x), -1, SHORTEST)
    means = turned.mean(axis=2)
    return means, np.sqrt(((turned - means[:, :, None]) ** 2).sum(axis=2))


class Summary:
    """Vectors with bounds' parts of all levels, those of the longest segments first."""

    def __init__(self, x: np.ndarray, means: np.ndarray, deviations: np.ndarray):
        self.x = x
        self.norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        mean, off = means * np.sqrt(SHORTEST), deviations
        self.levels = [(mean, off)]
        while mean.shape[1] > FEWEST:
            a, b = mean[:, ::2], mean[:, 1::2]
            off = np.sqrt(off[:, ::2] ** 2 + off[:, 1::2] ** 2 + (a - b) ** 2 / 2)
            mean = (a + b) / np.sqrt(2)
            self.levels.insert(0, (mean, off))

    def part(self, rows: slice | np.ndarray) -> Summary:
        own = object.__new__(Summary)
        own.x, own.norm = self.x[rows], self.norm[rows]
        own.levels = [(m[rows], o[rows]) for m, o in self.levels]
        return own


class Tally:
    """Pairs that were bounded, and those scored after all."""

    bounded = scored = 0


def scores_within(anchors: Summary, vectors: Summary, able: np.ndarray, low: np.ndarray, high: np.ndarray, tally: Tally) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (rows of both sides, score) of those marked in ``able`` whose scores lie within
    ``low`` and ``high`` of the anchor, and maybe a few others."""
    tally.bounded += int(able.sum())
    slack = 1e-9 * anchors.norm[:, None] * vectors.norm[None, :] + 1e-6
    low, high = low.astype(np.float64)[:, None] - slack, high.astype(np.float64)[:, None] + slack
    level = 0
    while level < len(anchors.levels) and np.count_nonzero(able) > FEW * able.size:
        (mean, off), (other_mean, other_off) = anchors.levels[level], vectors.levels[level]
        inner, reach = mean @ other_mean.T, off @ other_off.T
        able = able & (inner + reach >= low) & (inner - reach <= high)
        level += 1
    i, j = np.nonzero(able)
    if len(i) > FEW * able.size:
        tally.scored += len(i)
        return i, j, products(anchors.x, vectors.x)[i, j]
    for (mean, off), (other_mean, other_off) in zip(anchors.levels[level:], vectors.levels[level:]):
        inner = np.einsum("ij,ij->i", mean[i], other_mean[j])
        reach = np.einsum("ij,ij->i", off[i], other_off[j])
        keep = (inner + reach >= low[i, j]) & (inner - reach <= high[i, j])
        i, j = i[keep], j[keep]
    tally.scored += len(i)
    a, b = anchors.x[i].astype(np.int64), vectors.x[j].astype(np.int64)
    return i, j, np.einsum("ij,ij->i", a, b)


class Block:
    """A block of anchors of one dimension, and the ``k`` best of each window so far.

    ``low`` and ``high`` have a line for each anchor and a column for each of its windows;
    ``low`` rises to the worst of a full window.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, summary: Summary, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.ids, self.labels, self.summary, self.k, self.same = ids, labels, summary, k, same
        self.low, self.high = low, high
        self.score: dict[tuple[int, int], np.ndarray] = {}
        self.id: dict[tuple[int, int], np.ndarray] = {}
        self.tally = Tally()
        self.seen = 0

    def take(self, ids: np.ndarray, labels: np.ndarray, vectors: Summary) -> None:
        at = 0
        while at < len(ids):
            step = FIRST_VECTORS if self.seen < FIRST_VECTORS else VECTORS
            rows = slice(at, at + step)
            self._take(ids[rows], labels[rows], vectors.part(rows))
            at += step
            self.seen += step

    def _take(self, ids: np.ndarray, labels: np.ndarray, vectors: Summary) -> None:
        for first in range(0, len(self.ids), ANCHORS):
            mine = np.arange(first, min(first + ANCHORS, len(self.ids)))
            mine = mine[(self.high[mine] >= self.low[mine]).any(axis=1)]
            if not len(mine):
                continue
            able = (self.labels[mine][:, None] == labels[None, :]) == self.same
            able &= self.ids[mine][:, None] != ids[None, :]
            is_open = self.high[mine] >= self.low[mine]
            low = np.where(is_open, self.low[mine], _LONG).min(axis=1)
            high = np.where(is_open, self.high[mine], -_LONG).max(axis=1)
            i, j, score = scores_within(self.summary.part(mine), vectors, able, low, high, self.tally)
            edges = np.searchsorted(i, np.arange(len(mine) + 1))
            for own in np.unique(i):
                part = slice(edges[own], edges[own + 1])
                self._keep(int(mine[own]), score[part], ids[j[part]])

    def _keep(self, row: int, score: np.ndarray, ids: np.ndarray) -> None:
        for w in range(self.low.shape[1]):
            good = (score >= self.low[row, w]) & (score <= self.high[row, w])
            if not good.any():
                continue
            held_score, held_id = score[good], ids[good]
            if (row, w) in self.score:
                held_score = np.concatenate([self.score[row, w], held_score])
                held_id = np.concatenate([self.id[row, w], held_id])
            order = np.lexsort((held_id, -held_score))[: self.k]
            self.score[row, w], self.id[row, w] = held_score[order], held_id[order]
            if len(order) == self.k:
                self.low[row, w] = held_score[order[-1]]

    def found(self) -> Iterator[pa.RecordBatch]:
        if not self.score:
            return
        sizes = [len(s) for s in self.score.values()]
        rows, windows = np.array(list(self.score)).T
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(self.ids[rows], sizes)),
                pa.array(np.repeat(windows + 1, sizes).astype(np.int32)),
                pa.array(np.concatenate(list(self.id.values()))),
                pa.array(np.concatenate(list(self.score.values()))),
            ],
            names=["anchor_id", "window", "id", "score"],
        )


def _rows(lists: pa.ListArray, own: np.ndarray) -> np.ndarray:
    """The lists at ``own``, which are of equal length, as a matrix."""
    offsets = lists.offsets.to_numpy()
    starts = offsets[own].astype(np.int64)
    size = int(offsets[own[0] + 1] - offsets[own[0]]) if len(own) else 0
    return lists.values.to_numpy()[starts[:, None] + np.arange(size)]


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.diff(batch.column("vector").offsets.to_numpy())
    for d in np.unique(sizes):
        yield int(d), np.flatnonzero(sizes == d)


def searcher(k: int, same: bool):
    """Reads cells' rows, anchors before vectors, and gives each cell's best of every window."""

    def blocks_of(anchors: list[pa.RecordBatch]) -> dict[int, Block]:
        batch = pa.Table.from_batches(anchors).combine_chunks().to_batches()[0]
        blocks = {}
        for d, own in _by_dimension(batch):
            low, high = (_rows(batch.column(c), own).astype(np.int64) for c in ("low", "high"))
            summary = Summary(*(_rows(batch.column(c), own) for c in ("vector", "means", "deviations")))
            ids, labels = (batch.column(c).to_numpy()[own] for c in ("id", "label"))
            blocks[d] = Block(ids, labels, summary, low, high, k, same)
        return blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, anchors, blocks = None, [], {}
        for batch in batches:
            cells, kinds = batch.column("cell").to_numpy(), batch.column("is_vector").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for first, last in zip([0, *edges], [*edges, len(cells)]):
                if cells[first : first + 1].size and cells[first] != cell:
                    for block in blocks.values():
                        yield from block.found()
                    cell, anchors, blocks = cells[first], [], {}
                part = batch.slice(first, last - first)
                if part.num_rows and not kinds[first]:
                    anchors.append(part)
                    continue
                if anchors:
                    blocks, anchors = blocks_of(anchors), []
                for d, own in _by_dimension(part):
                    if d in blocks:
                        vectors = Summary(*(_rows(part.column(c), own) for c in ("vector", "means", "deviations")))
                        blocks[d].take(part.column("id").to_numpy()[own], part.column("label").to_numpy()[own], vectors)
        for block in blocks.values():
            yield from block.found()

    return run


def turns_for(vectors: DataFrame, share: float, seed: int = 29) -> dict[int, np.ndarray]:
    """The turn of every dimension that a sample of this share meets."""
    sample = vectors.select("vector").where(uniform(F.monotonically_increasing_id(), seed=seed) < F.lit(min(1.0, share)))
    by_size: dict[int, list] = {}
    for row in sample.collect():
        by_size.setdefault(len(row[0]), []).append(row[0])
    return {size: turn_for(np.array(rows)) for size, rows in by_size.items()}


def with_summaries(vectors: DataFrame, turns: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` (``vector`` of whole numbers) with ``means`` and ``deviations`` of their segments."""
    shared = vectors.sparkSession.sparkContext.broadcast(turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = shared.value
        for batch in batches:
            parts, order = [], []
            for d, own in _by_dimension(batch):
                turn = turns[d] if d in turns else np.eye(width_of(d))
                columns = []
                for values in summaries(_rows(batch.column("vector"), own), turn):
                    offsets = np.arange(len(own) + 1, dtype=np.int32) * values.shape[1]
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1))))
                parts.append(columns)
                order.append(own)
            if parts:
                back = pa.array(np.argsort(np.concatenate(order)))
                means, deviations = (pa.concat_arrays([p[c] for p in parts]).take(back) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, means, deviations], names=[*batch.schema.names, "means", "deviations"])

    fields = ", ".join(f"{name} {kind}" for name, kind in vectors.dtypes)
    return vectors.mapInArrow(run, f"{fields}, means array<double>, deviations array<double>")


def _best(anchors: DataFrame, vectors: DataFrame, k: int, same: bool, blocks: int, strips: int) -> DataFrame:
    """``anchor_id``, ``window``, ``id``, ``score``: the ``k`` best of each anchor's windows."""
    columns = ["cell", "is_vector", "id", "label", "vector", "means", "deviations", "low", "high"]
    nothing = F.lit(None).cast("array<long>")
    left = anchors.withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1)))).withColumns({"is_vector": F.lit(False), "block": F.pmod(F.xxhash64("id"), F.lit(blocks))})
    right = vectors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"is_vector": F.lit(True), "low": nothing, "high": nothing})
    cell = (F.col("block").cast("long") * strips + F.col("strip")).alias("cell")
    both = left.select(cell, *columns[1:]).unionByName(right.select(cell, *columns[1:]))
    dealt = both.repartition(blocks * strips, "cell").sortWithinPartitions("cell", "is_vector")
    found = dealt.mapInArrow(searcher(k, same), "anchor_id long, window int, id long, score long")
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _tenths(score: str, tenths: int, up: bool) -> Column:
    """So many tenths of a score, rounded up or down, without leaving 64 bits."""
    return F.expr(f"(({score} - pmod({score}, 10)) div 10) * {tenths} + (pmod({score}, 10) * {tenths} + {9 if up else 0}) div 10")


def hard_negatives(anchors: DataFrame, vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Both frames have ``id``, ``label`` and ``vector`` of whole numbers in doubles.  An anchor's
    positives are the ``positives`` highest scores among rows of its label; for each the
    ``negatives`` highest scores of other labels between 30 % and 90 % of the positive's.  Ties go
    to the smaller id.  Rows with the anchor's id aren't its candidates, nor are those of
    another dimension; rows without id, label or vector take no part.  Of repeated anchors the
    one of smaller label and vector counts, repeated candidates are candidates each.  An anchor
    without positives, and a positive of a negative score, give no rows; nor do empty tables.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    whole = "id is not null and label is not null and vector is not null"
    columns = ["id", "label", "vector"]
    vectors = vectors.select(*columns).where(whole)
    anchors = anchors.select(*columns).where(whole).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("a")).select("id", "a.*")
    n, most = vectors.agg(F.count("*"), F.max(F.size("vector"))).first()
    n_anchors = anchors.count()
    if not n or not n_anchors:
        return spark.createDataFrame([], RESULT)
    blocks = -(-n_anchors * width_of(most) // BLOCK_COMPONENTS)
    tasks = 2 * spark.sparkContext.defaultParallelism
    strips = max(-(-n // STRIP_ROWS), min(tasks, -(-n // FIRST_VECTORS)))
    strip = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(strips)).cast("int")
    turns = turns_for(vectors, TURN_ROWS / n)
    summarised = settle(with_summaries(vectors.withColumn("strip", strip), turns), "vectors")
    anchors = settle(with_summaries(anchors, turns), "anchors")
    open_ended = {"low": F.array(F.lit(-_LONG)), "high": F.array(F.lit(_LONG))}
    first = _best(anchors.withColumns(open_ended), summarised, positives, True, blocks, strips)
    first = settle(first.select("anchor_id", F.col("rank").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    low, high = _tenths("positive_score", LEAST_TENTHS, True), _tenths("positive_score", MOST_TENTHS, False)
    window = F.struct("window", low.alias("low"), high.alias("high"))
    windows = first.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(window)).alias("w"))
    windows = windows.select("id", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    # every anchor has as many windows, so that a block is a matrix; those beyond its positives are empty
    none = [F.array_repeat(F.lit(v).cast("long"), F.lit(positives) - F.size("low")) for v in (1, 0)]
    windows = windows.select("id", F.concat("low", none[0]).alias("low"), F.concat("high", none[1]).alias("high"))
    found = _best(anchors.join(windows, "id"), summarised, negatives, False, blocks, strips)
    return found.join(first, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def op11_segment_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives for every hundredth row of ``embeddings``, every seventh label moved on."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), whole_numbers("embedding", SCALE).alias("vector")
    )
    return hard_negatives(vectors.where("id % 100 = 0"), vectors)


#: Every anchor against every row, in lists of whole numbers.
SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.id AS anchor_id, v.id, a.label = v.label AS same,
    CAST(list_dot_product(CAST(a.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v ON a.id <> v.id AND len(a.e) = len(v.e) WHERE a.id % 100 = 0
),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same
  ) WHERE r <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM positives p JOIN s USING (anchor_id)
  WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
) WHERE rank <= 10
"""
