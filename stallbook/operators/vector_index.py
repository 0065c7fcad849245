"""A stored index of vectors: cells around centres, searched exactly.

Vectors are scaled to length one, so the angle between two of them decides their
cosine, and angles keep the triangle inequality: a vector of a cell is no nearer to a
query than the angle to the cell's centre less the cell's widest angle.  An index is a
table of vectors partitioned by cell, and a small one of the cells with their exact
widest angles.  It is built once and read for every search.

A search first visits each query's nearest cells, which gives a k-th score, then all
other cells that could still hold that score or better.  Both visits send queries by a
shuffle: the first one to cells, the second one to groups of cells, in which the task
itself passes over the cells that cannot hold such a score.  So a query travels once for
a group, not for a cell, however many cells it visits.  What holds very many vectors is
visited in strips, and queries in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from stallbook.operators.blocks import CELLS_PER_SLOT, cells, parts_of
from stallbook.operators.vectors import BLOCK_BYTES, DIGITS, DOUBT, LEAST_ROWS, _Best, _matrix, found_rows, whole_vectors
from stallbook.session import settle, ship_package

#: Vectors, on average, that the centres are fitted on; the cells hold every vector.
SAMPLE_ROWS = 16_384
#: Vectors a cell is planned for; there are no more cells than this, whose centres travel with the tasks.
CELL_ROWS, MOST_CELLS = 256, 4096
ROUNDS = 8
#: Cells that a query visits first.
FIRST_CELLS = 4
#: Vectors of a cell or a group that one task reads for a block of its queries, and queries of such a block.
STRIP_ROWS, BLOCK_ROWS = 1 << 18, 1 << 14
#: Places of tasks for each pair of a block and a strip of a group.
PLACES = 3
#: Queries whose angles to all centres, and vectors, whose cosines with all centres, are held at once.
BOUND_ROWS, ASSIGN_ROWS = 256, 1024
#: Vectors of length zero have no angle; they lie in a cell of their own.
NO_ANGLE = -1


def centres_of(sample: np.ndarray, cells: int, seed: int = 11) -> np.ndarray:
    """Unit centres by repeated means on a sample; an empty cell keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = sample[np.sort(rng.permutation(len(sample))[:cells])]
    for _ in range(ROUNDS):
        nearest = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(sample, -(-len(sample) // 1024))])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def _sample(vectors: DataFrame, rows: int, seed: int) -> np.ndarray:
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    mask = (1 << 52) - 1
    drawn = F.xxhash64(F.lit(seed), "vector_id").bitwiseAND(F.lit(mask)) < F.lit(int(share * mask))
    found = vectors.filter(drawn).orderBy(F.xxhash64(F.lit(seed), "vector_id"), "vector_id").select("embedding").toArrow()
    unit = _matrix(found.column("embedding").combine_chunks())
    return unit[(unit * unit).sum(axis=1) > 0] if len(unit) else unit


def build_index(vectors: DataFrame, path: str, vector_id: str = "vector_id", embedding: str = "embedding", seed: int = 11) -> None:
    """Writes the index of all vectors to ``path`` (``vectors``, partitioned by ``cell``, and ``cells``).

    Vectors that are null or have a null or NaN in them are left out; ids may repeat.
    The centres are fitted on a bounded sample (``SAMPLE_ROWS``); cells and angles are of all vectors.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    stored = whole_vectors(vectors, vector_id, "vector_id", embedding, "array<float>")
    rows = stored.count()
    sample = _sample(stored, rows, seed)
    wanted = int(min(MOST_CELLS, len(sample), max(1, -(-rows // CELL_ROWS))))
    shared = spark.sparkContext.broadcast(centres_of(sample, wanted, seed) if wanted else np.zeros((0, 0)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in parts_of(batches, ASSIGN_ROWS):
            unit = _matrix(batch.column("embedding"))
            cell, angle = np.full(len(unit), NO_ANGLE), np.zeros(len(unit))
            flat = np.flatnonzero((unit * unit).sum(axis=1) > 0)
            if len(flat):
                inner = unit[flat] @ centres.T
                cell[flat] = inner.argmax(axis=1)
                angle[flat] = angles(inner[np.arange(len(flat)), cell[flat]])
            columns = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "cell", "angle"])

    kinds = {f.name: f.dataType.simpleString() for f in stored.schema}
    assigned = stored.mapInArrow(assign, f"vector_id {kinds['vector_id']}, embedding array<float>, cell int, angle double")
    # few files for a cell; a cell with very many vectors has several
    assigned.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    if not rows:
        stored.select("vector_id", "embedding", F.lit(0.0).alias("angle"), F.lit(0).alias("cell")).limit(0).write.mode("overwrite").parquet(f"{path}/vectors")
    number = spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(shared.value)] + [(NO_ANGLE, None)], "cell int, centre array<double>"
    )
    held = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("rows"), F.max("angle").alias("angle"))
    number.join(held, "cell").coalesce(1).write.parquet(f"{path}/cells")


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


class _Cells:
    """The index's cells by number, as tasks hold them (``MOST_CELLS`` and one at most)."""

    def __init__(self, table: pa.Table):
        order = np.argsort(table["cell"].to_numpy())
        self.number, self.reach, self.rows = (table[c].to_numpy()[order] for c in ("cell", "angle", "rows"))
        centres = [table["centre"][int(i)].as_py() for i in order]
        self.angled = np.array([c is not None for c in centres], dtype=bool)
        self.middle = np.array([c for c in centres if c is not None])
        self.place = {int(n): i for i, n in enumerate(self.number)}
        self.row = np.cumsum(self.angled) - 1  # of the centre in ``middle``

    def most(self, unit: np.ndarray, place: int | None = None) -> np.ndarray:
        """No score of a query in a cell (of all, or of the one at ``place``) is above this; zero where either side has no angle."""
        flat = ((unit * unit).sum(axis=1) > 0)[:, None]
        which = slice(None) if place is None else slice(place, place + 1)
        most = np.zeros((len(unit), len(self.number[which])))
        angled = self.angled[which]
        if angled.any():
            if len(unit) and unit.shape[1] != self.middle.shape[1]:
                raise ValueError("queries and vectors differ in length")
            middle = self.middle if place is None else self.middle[self.row[which]]
            away = np.maximum(angles(unit @ middle.T) - self.reach[which][angled][None, :], 0.0)
            most[:, angled] = np.where(flat, np.cos(away), 0.0)
        return most


def _list_array(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """Lists of ``n`` rows, from values by ascending row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _nearest(queries: DataFrame, shared, kind: str) -> DataFrame:
    """``query_id``, ``query`` and ``near``: the ``FIRST_CELLS`` nearest cells (all, if fewer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in parts_of(batches, BOUND_ROWS):
            most = of.most(_matrix(batch.column("query")))
            best = np.argsort(-most, axis=1, kind="stable")[:, :FIRST_CELLS]
            near = _list_array(of.number[best].ravel(), np.repeat(np.arange(len(best)), best.shape[1]), len(best))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("query"), near], ["query_id", "query", "near"])

    return queries.mapInArrow(run, f"query_id {kind}, query array<double>, near array<int>")


def _may_hold(most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Where a cell could hold the score ``least`` (-inf: any) or a better one."""
    return most >= np.maximum(least, -2.0)[:, None] - 2 * DOUBT


def _others(queries: DataFrame, shared, groups: list[tuple[int, int]], kind: str) -> DataFrame:
    """Queries with ``groups``, those with another cell that could hold ``least``, the k-th score so
    far (null: any), or better; and how many such cells (``visited``) of how many vectors (``scored``)."""
    starts = np.array([first for first, _ in groups], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in parts_of(batches, BOUND_ROWS):
            visit = _may_hold(of.most(_matrix(batch.column("query"))), _least(batch))
            near = batch.column("near")
            row = np.repeat(np.arange(len(near)), np.diff(near.offsets.to_numpy()))
            visit[row, np.searchsorted(of.number, near.flatten().to_numpy())] = False
            row, group = np.nonzero(np.logical_or.reduceat(visit, starts, axis=1))
            extra = [_list_array(group, row, len(visit)), pa.array(visit.sum(axis=1)), pa.array((visit * of.rows).sum(axis=1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "groups", "visited", "scored"])

    schema = f"query_id {kind}, query array<double>, near array<int>, least double, groups array<int>, visited bigint, scored bigint"
    return queries.select("query_id", "query", "near", "least").mapInArrow(run, schema)


def _least(batch: pa.RecordBatch) -> np.ndarray:
    least = batch.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
    return np.where(np.isnan(least), -np.inf, least)


def _groups(rows: np.ndarray, strips: int) -> list[tuple[int, int]]:
    """Consecutive cells in groups that hold about as many vectors: first cell, vectors.  A cell that
    holds more by itself is a group, which is cut into strips later."""
    wanted, groups = max(1.0, rows.sum() / strips), []
    for i, n in enumerate(rows.tolist()):
        if not groups or groups[-1][1] + n > wanted:
            groups.append((i, 0))
        groups[-1] = (groups[-1][0], groups[-1][1] + n)
    return groups


def _scan(visits: DataFrame, vectors: DataFrame, strips: DataFrame, k: int, schema: T.StructType, block_rows: int, shared=None) -> DataFrame:
    """The ``k`` best of every query in the groups it visits, for each strip of a group.

    ``visits`` have ``groups``, those of each query, ``vectors`` a ``group`` and the ``cell``.  With the
    cells given, of a group only those cells are searched that are not in ``near`` and could hold ``least``."""
    types = tuple(to_arrow_type(schema[c].dataType) for c in ("query_id", "vector_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, names, parts, near, least, best = None, [], [], [], [], None
        for cell, is_row, part in cells(batches):
            if cell != present:
                if best:
                    yield from found_rows(names, best, types)
                present, names, parts, near, least, best = cell, [], [], [], [], None
            if not is_row:
                names += part.column("query_id").to_pylist()
                parts.append(_matrix(part.column("query")))
                if shared:
                    near.append(part.column("near").flatten().to_numpy().reshape(part.num_rows, -1))
                    least.append(_least(part))
                continue
            if parts:
                best, parts = _Best(np.concatenate(parts), k, np.concatenate(least) if shared else None), []
                near = np.concatenate(near) if shared else None
            if not best:
                continue
            ids, rows = part.column("vector_id").to_numpy(zero_copy_only=False), _matrix(part.column("embedding"))
            if not shared:
                best.take(ids, rows)
                continue
            of = part.column("of").to_numpy()
            edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), len(of)]
            for first, last in zip(edges[:-1], edges[1:]):
                most = shared.value.most(best.queries, shared.value.place[int(of[first])])
                visit = _may_hold(most, best.least)[:, 0] & ~(near == of[first]).any(axis=1)
                best.take(ids[first:last], rows[first:last], np.flatnonzero(visit))
        if best:
            yield from found_rows(names, best, types)

    # a group's queries in blocks, its vectors in strips; each block meets each strip
    per_group = visits.select(F.explode("groups").alias("group")).groupBy("group").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")
    shape = settle(strips.join(per_group, "group").select("group", "strips", blocks), "groups")
    spread = F.xxhash64(F.monotonically_increasing_id())
    # a row draws its own block or strip first; in one step with the explosion each copy would draw anew
    left = visits.withColumn("group", F.explode("groups")).join(shape, "group").withColumn("block", F.pmod(spread, "blocks"))
    left = left.withColumn("strip", F.explode(F.expr("sequence(0, strips - 1)")))
    right = vectors.join(shape, "group").withColumn("strip", F.pmod(spread, "strips"))
    right = right.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    name = F.xxhash64("group", F.col("block").cast("int"), F.col("strip").cast("int"))
    also = ["near", "least"] if shared else []
    left = left.select(name.alias("cell"), F.lit(False).alias("is_row"), "query_id", "query", *also)
    of = [F.col("cell").alias("of")] if shared else []
    right = right.select(name.alias("cell"), F.lit(True).alias("is_row"), "vector_id", "embedding", *of)
    both = left.unionByName(right, allowMissingColumns=True)
    if not shared:
        return both.repartition("cell").sortWithinPartitions("cell", "is_row").mapInArrow(run, schema)
    # little data and much work: more places than blocks meet strips, so that few of these share a task
    pairs = shape.agg(F.sum(F.col("blocks") * F.col("strips")).alias("n")).first()["n"] or 1
    return both.repartition(PLACES * int(pairs), "cell").sortWithinPartitions("cell", "is_row", "of").mapInArrow(run, schema)


def search_index(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int = 5,
    query_id: str = "query_id",
    embedding: str = "embedding",
) -> tuple[DataFrame, DataFrame]:
    """``query_id``, ``rank``, ``vector_id``, ``score`` as :func:`vectors.cosine_top_k` gives them, and
    how much was visited: ``pairs`` of queries and cells in all, ``visited`` ones, ``vectors_scored`` of
    ``vectors`` pairs of queries and vectors.

    Query ids are unique.  A query that is null or has a null or NaN in it has no answer.
    """
    ship_package(spark)
    vectors = spark.read.parquet(f"{path}/vectors").select("vector_id", "embedding", "cell")
    held = spark.read.parquet(f"{path}/cells")
    cells_of = _Cells(held.toArrow())  # MOST_CELLS rows and one at most
    shared = spark.sparkContext.broadcast(cells_of)
    asked = whole_vectors(queries, query_id, "query_id", embedding, "array<double>").withColumnRenamed("embedding", "query")
    asked = settle(asked, "query_vectors")
    kind = asked.schema["query_id"].dataType.simpleString()
    schema = T.StructType(
        [
            T.StructField("query_id", asked.schema["query_id"].dataType),
            T.StructField("vector_id", vectors.schema["vector_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vector_id")
    n_cells, n_vectors, n_queries = len(cells_of.number), int(cells_of.rows.sum()), asked.count()
    width = cells_of.middle.shape[1] if len(cells_of.middle) else 1
    block_rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    first = settle(_nearest(asked, shared, kind), "first_visits")
    by_cell = held.select(F.col("cell").alias("group"), F.ceil(F.col("rows") / STRIP_ROWS).cast("int").alias("strips"))
    visits = first.withColumnRenamed("near", "groups")
    near = settle(best(_scan(visits, vectors.withColumn("group", F.col("cell")), by_cell, k, schema, block_rows)).drop("rank"), "near")
    least = near.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") == k)
    bounded = first.join(least.select("query_id", "least"), "query_id", "left")

    # as many groups as keep a task's vectors few, and the blocks of all groups as many as tasks run at once
    blocks = max(1, -(-n_queries // block_rows))
    slots = CELLS_PER_SLOT * spark.sparkContext.defaultParallelism
    groups = _groups(cells_of.rows, max(1, -(-n_vectors // STRIP_ROWS), min(-(-slots // blocks), n_vectors // LEAST_ROWS)))
    others = settle(_others(bounded, shared, groups, kind), "other_visits")
    ends = [*[first_cell for first_cell, _ in groups[1:]], n_cells]
    members = [(int(cells_of.number[i]), g) for g, ((a, _), b) in enumerate(zip(groups, ends)) for i in range(a, b)]
    members = settle(spark.createDataFrame(members, "cell int, group int").coalesce(1), "members")
    by_group = spark.createDataFrame([(g, max(1, -(-n // STRIP_ROWS))) for g, (_, n) in enumerate(groups)], "group int, strips int")
    found = near.union(_scan(others, vectors.join(members, "cell"), by_group, k, schema, block_rows, shared))

    near_rows = first.select(F.explode("near").alias("cell")).join(held, "cell")
    near_sums = near_rows.agg(F.count("*").alias("visited"), F.coalesce(F.sum("rows"), F.lit(0)).alias("scored"))
    sums = near_sums.union(others.agg(F.coalesce(F.sum("visited"), F.lit(0)), F.coalesce(F.sum("scored"), F.lit(0))))
    about = sums.agg(F.sum("visited").alias("visited"), F.sum("scored").alias("vectors_scored"))
    about = about.select(F.lit(n_queries * n_cells).alias("pairs"), "visited", F.lit(n_queries * n_vectors).alias("vectors"), "vectors_scored")
    ranked = best(found).select("query_id", "rank", "vector_id", F.round("score", DIGITS).alias("score"))
    return ranked, about
