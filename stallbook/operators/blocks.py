"""Bringing blocks of queries to strips of rows by a shuffle.

A search scores every query against every row, so its work is queries times rows
whatever is done.  Queries are cut into blocks and rows into strips, and each pair of
a block and a strip is a cell, which one task works through: the block's queries come
first, the strip's rows then pass by.  A query goes out once for each strip, a row once
for each block.  Neither passes through the driver, a task holds one block, and a lost
executor costs its cells only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells for each task slot, if there are rows enough: uneven cells then even out.
CELLS_PER_SLOT = 2


def strips_for(df: DataFrame, rows: int, most: int, least: int) -> int:
    """Strips of at most ``most`` rows on average, and more while they keep ``least``."""
    slots = CELLS_PER_SLOT * df.sparkSession.sparkContext.defaultParallelism
    return int(max(1, -(-rows // most), min(slots, rows // least)))


def in_cells(queries: DataFrame, rows: DataFrame, blocks: int, strips: int) -> DataFrame:
    """Both sides by cell, queries before rows: their columns, ``cell`` and ``is_row``.

    ``queries`` have a column ``block`` from 0 to ``blocks`` - 1.  A column that only one
    side has is null on the other.
    """
    strip = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(strips)).cast("int")
    left = queries.withColumn("_strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    right = rows.withColumn("_strip", strip).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cell = F.col("block").cast("long") * strips + F.col("_strip")
    sides = [
        side.withColumns({"cell": cell, "is_row": F.lit(is_row)}).drop("block", "_strip")
        for side, is_row in ((left, False), (right, True))
    ]
    both = sides[0].unionByName(sides[1], allowMissingColumns=True)
    return both.repartition(blocks * strips, "cell").sortWithinPartitions("cell", "is_row")


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Stretches of one cell and side, in the order in which they come."""
    for batch in batches:
        number = batch.column("cell").to_numpy()
        side = batch.column("is_row").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((number[1:] != number[:-1]) | (side[1:] != side[:-1])) + 1
        for first, last in zip([0, *edges], [*edges, len(number)]):
            if last > first:
                yield int(number[first]), bool(side[first]), batch.slice(first, last - first)


def parts_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
