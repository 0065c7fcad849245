"""Change rows applied by a sequence column, in whatever order they come.

A history holds every change that was applied as an interval: the values a key had
``valid_from`` one change ``valid_to`` the next (null: still).  Deletions are intervals
too (``deleted``), so that a change that arrives late and is older than a deletion does
not bring the key back.  Applying a batch touches only the keys in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DELETE = "delete"


def _intervals(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each event until the next of its key.

    A key's events are sorted in one task, which spills what it cannot hold; their number
    is that of the key's changes, not of its table.
    """
    following = Window.partitionBy(*keys).orderBy("valid_from")
    return events.withColumn("valid_to", F.lead("valid_from").over(following))


def change_events(changes: DataFrame, keys: Sequence[str], sequence: str, kind: str = "change") -> DataFrame:
    """Change rows as events: values, ``valid_from``, ``deleted`` (values of a deletion are null).

    Rows of one key and sequence number are one change: a deletion counts before others, and
    of several the greatest values do.  A change without a sequence number can't be placed and
    is refused with an error.
    """
    values = [c for c in changes.columns if c not in (*keys, sequence, kind)]
    deleted = F.coalesce(F.lower(kind) == DELETE, F.lit(False))
    placed = F.coalesce(F.col(sequence), F.raise_error(F.lit(f"a change has no {sequence}")).cast(changes.schema[sequence].dataType))
    events = changes.select(
        *keys,
        *[F.when(~deleted, F.col(c)).alias(c) for c in values],
        placed.alias("valid_from"),
        deleted.alias("deleted"),
    )
    first = F.max(F.struct("deleted", *values)).alias("_e")
    return events.groupBy(*keys, "valid_from").agg(first).select(*keys, *[f"_e.{c}" for c in values], "valid_from", "_e.deleted")


def new_history(table: DataFrame, keys: Sequence[str], sequence: object) -> DataFrame:
    """The history of a table as it stands: every row valid from ``sequence`` on."""
    events = table.withColumns({"valid_from": F.lit(sequence), "deleted": F.lit(False)})
    return _intervals(events, keys)


def apply_changes(
    history: DataFrame, changes: DataFrame, keys: Sequence[str], sequence: str, kind: str = "change"
) -> DataFrame:
    """The history with a batch of changes in their places.

    Batches may come in any order and more than once: a change that is there already
    (equal key and number) takes the batch's values.  Null keys are keys.  Intervals of
    keys that are not in the batch stay as they are.
    """
    events = change_events(changes, keys, sequence, kind)
    columns = [*events.columns]
    old = history.select(*columns, "valid_to", F.lit(False).alias("_new"))
    both = old.union(events.select(*columns, F.lit(None).cast(history.schema["valid_to"].dataType).alias("valid_to"), F.lit(True).alias("_new")))
    # one exchange and one sort of the history serve all three
    of_key = Window.partitionBy(*keys).orderBy("valid_from")
    whole = of_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same_place = of_key.rangeBetween(Window.currentRow, Window.currentRow)
    marked = both.withColumns({"_touched": F.max("_new").over(whole), "_replaced": F.max("_new").over(same_place)})
    left = marked.filter(F.col("_new") | ~F.col("_replaced"))
    until = F.when(F.col("_touched"), F.lead("valid_from").over(of_key)).otherwise(F.col("valid_to"))
    return left.withColumn("valid_to", until).select(*columns, "valid_to")


def version(history: DataFrame, at: object | None = None) -> DataFrame:
    """The table as it was at a sequence number, now if none is given."""
    if at is None:
        rows = history.filter(F.col("valid_to").isNull())
    else:
        moment = F.lit(at)
        rows = history.filter((F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (F.col("valid_to") > moment)))
    return rows.filter(~F.col("deleted")).drop("valid_from", "valid_to", "deleted")
