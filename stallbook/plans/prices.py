"""The price pipeline: raw observations -> silver -> enriched, and gold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.functions.dates import with_calendar
from stallbook.operators import quality, windows
from stallbook.session import settle


def silver(raw: DataFrame, deduplicate: bool = False) -> DataFrame:
    """Rule-checked rows with calendar columns, optionally one per identity.

    Works on batch and streaming input (a stream deduplicates by watermark, see
    ``stallbook.streaming.silver``, and passes ``deduplicate=False`` here).
    """
    rows = quality.keep_valid(raw, quality.price_rules())
    rows = quality.not_null(rows, "state", "market")
    # derived columns come last, so that they are not shuffled
    return with_calendar(quality.dedupe(rows) if deduplicate else rows)


def enriched(
    raw: DataFrame,
    keys: Sequence[str] = windows.SERIES,
    rows_per_piece: int = windows.ROWS_PER_PIECE,
) -> DataFrame:
    """Valid, deduplicated prices with change, moving averages and volatility.

    Copies are dropped before the windows.  Where no series is long, copies included,
    the rows go by series once, and the same exchange and sort serve deduplication and
    windows.  Else copies are dropped before the shuffle, one row per key and task at
    most, the result is written, and long series are cut in it.  A pipeline that keeps
    a silver table calls ``windows.with_indicators`` on that table instead.
    """
    identity = [*keys, *[c for c in quality.PRICE_IDENTITY if c not in keys]]
    return windows.with_indicators(*clean_series(quality.valid_prices(raw), identity, keys, rows_per_piece))


def clean_series(
    valid: DataFrame, identity: Sequence[str], keys: Sequence[str], rows_per_piece: int
) -> tuple[DataFrame, Sequence[str], Sequence[str], int | None]:
    """Deduplicated rows with calendar columns and how windows over ``keys`` take them: keys,
    order, and rows per piece (``None``: no series is long).

    Counting the rows of every series reads the keys only."""
    if windows.long_series(valid, keys, rows_per_piece) is None:
        near = valid.repartition(*[F.col(k) for k in keys])
        return with_calendar(quality.dedupe(near, identity)), keys, windows.ORDER, None
    clean = settle(with_calendar(quality.dedupe(valid, identity)), "silver")
    return clean, keys, windows.ORDER, rows_per_piece
