"""Date parsing and calendar features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The date formats found in price files, in the order they are tried.
# Single letters accept days and months with and without a leading zero.
DATE_FORMATS = ("d MMM yyyy", "d/M/yyyy", "yyyy-M-d", "d-M-yyyy")


def parse_date(text: str | Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """First format that parses wins; unparsable text becomes null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(*[F.try_to_date(F.trim(text), f) for f in formats])


def with_calendar(df: DataFrame, date: str = "arrival_date") -> DataFrame:
    """Add year, month and day_of_week (1 = Sunday)."""
    return df.withColumns(
        {"year": F.year(date), "month": F.month(date), "day_of_week": F.dayofweek(date)}
    )
