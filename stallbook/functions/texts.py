"""Text expressions: words, labelled chunks, class labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from stallbook.functions.numeric import half_up

# every Unicode white-space character and the ASCII separators 1c-1f
WHITE_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: str | Column) -> Column:
    """Lower-cased blank-separated words, repeats kept."""
    return F.filter(F.split(F.lower(_col(text)), WHITE_SPACE), lambda w: w != "")


def strip(text: str | Column) -> Column:
    return F.regexp_replace(_col(text), f"^{WHITE_SPACE}|{WHITE_SPACE}$", "")


def text_or_empty(value: str | Column) -> Column:
    return F.coalesce(_col(value).cast("string"), F.lit(""))


def unambiguous(*parts: Column) -> Column:
    """The texts in a row, each after its length, so that no two rows of parts
    give the same text; null counts as an empty text."""
    texts = [F.coalesce(p, F.lit("")) for p in parts]
    return F.concat(*[x for t in texts for x in (F.char_length(t).cast("string"), F.lit(":"), t)])


def labelled(lines: Mapping[str, str | Column]) -> Column:
    """``Label: value`` lines; a null value leaves the label with an empty text."""
    return F.concat_ws(
        "\n", *[F.concat(F.lit(f"{label}: "), text_or_empty(v)) for label, v in lines.items()]
    )


def preview(text: str | Column, length: int = 100, mark: str = "...") -> Column:
    """The first characters, always followed by ``mark``."""
    return F.concat(F.substring(text_or_empty(text), 1, length), F.lit(mark))


# ---- class labels: Crop___Disease_name ---------------------------------------

LABEL_SEPARATOR = "___"


def label_crop(label: str | Column) -> Column:
    """Text before the separator, underscores as blanks."""
    return F.replace(F.split_part(_col(label), F.lit(LABEL_SEPARATOR), F.lit(1)), F.lit("_"), F.lit(" "))


def label_disease(label: str | Column) -> Column:
    """Text between the first and second separator; ``Unknown`` without one."""
    label = _col(label)
    part = F.replace(F.split_part(label, F.lit(LABEL_SEPARATOR), F.lit(2)), F.lit("_"), F.lit(" "))
    return F.when(F.contains(label, F.lit(LABEL_SEPARATOR)), part).otherwise("Unknown")


def ingest_crop(label: str | Column) -> Column:
    """Ingest form: everything before the first underscore."""
    return F.regexp_extract(_col(label), r"^([^_]+)", 1)


def ingest_disease(label: str | Column) -> Column:
    """Ingest form: everything after the separator, underscores as blanks."""
    return F.regexp_replace(F.regexp_extract(_col(label), r"___(.+)$", 1), "_", " ")


def is_healthy(disease: str | Column) -> Column:
    return F.contains(F.lower(_col(disease)), F.lit("healthy"))


def health_status(disease: str | Column) -> Column:
    return F.when(is_healthy(disease), "Healthy").otherwise("Disease Detected")


def percent_text(share: str | Column) -> Column:
    """A share as percent text with one decimal, e.g. ``93.5%``."""
    return F.format_string("%.1f%%", half_up(_col(share).cast("double") * 100, 1))
