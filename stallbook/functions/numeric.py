"""Exact money arithmetic.

Prices are doubles.  They are summed as they are written in decimals, so a mean does not
depend on the order in which partitions are merged, and no price is rounded before its
mean or change is.  Infinite prices and NaN are none.

Prices below ``PLAIN`` with up to six decimals, which are nearly all, are whole numbers of
millionths: their sums run over 64-bit integers, and rolling means and changes stay in
them.  All others are summed beside them as wide decimals, up to 10 ** 22 and with sixteen
decimals; a larger price is refused with an error.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: Prices from here on are summed as decimals.  Twenty thousand differences of two
#: prices below it, in millionths, fit into 64 bits.
PLAIN = 1e8
MILLION = 1_000_000
WIDE = "decimal(38,16)"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(price: str | Column) -> Column:
    """The price; null if it is infinite or NaN."""
    value = _col(price).cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def _is_plain(price: Column) -> Column:
    return (F.abs(price) < PLAIN) & (F.rint(price * MILLION) / MILLION == price)


def millionths(price: str | Column) -> Column:
    """The price as a whole number of millionths; null if it isn't a plain one."""
    value = _col(price).cast("double")
    return F.when(_is_plain(value), F.rint(value * MILLION).cast("bigint"))


def wide(price: str | Column) -> Column:
    """A price that isn't plain, as a decimal; null if it is."""
    value = number(price)
    return F.when(~_is_plain(value), value.cast(WIDE))


def half_up(value: str | Column, digits: int = 2) -> Column:
    """Round the number as it is written in decimals, half away from zero."""
    return F.round(_col(value), digits)


def money(price: str | Column) -> Column:
    """A price rounded half up to two decimals, exact on ties."""
    return half_up(number(price))


def price_count(price: str | Column) -> Column:
    """Aggregate: the number of prices."""
    return F.count(number(price))


def price_total(price: str | Column) -> Column:
    """Aggregate: the exact sum of prices as a decimal; null if there are none.

    Whole units and millionths are summed apart, so neither sum leaves 64 bits before
    there are 10 ** 10 rows of the largest plain price."""
    small = millionths(price)
    none = F.lit(0).cast("bigint")
    units = F.coalesce(F.sum(F.floor(small / MILLION)), none).cast("decimal(20,0)")
    rest = F.coalesce(F.sum(F.pmod(small, F.lit(MILLION))), none).cast("decimal(20,0)")
    total = units + rest / F.lit(MILLION).cast("decimal(7,0)") + F.coalesce(F.sum(wide(price)), F.lit(0).cast(WIDE))
    return F.when(price_count(price) > 0, total)


def mean_price(price: str | Column) -> Column:
    """Aggregate: unrounded mean price, as a double."""
    return F.try_divide(price_total(price).cast("double"), price_count(price))


def rounded_mean(total: Column, count: Column) -> Column:
    """Mean price rounded half up to two decimals, exact on ties."""
    return F.round(F.try_divide(total, count), 2).cast("double")


def avg_price(price: str | Column) -> Column:
    """Aggregate: rounded mean of a price column."""
    return rounded_mean(price_total(price), price_count(price))


RUNNING = ("_n", "_units", "_rest", "_wides", "_wide")


def running_sums(price: str | Column, upto: WindowSpec) -> dict[str, Column]:
    """The columns ``RUNNING``: numbers and exact sums of the prices up to each row of a window;
    ``_wide`` is null before the first price that isn't plain.

    A frame that grows costs one step a row, however long the means are that are taken from it."""
    small, none = millionths(price), F.lit(0).cast("bigint")
    sums = {
        "_n": price_count(price).over(upto),
        "_units": F.sum(F.floor(small / MILLION)).over(upto),
        "_rest": F.sum(F.pmod(small, F.lit(MILLION))).over(upto),
        "_wides": F.count(wide(price)).over(upto),
    }
    return {**{name: F.coalesce(total, none) for name, total in sums.items()}, "_wide": F.sum(wide(price)).over(upto)}


def mean_of_last(rows: int, order: WindowSpec, skip: int = 0) -> Column:
    """Rounded mean of the last ``rows`` prices, those of ``skip`` rows before this one left out,
    from ``RUNNING`` columns; null if there are none.  Up to thousands of rows."""

    def within(name: str) -> Column:
        none = F.lit(0).cast(WIDE if name == "_wide" else "bigint")
        end = F.coalesce(F.lag(name, skip).over(order) if skip else F.col(name), none)
        return end - F.coalesce(F.lag(name, rows + skip).over(order), none)

    count, small = within("_n"), within("_units") * MILLION + within("_rest")
    quick = F.signum(small.cast("double")) * _divide(F.abs(small) * 2 + count * 10_000, count * 20_000) / 100
    total = small.cast("decimal(20,0)") / F.lit(MILLION).cast("decimal(7,0)") + within("_wide")
    # decimals only where such a price is in the frame
    return F.when(count > 0, F.when(within("_wides") == 0, quick).otherwise(rounded_mean(total, count)))


def _divide(a: Column, b: Column) -> Column:
    """Whole part of the quotient of two whole numbers."""
    return F.call_function("div", a, b)


def change_pct(now: Column, before: Column) -> Column:
    """Change of ``now`` against ``before`` in percent, two decimals; null if
    the price before was zero."""
    new, old = millionths(now), millionths(before)
    size = F.abs(old)
    whole = _divide(F.abs(new - old) * 20_000 + size, size * 2)
    quick = F.when(old != 0, F.signum((new - old).cast("double")) * F.signum(old.cast("double")) * whole / 100)
    a, b = number(now).cast(WIDE), number(before).cast(WIDE)
    slow = F.round(F.try_divide((a - b) * 100, b), 2).cast("double")
    return F.when(new.isNotNull() & old.isNotNull(), quick).otherwise(slow)
