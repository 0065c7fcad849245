"""The price report of a selection: what a price page shows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stallbook.operators.daily import choose, price_trend
from stallbook.operators.forecast import price_forecast, price_outlook
from stallbook.operators.recency import best_markets, latest_prices, state_comparison


def price_report(
    prices: DataFrame,
    commodity: str | None = None,
    state: str | None = None,
    market: str | None = None,
    days: int = 90,
    days_ahead: int = 7,
    per_key: int = 15,
) -> dict[str, DataFrame]:
    """The tables of a report, for one selection or, without one, for all keys.

    ``prices`` is read by each of the tables: pass a stored table.  The series
    are keyed by the parts of the selection that are given, so a
    commodity without state or market is one series over all of its markets.
    """
    keys = ["commodity"]
    keys += ["state"] if state or not commodity else []
    keys += ["market"] if market or not commodity else []
    chosen = choose(prices, commodity=commodity, state=state)
    series = choose(chosen, market=market)
    return {
        "current_prices": latest_prices(chosen, per_key),
        "trend": price_trend(series, keys, days),
        "forecast": price_forecast(series, keys, days_ahead),
        "outlook": price_outlook(series, keys, days_ahead),
        "best_markets": best_markets(chosen),
        "state_comparison": state_comparison(choose(prices, commodity=commodity)),
    }
