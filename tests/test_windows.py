import random
import statistics
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from stallbook.operators import quality, windows
from stallbook.plans import prices as plan
from stallbook.session import settle


def brute(rows):
    """Indicators by plain loops over each sorted series."""
    series = {}
    for r in rows:
        series.setdefault((r.commodity, r.market), []).append(r)
    out = {}
    for group in series.values():
        group.sort(key=lambda r: (r.arrival_date, r.variety, r.price_id))
        prices = [r.modal_price for r in group]
        for i, r in enumerate(group):
            week, month = prices[max(0, i - 6): i + 1], prices[max(0, i - 29): i + 1]
            change = 0.0 if i == 0 else (prices[i] - prices[i - 1]) / prices[i - 1] * 100
            out[r.price_id] = (
                change,
                sum(week) / len(week),
                sum(month) / len(month),
                statistics.stdev(week) if len(week) > 1 else None,
            )
    return out


def observations(price_frame, seed=1):
    """One long series with uneven days, one medium and many short ones."""
    rng = random.Random(seed)
    rows = []
    for market, days, most in (("long", 120, 4), ("medium", 20, 1), *[(f"m{i}", 1 + i, 1) for i in range(4)]):
        for day in range(days):
            for v in range(rng.randint(1, most)):
                rows.append(
                    {"market": market, "variety": f"v{v}", "day": day * rng.choice([1, 1, 3]),
                     "price": round(rng.uniform(50, 150), 2)}
                )
    return price_frame([{**r, "id": f"p{i:05d}"} for i, r in enumerate(rows)])


@pytest.mark.parametrize("rows_per_piece", [1, 7, 40, 10**6])
def test_pieces_give_the_same_result_as_the_whole_series(price_frame, rows_per_piece):
    prices = observations(price_frame)
    expected = brute(prices.collect())
    got = windows.with_indicators(prices, rows_per_piece=rows_per_piece).collect()
    assert len(got) == len(expected)
    for r in got:
        change, week, month, spread = expected[r.price_id]
        assert r.price_change_pct == pytest.approx(change, abs=0.0051)
        assert r.moving_avg_7d == pytest.approx(week, abs=0.0051)
        assert r.moving_avg_30d == pytest.approx(month, abs=0.0051)
        assert r.volatility_7d == (None if spread is None else pytest.approx(spread, abs=0.0051))


def test_a_long_series_without_a_market_is_cut_too(price_frame):
    prices = price_frame([{"market": None, "price": 10.0 + i % 7} for i in range(80)])
    pieces = windows.split_long_series(prices, windows.SERIES, "arrival_date", 29, 20)
    assert pieces.select("_piece").distinct().count() == 4
    expected = brute(prices.collect())
    for r in windows.with_indicators(prices, rows_per_piece=20).collect():
        assert r.moving_avg_30d == pytest.approx(expected[r.price_id][2], abs=0.0051)


def test_one_day_may_exceed_a_piece(price_frame):
    """A giant day next to single-row days: pieces stay shorter than the frame."""
    rows = [{"variety": f"v{i:03d}", "day": 1} for i in range(60)]
    rows += [{"day": 0}, *[{"day": d} for d in range(2, 40)]]
    rng = random.Random(3)
    prices = price_frame([{**r, "price": round(rng.uniform(1, 9), 2)} for r in rows])
    expected = brute(prices.collect())
    for r in windows.with_indicators(prices, rows_per_piece=20).collect():
        assert r.moving_avg_30d == pytest.approx(expected[r.price_id][2], abs=0.0051)


def test_no_group_is_longer_than_piece_day_and_lookback(price_frame):
    prices = observations(price_frame)
    pieces = windows.split_long_series(prices, windows.SERIES, "arrival_date", 29, 40)
    sizes = pieces.groupBy(*windows.SERIES, "_piece").count()
    assert sizes.agg({"count": "max"}).first()[0] <= 40 + 3 * 4 + 29 + 3 * 4
    assert pieces.filter("NOT _carried").count() == prices.count()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_indicators_take_one_exchange_and_one_sort(price_frame):
    text = plan_of(plan.enriched(observations(price_frame)))
    assert text.count("Exchange") == 1 and text.count("Sort [") == 1
    assert "moving_avg_30d" in text


def test_short_series_are_enriched_without_a_copy_of_the_rows(spark, price_frame, monkeypatch):
    written = []
    monkeypatch.setattr(plan, "settle", lambda df, name: written.append(name) or settle(df, name))
    raw = observations(price_frame, seed=9)
    raw = raw.union(raw.withColumn("price_id", F.concat(F.lit("z"), "price_id")))
    whole, cut = (sorted(map(str, plan.enriched(raw, rows_per_piece=n).collect())) for n in (10**6, 20))
    assert whole == cut and written == ["silver"]
    # a null market is a series as well
    lone = price_frame([{"market": None, "price": p} for p in (10.0, 20.0)])
    assert sorted(r.moving_avg_7d for r in plan.enriched(lone).collect()) == [10.0, 15.0]


@pytest.mark.parametrize("rows_per_piece", [20, 10**6])
def test_enriched_deduplicates_before_the_windows(price_frame, rows_per_piece):
    raw = observations(price_frame, seed=9)
    copies = raw.withColumn("price_id", F.concat(F.lit("z"), "price_id"))
    once = quality.dedupe(raw)
    expected = brute(once.collect())
    got = plan.enriched(raw.union(copies), rows_per_piece=rows_per_piece).collect()
    assert {r.price_id for r in got} == set(expected)
    for r in got:
        assert r.moving_avg_30d == pytest.approx(expected[r.price_id][2], abs=0.0051)


def test_averages_stay_within_the_frame(price_frame):
    prices = observations(price_frame, seed=5)
    for r in windows.with_indicators(prices, rows_per_piece=25).collect():
        assert 49.99 <= r.moving_avg_7d <= 150.01 and 49.99 <= r.moving_avg_30d <= 150.01


def test_lagged_averages_exclude_the_current_row(price_frame):
    prices = price_frame([{"price": p} for p in (10.0, 20.0, 30.0)])
    got = {r.price_id: r.lagged_avg_7d for r in windows.with_lagged_averages(prices).collect()}
    assert got == {"p00000": None, "p00001": 10.0, "p00002": 15.0}


def test_indicators_are_computed_in_steps_of_their_own(price_frame):
    text = plan_of(windows.with_indicators(observations(price_frame), rows_per_piece=None))
    # change and volatility, running sums, means: in one step the method is too long to be compiled
    assert text.count("Window [") == 3


def test_means_of_frames_with_and_without_prices_that_are_not_plain(price_frame):
    prices = [10.0, 2e9, 20.0, 0.12345678, -2e9, *[float(i) for i in range(40)], 3e8]
    frame = price_frame([{"price": p} for p in prices])
    got = {r.price_id: r for r in windows.with_indicators(frame, rows_per_piece=None).collect()}
    for i in range(len(prices)):
        r = got[f"p{i:05d}"]
        for mean, rows in ((r.moving_avg_7d, 7), (r.moving_avg_30d, 30)):
            some = [Decimal(repr(p)) for p in prices[max(0, i + 1 - rows): i + 1]]
            assert mean == float((sum(some) / len(some)).quantize(Decimal("0.01"), ROUND_HALF_UP))
