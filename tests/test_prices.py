import datetime as dt
import random
import statistics
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stallbook.functions.dates import with_calendar
from stallbook.functions.numeric import half_up
from stallbook.operators import daily, forecast, recency, summaries, windows
from stallbook.plans.report import price_report


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_monthly_analytics(price_frame):
    rows = with_calendar(
        price_frame([{"day": 0, "price": 1.0}, {"day": 0, "price": 1.01, "variety": "w"}, {"day": 30, "price": 4.0},
                     {"day": 31, "price": 9.0}])
    )
    january, february = summaries.monthly_analytics(rows).orderBy("month").collect()
    assert (january.total_records, january.trading_days) == (3, 2)
    assert january.avg_modal_price == 2.0 and january.max_modal_price == 4.0
    assert january.price_stddev == pytest.approx(1.73)
    assert february.price_stddev is None and february.avg_min_price == 8.0


def test_missing_and_tiny_prices_do_not_fail(price_frame):
    rows = price_frame([{"price": 0.004}, {"price": 5.0}]).withColumns(
        {"min_price": F.lit(None).cast("double"), "max_price": F.lit(None).cast("double")}
    )
    month = summaries.monthly_analytics(with_calendar(rows)).first()
    assert month.avg_min_price is None and month.total_records == 2
    assert daily.price_trend(rows, ("commodity",)).first().min_price is None
    changes = [r.price_change_pct for r in windows.with_indicators(rows).orderBy("arrival_date").collect()]
    assert changes == [0.0, 124900.0]


def test_prices_are_not_rounded_before_means_and_changes(price_frame):
    rows = price_frame([{"price": 10.004}, {"price": 10.005}, {"price": 1.234}, {"price": 1.236}, {"price": 0.0}, {"price": 3.0}])
    assert summaries.top_commodities(rows.filter("modal_price > 10")).first().avg_price == 10.0
    changes = [r.price_change_pct for r in windows.with_indicators(rows).orderBy("arrival_date").collect()]
    assert changes[3] == 0.16 and changes[5] is None
    odd = rows.withColumn("modal_price", F.expr("if(modal_price < 1, double('Infinity'), modal_price)"))
    assert summaries.commodity_counts(odd).first()["count"] == 6
    assert summaries.top_commodities(odd).first().avg_price == 5.1


def test_commodity_spread_is_put_together_from_groups(price_frame):
    rng = random.Random(6)
    prices = [round(rng.uniform(10, 500), 2) for _ in range(200)]
    rows = price_frame([{"market": f"m{i % 7}", "state": f"s{i % 3}", "price": p} for i, p in enumerate(prices)])
    row = summaries.commodity_analytics(rows).first()
    assert row.price_stddev == pytest.approx(statistics.stdev(prices), abs=0.0051)
    assert (row.num_markets, row.num_states, row.total_records) == (7, 3, 200)
    constant = price_frame([{"market": f"m{i % 7}", "price": 123456.78} for i in range(101)])
    assert summaries.commodity_analytics(constant).first().price_stddev == 0.0


def test_mean_rounds_ties_up_exactly(price_frame):
    row = summaries.top_commodities(price_frame([{"price": 1.0}, {"price": 1.01}])).first()
    assert row.avg_price == 1.01  # 1.005


def test_having_and_top_k(price_frame):
    rows = price_frame(
        [{"commodity": "a", "price": 9.0}] * 3 + [{"commodity": "b", "price": 5.0}] * 5 + [{"commodity": "c"}]
    )
    assert [r.commodity for r in summaries.commodity_analytics(rows, more_than=2).collect()] == ["a", "b"]
    assert [r.commodity for r in summaries.commodity_counts(rows, top=2).collect()] == ["b", "a"]
    assert [r.records for r in summaries.commodity_summary(rows).collect()] == [5, 3, 1]
    assert [r.commodity for r in summaries.first_commodities(rows, 2).collect()] == ["a", "b"]


def test_value_lists_drop_empty_values(price_frame):
    rows = price_frame([{"market": "z"}, {"market": "a"}, {"market": "a"}, {"market": ""}, {"market": None}])
    assert summaries.value_lists(rows, ["commodity"], "market").first().market_list == ["a", "z"]


def test_recent_days_are_relative_to_each_key(price_frame):
    rows = price_frame(
        [{"commodity": "a", "day": 0}, {"commodity": "a", "day": 30}, {"commodity": "a", "day": 31},
         {"commodity": "b", "day": 0}]
    )
    kept = {(r.commodity, r.arrival_date) for r in recency.recent_days(rows, ["commodity"]).collect()}
    assert kept == {("a", day(30)), ("a", day(31)), ("b", day(0))}


def test_rankings(price_frame):
    rows = price_frame([{"market": f"m{i:02d}", "state": f"s{i % 7}", "day": 0, "price": 100.0 + i} for i in range(14)])
    best = recency.best_markets(rows, per_key=1).orderBy("state").collect()
    assert [r.market for r in best] == ["m07", "m08", "m09", "m10", "m11", "m12", "m13"]
    states = recency.state_comparison(rows, top=5).orderBy("position").collect()
    assert [r.state for r in states] == ["s2", "s3", "s4", "s5", "s6"]
    newest = recency.latest_prices(rows, per_key=3).orderBy("rank").collect()
    assert [r.market for r in newest] == ["m00", "m01", "m02"]


@pytest.mark.parametrize("points,kept", [(6, 6), (10, 10), (11, 11), (12, 11)])
def test_last_days_cut_only_longer_series(price_frame, points, kept):
    series = daily.daily_prices(price_frame([{"day": d} for d in range(points)]), ("commodity",))
    # a cut to N days keeps N + 1 points, and happens only beyond N points
    assert daily.last_days(series, ("commodity",), 10).count() == kept


def test_rolling_means_start_after_the_cut(price_frame):
    rows = price_frame([{"day": d, "price": 1000.0 if d < 5 else 10.0} for d in range(20)])
    trend = daily.price_trend(rows, ("commodity",), days=10).orderBy("arrival_date").collect()
    assert trend[0].arrival_date == day(9) and all(r.ma_30d == 10.0 for r in trend)


def loop_forecast(prices, days=7):
    """The textbook recursions."""
    level = prices[0]
    for p in prices[1:]:
        level = 0.3 * p + 0.7 * level
    recent = prices[-30:]
    shift = 0.0
    if len(recent) >= 7:
        m7, m30 = sum(recent[-7:]) / 7, sum(recent) / len(recent)
        shift = (m7 - m30) / m30 * 100
    out, price = [], level
    for _ in range(days):
        price = max(price * (1 + shift / 100 / 30), prices[-1] * 0.7)
        out.append(price)
    return shift, out


SERIES = {
    "six": [100.0 + i for i in range(6)],
    "nine": [50.0] * 9,
    "ten": [50.0] * 10,
    "rising": [100.0 * 1.05**i for i in range(31)],
    "falling": [100.0 * 0.9**i for i in range(30)],
    "crash": [1000.0] * 40 + [10.0],
    "noisy": [random.Random(4).uniform(50, 150) for _ in range(75)],
}


@pytest.fixture(scope="module")
def many_series(price_frame):
    rows = [
        {"commodity": name, "market": name, "day": d, "price": round(p, 2), "id": f"{name}{d:03d}"}
        for name, prices in SERIES.items()
        for d, p in enumerate(prices)
    ]
    return price_frame(rows)


def test_forecast_equals_the_loop(many_series):
    got = {}
    for r in forecast.price_forecast(many_series, ("commodity",)).orderBy("day").collect():
        got.setdefault(r.commodity, []).append(r.predicted_price)
    assert set(got) == set(SERIES) - {"six", "nine"}
    for name, prices in got.items():
        _, expected = loop_forecast([round(p, 2) for p in SERIES[name]])
        assert prices == pytest.approx(expected, abs=0.0051)


def test_outlook_keeps_refusals_as_rows(many_series):
    rows = {r.commodity: r for r in forecast.price_outlook(many_series, ("commodity",)).collect()}
    assert rows["six"].status == "insufficient data" and rows["six"].trend == "unknown"
    assert rows["six"].records == 6 and rows["six"].forecast_avg is None
    assert rows["ten"].trend == "stable" and rows["ten"].forecast_avg == 50.0
    assert rows["rising"].trend == "rising" and rows["falling"].trend == "falling"
    shift, path = loop_forecast([round(p, 2) for p in SERIES["noisy"]])
    assert rows["noisy"].pct_change == pytest.approx(shift, abs=0.0051)
    assert rows["noisy"].forecast_avg == pytest.approx(sum(path) / 7, abs=0.011)


def test_noise_is_optional_and_seeded(many_series):
    def run(seed):
        df = forecast.price_forecast(many_series, ("commodity",), noise_seed=seed)
        return sorted((r.commodity, r.day, r.predicted_price) for r in df.collect())

    assert run(None) != run(1)
    assert run(1) != run(2)
    whole = forecast.price_forecast(many_series, ("commodity",), noise_seed=1)
    dealt = forecast.price_forecast(many_series.repartition(7), ("commodity",), noise_seed=1)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, dealt.collect()))


def test_noise_feeds_the_next_day(spark, many_series):
    state = {r.commodity: r for r in forecast.series_state(many_series, ("commodity",)).collect()}
    days = spark.range(1, 8).select(F.col("id").cast("int").alias("day"))
    names = spark.createDataFrame([(c,) for c in state], "commodity string")
    draws = {(r.commodity, r.day): r.z for r in names.crossJoin(days).select("commodity", "day", forecast.gaussian(5, F.col("commodity"), F.col("day")).alias("z")).collect()}
    got = {(r.commodity, r.day): r.predicted_price for r in forecast.price_forecast(many_series, ("commodity",), noise_seed=5).collect()}
    for name in {c for c, _ in got}:
        s = state[name]
        price = s.level
        for day in range(1, 8):
            price = max(price * (1 + s.shift_pct / 3000) + draws[name, day] * s.last_price * 0.01, s.last_price * 0.7)
            assert got[name, day] == pytest.approx(price, abs=0.0051)


@settings(max_examples=200, deadline=None)
@given(st.floats(10, 1000), st.floats(10, 1000), st.floats(-90, 300), st.integers(1, 30))
def test_closed_form_of_the_floor(level, last, shift, days):
    factor, least, price = 1 + shift / 100 / 30, last * 0.7, level
    for _ in range(days):
        price = max(price * factor, least)
    closed = (
        max(level * factor**days, least) if factor < 1 else max(level * factor, least) * factor ** (days - 1)
    )
    assert closed == pytest.approx(price, rel=1e-9)


def test_report_for_one_selection(many_series):
    tables = price_report(many_series, commodity="noisy")
    assert {r.commodity for r in tables["current_prices"].collect()} == {"noisy"}
    assert tables["forecast"].count() == 7 and tables["outlook"].count() == 1
    assert tables["trend"].count() == 75
    assert price_report(many_series)["outlook"].count() == len(SERIES)


def test_half_up_is_decimal_half_up(spark):
    values = [k / 1000 for k in range(-3000, 3000)] + [52030.365, 1.005, 2.675, 99999.995]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", half_up("v").alias("r")).collect():
        assert r.r == float(Decimal(repr(r.v)).quantize(Decimal("0.01"), ROUND_HALF_UP)), r.v
