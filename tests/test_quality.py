from pyspark.sql import functions as F

from stallbook.operators import changes, quality
from stallbook.plans.prices import silver


def edge_rows(price_frame):
    return price_frame(
        [
            {"price": 10.0},
            {"price": None},
            {"price": 0.0},
            {"price": -5.0},
            {"day": None, "price": 10.0},
            {"commodity": "  ", "price": 10.0},
            {"commodity": None, "price": 10.0},
            {"state": None, "price": 10.0},
        ]
    )


def test_rules_keep_only_rows_that_hold(price_frame):
    rows = edge_rows(price_frame)
    rules = quality.price_rules()
    assert {r.price_id for r in quality.keep_valid(rows, rules).collect()} == {"p00000", "p00007"}
    bad = {r.price_id: r.failed_rules for r in quality.quarantine(rows, rules).collect()}
    assert bad["p00001"] == ["valid_price"] and bad["p00004"] == ["valid_date"]
    assert bad["p00005"] == ["valid_commodity"] and len(bad) == 6
    assert [r.price_id for r in silver(rows).collect()] == ["p00000"]


def test_rule_counts_and_observation_agree(price_frame):
    rows, rules = edge_rows(price_frame), quality.price_rules()
    counts = {r.rule: (r.rows, r.passed, r.failed) for r in quality.rule_counts(rows, rules).collect()}
    assert counts == {
        "valid_price": (8, 5, 3), "valid_date": (8, 7, 1), "valid_commodity": (8, 6, 2),
    }
    kept, seen = quality.keep_valid_observed(rows, rules)
    assert kept.count() == 2
    assert seen.get == {"rows": 8, "valid_price": 3, "valid_date": 1, "valid_commodity": 2}


def test_dedupe_keeps_the_first_and_is_idempotent(price_frame):
    rows = price_frame(
        [{"day": 0, "price": 5.0, "id": "b"}, {"day": 0, "price": 6.0, "id": "a"}, {"day": 1}]
    )
    once = quality.dedupe(rows)
    assert sorted(r.price_id for r in once.collect()) == ["a", "p00002"]
    assert sorted(quality.dedupe(once).collect()) == sorted(once.collect())


def test_dedupe_limits_groups_before_the_shuffle(price_frame):
    plan = quality.dedupe(price_frame([{}]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_key_check(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    row = quality.key_check(df, ["k"]).first()
    assert (row.rows, row.null_keys, row.repeated_keys, row.surplus_rows) == (4, 1, 1, 1)
    assert [tuple(r) for r in quality.repeated_keys(df, ["k"]).collect()] == [(1, 2)]
    empty = quality.key_check(df.limit(0), ["k"]).first()
    assert tuple(empty) == (0, 0, 0, 0)


def test_upsert_then_diff_gives_the_upserted_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (4, "d"), (3, "c")], "k int, v string")
    merged = changes.upsert(old, new, ["k"])
    assert sorted(tuple(r) for r in merged.collect()) == [(1, "a"), (2, "x"), (3, "c"), (4, "d")]
    diff = {(r.k, r.change, r.v) for r in changes.snapshot_diff(old, merged, ["k"]).collect()}
    assert diff == {(2, "update", "x"), (4, "insert", "d")}
    gone = changes.snapshot_diff(old, old.filter("k <> 2"), ["k"]).collect()
    assert [(r.k, r.change, r.v) for r in gone] == [(2, "delete", None)]


def test_append_evolving_fills_missing_columns(spark):
    a = spark.createDataFrame([(1,)], "k int")
    b = spark.createDataFrame([(2, "x")], "k int, extra string")
    both = changes.append_evolving(a, b).orderBy("k").collect()
    assert [tuple(r) for r in both] == [(1, None), (2, "x")]
    assert changes.append_evolving(b, a).filter(F.col("extra").isNull()).count() == 1


def test_diff_counts_copies_and_null_keys(spark):
    old = spark.createDataFrame([(1, "a"), (1, "a"), (None, "n"), (None, "m")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (None, "n"), (2, "b")], "k int, v string")
    got = {(r.k, r.v, r.change, r.copies) for r in changes.snapshot_diff(old, new, ["k"]).collect()}
    assert got == {(1, "a", "insert", 1), (None, "m", "delete", 1), (2, "b", "insert", 1)}
