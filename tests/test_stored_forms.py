"""Indexes, states, change feeds, rescued lines, layouts and pages against brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stallbook.functions import numeric
from stallbook.operators import change_feed, changes, matching, pages, price_states, quality, summaries, treatments, vector_index, vectors, windows
from stallbook.plans import model
from stallbook.plans import prices as price_plan
from stallbook.session import scratch_path, settle
from stallbook.sinks import layout
from stallbook.sources import files, rescue, tables
from stallbook.streaming import gold_states, ingest, metrics
from stallbook.streaming.survivors import drain_survivors, read_survivors, smallest_of_batches

# ---- searches in cells ----------------------------------------------------------


@pytest.mark.parametrize("whole_word", [False, True])
@pytest.mark.parametrize("block_words, strip_rows", [(200_000, 200_000), (4, 3)])
def test_keyword_search_in_blocks_and_strips(spark, monkeypatch, whole_word, block_words, strip_rows):
    monkeypatch.setattr(matching, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(matching, "STRIP_ROWS", strip_rows)
    monkeypatch.setattr(matching, "STEP_SCORES", 7)
    rng = random.Random(3)
    words = ["a", "ab", "abc", "bc", "über", "c", "xyz", "yz", "日本"]
    queries = [(i, " ".join(rng.choices(words, k=rng.randrange(5)))) for i in range(15)] + [(90, None), (91, "a a ab"), (92, "A A aB")]
    texts = [(i, " ".join(rng.choices([*words, "zabcz", "bcx"], k=rng.randrange(9)))) for i in range(40)] + [(50, None), (51, "")]
    asked = spark.createDataFrame(queries, "query_id long, text string")
    stored = spark.createDataFrame(texts, "chunk_id long, text string").repartition(3)
    found = sorted(tuple(r) for r in matching.keyword_top_k(asked, stored, 4, whole_word=whole_word).collect())
    expected = []
    for q, text in queries:
        scores = []
        for c, chunk in texts:
            own = (chunk or "").lower().split() if whole_word else (chunk or "").lower()
            score = sum(w in own for w in (text or "").lower().split())
            if score and chunk is not None:
                scores.append((-score, c))
        expected += [(q, r, c, -s) for r, (s, c) in enumerate(sorted(scores)[:4], 1)]
    assert found == sorted(expected)


def clustered(n, d, groups, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (groups, d))
    return [[float(v) for v in np.float32(middles[i % groups] + rng.normal(0, spread, d))] for i in range(n)]


@pytest.mark.parametrize("strip_rows, block_rows", [(1 << 18, 1 << 14), (20, 5)])
def test_vector_index_equals_the_scan_and_visits_few_cells(spark, monkeypatch, strip_rows, block_rows):
    monkeypatch.setattr(vector_index, "CELL_ROWS", 20)
    monkeypatch.setattr(vector_index, "STRIP_ROWS", strip_rows)
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", block_rows)
    x = clustered(900, 8, 45, 2)
    rows = [(i, v) for i, v in enumerate(x)] + [(2000 + i, x[3]) for i in range(70)]  # a hot cell of equal vectors
    rows += [(3000, [0.0] * 8), (3001, [0.0] * 8), (3002, None), (3003, [1.0, None] + [0.0] * 6), (3004, [float("nan")] * 8)]
    frame = spark.createDataFrame(rows, "vector_id long, embedding array<float>").repartition(5)
    asked = [(i, x[i * 7]) for i in range(60)] + [(100, [0.0] * 8), (101, None), (102, x[3])]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<float>")
    path = scratch_path(spark, "index")
    vector_index.build_index(frame, path)
    found, about = vector_index.search_index(spark, path, queries, 5)
    expected = vectors.cosine_top_k(queries, frame, 5).collect()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected))
    visited = about.first()
    assert visited["visited"] < 0.5 * visited["pairs"] and visited["vectors_scored"] < 0.5 * visited["vectors"]
    held = spark.read.parquet(f"{path}/vectors")
    assert held.count() == 972 and held.filter("cell = -1").count() == 2


def test_a_query_that_visits_every_cell_is_stored_once_and_leaves_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "CELL_ROWS", 10)
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 64)
    monkeypatch.setattr(vectors, "FOUND_QUERIES", 16)
    rng = np.random.default_rng(5)
    x = [[float(v) for v in np.float32(rng.normal(0, 1, 12))] for _ in range(400)]  # no direction is like another
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vector_id long, embedding array<float>")
    queries = frame.withColumnRenamed("vector_id", "query_id")
    stored = {}

    def spy(df, name):
        stored[name] = settle(df, name)
        return stored[name]

    monkeypatch.setattr(vector_index, "settle", spy)
    path = scratch_path(spark, "index")
    vector_index.build_index(frame, path)
    found, about = vector_index.search_index(spark, path, queries, 3)
    seen = about.first()
    assert seen["visited"] > 20 * 400
    assert stored["first_visits"].count() == 400 and stored["other_visits"].count() == 400
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, vectors.cosine_top_k(queries, frame, 3).collect()))


def test_scores_are_kept_by_what_is_known_of_them():
    rng = np.random.default_rng(1)
    unit = vectors._unit(rng.normal(0, 1, (500, 16)))
    exact = unit[:40] @ unit.T
    least = np.sort(exact, axis=1)[:, -3]
    for known, asked in ((None, None), (least, None), (least, np.arange(0, 40, 3))):
        best = vectors._Best(unit[:40], 3, None if known is None else known.copy())
        for start in range(0, 500, 70):
            best.take(np.arange(start, min(500, start + 70)), unit[start : start + 70], asked)
        for i in range(40):
            wanted = np.argsort(-exact[i], kind="stable")[:3].tolist() if asked is None or i in asked else None
            assert (None if best.ids[i] is None else best.ids[i].tolist()) == wanted
    names = [f"q{i}" for i in range(40)]
    batches = list(vectors.found_rows(names, best, (pa.string(), pa.int64())))
    assert len(batches) == 1 and batches[0].num_rows == 3 * 14


def test_vector_index_of_nothing(spark):
    none = spark.createDataFrame([], "vector_id long, embedding array<float>")
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vector_id long, embedding array<float>")
    queries = some.withColumnRenamed("vector_id", "query_id")
    for stored, asked, n in ((none, queries, 0), (some, queries.limit(0), 0), (some, queries, 4)):
        path = scratch_path(spark, "index")
        vector_index.build_index(stored, path)
        assert vector_index.search_index(spark, path, asked, 3)[0].count() == n


# ---- prices -----------------------------------------------------------------------


def test_prices_of_any_size_are_summed_as_written(spark):
    rows = [("a", 1e12), ("a", 10.0), ("b", 0.1234567), ("b", 0.1234568), ("c", 3e15), ("c", 0.005), ("d", float("nan")), ("d", None), ("e", float("inf")), ("e", 2.675)]
    rows += [("f", 1.005)] * 2 + [("g", -7.005), ("g", -7.005)]
    frame = spark.createDataFrame(rows, "k string, p double")
    got = {r.k: (r.m, r.n) for r in frame.groupBy("k").agg(numeric.avg_price("p").alias("m"), numeric.price_count("p").alias("n")).collect()}
    assert got["a"] == (500000000005.0, 2) and got["b"] == (0.12, 2) and got["c"] == (1500000000000000.0, 2)
    assert got["d"] == (None, 0) and got["e"] == (2.68, 1) and got["f"] == (1.01, 2) and got["g"] == (-7.01, 2)
    with pytest.raises(Exception, match="(?i)out_of_range|overflow"):
        spark.createDataFrame([(1e25,)], "p double").agg(numeric.avg_price("p")).collect()


def test_rolling_means_and_changes_of_mixed_prices(spark):
    values = [100.005, 5e13, 0.1234567, 7.0, 99999999.99, 1e8, 3.0, 0.0, 12.5]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, p double")
    from decimal import ROUND_HALF_UP, Decimal

    from pyspark.sql import Window

    order = Window.partitionBy(F.lit(0)).orderBy("i")
    summed = frame.withColumns(numeric.running_sums("p", order.rowsBetween(Window.unboundedPreceding, 0)))
    got = summed.select("i", numeric.mean_of_last(3, order).alias("m"), numeric.mean_of_last(2, order, skip=1).alias("before"), numeric.change_pct(F.col("p"), F.lag("p").over(order)).alias("c")).orderBy("i").collect()
    for r in got:
        own = [Decimal(repr(v)) for v in values[max(0, r.i - 2) : r.i + 1]]
        assert r.m == float((sum(own) / len(own)).quantize(Decimal("0.01"), ROUND_HALF_UP))
        earlier = [Decimal(repr(v)) for v in values[max(0, r.i - 2) : r.i]]
        assert r.before == (float((sum(earlier) / len(earlier)).quantize(Decimal("0.01"), ROUND_HALF_UP)) if earlier else None)
        if r.i and values[r.i - 1]:
            change = (own[-1] - own[-2]) * 100 / own[-2]
            assert r.c == pytest.approx(float(change.quantize(Decimal("0.01"), ROUND_HALF_UP)), abs=1e-9)
        else:
            assert r.c is None


def test_states_of_parts_merge_to_the_state_of_all(spark, price_frame, tmp_path):
    rng = random.Random(9)
    rows = [{"market": f"M{rng.randrange(4)}", "day": rng.randrange(70), "price": rng.choice([1e9 + rng.random(), rng.randrange(1, 10**6) / 100, 0.1234567])} for _ in range(400)]
    prices = price_plan.silver(price_frame([*rows, {"market": "alone", "price": 5.0}]))
    whole = {tuple(r) for r in summaries.monthly_analytics(prices).collect()}
    parts = prices.withColumn("part", F.pmod(F.xxhash64("price_id"), F.lit(7)))
    path = str(tmp_path / "states")
    for number in range(7):
        gold_states.add_batch(parts.filter(F.col("part") == number).drop("part"), number, path, compact_every=3)
        if number in (2, 4):  # a repeated batch replaces its states, at a base and behind one
            gold_states.add_batch(parts.filter(F.col("part") == number).drop("part"), number, path, compact_every=3)
    assert sorted(gold_states._folders(spark, path, "base")) == [2, 5]
    assert gold_states.stored_states(spark, path).inputFiles()[0].count("batch=6") + sum("batch=" in f for f in gold_states.stored_states(spark, path).inputFiles()) >= 1
    got = {tuple(r) for r in gold_states.read_gold(spark, path).collect()}
    assert {r[:7] + r[7:10] + r[11:] for r in got} == {r[:7] + r[7:10] + r[11:] for r in whole}
    spread = {r[:5]: r[10] for r in got}
    for r in whole:
        assert (r[10] is None) == (spread[r[:5]] is None)
        if r[10] is not None:
            assert math.isclose(spread[r[:5]], r[10], rel_tol=1e-9, abs_tol=0.011)
    month = gold_states.read_gold(spark, path, year=2024, month=2)
    assert month.count() == sum(r[3:5] == (2024, 2) for r in whole)
    twice = price_states.merge_states(price_states.merge_states(price_states.price_states(prices)))
    assert price_states.finished(twice).count() == len(whole)


def test_states_that_are_one_per_group_are_read_without_a_shuffle(spark, price_frame, tmp_path):
    prices = price_plan.silver(price_frame([{"market": f"M{i % 3}", "day": 9 * i, "price": 2.5 * i + 1} for i in range(30)]))
    path = str(tmp_path / "states")
    for number in range(2):
        gold_states.add_batch(prices, number, path, compact_every=2)
    base = gold_states.read_gold(spark, path)
    assert "Exchange" not in base._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in base.collect()} == {tuple(r) for r in summaries.monthly_analytics(prices.union(prices)).collect()}
    # a later batch has states of its own for the same groups
    gold_states.add_batch(prices, 2, path, compact_every=2)
    assert {tuple(r) for r in gold_states.read_gold(spark, path).collect()} == {
        tuple(r) for r in summaries.monthly_analytics(prices.union(prices).union(prices)).collect()
    }


# ---- change rows ------------------------------------------------------------------


def test_changes_in_any_order_give_the_last_state(spark):
    rng = random.Random(2)
    keys = ["a", "b", "c", None]
    log = [(rng.choice(keys), n, rng.choice(["insert", "update", "delete"]), f"v{n}") for n in range(1, 60)]
    start = [("a", "old"), ("z", "stays")]
    expected, spans = dict(start), {}
    for key, n, kind, value in log:
        spans.setdefault(key, []).append(n)
        expected.pop(key, None)
        if kind != "delete":
            expected[key] = value
    for seed in (1, 2):
        order = random.Random(seed).sample(log, len(log))
        history = change_feed.new_history(spark.createDataFrame(start, "k string, v string"), ["k"], 0)
        for a in range(0, len(order), 20):
            batch = spark.createDataFrame([(k, v, n, c) for k, n, c, v in order[a : a + 20]], "k string, v string, n int, change string")
            history = change_feed.apply_changes(history, batch, ["k"], "n")
            if a == 20:
                history = change_feed.apply_changes(history, batch, ["k"], "n")
            history = spark.createDataFrame(history.collect(), history.schema)
        assert {r.k: r.v for r in change_feed.version(history).collect()} == expected
        early = {}
        for key, n, kind, value in [*((k, 0, "insert", v) for k, v in start), *log]:
            if n <= 30:
                early.pop(key, None)
                if kind != "delete":
                    early[key] = value
        assert {r.k: r.v for r in change_feed.version(history, 30).collect()} == early
        rows = sorted((r.valid_from, r.valid_to) for r in history.filter("k = 'b'").collect())
        assert [a for a, _ in rows] == spans["b"] and [b for _, b in rows] == [*spans["b"][1:], None]


def test_changes_at_one_number_and_without_one(spark):
    schema = "k int, v string, n int, change string"
    history = change_feed.new_history(spark.createDataFrame([(1, "x")], "k int, v string"), ["k"], 0)
    same = spark.createDataFrame([(1, "a", 5, "update"), (1, "b", 5, "update"), (2, "c", 5, "insert"), (2, None, 5, "delete")], schema)
    after = change_feed.apply_changes(history, same, ["k"], "n")
    assert [(r.k, r.v) for r in change_feed.version(after).collect()] == [(1, "b")]
    with pytest.raises(Exception, match="a change has no n"):
        change_feed.apply_changes(history, spark.createDataFrame([(1, "a", None, "update")], schema), ["k"], "n").collect()


def test_repeated_keys_of_a_batch(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "z", None), (3, "w", 1), (None, "n", 1), (None, "m", 1)], "k int, v string, at int")
    with pytest.raises(ValueError, match="'k': "):
        changes.upsert(old, new, ["k"])
    got = sorted((r.k is None, r.k or 0, r.v) for r in changes.upsert(old, new, ["k"], order=["at"]).collect())
    assert got == [(False, 1, "y"), (False, 2, "b"), (False, 3, "w"), (True, 0, "m"), (True, 0, "n")]


# ---- files and tables -------------------------------------------------------------


def test_every_line_is_loaded_or_rescued(spark, tmp_path):
    good = '{"Commodity": "Rice", "Modal Price (Rs./Quintal)": 12.5, "Market": "M"}'
    lines = [good, '{"Commodity": "Rice", "Moisture": "7 %", "Note": null}', '{"Commodity": "Rice", "Modal', "", "  ", "[1, 2]", "5", "text", "{}", '{"Commodity": {"a": 1}}']
    (tmp_path / "prices_1.json").write_text("\n".join(lines))
    (tmp_path / "prices_2.json").write_text(good)
    found = rescue.read_lines(spark, str(tmp_path), files.PRICE_FILE)
    counts = {r.source_file[-6]: r for r in rescue.rescue_counts(found).collect()}
    assert (counts["1"].lines, counts["1"].loaded, counts["1"].broken_line, counts["1"].unexpected_column) == (8, 4, 4, 1)
    assert (counts["2"].lines, counts["2"].loaded) == (1, 1)
    rescued = sorted((r.rule, r.column or "", r.content) for r in rescue.rescued(found).filter("content is not null").collect())
    assert rescued == [("broken_line", "", c) for c in sorted(["[1, 2]", "5", "text", lines[2]])] + [("unexpected_column", "Moisture", "7 %")]
    rows = files.price_columns(rescue.loaded(found)).collect()
    assert sorted((r.commodity or "", r.modal_price) for r in rows if r.modal_price) == [("Rice", 12.5)] * 2 and len(rows) == 5


def test_headers_of_json_lines_in_any_case(spark, tmp_path):
    lines = ['{"COMMODITY": "Rice", "modal price (rs./quintal)": 12.5}', '{"Commodity": "Wheat", "Modal_Price": "7", "commodity": "x"}', "broken", '{"Modal_Price": "NR"}']
    (tmp_path / "p.json").write_text("\n".join(lines))
    rows = files.load_prices(spark, str(tmp_path / "p.json"), multi_line=False).collect()
    assert sorted((r.commodity, r.modal_price) for r in rows) == [("Rice", 12.5), ("Wheat", 7.0)]
    assert all(r.source_file.endswith("p.json") for r in rows)


def test_limit_of_no_rows(spark, tmp_path):
    spark.range(5).write.mode("overwrite").option("path", str(tmp_path / "t")).saveAsTable("five_rows")
    assert tables.read_table(spark, "five_rows", limit=0).count() == 0
    assert tables.read_table(spark, "five_rows", limit=2).count() == 2
    spark.sql("DROP TABLE five_rows")


def test_the_last_file_by_name_counts(spark):
    schema = "disease_class string, treatment string, prevention string, organic string, source_file string"
    known = spark.createDataFrame([("L", "late", "p", "o", "b.json"), ("L", "early", "p", "o", "a.json")], schema).repartition(2)
    got = treatments.with_treatments(spark.createDataFrame([("L",)], "label string"), known).collect()
    assert [r.treatment for r in got] == ["late"]


def test_windows_and_merges_over_buckets_need_no_exchange(spark, price_frame, tmp_path):
    rows = price_plan.silver(price_frame([{"market": f"M{i % 9}", "day": i // 9, "price": 10.0 + i} for i in range(300)]))
    layout.write_bucketed(rows, "silver_in_buckets", windows.SERIES, windows.ORDER, 4, str(tmp_path / "s"))
    stored = spark.table("silver_in_buckets")
    assert layout.bucketing(spark, "silver_in_buckets") == (4, list(windows.SERIES))
    kept = quality.dedupe(stored, [*windows.SERIES, "arrival_date", "variety"])
    enriched = windows.with_indicators(kept)
    assert layout.exchanges(enriched) == 0 and layout.exchanges(windows.with_indicators(rows)) > 0
    assert sorted(map(tuple, enriched.collect())) == sorted(map(tuple, windows.with_indicators(quality.dedupe(rows)).select(*enriched.columns).collect()))
    new = rows.filter("market = 'M1'").withColumn("modal_price", F.lit(1.0))
    keys = [*windows.SERIES, "price_id"]
    layout.merge_bucketed(new, "silver_in_buckets", keys, windows.ORDER, "silver_merged", str(tmp_path / "m"))
    merged = spark.table("silver_merged")
    assert merged.count() == 300 and merged.filter("modal_price = 1").count() == new.count()
    with pytest.raises(ValueError, match="not among the keys"):
        layout.merge_bucketed(new, "silver_merged", ["price_id"], (), "other")
    for name in ("silver_in_buckets", "silver_merged"):
        spark.sql(f"DROP TABLE {name}")
    assert layout.buckets_for(10 << 30) == 64


def test_pages_of_a_key_with_most_values(spark):
    rows = [("hot", f"v{i:04d}") for i in range(2500)] + [("cold", "x"), ("cold", "x"), ("cold", ""), (None, "n"), ("hot", None)]
    frame = spark.createDataFrame(rows, "k string, v string").repartition(6)
    got = {(r.k, r.page): r.v_page for r in pages.value_pages(frame, ["k"], "v", 400).collect()}
    assert [v for p in range(1, 8) for v in got["hot", p]] == [f"v{i:04d}" for i in range(2500)]
    assert all(len(p) <= 400 for p in got.values()) and got["cold", 1] == ["x"] and got[None, 1] == ["n"] and len(got) == 9


# ---- streams ----------------------------------------------------------------------


def test_rule_counts_of_a_stream_are_kept_per_batch(spark, price_frame, tmp_path):
    inbox = str(tmp_path / "in")
    for part in ([{"price": 1.0}, {"price": -1.0}], [{"price": None}, {"day": None}], [{"price": 3.0}]):
        price_frame(part).coalesce(1).write.mode("append").parquet(inbox)
    stream = ingest.file_stream(spark, inbox, spark.read.parquet(inbox).schema, "parquet", max_files=1)
    listener = metrics.RuleMetrics(spark, str(tmp_path / "metrics"))
    spark.streams.addListener(listener)
    try:
        ingest.drain(metrics.watch_rules(stream, quality.price_rules()), str(tmp_path / "offsets"), path=str(tmp_path / "out"))
        listener.wait()
    finally:
        spark.streams.removeListener(listener)
    stored = metrics.stored_metrics(spark, str(tmp_path / "metrics"))
    assert {r.batch for r in stored.filter("rows > 0").collect()} == {0, 1, 2}
    sums = {r.rule: (r.rows, r.failed) for r in metrics.metrics_by_rule(stored).collect()}
    assert sums == {"valid_price": (5, 2), "valid_date": (5, 1), "valid_commodity": (5, 0)}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_survivors_of_late_and_hot_keys(spark, tmp_path):
    inbox, schema = str(tmp_path / "in"), "k string, day date, id string, v double"
    batches = [
        [("hot", None, f"id{i:03d}", 1.0) for i in range(900, 400, -1)] + [("a", None, "b", None)],
        [("a", None, "a", 2.0), (None, None, "n2", 3.0), ("hot", None, "id999", 4.0)],
        [("a", None, "c", 5.0), (None, None, "n1", 6.0), ("hot", None, "id000", 7.0), ("x", None, None, 8.0)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
    whole = spark.read.schema(schema).parquet(inbox)
    few = smallest_of_batches(whole.filter("id is not null").coalesce(1), ["k"], "id")
    assert few.filter("k = 'hot'").count() <= 3
    stream = ingest.file_stream(spark, inbox, whole.schema, "parquet", max_files=1)
    drain_survivors(stream, str(tmp_path / "out"), str(tmp_path / "offsets"), ["k"], "id")
    got = {r.k: (r.id, r.v) for r in read_survivors(spark, str(tmp_path / "out"), whole.schema, ["k"], "id").collect()}
    assert got == {"hot": ("id000", 7.0), "a": ("a", 2.0), None: ("n1", 6.0)}


def test_survivors_without_a_state_store_of_several_parts(spark, tmp_path):
    inbox, schema = str(tmp_path / "in"), "k string, id string"
    for rows in ([("a", "2"), ("b", "1")], [("a", "1"), ("b", "1"), ("b", "3")], [("a", "3"), (None, "0")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        out = str(tmp_path / "out")
        stream = ingest.file_stream(spark, inbox, spark.read.parquet(inbox).schema, "parquet", max_files=1)
        drain_survivors(stream, out, str(tmp_path / "offsets"), ["k"], "id")
    finally:
        spark.conf.set(store, before)
    assert sorted(map(tuple, read_survivors(spark, out, stream.schema, ["k"], "id").collect()), key=str) == [("a", "1"), ("b", "1"), (None, "0")]
    # each batch passed on what was smaller than all before
    assert spark.read.parquet(out).count() == 4
    assert all(f.name.endswith(".zstd.parquet") for f in (tmp_path / "out").rglob("*.parquet"))
    # rows go by key once, with their ids as bytes
    read = read_survivors(spark, out, stream.schema, ["k"], "id")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(k") == 1 and "_bytes_of_id" in plan


def test_stump_finds_the_best_split(spark):
    rng = random.Random(4)
    rows = [(float(rng.randrange(5)), float(rng.randrange(7))) for _ in range(500)]
    frame = spark.createDataFrame([(a, b, (10.0 if a > 2 else 1.0) + b / 100) for a, b in rows], "a double, b double, modal_price double")
    got = sorted(model.stump(frame, ("a", "b")).collect(), key=lambda r: r.below)
    assert [r.feature for r in got] == ["a", "a"] and got[0].threshold == 2.5
    below = [1.0 + b / 100 for a, b in rows if a <= 2]
    assert got[1].rows == len(below) and got[1].prediction == pytest.approx(sum(below) / len(below), abs=1e-3)


def test_a_batch_of_changes_reads_and_exchanges_a_history_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (None, "c")], "k long, v string")
    history = change_feed.new_history(rows, ["k"], 0)
    # an interval that its key's other rows do not give stays as it is while the key is not touched
    history = history.withColumn("valid_to", F.when(F.col("k") == 2, 7).otherwise(F.col("valid_to")))
    batch = spark.createDataFrame([(1, "x", 3, "update"), (1, "y", 0, "update"), (3, "z", 1, "insert")], "k long, v string, n int, change string")
    stored = [scratch_path(spark, "stored") for _ in range(2)]
    for frame, path in ((history, stored[0]), (batch, stored[1])):
        frame.write.parquet(path)
    old, new = (spark.read.parquet(path) for path in stored)
    after = change_feed.apply_changes(old, new, ["k"], "n")
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(k") == 2  # the history with the events, and the batch's own
    got = sorted(map(str, (tuple(r) for r in after.select("k", "v", "valid_from", "valid_to", "deleted").collect() if r.k is not None)))
    assert got == ["(1, 'x', 3, None, False)", "(1, 'y', 0, 3, False)", "(2, 'b', 0, 7, False)", "(3, 'z', 1, None, False)"]
    lone = [r for r in after.collect() if r.k is None]
    assert [r.v for r in lone] == ["c", "c"] and {r.valid_to for r in lone} == {0, None}
