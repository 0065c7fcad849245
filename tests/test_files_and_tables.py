import datetime as dt
import json
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stallbook import schemas
from stallbook.operators import changes, chunks, quality, recency, treatments
from stallbook.operators.keys import pack_ids, unpack_ids
from stallbook.plans import registry
from stallbook.plans.prices import silver
from stallbook.session import clear_scratch, scratch_path, settle, shared_folder
from stallbook.sinks import layout
from stallbook.sinks import tables as sinks
from stallbook.sources import files, tables
from stallbook.streaming import gold, ingest
from stallbook.streaming import silver as streaming_silver
from stallbook.streaming.silver import dedupe_stream, drain_unique, silver_stream


def raw(i, **over):
    return {
        "Sl no.": i, "State": "S", "District Name": "D", "Market Name": "M", "Commodity": "Rice", "Variety": "V",
        "Grade": "FAQ", "Min Price (Rs./Quintal)": 90, "Max Price (Rs./Quintal)": "110",
        "Modal Price (Rs./Quintal)": 100.5, "Price Date": f"{i:02d} Apr 2025", **over,
    }


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps(rows, indent=1, ensure_ascii=False), encoding="utf-8")


@pytest.fixture
def table_name(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    return f"shop.t_{uuid.uuid4().hex[:12]}"


def test_raw_price_files(spark, tmp_path):
    write(tmp_path, "a_prices_1.json", [
        raw(1), raw(2, **{"Modal Price (Rs./Quintal)": "NR"}), raw(3, **{"Price Date": "soon"}),
        raw(4, **{"Modal Price (Rs./Quintal)": -1}),
        raw(5, **{"Modal Price (Rs./Quintal)": "NaN"}),
    ])
    write(tmp_path, "schemes.json", [{"scheme_id": "x"}])
    rows = files.load(spark, "prices", str(tmp_path), files.FILE_PATTERNS["prices"])
    assert rows.columns == schemas.RAW_PRICES.names
    got = {r.arrival_date: r for r in rows.collect()}
    assert len(got) == 5 and None in got
    first = got[dt.date(2025, 4, 1)]
    assert (first.min_price, first.max_price, first.modal_price) == (90.0, 110.0, 100.5)
    assert first.source_file.endswith("a_prices_1.json") and got[dt.date(2025, 4, 2)].modal_price is None
    assert {r.price_id for r in rows.collect()} == {r.price_id for r in rows.collect()}
    assert files.load_prices(spark, str(tmp_path / "a_prices_1.json")).count() == 2


@pytest.mark.parametrize("text", ["05 Apr 2025", "05/04/2025", "2025-04-05", "05-04-2025", "5/4/2025"])
def test_alternative_headers_and_dates(spark, tmp_path, text):
    write(tmp_path, "p.json", [{
        "state": "S", "District": "D", "Market": "M", "Commodity": "Rice", "Arrival_Date": text, "Modal_Price": "7",
    }])
    row = files.load_prices(spark, str(tmp_path / "p.json")).first()
    assert row.arrival_date == dt.date(2025, 4, 5)
    assert (row.state, row.market, row.modal_price, row.min_price) == ("S", "M", 7.0, None)
    (tmp_path / "p.csv").write_text(
        f"State,District,Market,Commodity,Arrival_Date,Modal_Price\nS,D,M,Rice,{text},7\nS,D,M,Rice,{text},NR\n"
    )
    rows = files.load_prices(spark, str(tmp_path / "p.csv"), "csv").collect()
    assert [(r.arrival_date, r.modal_price) for r in rows] == [(dt.date(2025, 4, 5), 7.0)]


def test_text_sources(spark, tmp_path):
    write(tmp_path, "crop_knowledge.json", [
        {"disease_class": "Corn_(maize)___Common_rust_", "treatment": "t", "prevention": "p", "organic": "o"}])
    write(tmp_path, "govt_schemes.json", [{"scheme_id": "s", "eligibility": ["a"], "documents_required": []}])
    write(tmp_path, "pesticide_fertilizer.json", [{"crop": "Rice", "cost_estimate": "₹300"}])
    knowledge = files.load(spark, "knowledge", str(tmp_path), files.FILE_PATTERNS["knowledge"]).first()
    assert (knowledge.crop, knowledge.disease_name) == ("Corn", "Common rust ")
    assert files.load(spark, "schemes", str(tmp_path), files.FILE_PATTERNS["schemes"]).first().eligibility == ["a"]
    assert files.load(spark, "guide", str(tmp_path), files.FILE_PATTERNS["guide"]).first().cost_estimate == "₹300"
    assert files.inferred_schema(spark, str(tmp_path / "govt_schemes.json")).names == [
        "documents_required", "eligibility", "scheme_id"]


def test_remembered_schema(spark, tmp_path):
    write(tmp_path / "in", "a.json", [{"k": 1}])
    memory = str(tmp_path / "schema")
    first = files.remembered_schema(spark, str(tmp_path / "in"), memory)
    write(tmp_path / "in", "b.json", [{"k": "text", "new": 1}])
    assert files.remembered_schema(spark, str(tmp_path / "in"), memory) == first
    assert first.names == ["k"]


def test_comments_reach_the_catalog(spark, table_name, price_frame):
    rows = schemas.with_comments(price_frame([{}]), schemas.RAW_PRICES)
    sinks.write_table(rows, table_name)
    comments = {c.name: c.description for c in spark.catalog.listColumns(table_name)}
    assert comments["market"] == "Name of the market"


def test_reads_writes_and_inventory(spark, table_name):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "c", 3.0)], "k int, g string, v double")
    sinks.write_table(rows, table_name, partition_by=["g"])
    assert tables.table_exists(spark, table_name)
    assert table_name.split(".")[1] in tables.list_tables(spark, "shop")
    assert [r.k for r in tables.read_table(spark, table_name, {"g": ["a", "b"], "v": 1.0}).collect()] == [1]
    assert [r.k for r in tables.read_table(spark, table_name, {"v": None}).collect()] == [2]
    assert tables.read_table(spark, table_name, limit=2).count() == 2
    got = tables.run_sql(spark, f"SELECT k FROM {table_name} WHERE g = :g", {"g": "c"}).collect()
    assert [r.k for r in got] == [3]
    stats = {r.table_name: tuple(r)[1:] for r in tables.table_stats(spark, [table_name, "shop.none"]).collect()}
    assert stats == {table_name: (3, 3), "shop.none": (None, None)}


def test_append_adds_new_columns(spark, table_name):
    sinks.write_table(spark.createDataFrame([(1,)], "k int"), table_name)
    sinks.write_table(spark.createDataFrame([(2,)], "k int"), table_name, "append")
    sinks.write_table(spark.createDataFrame([(3, "x")], "k int, extra string"), table_name, "append")
    sinks.write_table(spark.createDataFrame([(4,)], "k int"), table_name, "append")
    assert sorted(tuple(r) for r in spark.table(table_name).collect()) == [
        (1, None), (2, None), (3, "x"), (4, None)]


@pytest.mark.parametrize("parts", [(), ("g",)])
def test_merge(spark, table_name, parts):
    old = spark.createDataFrame([(1, "x", "a"), (2, "y", "b"), (3, "z", "c")], "k int, v string, g string")
    new = spark.createDataFrame([(2, "Y", "a"), (4, "w", "d")], "k int, v string, g string")
    sinks.write_table(old, table_name, "merge", parts, keys=["k"])
    sinks.write_table(new, table_name, "merge", parts, keys=["k"])
    got = sorted((r.k, r.v, r.g) for r in spark.table(table_name).collect())
    assert got == [(1, "x", "a"), (2, "Y", "a"), (3, "z", "c"), (4, "w", "d")]


def test_logs(spark, price_frame):
    spark.sql("CREATE DATABASE IF NOT EXISTS logs")
    sinks.create_log_tables(spark, "logs")
    sinks.create_log_tables(spark, "logs")
    before = spark.table("logs.price_predictions_log").count()
    forecasts = spark.createDataFrame([("Rice", 1.5, 3), (None, None, None)], "commodity string, predicted_price double, day int")
    sinks.append_log(sinks.price_log_rows(forecasts), "logs.price_predictions_log")
    rows = spark.table("logs.price_predictions_log")
    assert rows.count() == before + 2 and rows.schema["timestamp"].dataType.typeName() == "timestamp"
    assert {r.days_ahead for r in rows.collect()} >= {3, 7}
    labels = spark.createDataFrame([("A___b", 0.5, "t")], "label string, score double, treatment string")
    sinks.append_log(sinks.disease_log_rows(labels), "logs.disease_predictions_log")
    chat = spark.createDataFrame([("q", "price", "x" * 900)], "text string, intent string, answer string")
    sinks.append_log(sinks.chat_log_rows(chat), "logs.chat_sessions")
    assert len(spark.table("logs.chat_sessions").first().response_summary) == 500


def test_chunk_files(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "one\ntwo ₹")], "chunk_id string, text string")
    sinks.write_chunks(chunks, str(tmp_path / "chunks"))
    assert spark.read.json(str(tmp_path / "chunks")).first().text == "one\ntwo ₹"


def test_settled_tables_live_in_the_shared_folder(spark):
    df = settle(spark.range(5), "numbers")
    assert df.count() == 5 and df.inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(
        shared_folder(spark).split(":", 1)[-1].lstrip("/"))


def test_ingest_takes_every_file_once(spark, tmp_path, table_name):
    inbox, offsets = tmp_path / "in", str(tmp_path / "offsets")
    write(inbox, "prices_1.json", [raw(1), raw(2)])
    write(inbox, "other.json", [raw(9)])
    ingest.ingest(spark, "prices", str(inbox), table_name, offsets)
    ingest.ingest(spark, "prices", str(inbox), table_name, offsets)
    assert spark.table(table_name).count() == 2
    write(inbox, "prices_2.json", [raw(3, Extra="new column")])
    ingest.ingest(spark, "prices", str(inbox), table_name, offsets)
    rows = spark.table(table_name)
    assert rows.count() == 3 and {r.source_file.rsplit("/", 1)[1] for r in rows.collect()} == {
        "prices_1.json", "prices_2.json"}


def test_streamed_silver_and_gold_equal_the_batch(spark, tmp_path):
    inbox = tmp_path / "in"
    write(inbox, "prices_1.json", [raw(1), raw(2, State=None), raw(3, **{"Modal Price (Rs./Quintal)": 0})])
    write(inbox, "prices_2.json", [raw(4), raw(4, Variety="W"), raw(5, **{"Price Date": "07 May 2025"})])
    stream = silver_stream(ingest.source_stream(spark, "prices", str(inbox), max_files=1))
    silver_path, gold_path = str(tmp_path / "silver"), str(tmp_path / "gold")
    ingest.drain(stream, str(tmp_path / "o1"), path=silver_path, partition_by=gold.MONTH)
    batch = silver(files.load(spark, "prices", str(inbox), files.FILE_PATTERNS["prices"]))
    ours = spark.read.schema(batch.schema).parquet(silver_path).select(*batch.columns)
    assert sorted(ours.collect()) == sorted(batch.collect()) and batch.count() == 4

    def follow():
        feed = ingest.file_stream(spark, silver_path, batch.schema, "parquet")
        gold.drain_gold(spark, feed, silver_path, gold_path, str(tmp_path / "o2"))
        return {(r.month, r.total_records, r.trading_days) for r in spark.read.parquet(gold_path).collect()}

    assert follow() == {(4, 3, 2), (5, 1, 1)}
    write(inbox, "prices_3.json", [raw(5, **{"Price Date": "08 May 2025"})])
    ingest.drain(
        silver_stream(ingest.source_stream(spark, "prices", str(inbox), max_files=1)),
        str(tmp_path / "o1"), path=silver_path, partition_by=gold.MONTH)
    assert follow() == {(4, 3, 2), (5, 2, 2)}


def test_a_later_stream_adds_columns(spark, tmp_path, table_name):
    first = spark.createDataFrame([(1,)], "k int")
    second = spark.createDataFrame([(2, "x")], "k int, extra string")
    for df in (first, second):
        df.write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.file_stream(spark, str(tmp_path / "in"), df.schema, "parquet")
        ingest.drain(stream, str(tmp_path / "offsets"), table=table_name)
    assert sorted(tuple(r) for r in spark.table(table_name).collect()) == [(1, None), (2, "x")]


def test_merged_parquet_and_table_stream(spark, tmp_path, table_name):
    spark.createDataFrame([(1,)], "k int").write.parquet(str(tmp_path / "p" / "a"))
    spark.createDataFrame([(2, "x")], "k int, extra string").write.parquet(str(tmp_path / "p" / "b"))
    both = files.read_parquet(spark, str(tmp_path / "p" / "*"))
    assert sorted(tuple(r) for r in both.collect()) == [(1, None), (2, "x")]
    sinks.write_table(both, table_name)
    sinks.comment_table(spark, table_name, "it's a table")
    assert spark.catalog.getTable(table_name).description == "it's a table"
    ingest.drain(ingest.table_stream(spark, table_name), str(tmp_path / "o"), path=str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 2


def test_streamed_dedupe_across_batches(spark, tmp_path):
    inbox = tmp_path / "in"
    write(inbox, "prices_1.json", [raw(1), raw(1, **{"Modal Price (Rs./Quintal)": 7}), raw(2)])
    write(inbox, "prices_2.json", [raw(2), raw(3)])
    stream = dedupe_stream(silver_stream(ingest.source_stream(spark, "prices", str(inbox), max_files=1)))
    out = str(tmp_path / "out")
    ingest.drain(stream, str(tmp_path / "offsets"), path=out)
    got = spark.read.parquet(out)
    batch = quality.dedupe(silver(files.load(spark, "prices", str(inbox), files.FILE_PATTERNS["prices"])))
    keys = list(quality.PRICE_IDENTITY)
    assert sorted(got.select(*keys).collect()) == sorted(batch.select(*keys).collect()) and got.count() == 3


def test_unique_across_batches_without_a_watermark(spark, tmp_path):
    inbox, out, offsets = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "offsets")
    write(inbox, "prices_1.json", [raw(1), raw(1, **{"Modal Price (Rs./Quintal)": 7}), raw(2)])

    def run():
        stream = silver_stream(ingest.source_stream(spark, "prices", str(inbox), max_files=1))
        drain_unique(stream, out, offsets)
        return sorted((r.batch, r.arrival_date.day, r.variety) for r in spark.read.parquet(out).collect())

    assert run() == [(0, 1, "V"), (0, 2, "V")]
    write(inbox, "prices_2.json", [raw(2), raw(2, Variety="W"), raw(1)])
    write(inbox, "prices_3.json", [raw(2, Variety="W")])
    assert run() == [(0, 1, "V"), (0, 2, "V"), (1, 2, "W")]


def test_ids_travel_as_bytes_and_come_back(spark):
    ids = ["00ff", "0", "", "AB", "ab", "abc", "zz", None, "ab" * 32, "é"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "n int, id string")
    packed = pack_ids(rows, ["id", "n"])
    assert [r.n for r in packed.filter("id is null").sort("n").collect()] == [0, 2, 4, 7, 8]
    assert packed.filter("n = 8").select(F.length("_bytes_of_id")).first()[0] == 32
    back = unpack_ids(packed, ["id", "n"])
    assert back.schema == rows.schema and [r.id for r in back.sort("n").collect()] == ids


def test_unique_rows_of_hot_and_null_keys_are_written_closely(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming_silver, "HOT_ROWS", 5)
    monkeypatch.setattr(streaming_silver, "PLACES", 2)
    found, asked = [], streaming_silver._hot
    monkeypatch.setattr(streaming_silver, "_hot", lambda *a: found.append(asked(*a)) or found[-1])
    inbox, schema = str(tmp_path / "in"), "k string, v string, id string, year int, month int"
    drops = [
        [("hot", None, f"{i:04x}", 2024, 1) for i in range(60, 0, -1)] + [(None, None, "b", 2024, 2), (None, None, "0a", 2024, 2), ("x", "y", None, 2024, 3)],
        [("hot", None, "0000", 2024, 1), (None, None, "00", 2024, 2), ("x", "y", "0", 2024, 3), ("hot", "v", "zz", 2024, 1)],
    ]
    for rows in drops:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
    stream = ingest.file_stream(spark, inbox, spark.read.parquet(inbox).schema, "parquet", max_files=1)
    drain_unique(stream, str(tmp_path / "out"), str(tmp_path / "offsets"), ["k", "v"], ["id"])
    got = spark.read.parquet(str(tmp_path / "out")).select("k", "v", "id", "year", "month", "batch")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(
        map(str, [("hot", None, "0001", 2024, 1, 0), (None, None, "0a", 2024, 2, 0), ("x", "y", None, 2024, 3, 0), ("hot", "v", "zz", 2024, 1, 1)])
    )
    assert [len(x) for x in found] == [1, 0]
    files_of = list((tmp_path / "out").rglob("*.parquet"))
    assert len(files_of) == 4 and all(f.name.endswith(".zstd.parquet") for f in files_of)


def test_shuffle_files_of_a_drained_stream_are_gone(spark, tmp_path):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    inbox, out, seen = str(tmp_path / "in"), str(tmp_path / "out"), []
    spark.range(50).selectExpr("id", "cast(id % 3 as int) AS month", "2024 AS year", "date'2024-01-01' AS day").write.parquet(inbox)
    stream = ingest.file_stream(spark, inbox, spark.read.parquet(inbox).schema, "parquet")
    start = streaming_silver.dedupe
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(streaming_silver, "dedupe", lambda df, *a: seen.append(df.sparkSession.conf.get(setting)) or start(df, *a))
        drain_unique(stream, out, str(tmp_path / "offsets"), ["id"], ["id"])
    assert seen == ["true"] and spark.conf.get(setting, "false") == "false"
    assert spark.read.parquet(out).count() == 50


def test_drops_and_gold_are_written_closely(spark, tmp_path, price_frame):
    spark.range(4).write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = silver(price_frame([{"id": x, "day": 20 * i} for i, x in enumerate(["00ff", "x1", "AB", "ab"])]))
    inbox, each = registry._dropping_box(spark, str(tmp_path), rows)
    assert each == 1 and sorted(spark.read.parquet(inbox).collect()) == sorted(rows.collect())
    stream = ingest.file_stream(spark, inbox, rows.schema, "parquet")
    stored, months = str(tmp_path / "silver"), str(tmp_path / "gold")
    ingest.drain(stream, str(tmp_path / "offsets"), path=stored, partition_by=gold.MONTH, ids=["price_id"])
    assert sorted(spark.read.parquet(stored).select(rows.columns).collect()) == sorted(rows.collect())
    follow = ingest.file_stream(spark, stored, rows.schema, "parquet")
    gold.drain_gold(spark, follow, stored, months, str(tmp_path / "offsets_of_gold"))
    assert spark.read.parquet(months).count() == 3
    for folder in (inbox, stored, months):
        assert all(f.name.endswith(".zstd.parquet") for f in Path(folder).rglob("*.parquet"))


def test_scratch_can_be_cleared(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("stallbook.session.shared_folder", lambda _: str(tmp_path))
    kept = settle(spark.range(3), "numbers").inputFiles()[0]
    assert clear_scratch(spark) and not list(tmp_path.rglob("*.parquet")) and str(tmp_path) in kept


def test_cluster_without_a_shared_folder_is_refused(monkeypatch, spark):
    if spark.conf.get("spark.checkpoint.dir", None):
        pytest.skip("the session names a shared folder")
    monkeypatch.setattr(type(spark.sparkContext), "master", property(lambda _: "spark://host:7077"))
    with pytest.raises(RuntimeError):
        scratch_path(spark, "x")


def test_merge_keeps_null_partitions_place_and_partitioning(spark, tmp_path):
    place = str(tmp_path / "kept")
    old = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", "x"), (4, "d", "it's\\")], "id int, v string, p string")
    sinks.write_table(old, "kept", partition_by=["p"], location=place)
    new = spark.createDataFrame([(2, "B", None), (3, "C", "y"), (4, "D", "y"), (5, "E", None)], "id int, v string, p string")
    sinks.write_table(new, "kept", "merge", keys=["id"])
    assert sorted((r.id, r.v, r.p) for r in spark.table("kept").collect()) == [
        (1, "a", None), (2, "B", None), (3, "C", "y"), (4, "D", "y"), (5, "E", None)]
    assert sinks.partition_columns(spark, "kept") == ["p"]
    assert {r[0] for r in spark.sql("SHOW PARTITIONS kept").collect()} == {"p=__HIVE_DEFAULT_PARTITION__", "p=y"}
    moved = spark.createDataFrame([(1, "a", "y"), (2, "B", "y"), (5, "E", "y")], "id int, v string, p string")
    sinks.write_table(moved, "kept", "merge", keys=["id"])
    assert {r[0] for r in spark.sql("SHOW PARTITIONS kept").collect()} == {"p=y"}
    with pytest.raises(ValueError):
        sinks.write_table(moved, "kept", "merge", partition_by=["v"], keys=["id"])
    location = spark.sql("DESCRIBE EXTENDED kept").where("col_name = 'Location'").first().data_type
    assert location.endswith("/kept") and str(tmp_path) in location
    spark.sql("DROP TABLE kept")


def test_literals_of_partitions():
    import datetime as dt

    got = [sinks._literal(x) for x in (None, True, 3, dt.date(2024, 1, 2), "a'b\\c")]
    assert got == ["NULL", "true", "3", "DATE '2024-01-02'", "'a\\'b\\\\c'"]


def test_a_dropped_or_added_column_is_a_change(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, v string, w string")
    gone = changes.snapshot_diff(old, old.drop("w"), ["id"]).collect()
    assert [(r.id, r.change, r.w) for r in gone] == [(1, "update", None)]
    come = changes.snapshot_diff(old.drop("w"), old, ["id"]).collect()
    assert [(r.id, r.change, r.w) for r in come] == [(1, "update", "x")]
    swapped = spark.createDataFrame([(1, None, "a")], "id int, v string, w string")
    before = spark.createDataFrame([(1, "a", None)], "id int, v string, w string")
    assert changes.snapshot_diff(before, swapped, ["id"]).count() == 1


def test_ids_tell_parts_apart(spark):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a", "b|c")], "x string, y string")
    assert chunks.with_chunk_id(rows, "x", "y").count() == 2


def test_rows_without_a_date_are_the_oldest(price_frame):
    rows = price_frame([{"day": 1}, {"day": None}, {"commodity": "undated", "day": None}, {"commodity": None, "day": 3}])
    got = [(r.commodity, r.arrival_date is None, r["rank"]) for r in recency.latest_prices(rows, 5).collect()]
    assert sorted(got, key=str) == sorted([("Rice", False, 1), ("Rice", True, 2), ("undated", True, 1), (None, False, 1)], key=str)
    assert [r.arrival_date for r in recency.latest_prices(rows.filter("commodity = 'Rice'"), 1).collect()] == [rows.first().arrival_date]


def test_repeated_labels_take_the_last_entry(spark):
    known = spark.createDataFrame([("L", "one", "p", "o"), ("L", "two", "p", "o")], "disease_class string, treatment string, prevention string, organic string").coalesce(1)
    got = treatments.with_treatments(spark.createDataFrame([("L",)], "label string"), known).collect()
    assert [r.treatment for r in got] == ["two"]


def test_a_partitioned_target_has_few_files(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(4000).selectExpr("id", "id % 2 AS month").repartition(4).write.parquet(inbox)
    stream = ingest.file_stream(spark, inbox, spark.read.parquet(inbox).schema, "parquet")
    ingest.drain(stream, str(tmp_path / "offsets"), path=out, partition_by=["month"])
    assert spark.read.parquet(out).count() == 4000
    assert len(list((tmp_path / "out").glob("month=*/*.parquet"))) == 2


def test_drops_of_an_inbox_have_more_files_for_more_rows(spark, tmp_path, monkeypatch):
    spark.range(100).write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = spark.range(100).selectExpr("id", "if(id % 2 = 0, 'F', null) AS grade")
    folder = str(tmp_path)
    assert registry._dropping_box(spark, folder, rows)[1] == 1
    monkeypatch.setattr(registry, "FILE_ROWS", 5)
    inbox, each = registry._dropping_box(spark, folder, registry._some_twice(rows, "grade = 'F'"))
    assert each == 4
    found = spark.read.parquet(inbox)
    assert len(found.inputFiles()) == 24 and found.count() == 150 and found.distinct().count() == 100


def test_buckets_follow_the_rows(spark, data, monkeypatch):
    asked = []
    write = layout.write_bucketed
    monkeypatch.setattr(layout, "write_bucketed", lambda *a, **k: asked.append(a[4]) or write(*a, **k))
    registry.QUERIES["bucketed_enriched"](spark, data)
    monkeypatch.setattr(registry, "SILVER_BYTES", 700_000)
    registry.QUERIES["bucketed_enriched"](spark, data)
    assert asked[0] == 8 and asked[1] == 16


def test_lines_of_price_files_are_packed_and_parsed_once(spark, data, monkeypatch):
    written = []
    monkeypatch.setattr(registry, "settle", lambda df, name: written.append(name) or settle(df, name))
    monkeypatch.setattr(registry, "scratch_path", lambda s, name: written.append(scratch_path(s, name)) or written[-1])
    registry.price_files_rescued(spark, data)
    assert written[1:] == ["read_lines"]
    registry.stream_ingest_by_name(spark, data)
    for path in (written[0], written[2]):
        found = {r[0] for r in spark.read.text(path).select("_metadata.file_path").distinct().collect()}
        assert any(f.endswith(".lz4") for f in found)
