import zlib

import pytest
from pyspark.sql import functions as F

from stallbook.llm import mixing, sharding
from stallbook.session import settle


def test_shards_of_awkward_rows(awkward, empty):
    rows = sharding.shard_documents(awkward, 4).collect()
    texts = sorted((r["text"] or "").encode() for r in awkward.collect())
    assert sorted(r["size"] for r in rows) == sorted(len(t) + 1 for t in texts)
    assert sorted(r["text_crc32"] for r in rows) == sorted(map(zlib.crc32, texts))
    for s in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(empty).count() == 0


def test_bytes_are_even_with_a_hot_key(spark):
    rows = spark.range(30_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), F.col("id") % 9000)).alias("text"),
    )
    shards = sharding.shard_documents(rows)
    sums = shards.groupBy("shard").agg(F.sum("size").alias("b"), F.max("size").alias("m"), F.max("slot").alias("s"), F.count("*").alias("n")).collect()
    assert len(sums) == 16
    assert max(r["b"] for r in sums) - min(r["b"] for r in sums) <= 2 * max(r["m"] for r in sums)
    assert all(r["s"] + 1 == r["n"] for r in sums)
    small = shards.where("size < 9").groupBy("text_crc32").agg(F.countDistinct("shard").alias("n"))
    assert small.where("n > 1").count() <= 15


def test_ranges_are_bounded_and_found_by_halving(spark):
    sized = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 7 + 1).alias("size"), F.when(F.col("id") < 2000, 77).otherwise(F.col("id")).cast("long").alias("key"), F.col("id").alias("spread"))
    sized = settle(sized, "sized")
    bounds = sharding.splitters(sized, sized.agg(F.sum("size")).first()[0], ranges=20)
    assert 77 in bounds and 78 in bounds and len(bounds) <= 39
    got = sized.select("key", sharding.range_of("key", bounds).alias("r")).distinct().collect()
    assert all(r["r"] == sum(b <= r["key"] for b in bounds) for r in got)
    assert {r["r"] for r in sized.select(sharding.range_of("key", []).alias("r")).collect()} == {0}


def plain_targets(sizes, weights=(1.0, 2.0, 3.0)):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
        free -= over
    return target


@pytest.mark.parametrize(
    "sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 2, "d": 5, None: 40}, {"a": 0, "b": 0}, {"a": 7}, {None: 3, "z": 0}]
)
def test_targets_are_shared_again(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mixture_comes_near_its_targets(spark, data, awkward, empty):
    rows = mixing.op4_source_mixing(spark, data).collect()
    again = mixing.op4_source_mixing(spark, data).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    documents = spark.read.parquet(f"{data}/documents.parquet")
    source = {r["doc_id"]: r["source"] for r in documents.collect()}
    by = {}
    for r in rows:
        by.setdefault(source[r["doc_id"]], []).append(r)
        assert r["size"] == 0 or r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"]
    for own in by.values():
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    rows = mixing.mixture(awkward).collect()
    assert len(rows) == awkward.count()
    mixed = mixing.mixed_documents(awkward)
    assert mixed.schema == awkward.schema
    taken = mixed.select(mixing.word_count(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]
    assert taken == sum(r["taken"] for r in rows)
    assert mixing.mixture(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_words_are_counted_whole(spark):
    texts = ["", " ", "a", " a\tb\x0bc\x0c\r\n d ", "a\x1cb", "x y z", None, "é" * 3]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    got = [r[0] for r in frame.select(mixing.word_count(F.col("text"))).collect()]
    assert got == [0, 0, 1, 4, 1, 2, 0, 1]


def test_rows_without_ids_are_drawn_apart(spark):
    rows = [(None, "a b c d", "a")] * 200 + [(7, "x y z", "b")] * 100 + [(i, "one two", "c") for i in range(100)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, _place int, _text int")
    taken = [mixing.mixture(frame.repartition(n)).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect() for n in (2, 7)]
    assert sorted(map(tuple, taken[0])) == sorted(map(tuple, taken[1]))
    for r in taken[0]:
        assert abs(r["t"] - r["target"]) <= 4
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns
    assert mixed.count() == sum(r["t"] / {800: 4, 300: 3, 200: 2}[r["source_size"]] for r in taken[0])


def test_copies_without_ids_are_spread_over_parts(spark):
    rows = [(None, "the same text " * 20) for _ in range(3000)] + [(i, f"text {i}") for i in range(300)]
    placed = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    by_shard = {}
    for r in placed:
        by_shard.setdefault(r["shard"], []).append(r)
    assert len(by_shard) == 8 and all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in by_shard.values())
    sums = [sum(r["size"] for r in own) for own in by_shard.values()]
    assert max(sums) - min(sums) < 2 * 281
