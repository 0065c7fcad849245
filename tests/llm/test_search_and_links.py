import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallbook.llm import cover_tree, near_duplicates
from stallbook.llm.components import components


def plain_top(rows, queries, k):
    out = []
    for q, v in queries:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def whole(vector):
    return [int(np.floor(1024 * x)) for x in vector]


@pytest.mark.parametrize("n, dims", [(700, 6), (300, 3), (5, 2)])
def test_top_products_match_brute_force(spark, n, dims):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=dims), 1)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(60)]  # ties
    frame = spark.createDataFrame(rows, "id long, e array<double>").repartition(5).select("id", cover_tree.whole_numbers("e").alias("vector"))
    got = cover_tree.top_inner_products(frame.where("id % 20 = 0"), frame, 7).collect()
    numbers = [(i, whole(v)) for i, v in rows]
    assert sorted(map(tuple, got)) == sorted(plain_top(numbers, [x for x in numbers if x[0] % 20 == 0], 7))


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [1.0]),
            (None, [1.0, 1.0]), (7, [3.0, 3.0]), (100, [0.0, 0.0]), (8, [1e300, 1.0])]
    frame = spark.createDataFrame(rows, "id long, e array<double>").select("id", cover_tree.whole_numbers("e").alias("vector"))
    got = cover_tree.top_inner_products(frame.where("id % 100 = 0"), frame).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 7), (0, 2, 100), (100, 1, 0), (100, 2, 7)]
    assert cover_tree.top_inner_products(frame.where("id < 0"), frame).count() == 0


def test_large_vectors_are_scored_exactly(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=64) * 10.0 ** rng.integers(-1, 5)).tolist()) for i in range(300)]
    # scores that doubles don't tell apart
    big = (rng.normal(size=64) * 60_000).tolist()
    rows += [(300 + i, [*big[:-1], 20_000 + i / 1024]) for i in range(40)] + [(400, [360_000.0] * 64), (401, [-360_000.0] * 64)]
    numbers = [(i, whole(v)) for i, v in rows]
    frame = spark.createDataFrame(rows, "id long, e array<double>").repartition(3).select("id", cover_tree.whole_numbers("e").alias("vector"))
    got = cover_tree.top_inner_products(frame.where("id % 20 = 0"), frame, 7).collect()
    assert sorted(map(tuple, got)) == sorted(plain_top(numbers, [x for x in numbers if x[0] % 20 == 0], 7))


@pytest.mark.parametrize("clustered, share", [(True, 0.5), (False, 1.0)])
def test_pairs_of_clustered_vectors_are_left_out(clustered, share):
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 400, (40, 16))
    x = np.floor(middles[rng.integers(0, 40, 5000)] + rng.normal(0, 20, (5000, 16))) if clustered else np.floor(rng.normal(0, 400, (5000, 16)))
    asked = x[:300]
    best = cover_tree.Best(np.arange(300), 10, np.full(300, -(2**62), dtype=np.int64))
    queries, scored = cover_tree.CoverTree(asked), 0
    for first in range(0, 5000, 2500):
        scored += cover_tree.search(queries, cover_tree.CoverTree(x[first : first + 2500]), np.arange(first, first + 2500), best)
    assert scored <= share * 300 * 5000
    products = asked @ x.T
    for q in range(300):
        good = sorted((-products[q, j], j) for j in range(5000) if j != q)[:10]
        assert best.id[q].tolist() == [j for _, j in good]


def test_a_tree_of_far_points_is_one_leaf():
    x = np.floor(np.random.default_rng(1).normal(0, 100, (4000, 64)))
    assert len(cover_tree.CoverTree(x).centre) == 1
    tree = cover_tree.CoverTree(np.concatenate([x[:20].repeat(100, axis=0)]))
    assert len(tree.centre) > 15


def test_angles_hold():
    x = np.floor(np.random.default_rng(2).normal(0, 20, (400, 4)))
    x[7] = 0
    tree = cover_tree.CoverTree(x, leaf=4)

    def below(node):
        own = tree.children[node]
        return list(tree.points(node)) if own is None else [p for c in own for p in below(c)]

    for node in range(len(tree.centre)):
        rows, middle = x[below(node)], x[tree.centre[node]]
        lengths = np.linalg.norm(rows, axis=1)
        assert lengths.max() <= tree.longest[node] + 1e-9
        if middle.any() and lengths.all():
            cosines = rows @ middle / (lengths * np.linalg.norm(middle))
            assert np.arccos(np.clip(cosines, -1, 1)).max() <= tree.angle[node] + 1e-6


def test_repeated_queries_and_further_columns(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [3.0, 4.0]), (2, [3.0, 4.0]), (None, [9.0, 9.0]), (3, None), (4, [1.0])]
    frame = spark.createDataFrame([(*r, 5, "c") for r in rows], "id long, vector array<double>, cell int, block string")
    got = cover_tree.top_inner_products(frame.where("id = 1"), frame, 3).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2, 7), (1, 2, 2, 7)]


def test_covering_radii_hold():
    x = np.random.default_rng(1).normal(size=(500, 4))
    tree = cover_tree.CoverTree(x, leaf=4)

    def below(node):
        own = tree.children[node]
        return list(tree.points(node)) if own is None else [p for c in own for p in below(c)]

    assert sorted(below(0)) == list(range(500))
    for node in range(len(tree.centre)):
        away = np.linalg.norm(x[below(node)] - x[tree.centre[node]], axis=1)
        assert away.max() <= tree.radius[node] + 1e-5


def test_components_of_a_path(spark):
    order = list(range(400))
    random.Random(6).shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(len(order) - 1) if i != 250] + [(900, 900)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    first, second = order[:251], order[251:]
    assert got == {x: min(first) for x in first} | {x: min(second) for x in second}


def plain_classes(rows, percent=80):
    sets = [(d, frozenset(near_duplicates.shingle_set(t or "").tolist())) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        ids[find(i)].append(d)
    least = {r: min([d for d in own if d is not None], default=None) for r, own in ids.items()}
    return [(d, len(s), least[find(i)] if s else d) for i, (d, s) in enumerate(sets)]


def near(rng, words, vocabulary, share):
    return [rng.choice(vocabulary) if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def copies():
    """Groups of near copies around the threshold, sharing passages, at all sizes."""
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(2000)]
    passage = [rng.choice(vocabulary) for _ in range(55)]
    rows = []
    for group in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 8, 12, 20, 40, 90, 200, 400]))]
        if group % 3 == 0:
            base = base + passage
        for _ in range(rng.randrange(1, 7)):
            rows.append(" ".join(near(rng, base, vocabulary, rng.choice([0, 0.004, 0.01, 0.02, 0.04]))))
    rows += [None, "", " ", rows[0], rows[0].upper()]
    return [(i if i % 17 else None if i == 17 else i, t) for i, t in enumerate(rows)]


def test_classes_match_brute_force(spark, copies):
    frame = spark.createDataFrame(copies, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in near_duplicates.near_duplicates(frame).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(plain_classes(copies), key=key)


def test_hot_signatures_keep_all_links(spark, copies, monkeypatch):
    monkeypatch.setattr(near_duplicates, "HOT", 3)
    monkeypatch.setattr(near_duplicates, "SEND", 500)
    frame = spark.createDataFrame(copies, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in near_duplicates.near_duplicates(frame).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(plain_classes(copies), key=key)


def test_signatures_cover_every_allowed_difference():
    rng = np.random.default_rng(9)
    for size in (4, 5, 9, 14, 33, 70, 180, 300):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64))
            gone = rng.integers(0, size // 5 + 1)
            new = rng.integers(0, 2**63, rng.integers(0, size // 5 + 1), dtype=np.int64).astype(np.uint64)
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], new]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            shared, needed = 0, []
            for s, need, parity in near_duplicates.signatures(a):
                for t, other, same in near_duplicates.signatures(b):
                    times = len(np.intersect1d(s, t))
                    if parity == same and times:
                        shared = max(shared, times)
                        needed.append(times >= max(need, other))
            assert shared >= 1 and any(needed)


def test_one_of_each_class_stays(spark, awkward, empty, copies):
    frame = spark.createDataFrame([(d, t, "x") for d, t in copies], "doc_id long, text string, stays string")
    kept = near_duplicates.one_of_each(frame)
    assert kept.schema == frame.schema
    classes = plain_classes(copies)
    empties = sum(n == 0 for _, n, _ in classes)
    assert kept.count() == len({c for _, n, c in classes if n}) + empties
    assert kept.where(F.trim("text") != "").select("doc_id").distinct().count() == len({c for _, n, c in classes if n})
    kept = near_duplicates.one_of_each(awkward)
    assert kept.schema == awkward.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(4) == 1 and 5 not in ids and 6 not in ids and {1, 2, 3} <= set(ids)
    assert near_duplicates.near_duplicates(awkward).count() == awkward.count()
    assert near_duplicates.near_duplicates(empty).count() == 0 and near_duplicates.one_of_each(empty).count() == 0
