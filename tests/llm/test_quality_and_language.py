import random
import re
from collections import Counter

import numpy as np
import pytest

from stallbook.llm import language, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(text):
    words = WORD.findall(text)
    seen = Counter(zip(words, words[1:], words[2:]))
    held = [False] * len(words)
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            held[i : i + 3] = [True] * 3
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(held))


def test_statistics_match_plain_python(awkward):
    rng = random.Random(3)
    texts = [r["text"] or "" for r in awkward.collect()]
    texts += ["".join(rng.choice(["a", "b", "é", " ", "\n", "\x0b", "\x1c", "#", "|", "ÀÉ"]) for _ in range(rng.randrange(60))) for _ in range(400)]
    for text in texts:
        assert quality.statistics(text)[0] == plain_statistics(text), text[:80]


def test_trees_learn_and_keep_their_directions():
    rng = np.random.default_rng(5)
    x = rng.random((4000, len(quality.FEATURES)))
    names = list(quality.FEATURES)
    down = names.index("symbols_per_word")
    # the data pull the constrained feature upwards; the constraint must win
    y = ((x[:, 0] > 0.5) ^ (rng.random(4000) < 0.05)).astype(float)
    y = np.where(rng.random(4000) < 0.3 * x[:, down], 1.0, y)
    trees = quality.grow(x[:3000], y[:3000])
    held = ((trees.probability(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean()
    assert held > 0.85
    line = np.repeat(x[:50], 40, axis=0)
    line[:, down] = np.tile(np.linspace(0, 1, 40), 50)
    steps = np.diff(trees.margin(line).reshape(50, 40), axis=1)
    assert (steps <= 1e-9).all()
    one = [walk(trees, row) for row in x[:100]]
    assert np.allclose(one, trees.margin(x[:100]))


def walk(trees, row):
    total = trees.start
    for t in range(len(trees.feature)):
        node = 0
        while trees.feature[t, node] >= 0:
            node = 2 * node + (1 if row[trees.feature[t, node]] <= trees.threshold[t, node] else 2)
        total += trees.value[t, node]
    return total


def test_one_class_gives_a_constant():
    trees = quality.grow(np.random.default_rng(1).random((100, len(quality.FEATURES))), np.ones(100))
    assert len(trees.feature) == 0 and trees.probability(np.zeros((2, len(quality.FEATURES)))).min() > 0.9


def test_quality_on_the_tables(spark, data):
    rows = {r["doc_id"]: r for r in quality.op2_boosted_quality(spark, data).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    judged = [rows[d] for d in labels if d in rows and not rows[d]["base_failed"]]
    right = [r["kept"] == (labels[r["doc_id"]] == 1) for r in judged]
    assert sum(right) >= 0.95 * len(right)


def test_quality_of_awkward_rows(spark, awkward, empty, data):
    none = spark.createDataFrame([(None, None), (4, None), (None, 1), (4, 7)], "doc_id long, quality int")
    trees = quality.learn(awkward, none)
    rows = quality.assess(awkward, trees).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"])
    kept = quality.good_documents(awkward, trees)
    assert kept.schema == awkward.schema
    assert kept.count() == sum(r["kept"] for r in rows)
    assert quality.assess(empty, trees).count() == 0 and quality.good_documents(empty, trees).count() == 0


def test_language_by_brute_force(spark):
    texts = ["The cat, the hat", "der Hund und die Katze", "", "12 ;;", "le chat et l'été", "a" * 50]
    model = language.Model(["x", "y"], np.random.default_rng(2).normal(size=(language.BUCKETS, 2)).astype(np.float32), np.zeros(2))
    model.matrix[0] = 0
    sums, n_letters = language.totals(texts, model.matrix)
    for text, got, n in zip(texts, sums, n_letters):
        codes = [ord(c) if c.isalpha() else 0 for c in text.lower()]
        padded = [0, 0, *codes, 0]
        expected = np.zeros(2)
        for i in range(2, len(padded)):
            triple, pair = language.grams(np.array(padded[i - 2 : i + 1], dtype=np.uint32))
            expected += model.matrix[triple[0]] + model.matrix[pair[0]]
        assert np.allclose(got, expected, atol=1e-3)
        assert n == sum(c > 0 for c in codes)
    long = "der Hund und die Katze " * 100_000
    assert np.allclose(language.totals([long, long], model.matrix)[0][0], language.totals([long], model.matrix)[0][0])


def test_language_held_out_accuracy(spark, data):
    found = language.op9_language_id(spark, data)
    truth = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 20 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


def test_language_of_awkward_rows(awkward, empty):
    model = language.fit(language.labelled_rows(awkward))
    rows = language.identify(awkward, model).collect()
    assert len(rows) == awkward.count()
    assert all((r["lang_pred"] == "und") == (r["score"] == 0.0) and 0 <= r["score"] <= 1 for r in rows)
    by_id = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert {by_id[i] for i in (1, 2, 3, 10)} == {"und"} and by_id[9] != "und"
    kept = language.in_known_language(awkward, model)
    assert kept.schema == awkward.schema and kept.where("doc_id in (1, 2, 3, 10)").count() == 0
    assert language.identify(empty, model).count() == 0
    nothing = language.fit(language.labelled_rows(empty))
    assert {r["lang_pred"] for r in language.identify(awkward, nothing).collect()} == {"und"}
    assert language.in_known_language(awkward, nothing).count() == 0


@pytest.mark.parametrize("doc", [0, 1, 17, 123456, -5])
def test_held_out_rule(spark, doc):
    import zlib

    row = spark.createDataFrame([(doc,)], "doc_id long").select(language.held_out().alias("h")).first()
    assert row["h"] == (zlib.crc32(str(doc).encode()) % 4 == 2)
