import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallbook.functions import texts
from stallbook.operators import chunks, intents, matching, retrieval, treatments, vectors
from stallbook.operators import text_vectors
from stallbook.operators.text_vectors import fit_text_vectors, with_text_vectors
from stallbook.plans import advice


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(
    "label,crop,disease,ingest",
    [
        ("Tomato___Late_blight", "Tomato", "Late blight", ("Tomato", "Late blight")),
        ("Pepper,_bell___Bacterial_spot", "Pepper, bell", "Bacterial spot", ("Pepper,", "Bacterial spot")),
        ("Corn_(maize)___Common_rust_", "Corn (maize)", "Common rust ", ("Corn", "Common rust ")),
        ("Grape", "Grape", "Unknown", ("Grape", "")),
    ],
)
def test_label_forms(spark, label, crop, disease, ingest):
    value = F.lit(label)
    assert one(spark, texts.label_crop(value), texts.label_disease(value)) == (crop, disease)
    assert one(spark, texts.ingest_crop(value), texts.ingest_disease(value)) == ingest


def test_treatments_and_defaults(spark):
    predictions = spark.createDataFrame(
        [("Apple___healthy", 0.93456), ("Apple___Scab", 0.5), ("Apple___New", 0.1)], "label string, score double"
    )
    knowledge = spark.createDataFrame(
        [("Apple___Scab", "old", "p", "o", 1), ("Apple___Scab", "new", "p", None, 2), ("", "x", "x", "x", 3)],
        "disease_class string, treatment string, prevention string, organic string, position int",
    )
    rows = treatments.with_confidence(
        treatments.with_treatments(predictions, knowledge, position="position")
    ).collect()
    by = {r.label: r for r in rows}
    assert by["Apple___Scab"].treatment == "new" and by["Apple___Scab"].organic == "Use neem-based sprays."
    assert by["Apple___New"].treatment == "Consult a local agriculture expert."
    assert by["Apple___healthy"].is_healthy and by["Apple___healthy"].status == "Healthy"
    assert by["Apple___healthy"].confidence == "93.5%" and len(rows) == 3


def test_top_predictions(spark):
    scores = spark.createDataFrame(
        [("i", f"l{n}", s) for n, s in enumerate([0.1, 0.50004, 0.5, 0.5, 0.2, 0.05, 0.3])],
        "image_id string, label string, score double",
    )
    top = treatments.top_predictions(scores).orderBy("rank").collect()
    assert [r.label for r in top] == ["l1", "l2", "l3", "l6", "l4"] and top[0].score == 0.5


def classify(spark, *questions, **options):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(questions)], "id int, text string")
    return [(r.intent, r.confidence) for r in intents.classify(df, **options).orderBy("id").collect()]


def test_intents(spark):
    assert classify(
        spark, "", "   \n", None, "hello", "Leaf BLIGHT on tomato", "price of urea spray", "scheme price", "protect"
    ) == [
        ("general", 0.0), ("general", 0.0), ("general", 0.0), ("general", 0.3), ("disease", 1.0),
        ("pesticide", 0.67), ("price", 0.5), ("disease", 1.0),
    ]
    assert classify(spark, "protect", "root rot!", whole_word=True) == [("general", 0.3), ("disease", 1.0)]
    assert classify(spark, "मंडी में गेहूं का भाव")[0][0] == "price"


def test_names_follow_the_list_order(spark):
    df = spark.createDataFrame([("rice and WHEAT",), ("nothing",), ("paddy apple",)], "text string")
    got = [(r.commodity, r.crop) for r in intents.extract_names(df).collect()]
    assert got == [("Wheat", "Rice"), (None, "General"), ("Paddy", "Apple")]


SCHEME = (
    "scheme_id string, name string, name_en string, category string, description string, "
    "eligibility array<string>, benefits string, how_to_apply string, documents_required array<string>, "
    "official_url string, helpline string, coverage string"
)


@pytest.fixture(scope="module")
def schemes(spark):
    return spark.createDataFrame(
        [
            ("s1", "PMX", "Income support", "cash", "pays farmers", ["a", "b"], "money", "online", ["id", None, "deed"],
             "u", "1", "all"),
            ("s2", "KCX", None, "loan", None, [], "x" * 120, None, None, None, None, None),
            (None, "none", None, None, None, None, None, None, None, None, None, None),
        ],
        SCHEME,
    )


def test_scheme_chunks(schemes):
    rows = {(r.scheme_id, r.chunk_type): r.text for r in chunks.scheme_chunks(schemes).collect()}
    assert len(rows) == 4
    assert rows["s1", "overview"] == (
        "Scheme: Income support\nCategory: cash\nDescription: pays farmers\nBenefits: money\nCoverage: all"
    )
    assert "Eligibility: a; b\n" in rows["s1", "application"]
    assert "Documents Required: id, deed\n" in rows["s1", "application"]
    assert rows["s2", "application"] == (
        "Scheme: KCX\nEligibility: \nHow to Apply: \nDocuments Required: \nHelpline: \nOfficial URL: "
    )
    bracketed = chunks.scheme_chunks(schemes, "bracketed").filter("scheme_id = 's1'").collect()
    assert any("Eligibility: [a, b]\n" in r.text for r in bracketed)


def test_scheme_list_and_detail(schemes):
    rows = {r.scheme_id: r for r in chunks.scheme_list(schemes).collect()}
    assert rows["s1"].benefits_summary == "money..." and rows["s2"].benefits_summary == "x" * 100 + "..."
    assert rows["s2"].name == "KCX" and rows["s1"].short_name == "PMX"
    assert chunks.scheme_detail(schemes, "s2").count() == 1


def brute_keywords(queries, documents, k):
    out = {}
    for qid, query in queries:
        scored = []
        for cid, text in documents:
            lowered = text.lower()
            score = sum(1 for word in query.lower().split() if word in lowered)
            if score:
                scored.append((-score, cid))
        out[qid] = [(cid, -s) for s, cid in sorted(scored)[:k]]
    return out


def keyword_rows(spark, queries, documents, k, **options):
    q = spark.createDataFrame(queries, "query_id int, text string")
    c = spark.createDataFrame(documents, "chunk_id int, text string")
    got = {qid: [] for qid, _ in queries}
    for r in matching.keyword_top_k(q, c, k, **options).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.chunk_id, r.score))
    return got


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_keyword_search_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    syllables = ["a", "th", "the", "rot", "pro", "tect", "é", "ab", "x", "ing", "(", "."]

    def text(n):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))

    documents = [(i, text(rng.choice([0, 1, 3, 30]))) for i in range(60)]
    documents += [(100 + i, documents[5][1]) for i in range(20)]  # copies tie
    queries = [(i, text(rng.randint(1, 8))) for i in range(12)]
    queries += [(50, ""), (51, "   "), (52, "a"), (53, "a a a th"), (54, "zzz"), (55, "THE rot\tthe"), (56, queries[0][1])]
    assert keyword_rows(spark, queries, documents, 5) == brute_keywords(queries, documents, 5)


def test_whole_words_are_matched_as_tokens(spark):
    got = keyword_rows(spark, [(1, "rot in")], [(1, "protect"), (2, "root rot in it")], 5, whole_word=True)
    assert got == {1: [(2, 2)]}


def frame(spark, name, matrix, ids=None):
    ids = range(len(matrix)) if ids is None else ids
    return spark.createDataFrame(
        [(int(i), [float(x) for x in v]) for i, v in zip(ids, matrix)], f"{name} int, embedding array<float>"
    )


def brute_vectors(queries, stored, k):
    def unit(m):
        m = m.astype(np.float32).astype(np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    scores = [(unit(stored) * q).sum(axis=1) for q in unit(queries)]
    return [[int(i) for i in np.lexsort((np.arange(len(stored)), -row))[:k]] for row in scores]


def test_nearer_vectors_come_first_however_close(spark):
    stored = frame(spark, "vector_id", np.array([[1, 0.0010], [1, 0.0009]]), ids=[1, 2])
    top = vectors.cosine_top_k(frame(spark, "query_id", np.array([[1.0, 0.0]])), stored, 1).first()
    assert (top.vector_id, top.score) == (2, 1.0)


def test_broken_vectors_take_no_part(spark):
    rows = [(1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [0.0, 1.0])]
    stored = spark.createDataFrame(rows, "vector_id int, embedding array<float>")
    got = vectors.cosine_top_k(frame(spark, "query_id", np.eye(2)[:1]), stored, 4).collect()
    assert [(r.vector_id, r.score) for r in got] == [(4, 0.0)]


@pytest.mark.parametrize("bound", [1 << 20, 200, 1])
def test_vector_search_equals_brute_force(spark, bound):
    rng = np.random.default_rng(7)
    stored = rng.normal(size=(300, 8))
    stored[10:40] = stored[9]  # copies tie
    stored[50] = 0
    asked = np.vstack([rng.normal(size=(5, 8)), stored[9], np.zeros(8)])
    got = vectors.cosine_top_k(
        frame(spark, "query_id", asked), frame(spark, "vector_id", stored).repartition(5), 4, block_bytes=bound
    )
    rows = {}
    for r in got.orderBy("query_id", "rank").collect():
        rows.setdefault(r.query_id, []).append(r.vector_id)
    assert [rows[i] for i in range(len(asked))] == brute_vectors(asked, stored, 4)


def test_search_modes(spark):
    asked = frame(spark, "query_id", np.eye(3)[:2]).withColumn("text", F.lit("rust"))
    stored = frame(spark, "chunk_id", np.eye(3)).withColumn("text", F.lit("Rust"))
    top = {(r.query_id, r.chunk_id) for r in retrieval.search(asked, stored, k=1).collect()}
    assert top == {(0, 0), (1, 1)}  # both sides have vectors
    words = {(r.query_id, r.chunk_id) for r in retrieval.search(asked, stored.drop("embedding"), k=1).collect()}
    assert words == {(0, 0), (1, 0)}  # falls back to words
    with pytest.raises(ValueError):
        retrieval.search(asked, stored, mode="other")


def test_k_larger_than_the_table_and_no_query(spark):
    stored = frame(spark, "vector_id", np.eye(3))
    asked = frame(spark, "query_id", np.eye(3)[:1])
    assert vectors.cosine_top_k(asked, stored, 10).count() == 3
    assert vectors.cosine_top_k(asked.limit(0), stored, 10).count() == 0


def test_normalised(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(vectors.normalised("v")).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_questions_get_context_or_fixed_text(spark, schemes):
    questions = spark.createDataFrame([(1, "income support"), (2, "zzzz")], "query_id int, text string")
    rows = {r.query_id: r.answer for r in advice.ask_schemes(questions, schemes).collect()}
    assert rows[1].startswith("Based on available information:\n\nScheme: Income support\n")
    assert "\n\n---\n\n" in rows[1] and rows[2] == retrieval.NO_SCHEME
    vector = advice.ask_schemes(questions, schemes, mode="vector").collect()
    assert {r.query_id for r in vector} == {1, 2}


GUIDE = (
    "crop string, growth_stage string, category string, problem string, product_name string, dosage string, "
    "application_method string, timing string, precautions string, organic_alternative string, cost_estimate string"
)


@pytest.fixture(scope="module")
def guide(spark):
    return spark.createDataFrame(
        [
            ("Rice", "Tillering", "fertilizer", "nitrogen", "Urea", "50 kg", "spread", "day 21", "dry", "compost", "₹300"),
            ("Wheat", "Sowing", "fungicide", "rust", "Mix", "2 g", "seed", "before", "mask", None, "₹90"),
        ],
        GUIDE,
    )


def test_recommendations(spark, guide):
    requests = spark.createDataFrame(
        [(1, "Rice", "Tillering", "", False), (2, "Zzz", "Qqq", None, None), (3, "Zzz", "", None, True)],
        "query_id int, crop string, growth_stage string, problem string, prefer_organic boolean",
    )
    rows = {r.query_id: r for r in advice.recommend(requests, guide).collect()}
    assert rows[1].text == "Rice Tillering" and rows[3].text == "Zzz organic biological natural"
    assert "Dosage: 50 kg" in rows[1].answer and rows[1].answer.startswith("Based on available guidance:\n\nCrop: Rice")
    assert rows[2].answer.startswith("No specific recommendation found for Zzz at Qqq stage. Please")
    assert rows[3].answer.startswith("Based on available guidance")  # "organic" is in every chunk label


def test_equal_chunks_are_found_once(spark, guide):
    requests = spark.createDataFrame(
        [(1, "Rice", "Tillering", "", False)],
        "query_id int, crop string, growth_stage string, problem string, prefer_organic boolean",
    )
    once = advice.recommend(requests, guide).first().answer
    assert advice.recommend(requests, guide.union(guide).union(guide)).first().answer == once


def test_routing(spark, schemes, guide):
    questions = spark.createDataFrame(
        [(1, "subsidy scheme income"), (2, "urea dose for rice"), (3, "mandi rate of onion"), (4, "hi")],
        "query_id int, text string",
    )
    rows = {r.query_id: r for r in advice.route(questions, schemes, guide).collect()}
    assert [rows[i].intent for i in (1, 2, 3, 4)] == ["scheme", "pesticide", "price", "general"]
    assert rows[2].crop == "Rice" and rows[3].commodity == "Onion" and rows[4].feature == "general"
    assert rows[1].answer.startswith("Based on available information") and rows[3].answer is None
    assert rows[1].preview == rows[1].answer[:100] and rows[4].preview == ""
    log = advice.chat_log(spark.createDataFrame(list(rows.values()))).collect()
    assert all(len(r.response_summary) <= 500 for r in log) and len({r.session_id for r in log}) == 4


def test_text_vectors_follow_tf_idf(spark):
    documents = [(0, "Rice rice wheat"), (1, "wheat, rust"), (2, "rust in wheat"), (3, ""), (4, None)]
    df = spark.createDataFrame(documents, "chunk_id int, text string")
    model = fit_text_vectors(df, dimensions=4096)  # wide enough for no collisions here
    rows = {r.chunk_id: np.array(r.embedding) for r in with_text_vectors(df, model).collect()}
    assert set(rows) == {0, 1, 2, 3} and not rows[3].any()

    def weights(words):
        n = {"rice": 1, "wheat": 3, "rust": 2, "in": 1}
        w = {t: words.count(t) * np.log((4 + 1) / (n[t] + 1)) for t in set(words)}
        norm = np.sqrt(sum(x * x for x in w.values()))
        return sorted(round(x / norm, 4) for x in w.values())

    for i, words in ((0, ["rice", "rice", "wheat"]), (1, ["wheat", "rust"]), (2, ["rust", "in", "wheat"])):
        assert sorted(round(float(x), 4) for x in rows[i] if x) == weights(words)


def test_terms_are_counted_by_partitions_of_keys(spark, monkeypatch):
    """One file of many texts is one task's input; its terms must not be one task's table."""
    plans = []

    def look(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return df

    monkeypatch.setattr(text_vectors, "settle", look)
    texts_ = spark.createDataFrame([(1, "a b"), (1, "a"), (None, "b b"), (2, None)], "chunk_id long, text string")
    got = {(r.chunk_id, r.weight) for r in text_vectors.term_weights(texts_).collect()}
    assert {k for k, _ in got} <= {1, None}
    counted = dict(plans)["term_counts"]
    assert counted.count("Exchange") == 1 and counted.index("HashAggregate") < counted.index("Exchange") < counted.index("Scan")
