import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from stallbook.llm import html_text, pseudo_likelihood
from stallbook.llm.html_text import main_text

ROOT = Path(__file__).resolve().parents[2]

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><a href="/">Site</a></header><nav><ul><li><a>x</a></li></ul></nav>
<div id="cookie-notice">We use cookies, a lot of them, and say so in many words.</div>
<div class="page"><main><article><h1>Title &amp; more</h1><p>First   para<br>with <b>bold.</p>
<p>Second &lt;b&gt; &copy;<div class="ad">buy now</div><ul><li>one<li>two</ul>
<form><label>Mail</label></form><p>End.</article>
<section id="comments"><article class="comment"><p>A reader's long comment, the longest text on this page by far, of no use.</p></article></section>
</main><aside>side</aside></div><footer>&copy; foot</footer></body></html>"""


def test_article_without_its_surroundings():
    assert main_text(PAGE).split("\n\n") == ["Title & more", "First para with bold.", "Second <b> ©", "one", "two", "End."]


def test_pages_without_article_elements():
    page = "<div><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul></div><div><p>A long paragraph of text that goes on for some time.<p>Another.<p>No</div>"
    assert main_text(page) == "A long paragraph of text that goes on for some time.\n\nAnother.\n\nNo"


LONG = "A long paragraph of text that goes on for some time. " * 20


def test_short_parts_beside_a_long_one_stay():
    parts = [LONG.strip(), "A short part.", "Another short one.", "The end of it."]
    for around in ("<section><p>{}</p></section>", "<div>{}</div>", "<article><p>{}</p></article>"):
        page = '<div><ul><li><a href="/">x</a><li><a href="/y">y</a><li><a href="/z">z</a></ul></div><div>%s</div>'
        assert main_text(page % "".join(around.format(x) for x in parts)).split("\n\n") == parts, around


def test_lists_of_links_in_the_text_stay():
    links = "".join(f'<li><a href="/{i}">Source {i}</a></li>' for i in range(4))
    names = [f"Source {i}" for i in range(4)]
    assert main_text(f"<article><p>{LONG}</p><ul>{links}</ul></article>").split("\n\n")[1:] == names
    page = f"<div><ul>{links}</ul></div><div><p>{LONG}</p><section><h2>Sources</h2><ul>{links}</ul></section><p>{LONG}</p></div>"
    assert main_text(page).split("\n\n") == [LONG.strip(), "Sources", *names, LONG.strip()]
    # a name that is never closed is no link
    assert main_text('<div><a id="top"><p>One line.</p><p>Two lines.</p><p>Three lines.</p></div>') == "One line.\n\nTwo lines.\n\nThree lines."


@pytest.mark.parametrize(
    "html", [
        '<div class="post has-comments"><article><p>{}</p></article></div>', '<article class="comments-open"><p>{}</p></article>',
        "<form action=x><div><article><p>{}</p></article></div></form>", "<form action=x><div><p>{}</p></div></form><div>Mail</div>",
        '<div class="comments"><article><p>{}</p></article></div>', '<div class="no-sidebar"><p>{}</p></div>',
        '<article><section id="related-work"><p>{}</p></section></article>', '<article><h2 id="search">{}</h2></article>']
)
def test_names_and_forms_do_not_hide_the_text(html):
    assert main_text(html.format("The text of the page, which is of some length.")).startswith("The text of the page, which is of some length.")


def test_forms_and_named_parts_beside_the_text_go():
    parts = '<form><label>Mail</label></form><div class="comments-area"><article class="comment">No.</article></div><div id="related-links">Else</div>'
    assert main_text(f"<article><p>Text.</p>{parts}</article>") == "Text."
    assert main_text(f"<div><p>{LONG}</p>{parts}</div>") == LONG.strip()
    assert main_text('<article>Text.</article><div id="comments"><article>A plain element with a comment.</article></div>') == "Text."


@pytest.mark.parametrize(
    "html, text", [("", ""), ("just text", "just text"), ("<p>", ""), ("a &lt; b", "a < b"), ("<p>x<script>if(a<b){'</p>'}", "x"),
                   ("<article><p>cut off <b>he", "cut off he"), ("</div></p><p>y</b>", "y"), ("<!-- <p>no</p> --><p>yes", "yes")]
)
def test_broken_pages(html, text):
    assert main_text(html) == text


def test_deep_and_long_pages():
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert len(main_text("<article>" + "<p>some words here</p>" * 20_000 + "</article>")) == 20_000 * 15 + 19_999 * 2


def test_gaussian_keeps_a_constant():
    assert np.allclose(html_text.smoothed(np.full(9, 4.0)), 4.0)
    assert len(html_text.smoothed(np.array([1.0]))) == 1


def test_pages_on_the_tables(spark, data):
    import html as h
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = html_text.op8_html_main_text(spark, data).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S).group(1)
        parts = [" ".join(h.unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


def test_awkward_pages(spark):
    rows = [(1, None, None, 1), (None, "u", PAGE, 2), (2, "u", "", 3), (2, "u", "", 3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    got = html_text.extract(frame).collect()
    assert sorted(r["n_chars"] for r in got)[:3] == [0, 0, 0] and len(got) == 4
    assert html_text.extract(frame.limit(0)).count() == 0


PARAGRAPH = "A sentence of some length that runs on for a while, as sentences of an article do, word after word. "


def page_of(*parts):
    return "<html><body><div>" + "".join(parts) + "</div></body></html>"


def test_smoothing_decides_about_links_in_the_same_box(monkeypatch):
    text, link, menu = f"<p>{PARAGRAPH * 3}</p>", "<p><a href=x>One single source</a></p>", [f"<p><a href=m{i}>Entry {i}</a></p>" for i in range(14)]
    page = page_of(text, text, link, text, text, "".join(menu), text)
    plain = [PARAGRAPH.strip() + " " + (PARAGRAPH * 2).strip()] * 2
    expected = "\n\n".join([*plain, "One single source", *plain, plain[0]])
    got = html_text.main_text(page)
    assert got == expected
    monkeypatch.setattr(html_text, "smoothed", lambda ratios, *more: ratios)
    assert "One single source" not in html_text.main_text(page)


def test_the_region_follows_the_content_not_the_name():
    content = f"<p>{PARAGRAPH * 4}</p>" * 4
    teaser = "<article><p>Read on</p></article>"
    got = html_text.main_text(f"<body><div id=page>{teaser}<div>{content}</div></div></body>")
    assert got.count("A sentence") == 16
    got = html_text.main_text(f"<body><div>{'<p>Short.</p>' * 3}</div><article>{content}<p>Yes.</p></article></body>")
    assert got.count("A sentence") == 16 and got.endswith("Yes.") and "Short" not in got


def test_headings_and_names_inside_an_article():
    body = f"<p>{PARAGRAPH * 3}</p>" * 3
    page = f'<header><h1>Site</h1></header><article><header><h1>Headline</h1></header>{body}<p class="share">Share price rose.</p></article>'
    got = html_text.main_text(page)
    assert got.startswith("Headline\n\n") and got.endswith("Share price rose.") and "Site" not in got


@pytest.mark.parametrize("part", ["<div>", "<div><p>x ", "<b>", "<ul><li>z", "<table><tr><td>y", "</i><b>"])
def test_time_follows_the_length_of_deep_pages(part):
    import time

    def seconds(n):
        started = time.process_time()
        html_text.main_text(part * n + "text" + "</i>" * n)
        return time.process_time() - started

    small = min(seconds(4000) for _ in range(2))
    assert seconds(32_000) < 8 * 3 * small + 0.2


def plain_score(text, tree, net):
    ids = [int(i) for i in tree.rank[pseudo_likelihood.slots_of(text)]]
    total = 0.0
    for i, word in enumerate(ids):
        near = [ids[i + o] if 0 <= i + o < len(ids) else None for o in pseudo_likelihood.OFFSETS]
        rows = [0 if n is None else int(pseudo_likelihood.input_rows(np.array([n]))[0]) for n in near]
        state = np.tanh(sum(net.inputs[o][r].astype(float) for o, r in enumerate(rows)) + net.hidden)
        node, branch = int(tree.parent[word]), int(tree.branch[word])
        while True:
            kind = tree.class_edges(np.array([node]))[0][0]
            logits = net.branches[kind].astype(float) @ state + net.bias[kind] + tree.shares[node]
            total += logits[branch] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
            if not node:
                break
            node, branch = int(tree.node_parent[node]), int(tree.node_branch[node])
    return total


def test_scores_match_plain_python(awkward, empty):
    short = awkward.where("doc_id is null or doc_id not in (7, 8)")
    tree = pseudo_likelihood.Tree(pseudo_likelihood.word_counts(short))
    net = pseudo_likelihood.Network(tree, seed=3)
    net.bias[:] = np.random.default_rng(1).normal(0, 0.3, net.bias.shape)
    rows = pseudo_likelihood.score_encoded(pseudo_likelihood.encode(short, tree), net, "doc_id").collect()
    expected = sorted(plain_score(r["text"] or "", tree, net) for r in short.collect())
    assert np.allclose(sorted(r["log_prob"] for r in rows), expected, rtol=1e-4, atol=1e-3)
    assert all((r["mean_log_prob"] is None) == (r["n_words"] == 0) for r in rows)
    rows = pseudo_likelihood.score(awkward).collect()
    assert len(rows) == awkward.count() and max(r["n_words"] for r in rows) == 60_000
    assert pseudo_likelihood.score(empty).count() == 0


def random_tree(n, seed=4):
    rng = np.random.default_rng(seed)
    counts = np.zeros(n + 50, dtype=np.int64)
    counts[rng.permutation(n + 50)[:n]] = np.maximum(1, 1_000_000 // np.arange(1, n + 1) ** 2)
    return pseudo_likelihood.Tree(counts), counts


@pytest.mark.parametrize("n", [1, 2, 16, 17, 18, 300, 5000])
def test_every_counted_word_has_a_way_of_its_own(n):
    tree, counts = random_tree(n)
    words = tree.rank[counts > 0]
    assert sorted(words) == list(range(n))
    ways = {}
    for place, node, branch in tree.steps(words):
        for p, a, b in zip(place.tolist(), node.tolist(), branch.tolist()):
            ways.setdefault(p, []).append((a, b))
    assert len({tuple(w) for w in ways.values()}) == n and all(w[-1][0] == 0 for w in ways.values())
    # branches' shares of the counts make up each word's share of all
    total = [sum(float(tree.shares[a, b]) for a, b in ways[p]) for p in range(n)]
    assert np.allclose(np.exp(total), counts[counts > 0] / counts.sum(), rtol=1e-4)
    frequent = np.argmax(counts[counts > 0])
    assert len(ways[int(frequent)]) == 1


def test_probabilities_of_all_words_add_up():
    tree, _ = random_tree(400)
    net = pseudo_likelihood.Network(tree, np.random.default_rng(8).normal(0, 0.3, pseudo_likelihood.SIZE))
    line = np.array([[5, 0, 1999, 7]])
    found = net.log_probabilities(np.repeat(line, 400, axis=0), np.arange(400))
    assert np.exp(found).sum() == pytest.approx(1, abs=1e-4)


def test_gradient_by_differences():
    rng = np.random.default_rng(4)
    tree, _ = random_tree(3000)
    lines, words = rng.integers(0, pseudo_likelihood.INPUT_ROWS, (40, 4)), rng.integers(0, 3000, 40)
    times = rng.integers(1, 5, 40)
    net = pseudo_likelihood.Network(tree, seed=5)
    slope = net.gradient(lines, words, times).flat
    for at in [*np.flatnonzero(slope)[:: max(1, np.count_nonzero(slope) // 25)]]:
        values = []
        for step in (0.01, -0.01):
            moved = net.flat.astype(np.float64).copy()
            moved[at] += step
            values.append(np.average(pseudo_likelihood.Network(tree, moved).log_probabilities(lines, words), weights=times))
        assert slope[at] == pytest.approx((values[0] - values[1]) / 0.02, abs=3e-4)


def test_training_helps_and_repeats_under_another_layout(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    counts = pseudo_likelihood.word_counts(documents)
    tree, words = pseudo_likelihood.Tree(counts), int(counts.sum())
    start = pseudo_likelihood.Network(tree)
    nets, stored = [], None
    for layout in (documents, documents.repartition(7).orderBy("text")):
        stored = pseudo_likelihood.stored_texts(pseudo_likelihood.encode(layout, tree), words)
        nets.append(pseudo_likelihood.train_round(stored, start, 0))
    assert np.array_equal(nets[0].flat, nets[1].flat)
    assert stored.agg({"times": "sum"}).first()[0] == documents.count() > stored.count()
    before, after = (
        pseudo_likelihood.score_encoded(stored, n, "k0").agg({"log_prob": "sum"}).first()[0] for n in (start, nets[0])
    )
    assert after > before


def test_a_word_is_told_from_both_sides(spark):
    rng = np.random.default_rng(6)
    lines = []
    for _ in range(1500):
        a, b = rng.integers(0, 3, 2)
        lines.append(f"left{a} middle{a}{b} right{b}")
    frame = spark.createDataFrame([(i, " ".join(rng.permutation(lines))) for i in range(12)], "doc_id long, text string")
    good, bad = "left1 middle12 right2 " * 40, "left1 middle20 right2 " * 40
    asked = spark.createDataFrame([(100, good), (101, bad)], "doc_id long, text string")
    found = {r["doc_id"]: r["mean_log_prob"] for r in pseudo_likelihood.score(frame.union(asked), rounds=2).collect()}
    assert found[100] > found[101]


def test_every_word_is_predicted_in_some_round():
    ids = np.random.default_rng(2).integers(1, 1000, 5000).astype(np.uint16)
    for rounds in (1, 2, 7, pseudo_likelihood.MOST_ROUNDS):
        turns = [pseudo_likelihood.masked(ids, turn, rounds, 5) for turn in range(rounds)]
        assert np.array_equal(np.sort(np.concatenate(turns)), np.arange(5000))
        assert max(map(len, turns)) < 1.2 * 5000 / rounds
    halves = [pseudo_likelihood.masked(ids, 0, 2, key) for key in (5, 6, -7, None)]
    assert len({tuple(h) for h in halves}) == 4
    # a document in pieces is one document
    pieces = [pseudo_likelihood.masked(ids[a : a + 700], 0, 2, 5, a) + a for a in range(0, 5000, 700)]
    assert np.array_equal(np.concatenate(pieces), halves[0])


def test_rounds_follow_the_corpus():
    words = pseudo_likelihood.COPIES * pseudo_likelihood.COPY_WORDS
    assert pseudo_likelihood.rounds_for(words) == 2 and pseudo_likelihood.rounds_for(5 * words) == 5
    assert pseudo_likelihood.rounds_for(1000 * words) == pseudo_likelihood.MOST_ROUNDS


def test_neighbours_across_chunks():
    ids = np.arange(1, 30).astype(np.uint16)
    whole = pseudo_likelihood.neighbours(ids, 0, 29)
    parts = np.concatenate([pseudo_likelihood.neighbours(ids, a, min(a + 4, 29)) for a in range(0, 29, 4)])
    assert np.array_equal(whole, parts) and whole[0].tolist() == [0, 0, 2, 3] and whole[-1].tolist() == [27, 28, 0, 0]


def test_pipeline_matches_its_operators(spark, data):
    import corpus_pipeline
    from stallbook.session import settle

    documents = spark.read.parquet(f"{data}/documents.parquet")
    docs, counts = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, data), name)
        assert docs.columns == documents.columns
        counts[name] = docs.count()
    assert counts["language"] > 0.95 * documents.count()
    assert 0 < counts["near_duplicates"] <= counts["quality"] < counts["language"]
    rows = corpus_pipeline.run(spark, data).collect()
    copies = {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    held = {}
    for r in rows:
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + r["length"]
    tokens = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert held == {d: n * tokens[d] for d, n in copies.items()}


def test_pipeline_stages_on_awkward_and_empty_rows(spark, data, awkward, empty):
    import corpus_pipeline

    rng = random.Random(1)
    assert rng
    for frame in (awkward, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, data)
            out.count()
            if name != "packing":
                assert out.schema.fieldNames() == frame.schema.fieldNames(), name


def test_entry_works_without_this_subpackage(tmp_path):
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == "corpus_pipeline" or name.startswith("stallbook.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not [q for q in e.queries() if q.startswith("op") and q[2].isdigit()] and "pipeline" not in e.queries()
assert e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
