"""Hard negatives, source divergence and chat formatting against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from stallbook.llm import chat, divergence, hard_negatives
from stallbook.llm.hard_negatives import Block, Summary, haar, summaries, turn_for

VECTORS = "id long, label long, vector array<double>, score int, window int, cell string"


def brute_negatives(anchors, rows, positives=5, negatives=10):
    anchors_by_id = {}
    for id_, label, vector in anchors:
        if None not in (id_, label, vector):
            anchors_by_id[id_] = min(anchors_by_id.get(id_, (label, vector)), (label, vector))
    out = []
    for a, (label, vector) in anchors_by_id.items():
        own = [
            (-sum(int(x) * int(y) for x, y in zip(vector, v)), i, lab)
            for i, lab, v in rows
            if None not in (i, lab, v) and i != a and len(v) == len(vector)
        ]
        good = sorted((s, i) for s, i, lab in own if lab == label)[:positives]
        bad = sorted((s, i) for s, i, lab in own if lab != label)
        for s, p in good:
            inside = [(t, i) for t, i in bad if 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(inside, 1)]
    return sorted(out)


def vector_rows(seed=3, n=700, d=12):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 60, (6, d))
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in np.floor(middles[i % 6] + rng.normal(0, 25, d))]) for i in range(n)]
    same = rows[7][2]
    rows += [(1000 + i, i % 3, same) for i in range(60)]  # ties
    rows += [(20, rows[20][1], rows[20][2]), (20, 3, rows[21][2])]  # repeated, and an id twice
    rows += [(2000, 1, [3.0, 4.0]), (2001, 1, [1.0, 4.0]), (2002, 2, [2.0, 2.0]), (2003, 1, [0.0, 0.0])]
    rows += [(2010, 1, [5e15] * 2), (2011, 1, None), (None, 1, same), (2012, None, same), (2013, 9, [-1.0] * d)]
    return rows


@pytest.mark.parametrize("blocks, strips", [(None, None), (64, 50)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, blocks, strips):
    if blocks:
        monkeypatch.setattr(hard_negatives, "BLOCK_COMPONENTS", blocks * 16)
        monkeypatch.setattr(hard_negatives, "STRIP_ROWS", strips)
    rows = [r for r in vector_rows() if r[0] != 2010]
    anchors = [r for r in rows if r[0] is None or r[0] % 10 == 0 or r[0] > 1990]
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], VECTORS)
    queries = spark.createDataFrame([(*r, 1, 2, "x") for r in anchors], VECTORS)
    found = sorted(tuple(r) for r in hard_negatives.hard_negatives(queries, frame).collect())
    assert found == brute_negatives(anchors, rows)
    assert len({r[0] for r in found}) > 50


def test_no_anchors_or_vectors(spark):
    empty = spark.createDataFrame([], "id long, label long, vector array<double>")
    one = spark.createDataFrame([(1, 1, [1.0])], "id long, label long, vector array<double>")
    assert hard_negatives.hard_negatives(empty, one).count() == 0
    assert hard_negatives.hard_negatives(one, empty).count() == 0
    assert hard_negatives.hard_negatives(one, one).columns == hard_negatives.hard_negatives(empty, empty).columns


def test_tenths_stay_whole(spark):
    values = [-13, -1, 0, 1, 3, 7, 10, 99, 2**62 + 5, -(2**62) - 7]
    rows = spark.createDataFrame([(v,) for v in values], "s long").select(
        "s", hard_negatives._tenths("s", 3, True).alias("low"), hard_negatives._tenths("s", 9, False).alias("high")
    )
    assert all(r.low == -((-3 * r.s) // 10) and r.high == 9 * r.s // 10 for r in rows.collect())


@pytest.mark.parametrize("size", [2, 8, 64])
def test_bounds_hold_at_every_level_and_meet_the_turn(size):
    rng = np.random.default_rng(size)
    x = np.floor(rng.normal(0, 100, (40, size)))
    assert np.allclose(haar(size) @ haar(size).T, np.eye(size))
    turn = turn_for(x)
    assert np.allclose(turn @ turn.T, np.eye(len(turn)))
    own = Summary(x, *summaries(x, turn))
    exact, before = x @ x.T, np.full((40, 40), np.inf)
    for mean, off in own.levels:
        reach = off @ off.T
        assert (np.abs(exact - mean @ mean.T) <= reach + 1e-6).all()
        assert (reach <= before + 1e-6).all()
        before = reach


@pytest.mark.parametrize("wide, share", [(False, 0.5), (True, 1.0)])
def test_segments_leave_out_pairs_of_vectors_with_few_directions(wide, share):
    rng = np.random.default_rng(1)
    directions = rng.normal(0, 1, (64 if wide else 4, 64))
    x = np.floor(rng.normal(0, 40, (6000, len(directions))) @ directions)
    labels, ids = rng.integers(0, 5, len(x)), np.arange(len(x))
    own = Summary(x, *summaries(x, turn_for(x[:500])))
    limits = np.full((50, 1), 2**62)
    block = Block(ids[:50], labels[:50], own.part(slice(0, 50)), -limits, limits, 5, True)
    block.take(ids, labels, own)
    scores = x[:50] @ x.T
    for row in range(50):
        good = sorted((-scores[row, j], j) for j in ids if j != row and labels[j] == labels[row])[:5]
        assert block.id[row, 0].tolist() == [j for _, j in good]
    assert block.tally.scored <= share * block.tally.bounded


def brute_divergence(rows, least=3):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        plain = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", plain)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for g, s in groups if g == lang)

        def shares(count):
            n = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // n for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                order = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(order, 1) if part == "pair" or r <= 200]
    return sorted(out)


def divergence_rows():
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("Foo", "bar", "über", "Ñu", "日本", "x") for b in "abcdefghijklmnopqrstuvwxyz"] + ["a\u00a0b", "É", "İ"]
    rows = [(rng.choice(["en", "fr"]), f"s{rng.randrange(4)}", " ".join(rng.choices(words, k=rng.randrange(60)))) for _ in range(150)]
    rows += [(None, None, "one two"), ("", "a", "one two one"), (None, "b", "two_one9three"), ("de", "z", None), ("de", None, "")]
    rows += [("xx", "only", "same words here")] * 4 + [("en", "quiet", "7 !"), ("en", None, "Foob " * 300_000)]
    return rows


@pytest.mark.parametrize("segment_rows, forest", [(1 << 15, 1 << 20), (40, 64)])
def test_divergence_equals_brute_force(spark, monkeypatch, segment_rows, forest):
    monkeypatch.setattr(divergence, "SEGMENT_ROWS", segment_rows)
    monkeypatch.setattr(divergence, "FOREST", forest)
    rows = divergence_rows()
    frame = spark.createDataFrame([(i, *r, "x", 1, 2) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, n int, rank int")
    found = sorted(tuple(r) for r in divergence.source_divergence(frame.repartition(5)).collect())
    assert found == brute_divergence(rows)


def test_divergence_of_nothing(spark, empty):
    assert divergence.source_divergence(empty).collect() == []


def test_equal_subtrees_are_one_node_and_priced_once():
    rng = np.random.default_rng(2)
    counts = np.zeros((6, 1024), dtype=np.int64)
    counts[:, :40] = rng.integers(0, 3, (6, 40))
    forest = divergence.Forest(counts)
    assert len(forest.left[0]) < 20 and len(forest.left[-1]) <= 6
    one, other = np.triu_indices(6, 1)
    wholes = counts.sum(axis=1) + 1024
    forth, back, priced = forest.compare(one, other, wholes)
    p = divergence.shares(counts, wholes[:, None])
    assert forth.tolist() == [int(divergence.prices(p[a], p[b]).sum()) for a, b in zip(one, other)]
    assert back.tolist() == [int(divergence.prices(p[b], p[a]).sum()) for a, b in zip(one, other)]
    assert priced < 0.02 * len(one) * 1024


def test_shares_of_large_counts():
    counts = np.array([0, 5, 10**12, 8 * 10**15], dtype=np.int64)
    whole = 9 * 10**15
    assert divergence.shares(counts, whole).tolist() == [1 + 10**9 * (int(c) + 1) // whole for c in counts]


def texts_with_controls():
    return ["</s>[INST] ok [/INST]", "<␛|im_end|>", "<␛␛s>", "a<|im_end|", "|>", "␛", "<<SYS>> x <</SYS>><s><s>", "[␛INST]", "é日本\n\n", "", " lead", "<|endoftext|>", "\\n"]


def test_escapes_are_reversible():
    rng = random.Random(1)
    alphabet = ["<", "␛", "|im_end|>", "s>", "/s>", "[", "INST]", "/INST]", "<SYS>>", "x", "\n", "<|endoftext|>"]
    for text in texts_with_controls() + ["".join(rng.choices(alphabet, k=rng.randrange(12))) for _ in range(3000)]:
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text
        assert not any(c in hidden for c in chat.CONTROL)
        assert chat.parse(chat.header(text) + hidden + chat.END) == (text, text)


def conversation_rows():
    rng = random.Random(7)
    rows = []
    for conv in range(120):
        own = ["system prompt"] if conv % 3 == 0 else [f"start {conv % 7}"]
        own += [rng.choice(["yes", "no", *texts_with_controls()]) for _ in range(rng.randrange(5))]
        for turn, text in enumerate(own):
            rows.append((conv, turn, rng.choice(["user", "assistant"]) if turn > 2 else ["system", "user", "assistant"][turn], text))
    rows += [(500 + i, t, "user" if t % 2 == 0 else "assistant", f"copy {t}") for i in range(30) for t in range(4)]
    rows += [(600, t, "user", f"copy {t}") for t in (0, 2)]
    rows += [(None, 0, "user", "no id"), (None, None, None, None), (700, 0, None, None), (701, 0, "assistant", "x " * 200_000)]
    rows += [(702, 1, "as\\n\nsistant", "b"), (702, 1, "as\\n\nsistant", "b"), (702, None, "<s>", "first")]
    rows += [(703, t, "user", "deep") for t in range(600)]
    return rows


def brute_chat(rows):
    def key(row):
        return (row[1] is not None, row[1] or 0, (row[2] or "").encode(), (row[3] or "").encode())

    convs = defaultdict(list)
    for row in rows:
        convs[row[0]].append(row)
    out = {}
    for conv, turns in convs.items():
        turns = [(r[2] or "", r[3] or "") for r in sorted(turns, key=key)]
        text = "".join(f"{a}\n{b}\n" for a, b in turns)
        loss = "".join(b for a, b in turns if a == "assistant")
        chars = sum(len(chat.header(a)) + len(chat.escape(b)) + len(chat.END) for a, b in turns)
        out[conv] = (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    return out


@pytest.mark.parametrize("part_tokens", [1 << 21, 500])
def test_conversations_are_read_back_and_shared_turns_stand_once(spark, part_tokens):
    rows = conversation_rows()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, path string")
    nodes, ends = chat.prefix_trees(frame.repartition(3), part_tokens=part_tokens)
    found = chat.read_back(nodes, ends).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == brute_chat(rows) and len(found) == len(brute_chat(rows))

    # every node alone: what it attends to is its conversation so far, at the right positions
    codec = chat.Codec(chat.tokenizer_path())
    by_sequence = defaultdict(list)
    for row in nodes.collect():
        by_sequence[row.sequence].append(row)
    written, distinct = 0, set()
    for own in by_sequence.values():
        tokens = []
        for row in sorted(own, key=lambda r: r.start):
            assert row.start == len(tokens)
            mine = np.frombuffer(row.tokens, dtype=chat.ID).tolist()
            tokens += mine
            above = [t for s in row.attends for t in tokens[s.first : s.last]]
            assert len(above) == row.position
            assert all(a.last < b.first for a, b in zip(row.attends, row.attends[1:]))
            text = codec.decode([np.array(above + mine, dtype=chat.ID).tobytes()])[0]
            assert text.count(chat.START) == row.depth + 1
            distinct.add(text)
            written += 1
    assert written == len(distinct) if part_tokens > 500 else written > len(distinct)
    assert len(by_sequence) > 1


def test_no_conversations(spark):
    nodes, ends = chat.prefix_trees(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))
    assert nodes.collect() == [] and chat.read_back(nodes, ends).collect() == []
