import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from stallbook.llm import packing, tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.tokenizer_path())


def test_words_give_the_ids_of_whole_texts(library):
    rng = random.Random(1)
    parts = ["Word", "naïve.", "ÜBER,", "a,b", "it's.", "<|endoftext|>", "x<|STARTOFTEXT|>", "…", " y", "H̱", "İ", "Σας",
             "\x1c", "\x85z", "３", "ǅ", "don't,", "..", "a.,", "ª1", "K", "日本語"]
    words = tokens.WordIds(tokens.tokenizer_path())
    counts = tokens.WordIds(tokens.tokenizer_path(), lengths=True)
    assert words.plain
    for _ in range(300):
        text = "".join(rng.choice(parts) + rng.choice([" ", "\n", "\t", "  ", "", "\r\n"]) for _ in range(rng.randrange(12)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert words.ids(text).tolist() == ids, text
        assert counts.counts([text]) == [len(ids)]


def test_long_texts_are_split_at_white_space():
    text = "ab " * 1000 + "c" * 5000 + " d"
    parts = list(tokens.pieces(text, 300))
    assert "".join(parts) == text and max(map(len, parts[:-2])) <= 304
    where, held = zip(*tokens.byte_batches([text, "", "x"], 300))
    assert sorted({i for w in where for i in w}) == [0, 1, 2]
    assert "".join(p for w, h in zip(where, held) for i, p in zip(w, h) if i == 0) == text


@pytest.mark.parametrize("name, plain", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_every_tokenizer_file_counts_as_its_library(spark, name, plain):
    path = tokens.tokenizer_path(name)
    assert tokens.WordIds(path).plain == plain
    own, rng = Tokenizer.from_file(path), random.Random(5)
    words = ["Word", " ", "  ", "\n\n", "naïve", "<|endoftext|>", "'s", "12 34", "日本", "\t", "x" * 50, "\u00a0", "\u0301"]
    texts = ["".join(rng.choices(words, k=rng.randrange(40))) for _ in range(200)] + ["ab  cd\n" * 170_000, "y" * 1_200_000, None, ""]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(frame, path).collect()}
    assert got == {i: len(own.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_what_a_worker_remembers_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 2000)
    words = tokens.WordIds(tokens.tokenizer_path(), lengths=True)
    whole = tokens.WordIds(tokens.tokenizer_path(), lengths=True)
    rng = random.Random(2)
    for _ in range(30):
        texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(5)) for _ in range(2)]
        assert words.counts(texts) == [sum(map(len, whole.tokenizer.encode_batch(t.split(), add_special_tokens=False))) for t in texts]
        assert words.held <= 2000


def test_files_that_look_over_white_space_are_not_cut():
    import json

    with open(tokens.tokenizer_path(), encoding="utf-8") as source:
        file = json.load(source)
    assert tokens.cuts_at_spaces(file)
    split = file["pre_tokenizer"]["pretokenizers"][0]
    for change in ({"behavior": "Isolated"}, {"invert": False}, {"pattern": {"Regex": "[a-z ]+"}}, {"pattern": {"String": " "}}):
        other = {**file, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{**split, **change}]}}
        assert not tokens.cuts_at_spaces(other)
    assert not tokens.cuts_at_spaces({**file, "normalizer": {"type": "Prepend", "prepend": "x"}})
    assert not tokens.cuts_at_spaces({**file, "added_tokens": [{**file["added_tokens"][0], "content": "a b"}]})


def test_counts_of_awkward_rows(awkward, empty, library):
    rows = tokens.token_counts(awkward).collect()
    texts = sorted((r["text"] or "") for r in awkward.collect())
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(library.encode(t, add_special_tokens=False).ids) for t in texts)
    assert sorted(r["n_bytes"] for r in rows) == sorted(len(t.encode()) for t in texts)
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in rows)
    assert tokens.token_counts(empty).count() == 0


def checked(pieces, ids_of, limits):
    """Every id in exactly one piece, sequences without gaps and within their limits."""
    sequences, documents = {}, {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append(p)
        documents.setdefault(p["doc_id"], []).append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [sum(q["length"] for q in own[:i]) for i in range(len(own))]
        assert sum(p["length"] for p in own) <= limits[0]
        assert len(own) <= limits[1]
        assert sum(p["loss_tokens"] for p in own) <= limits[2]
    for doc, own in documents.items():
        ids = ids_of[doc]
        times = len([p for p in own if p["start"] == 0])
        held = np.zeros(len(ids), int)
        for p in own:
            held[p["start"] : p["start"] + p["length"]] += 1
            assert p["ids"] == np.array(ids[p["start"] : p["start"] + p["length"]], dtype="<u4").tobytes()
        assert (held == times).all()
    return sequences


def test_packing_awkward_rows(awkward, empty, library):
    named = awkward.where("doc_id is not null")
    ids = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in named.collect()}
    pieces = packing.pack(named).collect()
    sequences = checked(pieces, ids, (2048, 256, 2048))
    sizes = [sum(p["length"] for p in own) for own in sequences.values()]
    assert all(2048 - s <= packing.SLACK or s & (s - 1) == 0 for s in sizes)
    assert packing.pack(empty).count() == 0
    both = packing.pack(awkward)
    assert both.where("doc_id is null").agg({"length": "sum"}).first()[0] == len(ids[4]) + 1
    digest = {(r["doc_id"], r["start"], r["ids_crc32"]) for r in packing.digest(packing.pack(named)).collect()}
    assert digest == {(p["doc_id"], p["start"], zlib.crc32(p["ids"])) for p in pieces}


def test_three_limits_hold_at_once(spark, library):
    rng = random.Random(2)
    rows = [(i, " ".join("abc" for _ in range(rng.randrange(1, 200))), rng.randrange(0, 150)) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, answer long").coalesce(1)
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t, _ in rows}
    pieces = packing.pack(frame, max_tokens=256, max_segments=4, max_loss=100, loss_column="answer").collect()
    checked(pieces, ids, (256, 4, 100))
    bears = {}
    for p in pieces:
        bears[p["doc_id"]] = bears.get(p["doc_id"], 0) + p["loss_tokens"]
    assert bears == {i: min(a, len(ids[i])) for i, _, a in rows}


def test_largest_dot_product_goes_first():
    rule = packing.Sequences(100, 3, 100, 0)
    lengths = np.array([60, 30, 50, 10, 40])
    held = list(rule.packed(lengths, lengths))
    assert held[0] == [(0, 0, 60), (4, 0, 40)]
    assert held[1] == [(2, 0, 50), (1, 0, 30), (3, 0, 10)] or sum(x[2] for x in held[1]) <= 100
    with pytest.raises(ValueError):
        packing.Sequences(0, 1, 1, 0)


def test_the_longest_fit_by_a_sorted_list_is_that_of_the_dot_product(monkeypatch):
    rng = np.random.default_rng(5)
    for slack, segments, most in ((0, 256, 40), (2, 3, 40), (16, 256, 900), (0, 1, 63), (3, 4, 7)):
        rule = packing.Sequences(64, segments, 64, slack)
        lengths = rng.integers(0, most, 300)
        assert hasattr(rule, "_longest_first")
        quick = list(rule.packed(lengths, lengths))
        with monkeypatch.context() as patched:
            patched.setattr(packing.np, "array_equal", lambda a, b: False)
            assert quick == list(rule.packed(lengths, lengths))


def test_packing_remembers_no_more_words_than_told(spark, library):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(2000))) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in rows}
    pieces = packing.pack(frame, memory=1 << 20).collect()
    checked(pieces, ids, (2048, 256, 2048))
    assert sorted(pieces) == sorted(packing.pack(frame).collect())
    words = tokens.WordIds(tokens.tokenizer_path(), memory=1 << 20)
    for _, text in rows:
        words.ids_of([text])
        assert words.held <= 1 << 20
    assert tokens.WordIds(tokens.tokenizer_path()).memory == tokens.CACHE_BYTES


def test_a_lean_function_gives_the_same_batches_and_ends_with_its_input():
    from stallbook.llm.common import lean

    ended = []

    def run(batches):
        try:
            for b in batches:
                yield b + 1
        finally:
            ended.append(True)

    assert list(lean(run)(iter([1, 2]))) == [2, 3] and ended == [True]
    left = lean(run)(iter([1, 2]))
    assert next(left) == 2
    left.close()
    assert ended == [True, True]
