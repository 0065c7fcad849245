"""Token counts and token ids of whole texts by a tokenizer file.

Texts go to the library's batch encoding in batches of about ``BATCH_BYTES``.  Where the
file says that its pre-tokenizer drops ASCII white space, a text's ids are those of its
words in a row: long texts are cut there, and a worker keeps the ids of words it has met
and encodes a batch's new words only.  Texts of other files are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallbook.llm.common import pick, ship_package, table, text_or_empty

#: Bytes of words, with what a dictionary needs for each, that one worker remembers before it starts anew.
CACHE_BYTES, ENTRY_BYTES = 144 << 20, 120
#: Bytes of text that are encoded together, and after which a long text is split.
BATCH_BYTES = 1 << 20
#: New words that are encoded as one text.
JOINED = 512
SEQUENCE_LIMIT = 2048

_SPACES = " \t\n\x0b\x0c\r"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _parts(node: dict | None, inner: str) -> list[dict]:
    if not node:
        return []
    return node[inner] if node["type"] == "Sequence" else [node]


def cuts_at_spaces(file: dict) -> bool:
    """Does this tokenizer file drop ASCII white space, and work on each side of it apart?

    Its normalisers must not look across white space, and its first pre-tokenizer must keep
    only what a pattern matches that matches no white space.
    """
    import regex

    def local(step: dict) -> bool:
        whole = step["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents")
        return whole or step["type"] == "Replace" and step["pattern"] == {"Regex": "\\s+"} and step["content"] == " "

    first = next(iter(_parts(file["pre_tokenizer"], "pretokenizers")), None)
    if not all(map(local, _parts(file["normalizer"], "normalizers"))) or not first or first["type"] != "Split":
        return False
    if first["behavior"] != "Removed" or not first["invert"] or "Regex" not in first["pattern"]:
        return False
    pattern = regex.compile(first["pattern"]["Regex"])
    inside = any(set(m.group()) & set(_SPACES) for c in _SPACES for around in "a1!é" for m in pattern.finditer(f"{around}{c}{c}{around}'s{c}"))
    special = any(c.isspace() for token in file["added_tokens"] for c in token["content"])
    return not inside and not special and not any(t["lstrip"] or t["rstrip"] for t in file["added_tokens"])


class _Numbers(dict):
    """Numbers of words as they are met; ``new`` has those of no value yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class WordIds:
    """Ids (little-endian unsigned 32 bits) or numbers of ids of texts and their words."""

    def __init__(self, path: str, lengths: bool = False, memory: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as source:
            file = json.load(source)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lengths, self.memory = lengths, memory or CACHE_BYTES
        self.plain = cuts_at_spaces(file)
        #: ASCII capitals may be lowered first, if no special string can begin in the text.
        self.lowers = self.plain and any(n["type"] == "Lowercase" for n in _parts(file["normalizer"], "normalizers"))
        self.special = {token["content"][:2].encode() for token in file["added_tokens"]}
        self.forget()

    def forget(self) -> None:
        self.numbers, self.values, self.held = _Numbers(), [], 0

    def encoded(self, texts: list[str]) -> list:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [len(e.ids) if self.lengths else np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def encoded_words(self, words: list[bytes]) -> list:
        """The same for words, which go to the library ``JOINED`` in a text; a token belongs to
        the word that it begins in."""
        texts = [[w.decode() for w in words[a : a + JOINED]] for a in range(0, len(words), JOINED)]
        out: list = []
        for own, found in zip(texts, self.tokenizer.encode_batch([" ".join(own) for own in texts], add_special_tokens=False)):
            begins = np.fromiter((first for first, _ in found.offsets), np.int64, len(found.ids))
            cuts = np.searchsorted(begins, np.cumsum([len(w) + 1 for w in own])).tolist()
            if self.lengths:
                out += np.diff(cuts, prepend=0).tolist()
            else:
                ids = np.array(found.ids, dtype="<u4").tobytes()
                out += [ids[4 * a : 4 * b] for a, b in zip([0, *cuts], cuts)]
        return out

    def words(self, text: str) -> list[bytes]:
        raw = text.encode("utf-8", "replace")
        if not self.lowers or any(s in raw for s in self.special):
            return raw.split()
        if raw.isascii():
            return raw.lower().split()
        # before a mark a capital may compose otherwise than its small letter
        return [w.lower() if w.isascii() else w for w in raw.split()]

    def of(self, texts: list[str]) -> list[list]:
        """The values of each text's words, or of the text itself where it must not be cut."""
        if not self.plain:
            return [[v] for v in self.encoded(texts)]
        own = [self.words(t) for t in texts]
        # as if every word were new; so a batch's words are known together
        if self.held and self.held + sum(map(len, texts)) + ENTRY_BYTES * sum(map(len, own)) > self.memory:
            self.forget()
        found = [list(map(self.numbers.__getitem__, words)) for words in own]
        if new := self.numbers.new:
            self.values += self.encoded_words(new)
            self.held += sum(map(len, new)) + len(new) * ENTRY_BYTES
            new.clear()
        return [list(map(self.values.__getitem__, numbers)) for numbers in found]

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(values), dtype="<u4") for values in self.of(texts)]

    def ids(self, text: str) -> np.ndarray:
        return self.ids_of([text])[0]

    def counts(self, texts: list[str]) -> list[int]:
        return [sum(values) for values in self.of(texts)]


def pieces(text: str, size: int) -> Iterator[str]:
    """Parts of about ``size`` characters, cut after ASCII white space."""
    start = 0
    while len(text) - start > size:
        cut = re.compile(r"[\x20\x09-\x0d]").search(text, start + size)
        if not cut:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


def byte_batches(texts: list[str], size: int = BATCH_BYTES, cut: bool = True) -> Iterator[tuple[list[int], list[str]]]:
    """Batches of texts or, with ``cut``, parts of long texts, each with about ``size``
    characters: positions of the texts, and the parts."""
    where: list[int] = []
    parts: list[str] = []
    held = 0
    for i, text in enumerate(texts):
        for part in pieces(text, size) if cut else (text,):
            where.append(i)
            parts.append(part)
            held += len(part)
            if held >= size:
                yield where, parts
                where, parts, held = [], [], 0
    if parts:
        yield where, parts


_workers: dict[tuple[str, bool, int | None], WordIds] = {}


def words_of(path: str, lengths: bool, memory: int | None = None) -> WordIds:
    """One per Python worker, kept from task to task."""
    key = (path, lengths, memory)
    if key not in _workers:
        _workers[key] = WordIds(path, lengths, memory)
    return _workers[key]


def token_counts(
    documents: DataFrame, tokenizer: str | None = None, limit: int = SEQUENCE_LIMIT
) -> DataFrame:
    """UTF-8 bytes and tokens of every whole text: one row per row of
    ``documents`` (``doc_id``, ``text``).

    A null or empty text has no bytes and no tokens.  Repeated rows are counted
    each; a null ``doc_id`` stays null; further columns are ignored; an empty
    table gives an empty table.  Special strings in a text are one token each, as
    the library reads them.
    """
    ship_package(documents.sparkSession)
    path = tokenizer or tokenizer_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path, True)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n_tokens = np.zeros(len(texts), dtype=np.int64)
            for where, parts in byte_batches(texts, cut=words.plain):
                np.add.at(n_tokens, where, words.counts(parts))
            n_bytes = [len(t) if t.isascii() else len(t.encode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array(n_tokens > limit, pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    source = pick(documents, ["doc_id", "text"]).select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")
    )
    return source.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of all documents by the word-level tokenizer file."""
    return token_counts(table(spark, folder, "documents"))
