"""Quality rules: gradient-boosted trees over statistics of whole texts.

The trees are grown in numpy on a bounded sample of labelled rows, with monotonic
constraints: where a feature is a known fault (symbols, repeats, shouting), more of
it never raises the score.  They are then flat arrays of nodes, so a batch of
documents walks all trees at once, one array step for each level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallbook.llm.common import lean, ship_package, table, text_or_empty, uniform

#: Labelled rows that the trees are grown on, on average.
TRAIN_ROWS = 20_000
TREES = 60
DEPTH = 3
RATE = 0.2
BINS = 64
LEAST_IN_LEAF = 20
RIDGE = 1.0
#: Documents below this probability of good quality are rejected.
LEAST_PROBABILITY = 0.5
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees, and how they may move the score: 0 either way, -1 only down.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "letter_share": 0,
    "digit_share": 0,
    "words_per_line": 0,
    "marks_per_word": 0,
}

_SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
_MARKS = np.frombuffer(b"!?;:=_-/\\(){}[]\"'", dtype=np.uint8)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text has twice or more."""
    n = len(words)
    if n < 4 or len(set(zip(words, words[1:], words[2:]))) == n - 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    # a pair of ids becomes one id before the third joins, so nothing overflows
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, at, times = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    starts = times[at] > 1
    held = np.zeros(n, dtype=bool)
    for shift in range(3):
        held[shift : shift + n - 2] |= starts
    return int(held.sum())


def statistics(text: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The values of ``BASE`` and of ``FEATURES``."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return (0,) * len(BASE), (0.0,) * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    code_points = len(raw) - int(counts[0x80:0xC0].sum())
    word_chars = code_points - int(counts[9:14].sum()) - int(counts[32])
    n_symbols = int(counts[_SYMBOLS].sum())
    lines = [line for line in raw.split(b"\n") if line.strip()]
    n_dup_lines = len(lines) - len(set(lines))
    n_repeat = repeat_words(words)
    upper = int(counts[65:91].sum())
    latin = upper + int(counts[97:123].sum())
    letters = latin + int(counts[0xC0:].sum())
    base = (n, word_chars, n_symbols, n_dup_lines, n_repeat)
    return base, (
        float(np.log1p(n)),
        word_chars / n,
        n_symbols / n,
        n_dup_lines / len(lines),
        n_repeat / n,
        upper / max(1, latin),
        letters / word_chars,
        int(counts[48:58].sum()) / word_chars,
        n / len(lines),
        int(counts[_MARKS].sum()) / n,
    )


def all_statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    pairs = [statistics(t) for t in texts]
    base = np.array([p[0] for p in pairs], dtype=np.int64).reshape(len(texts), len(BASE))
    return base, np.array([p[1] for p in pairs]).reshape(len(texts), len(FEATURES))


@dataclass
class Trees:
    """Nodes of all trees, one row per tree; a leaf has the feature -1.

    The children of node i are 2 i + 1 (values at or below the threshold) and 2 i + 2.
    """

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        if not len(self.feature):
            return out
        tree = np.arange(len(self.feature))
        for first in range(0, len(x), 4096):
            rows = x[first : first + 4096]
            node = np.zeros((len(rows), len(tree)), dtype=np.int64)
            for _ in range(DEPTH):
                feature = self.feature[tree, node]
                here = np.take_along_axis(rows, np.maximum(feature, 0), axis=1)
                below = 2 * node + 2 - (here <= self.threshold[tree, node])
                node = np.where(feature < 0, node, below)
            out[first : first + 4096] += self.value[tree, node].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def grow(x: np.ndarray, y: np.ndarray, directions: tuple[int, ...] = tuple(FEATURES.values())) -> Trees:
    """Boosted trees for the logistic loss; ``y`` is 0 or 1.

    A split counts only if its children keep the direction of its feature, and what
    lies under a child never passes the middle of the two children's values.
    Without rows of both classes there are no trees, only a constant.
    """
    size = (1 << (DEPTH + 1)) - 1
    share = float(np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3))
    start = float(np.log(share / (1 - share)))
    if len(y) < 2 * LEAST_IN_LEAF or y.min() == y.max():
        return Trees(np.zeros((0, size), int), np.zeros((0, size)), np.zeros((0, size)), start)
    edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    feature = np.full((TREES, size), -1)
    threshold, value = np.zeros((TREES, size)), np.zeros((TREES, size))
    margin = np.full(len(y), start)
    for t in range(TREES):
        p = 1.0 / (1.0 + np.exp(-margin))
        slope, bend = y - p, p * (1 - p)
        stack = [(0, 0, np.arange(len(y)), -np.inf, np.inf)]
        while stack:
            node, depth, rows, low, high = stack.pop()
            own = _leaf(slope[rows].sum(), bend[rows].sum(), low, high)
            best = None
            if depth < DEPTH and len(rows) >= 2 * LEAST_IN_LEAF:
                best = _best_split(binned[rows], slope[rows], bend[rows], edges, directions, low, high)
            if best is None:
                value[t, node] = RATE * own
                margin[rows] += RATE * own
                continue
            f, b, left, right = best
            feature[t, node], threshold[t, node] = f, edges[f][b]
            goes = binned[rows, f] <= b
            middle, way = (left + right) / 2, directions[f]
            bounds = {0: (low, high, low, high), 1: (low, middle, middle, high), -1: (middle, high, low, middle)}[way]
            stack.append((2 * node + 2, depth + 1, rows[~goes], *bounds[2:]))
            stack.append((2 * node + 1, depth + 1, rows[goes], *bounds[:2]))
    return Trees(feature, threshold, value, start)


def _leaf(slope, bend, low: float, high: float):
    return np.clip(slope / (bend + RIDGE), low, high)


def _best_split(binned, slope, bend, edges, directions, low, high):
    """The feature, bin and children's values that gain most, or None."""
    total_slope, total_bend, rows = slope.sum(), bend.sum(), len(slope)

    def worth(g, h, v):
        return g * v - 0.5 * (h + RIDGE) * v * v

    best, most = None, worth(total_slope, total_bend, _leaf(total_slope, total_bend, low, high)) + 1e-6
    for f, e in enumerate(edges):
        if not len(e):
            continue
        g, h, n = (np.bincount(binned[:, f], w, len(e) + 1).cumsum()[:-1] for w in (slope, bend, None))
        left, right = _leaf(g, h, low, high), _leaf(total_slope - g, total_bend - h, low, high)
        gain = worth(g, h, left) + worth(total_slope - g, total_bend - h, right)
        legal = (n >= LEAST_IN_LEAF) & (rows - n >= LEAST_IN_LEAF) & (directions[f] * (right - left) >= 0)
        if legal.any():
            b = int(np.where(legal, gain, -np.inf).argmax())
            if gain[b] > most:
                best, most = (f, b, float(left[b]), float(right[b])), gain[b]
    return best


def learn(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, seed: int = 3) -> Trees:
    """Trees from ``labels`` (``doc_id``, ``quality`` 0 or 1) and their documents' texts.

    Labels without an id or a quality don't count.  About ``train_rows`` labels are
    drawn by hash, so what the join broadcasts and the driver gathers is bounded.
    """
    ship_package(documents.sparkSession)
    known = labels.where("doc_id is not null and quality in (0, 1)").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    )
    n = known.count()
    drawn = known.where(uniform(F.col("doc_id"), seed=seed) < F.lit(min(1.0, train_rows / max(1, n))))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = all_statistics(batch.column("text").to_pylist())
            columns = [batch.column("doc_id"), batch.column("quality"), *[pa.array(c) for c in x.T]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "quality", *FEATURES])

    schema = "doc_id long, quality int, " + ", ".join(f"{f} double" for f in FEATURES)
    # the size of the drawn labels is bounded above, so they are broadcast
    found = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "quality", "text").mapInArrow(lean(measure), schema).toArrow().to_pandas()
    found = found.sort_values(["doc_id", "quality", *FEATURES], kind="stable")
    return grow(found[list(FEATURES)].to_numpy(float), found["quality"].to_numpy(float))


def verdicts(texts: list[str], trees: Trees) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base statistics, failed base rules, probability, and which texts are kept."""
    base, x = all_statistics(texts)
    n_words, n_repeat = base[:, 0], base[:, 4]
    failed = (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED_PERCENT * n_words)
    probability = trees.probability(x)
    return base, failed, probability, ~failed & (probability >= LEAST_PROBABILITY)


def assess(documents: DataFrame, trees: Trees) -> DataFrame:
    """Statistics and verdict for every row of ``documents`` (``doc_id``, ``text``).

    A null, empty or blank text has no words: its counts are 0 and it fails the base
    rules.  Repeated rows are judged each, a null ``doc_id`` stays, further columns
    are ignored, an empty table gives an empty table.  Without labels of both
    classes the base rules decide alone.
    """
    ship_package(documents.sparkSession)
    names = ["doc_id", *BASE, "base_failed", "probability", "kept"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, failed, probability, kept = verdicts(batch.column("text").to_pylist(), trees)
            columns = [*[pa.array(c) for c in base.T], pa.array(failed), pa.array(probability), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    counts = ", ".join(f"{b} long" for b in BASE)
    return source.mapInArrow(judge, f"doc_id long, {counts}, base_failed boolean, probability double, kept boolean")


def good_documents(documents: DataFrame, trees: Trees) -> DataFrame:
    """The rows that pass, with all their columns."""
    ship_package(documents.sparkSession)
    at = documents.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = verdicts([t or "" for t in batch.column(at).to_pylist()], trees)[-1]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return documents.mapInArrow(lean(keep), documents.schema)


def op2_boosted_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and verdict of all documents, learned from ``labels``."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return assess(documents, learn(documents, table(spark, folder, "labels")))
