"""Documents scored by a bidirectional window network's masked pseudo-likelihood.

Every word is predicted from the words on both sides of it; a document's score is
the sum of these conditional log-probabilities.

Words are leaves of a tree: each node parts its words, in the order of their counts, into
up to ``BRANCHES`` ranges of near-equal count.  The network predicts a word's way down, branch
by branch, starting at each node from the shares that the corpus counts give its branches.
Every counted word has a leaf of its own, frequent ones near the root, so a prediction takes
few branches; weights belong to the upper nodes and to classes of the others, so their
number does not follow the vocabulary.

The corpus gives the counts, and it trains the network: texts that are equal are encoded
rows of one key, which count as often as they come but are read once.  Tasks train copies
on bounded numbers of words, and the copies' weighted mean starts the next round; the
rounds together predict every word once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallbook.llm.common import ship_package, table, text_or_empty
from stallbook.session import scratch_path

#: Words are hashed into so many slots; words that meet in one share a leaf.
SLOTS = 1 << 22
BRANCHES = 16
#: Weights of branches: the first nodes have their own, the others share the rest.
CLASSES, OWN_CLASSES = 64, 1 + BRANCHES
#: Rows of the inputs: the most frequent words have their own, the others share the rest; 0 is beyond a text's ends.
INPUT_ROWS, OWN_ROWS = 2048, 1536
#: Words on either side.
REACH = 2
OFFSETS = (*range(-REACH, 0), *range(1, REACH + 1))
WIDTH = 16
#: The least and the most rounds; each predicts an equal part of all words.
ROUNDS, MOST_ROUNDS = 2, 12
#: A copy is trained on so many words for each of its weights, and there are more
#: rounds if one had more copies than this.
WORDS_PER_WEIGHT = 8
COPIES = 64
BATCH = 8192
STEP = 0.1
#: Words that are scored at once.
CHUNK = 1 << 15
#: Words of a stored part, which one task trains on; there are no more parts than this.
PART_WORDS, MOST_PARTS = 4_000_000, 100_000
_FIXED = float(1 << 16)
_NEVER, _MOST = np.float32(-1e9), np.float32(60)
_ONES = np.ones(BRANCHES, dtype=np.float32)


def slots_of(text: str) -> np.ndarray:
    """The hash slots of a text's words, A-Z in lower case."""
    import zlib

    words = text.encode("utf-8", "replace").lower().split()
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) & np.uint32(SLOTS - 1)


def texts_of(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and its key of 128 bits (``k0``, ``k1``)."""
    text = text_or_empty()
    keys = [F.xxhash64(F.lit(i), text).alias(f"k{i}") for i in (0, 1)]
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), *keys, text.alias("text"))


def word_counts(documents: DataFrame) -> np.ndarray:
    """How often each slot occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for text in batch.column("text"):
                np.add.at(held, slots_of(text.as_py()), 1)
        slot = np.flatnonzero(held)
        for a in range(0, len(slot), 1 << 15):
            own = slot[a : a + (1 << 15)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(held[own])], names=["slot", "n"])

    found = texts_of(documents).select("text").mapInArrow(count, "slot int, n long")
    rows = found.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, dtype=np.int64)
    counts[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return counts


class Tree:
    """Every counted slot's way from the root, by its rank in the order of counts.

    A leaf has its parent and its branch there, and so has a node; ``shares`` are the
    logs of each node's branches' parts of its count.
    """

    def __init__(self, counts: np.ndarray):
        seen = np.flatnonzero(counts)
        order = seen[np.lexsort((seen, -counts[seen]))]
        self.words = len(order)
        # a word that was not counted is taken for the rarest one
        self.rank = np.full(len(counts), max(0, self.words - 1), dtype=np.int32)
        self.rank[order] = np.arange(self.words)
        below = np.concatenate([[0.0], np.cumsum(counts[order], dtype=np.float64)])
        self.parent = np.zeros(max(1, self.words), dtype=np.int32)
        self.branch = np.zeros(max(1, self.words), dtype=np.uint8)
        parents, branches, shares, self.levels = [np.zeros(1, np.int32)], [np.zeros(1, np.uint8)], [], [0]
        first, last, nodes = np.zeros(1, np.int64), np.full(1, self.words), 1
        while len(first) and self.words:
            own = nodes - len(first) + np.arange(len(first))
            mass = below[last] - below[first]
            edges = np.empty((len(first), BRANCHES + 1), dtype=np.int64)
            edges[:, 0], edges[:, -1] = first, last
            few = last - first <= BRANCHES
            for k in range(1, BRANCHES):
                even = np.searchsorted(below, below[first] + mass * (k / BRANCHES))
                # the first branch holds a word, and the others do if there are more
                even = np.clip(even, first + 1, np.maximum(first + 1, last - 1))
                edges[:, k] = np.minimum(np.where(few, first + k, even), last)
            edges = np.maximum.accumulate(edges, axis=1)
            sizes = np.diff(edges, axis=1)
            with np.errstate(divide="ignore"):
                share = np.log(np.diff(below[edges], axis=1) / mass[:, None])
            shares.append(np.where(sizes > 0, share, _NEVER).astype(np.float32))
            row, k = np.nonzero(sizes == 1)
            self.parent[edges[row, k]], self.branch[edges[row, k]] = own[row], k
            row, k = np.nonzero(sizes > 1)
            parents.append(own[row].astype(np.int32))
            branches.append(k.astype(np.uint8))
            first, last = edges[row, k], edges[row, k + 1]
            self.levels.append(nodes)
            nodes += len(first)
        self.node_parent, self.node_branch = np.concatenate(parents), np.concatenate(branches)
        self.shares = np.concatenate(shares) if shares else np.full((1, BRANCHES), _NEVER)

    def class_edges(self, nodes: np.ndarray) -> list[tuple[int, int, int]]:
        """Class, first and last place of each stretch of ascending nodes that share weights:
        one of the first nodes, or a range of the others."""
        others = max(1, len(self.shares) - OWN_CLASSES)
        ends = OWN_CLASSES + -(-others * np.arange(CLASSES - OWN_CLASSES + 1) // (CLASSES - OWN_CLASSES))
        at = np.searchsorted(nodes, np.concatenate([np.arange(OWN_CLASSES), ends]))
        return [(c, int(at[c]), int(at[c + 1])) for c in np.flatnonzero(at[1:] > at[:-1])]

    def steps(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All steps on the ways to these words, level by level from below: places in ``words``,
        nodes and branches taken there.  Ascending words give ascending nodes."""
        node, branch = self.parent[words], self.branch[words]
        for first in reversed(self.levels):
            place = np.flatnonzero(node >= first) if first else np.arange(len(words))
            if len(place):
                here = node[place]
                yield place, here, branch[place]
                if first:
                    branch[place], node[place] = self.node_branch[here], self.node_parent[here]


def input_rows(words: np.ndarray) -> np.ndarray:
    """The row of the inputs that a word has as a neighbour."""
    shared = OWN_ROWS + words % (INPUT_ROWS - OWN_ROWS)
    return np.where(words < OWN_ROWS - 1, words + 1, shared).astype(np.int32)


class Network:
    """Weights in one flat array, with a view of each part."""

    def __init__(self, tree: Tree, flat: np.ndarray | None = None, seed: int = 17):
        shapes = {
            "inputs": (len(OFFSETS), INPUT_ROWS, WIDTH),
            "hidden": (WIDTH,),
            "branches": (CLASSES, BRANCHES, WIDTH),
            "bias": (CLASSES, BRANCHES),
        }
        self.tree, self.size = tree, SIZE
        if flat is None:
            flat = np.random.default_rng(seed).normal(0, 0.05, self.size)
            flat[self.size - CLASSES * BRANCHES :] = 0
        self.flat = flat.astype(np.float32)
        at = 0
        for name, shape in shapes.items():
            size = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + size].reshape(shape))
            at += size

    def state(self, context: np.ndarray) -> np.ndarray:
        """The hidden layer for lines of neighbours, one column for each offset."""
        total = self.inputs[0][context[:, 0]]
        for o in range(1, len(OFFSETS)):
            total += self.inputs[o][context[:, o]]
        total += self.hidden
        return np.tanh(total, out=total)

    def _logits(self, own: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Of all branches of a step each, none so large that its exponential isn't finite; and
        the classes of the steps."""
        classes, logits = self.tree.class_edges(node), self.tree.shares[node]
        for c, a, b in classes:
            logits[a:b] += own[a:b] @ self.branches[c].T
            logits[a:b] += self.bias[c]
        return np.minimum(logits, _MOST, out=logits), classes

    def log_probabilities(self, context: np.ndarray, words: np.ndarray) -> np.ndarray:
        order = np.argsort(words, kind="stable")
        state, found = self.state(context[order]), np.zeros(len(words))
        for place, node, branch in self.tree.steps(words[order]):
            logits, _ = self._logits(state if len(place) == len(words) else state[place], node)
            taken = logits[np.arange(len(place)), branch]
            # sums as products: numpy adds up short rows slowly
            taken -= np.log(np.exp(logits, out=logits) @ _ONES)
            found[place] += taken
        out = np.empty(len(words))
        out[order] = found
        return out

    def gradient(self, context: np.ndarray, words: np.ndarray, times: np.ndarray | None = None) -> Network:
        """Of the mean log-probability, in which a word counts ``times``."""
        out = Network(self.tree, np.zeros(self.size, dtype=np.float32))
        order = np.argsort(words, kind="stable")
        context, words = context[order], words[order]
        weight = np.full(len(words), 1 / len(words)) if times is None else times[order] / times.sum()
        weight, state = weight.astype(np.float32), self.state(context)
        back, every_one = np.zeros_like(state), np.ones(len(words), dtype=np.float32)
        for place, node, branch in self.tree.steps(words):
            every = len(place) == len(words)
            own, part = (state, weight) if every else (state[place], weight[place])
            miss, classes = self._logits(own, node)
            np.exp(miss, out=miss)
            miss *= (-part / (miss @ _ONES))[:, None]
            miss[np.arange(len(place)), branch] += part
            slope = np.empty_like(own)
            for c, a, b in classes:
                out.branches[c] += miss[a:b].T @ own[a:b]
                out.bias[c] += every_one[a:b] @ miss[a:b]
                np.matmul(miss[a:b], self.branches[c], out=slope[a:b])
            if every:
                back += slope
            else:
                back[place] += slope
        back *= 1 - state * state
        out.hidden[:] = every_one @ back
        columns = back.T.astype(np.float64)
        for o in range(len(OFFSETS)):
            rows = np.ascontiguousarray(context[:, o])
            for w in range(WIDTH):
                out.inputs[o, :, w] = np.bincount(rows, columns[w], INPUT_ROWS)
        return out


#: Weights of a network.
SIZE = len(OFFSETS) * INPUT_ROWS * WIDTH + WIDTH + CLASSES * BRANCHES * (WIDTH + 1)


def neighbours(ids: np.ndarray, first: int, last: int) -> np.ndarray:
    """For the words from ``first`` to ``last``: what ``ids`` has at the offsets, 0 beyond the ends."""
    own = ids[max(0, first - REACH) : last + REACH]
    padded = np.zeros(last - first + 2 * REACH, dtype=np.int32)
    at = max(0, REACH - first)
    padded[at : at + len(own)] = own
    return np.stack([padded[REACH + o : REACH + o + last - first] for o in OFFSETS], axis=1)


def masked(ids: np.ndarray, turn: int, rounds: int = ROUNDS, key: int | None = None, first: int = 0) -> np.ndarray:
    """Places of the words that are predicted in this round; ``ids`` are those of a
    text from its place ``first``.  Every place is in one of ``rounds`` turns, and
    the text's key has a part in which."""
    place = np.arange(first, first + len(ids), dtype=np.uint64)
    mix = (place * np.uint64(0x9E3779B97F4A7C15)) ^ (ids.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
    mix ^= np.uint64((key or 0) * 0xD6E8FEB86659FD93 % (1 << 64))
    mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return np.flatnonzero((mix >> np.uint64(33)) % np.uint64(rounds) == turn % rounds)


#: Trained words of a copy.
COPY_WORDS = WORDS_PER_WEIGHT * SIZE


def rounds_for(words: int) -> int:
    return int(min(MOST_ROUNDS, max(ROUNDS, -(-words // (COPIES * COPY_WORDS)))))


def encode(documents: DataFrame, tree: Tree) -> DataFrame:
    """``doc_id``, the text's key, and its words' ranks (32 bits each)."""
    shared = documents.sparkSession.sparkContext.broadcast(tree.rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in batches:
            ids = [rank[slots_of(t.as_py())].tobytes() for t in batch.column("text")]
            columns = [batch.column(c) for c in ("doc_id", "k0", "k1")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], names=["doc_id", "k0", "k1", "ids"])

    return texts_of(documents).mapInArrow(run, "doc_id long, k0 long, k1 long, ids binary")


def stored_texts(encoded: DataFrame, words: int) -> DataFrame:
    """Each distinct text once with the ``times`` it comes, stored in parts by key.

    A part's rows are in the order of their keys in one file, so what a copy is trained on
    doesn't depend on how the input was laid out.  Copies of a text meet one from each task.
    """
    spark = encoded.sparkSession
    parts = int(min(MOST_PARTS, max(1, -(-words // PART_WORDS))))
    once = encoded.groupBy("k0", "k1").agg(F.first("ids").alias("ids"), F.count(F.lit(1)).alias("times"))
    dealt = once.withColumn("part", F.pmod("k0", F.lit(parts)).cast("int")).repartition(parts, "part")
    path = scratch_path(spark, "encoded")
    dealt.sortWithinPartitions("part", "k0", "k1").write.partitionBy("part").parquet(path)
    return spark.read.schema("k0 long, k1 long, ids binary, times long, part int").parquet(path)


def train_round(stored: DataFrame, start: Network, turn: int, rounds: int = ROUNDS) -> Network:
    """The mean of the copies that all tasks train, weighted by their words."""
    context = stored.sparkSession.sparkContext
    shared, tree_of = context.broadcast(start.flat), _broadcast_tree(stored, start.tree)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = tree_of.value
        sums, total = np.zeros(SIZE, dtype=np.int64), 0
        net, n, seen, part = Network(tree, shared.value), 0, 0, None
        squares = np.full(SIZE, 1e-6, dtype=np.float32)
        lines, words, times, held = [], [], [], 0

        def learn() -> None:
            nonlocal n, seen, held
            if held:
                line, word, often = (np.concatenate(c) for c in (lines, words, times))
                for a in range(0, len(word), BATCH):
                    own = slice(a, a + BATCH)
                    slope = net.gradient(line[own], word[own], often[own]).flat
                    squares[:] += slope * slope
                    net.flat += STEP * slope / np.sqrt(squares)
                n += int(often.sum())
                seen += len(word)
            for column in (lines, words, times):
                column.clear()
            held = 0

        def close() -> None:
            """Adds the copy to the sums and starts another."""
            nonlocal net, n, seen, total
            learn()
            if n:
                # whole numbers, so that the sum doesn't depend on the order of tasks
                sums[:] += np.rint(net.flat.astype(np.float64) * _FIXED).astype(np.int64) * n
                total += n
            net, n, seen = Network(tree, shared.value), 0, 0
            squares[:] = 1e-6

        for batch in batches:
            for own, key, row, often in zip(*[batch.column(c) for c in ("part", "k0", "ids", "times")]):
                if own.as_py() != part or seen >= COPY_WORDS:
                    close()
                    part = own.as_py()
                ids = np.frombuffer(row.as_py(), dtype=np.int32)
                as_inputs = input_rows(ids)
                for first in range(0, len(ids), CHUNK):
                    last = min(first + CHUNK, len(ids))
                    at = masked(ids[first:last], turn, rounds, key.as_py(), first)
                    lines.append(neighbours(as_inputs, first, last)[at])
                    words.append(ids[first:last][at])
                    times.append(np.full(len(at), often.as_py(), dtype=np.float64))
                    held += len(at)
                    if held >= 4 * BATCH:
                        learn()
        close()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([total], pa.int64())], names=["at", "v"])
            for a in range(0, SIZE, 1 << 15):
                at = np.arange(a, min(SIZE, a + (1 << 15)), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["at", "v"])

    rows = stored.select("part", "k0", "ids", "times").mapInArrow(train, "at int, v long")
    found = rows.groupBy("at").agg(F.sum("v").alias("v")).toArrow().sort_by("at")
    if not len(found):
        return start
    values = found["v"].to_numpy()
    return Network(start.tree, values[1:] / _FIXED / values[0])


def _broadcast_tree(df: DataFrame, tree: Tree):
    """The tree without the slots' ranks, which only the encoding needs."""
    light = object.__new__(Tree)
    light.__dict__.update({k: v for k, v in tree.__dict__.items() if k != "rank"})
    return df.sparkSession.sparkContext.broadcast(light)


def score_encoded(encoded: DataFrame, network: Network, *columns: str) -> DataFrame:
    """``columns`` with ``n_words``, ``log_prob`` and ``mean_log_prob`` of their ``ids``."""
    shared, tree_of = encoded.sparkSession.sparkContext.broadcast(network.flat), _broadcast_tree(encoded, network.tree)
    kinds = dict(encoded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(tree_of.value, shared.value)
        for batch in batches:
            rows = [np.frombuffer(r.as_py(), dtype=np.int32) for r in batch.column("ids")]
            total = np.zeros(len(rows))
            for where, lines, words in chunks(rows):
                total += np.bincount(where, net.log_probabilities(lines, words), len(rows))
            n = pa.array([len(r) for r in rows], pa.int64())
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, n, pa.array(total)], names=[*columns, "n_words", "log_prob"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in columns)
    found = encoded.select(*columns, "ids").mapInArrow(run, f"{schema}, n_words long, log_prob double")
    return found.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))


def chunks(rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows' numbers, neighbours and words, about ``CHUNK`` words at a time."""
    where, lines, words, held = [], [], [], 0
    for i, ids in enumerate(rows):
        as_inputs = input_rows(ids)
        for first in range(0, len(ids), CHUNK):
            last = min(first + CHUNK, len(ids))
            where.append(np.full(last - first, i))
            lines.append(neighbours(as_inputs, first, last))
            words.append(ids[first:last])
            held += last - first
            if held >= CHUNK:
                yield np.concatenate(where), np.concatenate(lines), np.concatenate(words)
                where, lines, words, held = [], [], [], 0
    if held:
        yield np.concatenate(where), np.concatenate(lines), np.concatenate(words)


def score(documents: DataFrame, rounds: int | None = None) -> DataFrame:
    """Trains on all rows of ``documents`` (``doc_id``, ``text``) and scores each: ``doc_id``,
    ``n_words``, ``log_prob``, the sum over its words, and ``mean_log_prob``.

    A null, empty or blank text has no words, the sum 0.0 and a null mean.  Repeated
    rows count as often as they come and are scored each, a null ``doc_id`` stays, further
    columns are ignored, an empty table gives an empty table.  The rows of the input decide
    the result, neither its layout nor the order in which tasks end.  Without ``rounds`` their
    number follows the words of the corpus.
    """
    ship_package(documents.sparkSession)
    counts = word_counts(documents)
    tree, words = Tree(counts), int(counts.sum())
    rounds = rounds or rounds_for(words)
    stored = stored_texts(encode(documents, tree), words)
    network = Network(tree)
    for turn in range(rounds):
        network = train_round(stored, network, turn, rounds)
    found = score_encoded(stored, network, "k0", "k1")
    return texts_of(documents).select("doc_id", "k0", "k1").join(found, ["k0", "k1"]).drop("k0", "k1")


def op5_pseudo_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    """Pseudo-log-likelihoods of all documents."""
    return score(table(spark, folder, "documents"))
