"""Conversations as token sequences in which shared first turns stand once.

Conversations that begin with the same turns form a prefix tree whose nodes are turns.
A tree is written depth first: each node's tokens once, with the position ids they have
in their conversation and the spans of the sequence that hold the turns before them, which
are what they may attend to.

Every turn has the hash of its conversation so far, and a conversation the row of these
hashes.  Sorted by that row, conversations stand in depth-first order: each adds the turns
by which it differs from the one before.  Spark sorts these short rows by range; equal
conversations are one row.  A range begins new sequences, so a tree whose first turn is
shared by a large part of all conversations is cut between them, and each part repeats
the turns above its first node.  Texts are only joined with the places that come out.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallbook.llm.common import ship_package, table, text_or_empty
from stallbook.session import settle

#: Strings that steer some chat format or tokenizer (fixed values).
CONTROL = [
    "<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>", "<s>", "</s>", "<unk>",
    "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]",
]
START, END = "<|im_start|>", "<|im_end|>\n"
#: Put behind the first character of a control string; it has one more of them then.
MARK = "␛"
LOSS_ROLE = "assistant"
TOKENIZER = "byte_bpe_50k.json"
#: Tokens in a part of the sorted conversations, on average.
PART_TOKENS = 1 << 21
#: Characters that are encoded at once, and after which a long text is cut.
CHUNK = 1 << 18
KEY = 16
#: Token ids in their binary columns.
ID = np.dtype("<u4")


def _pattern(times: str) -> re.Pattern:
    by_first: dict[str, list[str]] = {}
    for control in CONTROL:
        by_first.setdefault(control[0], []).append(re.escape(control[1:]))
    return re.compile("|".join(f"{re.escape(c)}{MARK}{times}(?:{'|'.join(rest)})" for c, rest in by_first.items()))


_PLAIN, _MARKED = _pattern("*"), _pattern("+")


def escape(text: str) -> str:
    """No control string is left in ``text``; strings that look escaped get one more mark.

    No control string's end is another's beginning, so what is replaced never overlaps,
    and :func:`unescape` finds the same places."""
    return _PLAIN.sub(lambda m: m[0][0] + MARK + m[0][1:], text)


def unescape(text: str) -> str:
    return _MARKED.sub(lambda m: m[0][0] + m[0][2:], text)


def header(role: str) -> str:
    """A role may hold any characters; its line ends are written in another way."""
    own = role.replace("\\", "\\\\").replace("\n", "\\n")
    return f"{START}{escape(own)}\n"


def parse(turn: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    line, _, rest = turn.partition("\n")
    if not line.startswith(START) or not rest.endswith(END):
        raise ValueError("not a turn")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line[len(START) :]))
    return role, unescape(rest[: -len(END)])


def pieces(text: str) -> list[str]:
    """A long text in parts; what tokens a part gives doesn't depend on the others."""
    return [text[a : a + CHUNK] for a in range(0, len(text), CHUNK)] if len(text) > CHUNK else [text]


class Codec:
    """Texts to token ids and back; special strings in a text are ordinary ones."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}

    def short(self, text: str) -> bytes:
        """Ids of a header or an end, which come again and again."""
        if text not in self.known:
            if len(self.known) > 1000:
                self.known.clear()
            self.known.update(self.encode([text]))
        return self.known[text]

    def encode(self, texts: list[str]) -> dict[str, bytes]:
        cut = {t: pieces(t) for t in dict.fromkeys(texts)}
        found = self.tokenizer.encode_batch([p for own in cut.values() for p in own], add_special_tokens=False)
        ids = (np.array(e.ids, dtype=ID).tobytes() for e in found)
        return {t: b"".join(islice(ids, len(own))) for t, own in cut.items()}

    def decode(self, rows: list[bytes]) -> list[str]:
        ids = [np.frombuffer(row, dtype=ID).tolist() for row in rows]
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_TURNS = "conv_id long, n int, position long, tokens binary, loss_first int, loss_last int, path binary, ends array<long>"


def tokenized_turns(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """A row for each turn with its place ``n``, the ``position`` of its first token and its
    ``tokens``, those from ``loss_first`` to ``loss_last`` under the loss; and a row for each
    conversation (``n`` -1) with the hashes of its beginnings (``path``) and where they end."""
    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")]
    turns = conversations.select(*columns, text_or_empty("role").alias("role"), text_or_empty().alias("text"))
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path or tokenizer_path())
        names = ["conv_id", "n", "position", "tokens", "loss_first", "loss_last", "path", "ends"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        begun, conv, keys, ends, last = False, None, bytearray(), [], b""
        rows: list[tuple] = []

        def close() -> None:
            if begun:
                rows.append((conv, -1, None, None, None, None, bytes(keys), ends))

        def hand_on() -> pa.RecordBatch:
            arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                heads, texts, held = [], [], 0
                while at < batch.num_rows and held < CHUNK:
                    heads.append((batch.column("conv_id")[at].as_py(), header(batch.column("role")[at].as_py()), batch.column("role")[at].as_py()))
                    texts.append(escape(batch.column("text")[at].as_py()))
                    held += len(texts[-1])
                    at += 1
                ids = codec.encode(texts)
                for (own, head, role), text in zip(heads, texts):
                    if not begun or own != conv:
                        close()
                        begun, conv, keys, ends, last = True, own, bytearray(), [], b""
                    parts = codec.short(head), ids[text], codec.short(END)
                    sizes = [len(part) // ID.itemsize for part in parts]
                    last = hashlib.blake2b(last + (head + text).encode("utf-8", "replace"), digest_size=KEY).digest()
                    position = ends[-1] if ends else 0
                    loss = (sizes[0], sizes[0] + sizes[1]) if role == LOSS_ROLE else (None, None)
                    rows.append((conv, len(ends), position, b"".join(parts), *loss, None, None))
                    ends.append(position + sum(sizes))
                    keys += last
                if rows:
                    yield hand_on()
        close()
        if rows:
            yield hand_on()

    return dealt.mapInArrow(run, _TURNS)


class Layout:
    """Places of one sorted part's conversations, one after the other."""

    def __init__(self, part: int):
        self.part, self.trees = part, 0
        self.path, self.length = np.zeros(0, dtype=f"V{KEY}"), 0
        #: Stretches of the present path that are written in one piece: first turn, start, end.
        self.runs: list[tuple[int, int, int]] = []

    def place(self, path: bytes, ends: np.ndarray) -> tuple[int, int, int, int, list[tuple[int, int]]]:
        """The sequence, the first turn that is new and its place, what positions are shifted
        by to places, and the spans of the turns before it."""
        keys = np.frombuffer(path, dtype=f"V{KEY}")
        n = min(len(keys), len(self.path))
        differ = np.flatnonzero(keys[:n] != self.path[:n])
        shared = int(differ[0]) if len(differ) else n
        if not shared:
            self.trees, self.length, self.runs = self.trees + 1, 0, []
        while self.runs and self.runs[-1][0] >= shared:
            self.runs.pop()
        above = int(ends[shared - 1]) if shared else 0
        if self.runs:
            first, start, _ = self.runs[-1]
            before = int(ends[first - 1]) if first else 0
            self.runs[-1] = (first, start, start + above - before)
        spans = [(start, end) for _, start, end in self.runs]
        base, shift = self.length, self.length - above
        if len(ends) > shared:
            self.length += int(ends[-1]) - above
            if self.runs and self.runs[-1][2] == base:
                self.runs[-1] = (*self.runs[-1][:2], self.length)
            else:
                self.runs.append((shared, base, self.length))
        self.path = keys
        return (self.part << 33) + self.trees, shared, base, shift, spans


def layout(paths: DataFrame, parts: int) -> DataFrame:
    """``owner`` (a conversation), its ``sequence``, the turns it adds (from ``first``, written from
    ``base``, their positions shifted by ``shift``), the spans ``above`` them, its number of
    ``turns`` and its ``leaf``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        places = Layout(TaskContext.get().partitionId())
        for batch in batches:
            rows = []
            for path, ends in zip(batch.column("path"), batch.column("ends")):
                own = ends.values.to_numpy()
                rows.append((*places.place(path.as_py(), own), len(own)))
            if rows:
                sequence, first, base, shift, spans, n = zip(*rows)
                span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
                columns = [
                    batch.column("owner"),
                    batch.column("leaf"),
                    pa.array(sequence, pa.int64()),
                    pa.array(first, pa.int32()),
                    pa.array(base, pa.int64()),
                    pa.array(shift, pa.int64()),
                    pa.array([[{"first": a, "last": b} for a, b in own] for own in spans], span),
                    pa.array(n, pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["owner", "leaf", "sequence", "first", "base", "shift", "above", "turns"])

    dealt = paths.repartitionByRange(parts, "path").sortWithinPartitions("path")
    return dealt.mapInArrow(run, "owner long, leaf binary, sequence long, first int, base long, shift long, above array<struct<first: long, last: long>>, turns int")


def prefix_trees(conversations: DataFrame, path: str | None = None, part_tokens: int = PART_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Nodes of all trees, and the node that ends each conversation.

    Nodes: ``sequence``, ``start`` (the place of the first token in it), ``depth`` (turns before),
    ``position`` (the position id of the first token; the others follow), ``tokens`` (ids as
    little-endian unsigned 32-bit numbers), ``attends``
    (spans of the sequence with the turns before; beside them a token sees those before it in its own
    node), ``loss_first`` and ``loss_last`` (places in the sequence; null where no loss falls) and
    ``leaf`` where a conversation ends.  Ends: ``conv_id``, ``leaf``.

    Turns are in the order of ``turn`` (null first), then of role and text; repeated rows are
    turns each.  Null roles and texts are empty.  Rows without ``conv_id`` are one conversation.  Any
    role is kept.  Further columns are ignored; an empty table gives empty ones.  ``path`` names a
    tokenizer file whose ids give back every text.
    """
    ship_package(conversations.sparkSession)
    turns = settle(tokenized_turns(conversations, path), "turns")
    whole = turns.where("n = -1").select("conv_id", "path", "ends", F.expr(f"substring(path, length(path) - {KEY - 1}, {KEY})").alias("leaf"))
    tokens = whole.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0
    owners = whole.groupBy("leaf").agg(F.min(F.struct("conv_id", "path", "ends")).alias("o")).select("leaf", F.col("o.conv_id").alias("owner"), "o.path", "o.ends")
    places = settle(layout(owners, int(-(-tokens // part_tokens)) or 1), "places")
    # a conversation is the first of those that begin like it, so it adds its own last turn
    nodes = turns.where("n >= 0").drop("path", "ends").join(places, F.col("conv_id").eqNullSafe(F.col("owner")) & (F.col("n") >= F.col("first")))
    nodes = nodes.withColumn("start", F.col("position") + F.col("shift"))
    attends = """
        CASE WHEN start = base THEN above
             WHEN element_at(above, -1).last = base
             THEN concat(slice(above, 1, size(above) - 1), array(named_struct('first', element_at(above, -1).first, 'last', start)))
             ELSE concat(above, array(named_struct('first', base, 'last', start))) END"""
    nodes = nodes.select(
        "sequence", "start", F.col("n").alias("depth"), "position", "tokens",
        F.expr(attends.replace("element_at(above, -1)", "try_element_at(above, -1)")).alias("attends"),
        (F.col("start") + F.col("loss_first")).alias("loss_first"), (F.col("start") + F.col("loss_last")).alias("loss_last"),
        F.when(F.col("n") == F.col("turns") - 1, F.col("leaf")).alias("leaf"),
    )
    return nodes, whole.select("conv_id", "leaf")


class Reading:
    """What has been read of a conversation: hashes and sums so far."""

    def __init__(self, above: Reading | None = None):
        self.turns, self.loss = (above.turns.copy(), above.loss.copy()) if above else (hashlib.sha256(), hashlib.sha256())
        self.n, self.loss_chars, self.chars = (above.n, above.loss_chars, above.chars) if above else (0, 0, 0)

    def add(self, turn: str, loss: str | None) -> Reading:
        role, text = parse(turn)
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
        self.n += 1
        self.chars += len(turn)
        if loss is not None:
            own = unescape(loss)
            self.loss.update(own.encode("utf-8", "replace"))
            self.loss_chars += len(own)
        return self


_READ = "leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(nodes: DataFrame, ends: DataFrame, path: str | None = None) -> DataFrame:
    """Every conversation as the sequences have it: ``conv_id``, ``n_turns``, ``turns_sha256`` (of each
    turn's role, line end, text, line end), ``loss_chars`` and ``loss_sha256`` (of all text under the loss),
    ``formatted_chars``.  A sequence is read once from its start; shared turns are decoded once."""
    ship_package(nodes.sparkSession)
    dealt = nodes.select("sequence", "start", "depth", "tokens", "loss_first", "loss_last", "leaf").repartition("sequence").sortWithinPartitions("sequence", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path or tokenizer_path())
        stack: list[Reading] = []
        for batch in batches:
            out: list[tuple] = []
            for a in range(0, batch.num_rows, 256):
                rows = batch.slice(a, 256).to_pylist()
                # before, under and behind the loss, each decoded once
                cuts = [[0, *[r[c] - r["start"] for c in ("loss_first", "loss_last")], None] if r["loss_first"] is not None else [0, None] for r in rows]
                segments = [r["tokens"][i * ID.itemsize : j if j is None else j * ID.itemsize] for r, cut in zip(rows, cuts) for i, j in zip(cut, cut[1:])]
                texts = iter(codec.decode(segments))
                for row, cut in zip(rows, cuts):
                    parts = list(islice(texts, len(cut) - 1))
                    del stack[row["depth"] :]
                    stack.append(Reading(stack[-1] if stack else None).add("".join(parts), parts[1] if len(parts) > 1 else None))
                    if row["leaf"] is not None:
                        r = stack[-1]
                        out.append((row["leaf"], r.n, r.turns.hexdigest(), r.loss_chars, r.loss.hexdigest(), r.chars))
            if out:
                kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(zip(*out), kinds)],
                    names=["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
                )

    return ends.join(dealt.mapInArrow(run, _READ), "leaf").drop("leaf")


def op13_prefix_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one whose turns are control strings, formatted and read back."""
    hard = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    conversations = table(spark, folder, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    conversations = conversations.union(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    return read_back(*prefix_trees(conversations))


_ESCAPED = r"""regexp_replace(regexp_replace({0}, '<(␛*)(\|im_start\|>|\|im_end\|>|\|startoftext\|>|\|endoftext\|>|s>|/s>|unk>|<SYS>>|</SYS>>)', '<␛\1\2', 'g'), '\[(␛*)(INST\]|/INST\])', '[␛\1\2', 'g')"""

#: What the format must give back, and the characters it takes.
SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
t AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(length('{START}') + length({_ESCAPED.format("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")}) + 1
      + length({_ESCAPED.format("text")}) + {len(END)}) AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, CAST(loss_chars AS BIGINT) AS loss_chars, loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM t
"""
