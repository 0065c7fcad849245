"""How far sources lie from each other and from their language, by term counts.

Counts of a language's kept terms are cut into segments of term ids.  In a segment
every group (language and source) has a tree over its counts: a leaf is a count, an
inner node a pair of nodes, and nodes are hash-consed, so equal subtrees are one node
whichever group and place they belong to.  Two groups are compared by walking both
trees at once; a pair of nodes is priced once for the two groups, however often it is
met.  A segment's prices are added up by Spark.

All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallbook.llm.common import pick, ship_package, table
from stallbook.session import settle

#: A term is kept if so many documents of its language have it.
LEAST_DOCUMENTS = 3
#: Ranks of terms that are reported; pairs of sources all are.
TERM_RANKS = 200
SCALE = 1_000_000_000
#: Counts above zero in a segment, on average.
SEGMENT_ROWS = 1 << 15
#: Leaves of all trees that are built at once in a task, and of pairs walked at once.
FOREST = 1 << 20
WALK = 1 << 20
#: Terms that a task counts before it hands them on, and bytes that are split at once.
HELD_TERMS = 300_000
CHUNK = 1 << 20

_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def chunks_of_terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in lists: runs of ASCII letters, in lower case, and characters beyond ASCII."""
    plain = text.encode("utf-8", "replace").translate(_LETTERS)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + CHUNK)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def counted_terms(documents: DataFrame) -> DataFrame:
    """Partial sums of each ``lang``, ``source`` and ``term``: ``n`` occurrences in ``docs`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = list(n)
                for a in range(0, len(terms), 1 << 15):
                    own = terms[a : a + (1 << 15)]
                    columns = [
                        pa.array([lang] * len(own)),
                        pa.array([source] * len(own)),
                        pa.array(own, pa.binary()).cast(pa.string()),
                        pa.array([n[t] for t in own], pa.int64()),
                        pa.array([docs[t] for t in own], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            held.clear()

        since = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
                n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                before = len(n)
                own: set[bytes] = set()
                for terms in chunks_of_terms(text.as_py()):
                    n.update(terms)
                    own.update(terms)
                docs.update(own)
                since += len(n) - before
                if since >= HELD_TERMS:
                    yield from hand_on()
                    since = 0
        yield from hand_on()

    return documents.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang``, ``term`` and its counts in the sources that have it (``sources``, ``ns``)."""
    # dealt by term, so that both sums need no further exchange; a term comes once from each task and group
    dealt = counted_terms(documents).repartition("lang", "term")
    by_source = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = by_source.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts")
    )
    return found.where(F.col("docs") >= least).select(
        "lang", "term", F.col("counts.source").alias("sources"), F.col("counts.n").alias("ns")
    )


def shares(counts: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + SCALE * (count + 1) / whole, rounded down, by long division in steps of a
    thousand: whole numbers of 64 bits hold every step up to a ``whole`` of 9 * 10**15."""
    value, rest = np.zeros_like(counts), counts + 1
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, whole)
        value = value * 1000 + step
    return value + 1


def prices(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Forest:
    """Trees of equal height over the rows of ``counts``; level 0 has the leaves.

    ``values`` are the leaves' counts (-1: beyond the last term), ``left`` and ``right``
    the children of each level's nodes, ``roots`` the rows' trees.
    """

    def __init__(self, counts: np.ndarray):
        width = 1 << max(0, int(counts.shape[1] - 1).bit_length())
        padded = np.full((len(counts), width), -1, dtype=np.int64)
        padded[:, : counts.shape[1]] = counts
        self.values, nodes = np.unique(padded, return_inverse=True)
        nodes = nodes.reshape(padded.shape)
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        size = len(self.values)
        while nodes.shape[1] > 1:
            pairs, nodes = np.unique(nodes[:, ::2] * size + nodes[:, 1::2], return_inverse=True)
            nodes = nodes.reshape(len(counts), -1)
            self.left.append(pairs // size)
            self.right.append(pairs % size)
            size = len(pairs)
        self.roots = nodes[:, 0]

    def compare(self, one: np.ndarray, other: np.ndarray, wholes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For rows ``one[i]`` and ``other[i]``: the price of the first against the second, that of
        the second against the first, and how many leaf pairs were priced for all."""
        pair, a, b = np.arange(len(one)), self.roots[one], self.roots[other]
        ways: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(len(self.left) - 1, -1, -1):
            left, right = self.left[level], self.right[level]
            size = len(self.left[level - 1]) if level else len(self.values)
            keys = np.concatenate([(pair * size + side[a]) * size + side[b] for side in (left, right)])
            keys, way = np.unique(keys, return_inverse=True)
            ways.append((way[: len(a)], way[len(a) :]))
            pair, a, b = keys // size // size, keys // size % size, keys % size
        p, q = shares(self.values[a], wholes[one[pair]]), shares(self.values[b], wholes[other[pair]])
        real = self.values[a] >= 0
        forth, back = np.where(real, prices(p, q), 0), np.where(real, prices(q, p), 0)
        priced = len(pair)
        for first, second in reversed(ways):
            forth, back = forth[first] + forth[second], back[first] + back[second]
        return forth, back, priced


def price_segment(segment: pa.Table) -> pa.Table:
    """``source``, ``part``, ``item``, ``value`` of one segment, from the rows of its terms and
    those of all groups of the language (``term`` null, their counts' sums in ``ns``)."""
    is_group = segment["term"].is_null()
    group, own = segment.filter(is_group), segment.filter(pa.compute.invert(is_group))
    lang, number = segment["lang"][0].as_py(), segment["segment"][0].as_py()
    out: list[tuple[list, str, list, np.ndarray]] = []
    names = pa.compute.list_flatten(group["sources"])
    order = pa.compute.sort_indices(names)
    names = names.take(order).combine_chunks()
    sums = pa.compute.list_flatten(group["ns"]).take(order).to_numpy()
    groups = len(names)
    n_terms, total = group["n_terms"][0].as_py(), group["total"][0].as_py()
    wholes, whole = sums + n_terms, total + n_terms

    own = own.take(pa.compute.sort_indices(own["term"]))
    terms = own["term"].combine_chunks()
    sizes = pa.compute.list_value_length(own["ns"]).to_numpy()
    rows = pa.compute.index_in(pa.compute.list_flatten(own["sources"]), names).to_numpy().astype(np.int64)
    counts = pa.compute.list_flatten(own["ns"]).to_numpy()
    columns = np.repeat(np.arange(len(own)), sizes)
    totals = np.zeros(len(own), dtype=np.int64)
    np.add.at(totals, columns, counts)

    # terms of like counts side by side, so that trees share more
    first_row = np.zeros(len(own), dtype=np.int64)
    first_row[columns[::-1]] = rows[::-1]
    place = np.empty(len(own), dtype=np.int64)
    place[np.lexsort((first_row, sizes, totals))] = np.arange(len(own))
    one, other = np.triu_indices(groups, 1)
    forth, back = np.zeros(len(one), dtype=np.int64), np.zeros(len(one), dtype=np.int64)
    width = max(1, FOREST // max(1, groups))
    for a in range(0, len(own), width):
        mine = (place[columns] >= a) & (place[columns] < a + width)
        block = np.zeros((groups, min(width, len(own) - a)), dtype=np.int64)
        block[rows[mine], place[columns[mine]] - a] = counts[mine]
        forest = Forest(block)
        many = max(1, WALK // block.shape[1])
        for b in range(0, len(one), many):
            own_forth, own_back, _ = forest.compare(one[b : b + many], other[b : b + many], wholes)
            forth[b : b + many] += own_forth
            back[b : b + many] += own_back
    out.append((names.take(pa.array(np.concatenate([one, other]))), "pair", names.take(pa.array(np.concatenate([other, one]))), np.concatenate([forth, back])))

    # equal counts of a group and of the language are priced once
    key = np.stack([rows, counts, totals[columns]]) if len(rows) else np.zeros((3, 0), dtype=np.int64)
    leaves, way = np.unique(key, axis=1, return_inverse=True)
    p, q = shares(leaves[1], wholes[leaves[0]]), shares(leaves[2], whole)
    value, above = prices(p, q)[way], (p > q)[way]
    for row in range(groups):
        mine = np.flatnonzero(above & (rows == row))
        best = mine[np.lexsort((columns[mine], -value[mine]))[:TERM_RANKS]]
        out.append((names.take(pa.array(np.full(len(best), row))), "term", terms.take(pa.array(columns[best])), value[best]))
    parts = [
        pa.table({"lang": [lang] * len(v), "segment": pa.array([number] * len(v), pa.int64()), "source": s, "part": [part] * len(v), "item": i, "value": pa.array(v, pa.int64())})
        for s, part, i, v in out
        if len(v)
    ]
    return pa.concat_tables(parts) if parts else _PRICED.empty_table()


_PRICED = pa.schema([("lang", pa.string()), ("segment", pa.int64()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def source_divergence(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank`` for every group of rows of equal
    ``lang`` and ``source``.

    Part ``pair`` has the other sources of the language by falling divergence, part ``term`` the
    ``TERM_RANKS`` terms that most set the source above its language.  Null ``lang``, ``source`` or
    ``text`` are empty ones.  Every row is a document, copies and rows without ``doc_id`` too.  A group
    without terms has pairs as any other; in a language without kept terms all values of pairs are 0.
    Further columns are ignored.  A language of one source has no pairs; an empty table gives no rows.
    """
    ship_package(documents.sparkSession)
    texts = pick(documents, ["lang", "source", "text"])
    texts = texts.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in texts.columns])
    kept = settle(kept_terms(texts, least), "kept-terms")
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "ns")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.ns").alias("n"), F.count("*").alias("entries"))
    groups = texts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["n", "entries"])
    languages = groups.groupBy("lang").agg(F.sum("n").alias("total"), F.sum("entries").alias("entries"))
    n_terms = kept.groupBy("lang").agg(F.count("*").alias("n_terms"))
    languages = languages.join(n_terms, "lang", "left").select(
        "lang", "total", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.ceil(F.greatest(F.col("entries"), F.lit(1)) / SEGMENT_ROWS).alias("segments")
    )
    groups, languages = settle(groups, "groups"), settle(languages, "languages")
    by_term = kept.join(languages.select("lang", "segments"), "lang").select(
        "lang", F.pmod(F.xxhash64("term"), "segments").alias("segment"), "term", "sources", "ns", F.lit(None).cast("long").alias("n_terms"), F.lit(None).cast("long").alias("total")
    )
    by_group = groups.join(languages, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("segments") - 1)).alias("segment"), F.lit(None).cast("string").alias("term"),
        F.array("source").alias("sources"), F.array("n").alias("ns"), "n_terms", "total",
    )
    priced = by_term.union(by_group).groupBy("lang", "segment").applyInArrow(price_segment, "lang string, segment long, source string, part string, item string, value long")
    priced = settle(priced, "prices")
    pairs = priced.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    every = pairs.withColumn("rank", F.row_number().over(order)).select(*columns)
    best = priced.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TERM_RANKS)
    return every.union(best.select(*columns))


def op12_segment_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Divergences of all sources of ``documents``, and their most telling terms."""
    return source_divergence(table(spark, folder, "documents"))


#: Every kept term against every source of its language.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
),
words AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM d),
sums AS (SELECT lang, source, sum(n) AS s FROM counts GROUP BY lang, source),
wholes AS (SELECT g.lang, g.source, coalesce(s.s, 0) + coalesce(v.v, 0) AS w FROM groups g LEFT JOIN sums s USING (lang, source) LEFT JOIN v USING (lang)),
p AS (
  SELECT w.lang, w.source, k.term, coalesce(c.n, 0) AS n,
    1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // CAST(w.w AS HUGEINT) AS p
  FROM wholes w JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = w.lang AND c.source = w.source AND c.term = k.term
),
whole_language AS (SELECT lang, sum(w) - (count(*) - 1) * any_value(coalesce(v.v, 0)) AS w FROM wholes LEFT JOIN v USING (lang) GROUP BY lang),
q AS (
  SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 1)) // CAST(any_value(w) AS HUGEINT) AS q
  FROM counts JOIN whole_language USING (lang) GROUP BY lang, term
),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q)) // q AS value
  FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM terms)
) WHERE part = 'pair' OR rank <= 200
"""
