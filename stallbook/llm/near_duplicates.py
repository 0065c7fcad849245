"""Near-duplicate documents by an exact Jaccard join with PartEnum signatures.

Sets whose Jaccard similarity reaches the threshold have close sizes and a bounded
number of features that only one of them holds.  Sizes are dealt into bands so that
linked sets lie in one band or in neighbouring ones; each set signs for its own
band and the next.  A band that allows ``k`` differing features cuts the domain of
features into ``k + 1`` parts and some more.  Linked sets agree on all parts but
``k`` at most, and a signature names the content of one part: the enumeration of
single parts, which for these sizes is the form with the fewest signatures.

As more than ``k + 1`` parts are cut, linked sets share several signatures.  So a set
that shares fewer with anybody has no link and drops out, one sum per set, before
any pair is formed; passages that many documents share end here.  Of each remaining
signature all sets are compared with one of them, which joins large groups of
copies.  Where a signature's sets then lie in different components, pairs across
them are formed that may still link, as their rarest features tell, and compared.
Comparisons are exact, on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallbook.llm.common import lean, ship_package, table, text_or_empty
from stallbook.llm.components import components
from stallbook.session import settle

WORDS = 5
PERCENT = 80
#: Signatures (12 bytes each) that one task meets, on average.
TASK_SIGNATURES = 1 << 20
LEAST_BUCKETS = 1024
#: Signatures that a task signs before it sends them on.
SEND = 1 << 19
#: Sets of a task's sending with the same signature beyond which only one goes on.
HOT = 256
#: Bits of the filter that finds the sets to compare again; larger data share bits.
FILTER_BITS = 1 << 27
#: Slots in which features are counted to tell rare ones; they only set an order.
RARITY_SLOTS = 1 << 18

_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, size: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles, A-Z in lower case."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(size, len(words))
    whole = np.full(len(words) - span + 1, np.uint64(span))
    for i in range(span):
        whole = whole * _MIX[0] + hashes[i : len(words) - span + 1 + i]
    return np.unique(mixed(whole))


def set_name(features: np.ndarray) -> int:
    """A 64-bit name that equal sets share, as a signed number."""
    total = mixed(features + _MIX[0]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(features))
    return int(mixed(total).astype(np.int64)[0])


@lru_cache(maxsize=8)
def bands(percent: int = PERCENT, largest: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all bands: the smallest size, the most differing features, and the parts.

    A band that starts at l ends at l / threshold, so what a set of one band links
    with lies in it or a neighbour.  Sets of sizes a and b that reach the threshold
    differ in at most (a + b) (1 - t) / (1 + t) features.
    """
    first, differ, parts = [], [], []
    low = 1
    while low <= largest:
        high = low * 100 // percent
        k = 2 * high * (100 - percent) // (100 + percent)
        first.append(low)
        differ.append(k)
        parts.append(k + 1 + 2 + k // 4)
        low = high + 1
    return np.array(first), np.array(differ), np.array(parts)


def signatures(features: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, int, int]]:
    """For the set's band and the next: its signatures, how many of them it shares
    with anything it links with, and the band's parity.

    Empty parts sign nothing.  Sets that might agree on empty parts only sign one
    extra value of the band instead, so none is lost.
    """
    first, differ, parts = bands(percent)
    own = int(np.searchsorted(first, len(features), side="right")) - 1
    for band in (own, own + 1):
        k, n = int(differ[band]), int(parts[band])
        if not k:
            continue
        # features are sorted, so those of a part, a range of hashes, are neighbours
        part = ((features >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        held = np.add.reduceat(mixed(features ^ _MIX[1]), starts)
        tag = np.array([band + 1], dtype=np.uint64) * _MIX[2]
        signs = mixed(held + part[starts].astype(np.uint64) * _MIX[0] + tag)
        share = n - k - (n - len(starts))
        if share < 1:
            signs = np.append(signs, mixed(tag))
        yield signs, max(1, share), band & 1


def named_sets(documents: DataFrame, size: int = WORDS) -> DataFrame:
    """``doc_id``, ``text_hash``, the name of the set (null if empty) and its size."""
    ship_package(documents.sparkSession)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), size) for t in batch.column("text")]
            names = [set_name(s) if len(s) else None for s in sets]
            columns = [pa.array(names, pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), *columns], names=["doc_id", "text_hash", "name", "n"]
            )

    return texts_of(documents).mapInArrow(lean(name), "doc_id long, text_hash long, name long, n long")


def texts_of(documents: DataFrame) -> DataFrame:
    text = text_or_empty()
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")
    )


def shared_signatures(documents: DataFrame, buckets: int, partitions: int, size: int, percent: int) -> DataFrame:
    """Rows of signatures that two sets or more have (``sign``, ``name``), and one
    row with ``need`` instead of ``sign`` for every set and parity of band.

    Signatures travel in packed arrays, dealt by bucket; in a bucket 32 bits tell
    them apart, the lowest being the band's parity.  Sets that meet by chance are
    sorted out later like all others that have too little in common.
    """

    def send(signs: list, names: list, needs: list, turn: int) -> Iterator[pa.RecordBatch]:
        sign, name = np.concatenate(signs), np.concatenate(names)
        bucket = ((sign >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        short = sign.astype(np.uint32)
        order = np.argsort((bucket << 32) | short)
        bucket, short, name = bucket[order], short[order], name[order]
        edge = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (short[1:] != short[:-1]), [True]]))
        times = np.diff(edge)
        hot = np.repeat(times >= HOT, times)
        one = np.zeros(len(hot), dtype=bool)
        one[edge[:-1]] = True
        # of a signature that many sets here share, one meets the others' sets
        told = (bucket[hot] << 32) | short[hot]
        told_name = name[hot]
        rest = ~hot | one
        bucket, short, name = bucket[rest], short[rest], name[rest]
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        rows = [(int(bucket[a]), short[a:b].tobytes(), name[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:])]
        held = np.array(needs, dtype=np.int64)
        rows.append((-1 - 2 * (turn % buckets), held.tobytes(), b""))
        for first in range(0, len(told), 1 << 16):
            part = slice(first, first + (1 << 16))
            rows.append((-2 - 2 * ((turn + first) % buckets), told[part].tobytes(), told_name[part].tobytes()))
        for first in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows[first : first + 256]), (pa.int32(), pa.binary(), pa.binary()))],
                names=["bucket", "signs", "names"],
            )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId() * 7919
        seen: set[int] = set()
        signs, names, needs, held = [], [], [], 0
        for batch in batches:
            for text in batch.column("text"):
                features = shingle_set(text.as_py(), size)
                if not len(features):
                    continue
                name = set_name(features)
                if name in seen:  # a copy; its signatures are on their way
                    continue
                if len(seen) >= 1 << 20:
                    seen.clear()
                seen.add(name)
                for found, need, parity in signatures(features, percent):
                    found = (found & ~np.uint64(1)) | np.uint64(parity)
                    signs.append(found)
                    names.append(np.full(len(found), name, dtype=np.int64))
                    needs.append((name, parity, need))
                    held += len(found)
                if held >= SEND:
                    yield from send(signs, names, needs, turn)
                    signs, names, needs, held, turn = [], [], [], 0, turn + 1
        if signs:
            yield from send(signs, names, needs, turn)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(signs: np.ndarray, names: np.ndarray, needs: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(names), 1 << 16):
                b = a + (1 << 16)
                n = len(names[a:b])
                need = pa.array(needs[a:b], pa.int64()) if needs is not None else pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signs[a:b]), pa.array(names[a:b]), need], names=["sign", "name", "need"]
                )

        held: dict[int, list] = {}
        for batch in batches:
            for bucket, signs, names in zip(*[c.to_pylist() for c in batch.columns]):
                if bucket >= 0:
                    held.setdefault(bucket, []).append((signs, names))
                elif bucket % 2:
                    told = np.frombuffer(signs, dtype=np.int64).reshape(-1, 3)
                    yield from rows(told[:, 1].copy(), told[:, 0].copy(), told[:, 2].copy())
                else:
                    yield from rows(np.frombuffer(signs, dtype=np.int64), np.frombuffer(names, dtype=np.int64))
        for bucket in list(held):
            own = held.pop(bucket)
            short = np.frombuffer(b"".join(s for s, _ in own), dtype=np.uint32)
            name = np.frombuffer(b"".join(n for _, n in own), dtype=np.int64)
            order = np.lexsort((name, short))
            short, name = short[order], name[order]
            new = np.concatenate([[True], (short[1:] != short[:-1]) | (name[1:] != name[:-1])])
            short, name = short[new], name[new]
            edge = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1], [True]]))
            times = np.diff(edge)
            many = np.repeat(times > 1, times)
            yield from rows((bucket << 32) | short[many].astype(np.int64), name[many])

    packed = texts_of(documents).select("text").mapInArrow(lean(sign), "bucket int, signs binary, names binary")
    return packed.repartition(partitions, "bucket").mapInArrow(lean(meet), "sign long, name long, need long")


def filter_of(names: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A bit for every name's hash: at most ``FILTER_BITS`` bits, whatever their number."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << (8 * names.count()).bit_length()))
    slot = F.pmod(F.col(column), F.lit(bits))
    words = (
        names.select(F.floor(slot / 63).cast("long").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(pmod({column}, {bits}), 63) as int))").alias("v"))
        .groupBy("w")
        .agg(F.bit_or("v").alias("v"))
        .toArrow()
    )
    held = np.zeros(bits // 63 + 1, dtype=np.int64)
    held[words["w"].to_numpy()] = words["v"].to_numpy()
    return held, bits


def sets_of(documents: DataFrame, names: DataFrame, size: int) -> DataFrame:
    """The sets with these names: ``name``, ``features`` (distinct).

    All texts are read again, and a filter of bounded size leaves the sets that are
    wanted and a few others, so no text is shuffled.
    """
    shared = documents.sparkSession.sparkContext.broadcast(filter_of(names, "name"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bits = shared.value
        seen: set[int] = set()
        for batch in batches:
            found, features = [], []
            for text in batch.column("text"):
                own = shingle_set(text.as_py(), size)
                name = set_name(own) if len(own) else 0
                slot = name % bits
                if len(own) and name not in seen and held[slot // 63] >> (slot % 63) & 1:
                    if len(seen) >= 1 << 20:
                        seen.clear()
                    seen.add(name)
                    found.append(name)
                    features.append(own.view(np.int64))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.int64()), pa.array(features, pa.list_(pa.int64()))], names=["name", "features"]
                )

    found = texts_of(documents).select("text").mapInArrow(lean(find), "name long, features array<long>")
    wanted = found.join(names, "name", "left_semi")
    return wanted.dropDuplicates(["name"])


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose sets reach the threshold."""
    left = sets.select(F.col("name").alias("a"), F.col("features").alias("fa"))
    right = sets.select(F.col("name").alias("b"), F.col("features").alias("fb"))
    both = F.size(F.array_intersect("fa", "fb"))
    return (
        pairs.select("a", "b")
        .join(right, "b")
        .join(left, "a")
        .where(100 * both >= percent * (F.size("fa") + F.size("fb") - both))
        .select("a", "b")
    )


def set_components(documents: DataFrame, named: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``node`` and ``root`` for all sets that are linked with another set."""
    spark = documents.sparkSession
    features = named.agg(F.sum("n")).first()[0] or 0
    signs = int(features * 6.3 * (100 - percent) / (100 + percent))  # two bands of parts, somewhat more than k
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), signs // TASK_SIGNATURES + 1)
    buckets = max(LEAST_BUCKETS, 8 * partitions)
    told = settle(shared_signatures(documents, buckets, partitions, size, percent), "signatures")
    needs = told.where("need is not null").select("name", F.col("sign").alias("parity"), "need").distinct()
    shared = told.where("need is null").select("name", "sign", F.col("sign").bitwiseAND(F.lit(1)).alias("parity"))
    enough = (
        shared.groupBy("name", "parity")
        .agg(F.count("*").alias("times"))
        .join(needs, ["name", "parity"])
        .where("times >= need")
        .select("name", "parity")
    )
    shared = settle(shared.distinct().join(enough, ["name", "parity"]).select("name", "sign"), "shared")
    # compared first: with the one of each signature that shares most with others
    sharers = shared.groupBy("sign").agg(F.count("*").alias("members")).where("members > 1")
    shared = settle(shared.join(sharers, "sign"), "met")
    weight = shared.groupBy("name").agg(F.sum("members").alias("weight"))
    first = F.max(F.struct("weight", "name")).getField("name")
    hubs = shared.join(weight, "name").groupBy("sign").agg(first.alias("hub"))
    stars = shared.join(hubs, "sign").where("name <> hub").select(
        F.least("hub", "name").alias("a"), F.greatest("hub", "name").alias("b")
    )
    stars = settle(stars.distinct(), "stars")
    # whoever shares a signature is in a star, so these are all sets to compare
    names = settle(stars.select(F.explode(F.array("a", "b")).alias("name")).distinct(), "names")
    sets = settle(sets_of(documents, names, size), "sets")
    links = settle(linked(stars, sets, percent), "links")
    roots = components(links)
    placed = shared.join(roots, shared["name"] == roots["node"], "left").select(
        "sign", "name", F.coalesce("root", "name").alias("root")
    )
    apart = placed.groupBy("sign").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    open_ = settle(placed.join(apart.select("sign"), "sign").select("name", "root").distinct(), "open")
    more = settle(linked(pairs_across(open_, sets, percent).join(stars, ["a", "b"], "left_anti"), sets, percent), "more")
    return components(links.union(more)) if more.limit(1).count() else roots


def rarity(sets: DataFrame) -> np.ndarray:
    """How many features of the sets fall into each of ``RARITY_SLOTS`` slots."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(RARITY_SLOTS, dtype=np.int64)
        for batch in batches:
            features = batch.column("features").flatten().to_numpy()
            held += np.bincount(features & (RARITY_SLOTS - 1), minlength=RARITY_SLOTS)
        slot = np.flatnonzero(held)
        for a in range(0, len(slot), 1 << 15):
            own = slot[a : a + (1 << 15)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(held[own])], names=["slot", "n"])

    rows = sets.select("features").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(RARITY_SLOTS, dtype=np.int64)
    counts[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return counts


def pairs_across(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a``, ``b``) of the sets in ``open_`` (``name``, ``root``) with different roots
    that may reach the threshold: their rarest features decide.

    In an order of all features, rare ones first, sets that link have a first common
    feature so early that the features from there on suffice for the overlap they
    need.  So only the first features of each set are joined, each with its place,
    and only if one of the two sets isn't in the root that holds most sets with
    that feature: a large class is never paired with itself.
    """
    ours = sets.join(open_, "name").select("name", "root", "features")
    shared = sets.sparkSession.sparkContext.broadcast(rarity(ours))

    def first_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                columns: list[list] = [[], [], [], [], []]
                for name, root, features in zip(*part.columns):
                    held = features.values.to_numpy()
                    n = len(held)
                    order = np.lexsort((held, rare[held & (RARITY_SLOTS - 1)]))[: n - -(-percent * n // 100) + 1]
                    for column, value in zip(columns, (np.full(len(order), name.as_py()), np.full(len(order), root.as_py()),
                                                       np.full(len(order), n), np.arange(len(order)), held[order])):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c), pa.int64()) for c in columns], names=["name", "root", "n", "at", "feature"]
                )

    rows = settle(ours.mapInArrow(lean(first_features), "name long, root long, n long, at long, feature long"), "first_features")
    top = rows.groupBy("feature", "root").agg(F.count("*").alias("m")).groupBy("feature").agg(
        F.max(F.struct("m", "root")).getField("root").alias("top"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    rows = settle(rows.join(top.where("low <> high").select("feature", "top"), "feature"), "ranked_features")
    # of a pair the smaller set needs its first features to a ninth (at 80 percent) only
    smaller = rows.where(F.col("at") <= F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)))

    def side(df: DataFrame, mark: str) -> DataFrame:
        return df.select("feature", *[F.col(c).alias(mark + c) for c in ("name", "root", "n", "at")])

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        needed = F.ceil(percent * (F.col("a_n") + F.col("b_n")) / (100 + percent))
        return side(left, "a_").join(side(right, "b_"), "feature").where(
            (F.col("a_root") != F.col("b_root"))
            & (F.struct("a_n", "a_name") < F.struct("b_n", "b_name"))
            & (100 * F.col("a_n") >= percent * F.col("b_n"))
            & (F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) >= needed)
        )

    minor, major = "root <> top", "root = top"
    found = meet(smaller.where(minor), rows).union(meet(smaller.where(major), rows.where(minor)))
    return found.select(F.least("a_name", "b_name").alias("a"), F.greatest("a_name", "b_name").alias("b")).distinct()


def near_duplicates(documents: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Classes of near-duplicates: one row per row of ``documents`` (``doc_id``, ``text``).

    ``n_shingles`` counts the distinct shingles of ``size`` words; a text with fewer
    words is one shingle; without words, or null, it has none, is linked with nothing
    and its class is its own ``doc_id``.  ``component_id`` is the smallest ``doc_id`` of
    all documents that links lead to.  Equal sets count as linked.  Rows without an
    id take part; a class of only such rows has the id null.  Repeated rows each come
    back; further columns are ignored; an empty table gives an empty table.
    """
    named = settle(named_sets(documents, size), "named")
    placed = classes(documents, named, size, percent)
    return placed.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def classes(documents: DataFrame, named: DataFrame, size: int, percent: int) -> DataFrame:
    """``named`` with ``class`` (null for empty sets) and ``component_id``."""
    roots = set_components(documents, named, size, percent)
    rooted = settle(
        named.join(roots, named["name"] == roots["node"], "left")
        .withColumn("class", F.coalesce("root", "name"))
        .drop("node", "root"),
        "rooted",
    )
    # a class of one row needs no look-up; the others are stored, so that the join
    # knows their size and a large class can be split
    least = rooted.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    least = settle(least.where("rows > 1").drop("rows"), "least")
    return rooted.join(least, "class", "left").withColumn("component_id", F.coalesce("least", "doc_id")).drop("least")


def one_of_each(documents: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows, with all their columns, less all but one of each class: the smallest
    ``doc_id`` stays (null last), of its repeated rows one.  Texts without words stay."""
    named = settle(named_sets(documents, size), "named")
    placed = classes(documents, named, size, percent).select("doc_id", "text_hash", "class")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    ours = placed.where("class is not null").withColumn("rank", rank)
    best = ours.groupBy("class").agg(F.min("rank").alias("best"), F.count("*").alias("rows")).where("rows > 1")
    best = settle(best, "best")
    grouped = ours.join(best, "class").select(
        F.col("doc_id").alias("_nd_doc"), F.col("text_hash").alias("_nd_hash"), (F.col("rank") == F.col("best")).alias("_nd_stays")
    )
    grouped = settle(grouped.distinct(), "grouped")
    keyed = documents.withColumn("_nd_own", F.xxhash64(text_or_empty()))
    same = keyed["doc_id"].cast("long").eqNullSafe(grouped["_nd_doc"]) & (keyed["_nd_own"] == grouped["_nd_hash"])
    joined = keyed.join(grouped.hint("shuffle_hash"), same, "left")
    columns = [F.col(f"`{c}`") for c in documents.columns]
    alone = joined.where("_nd_stays is null").select(*columns)
    first = joined.where("_nd_stays").dropDuplicates(["_nd_doc", "_nd_hash"]).select(*columns)
    return alone.unionByName(first)


def op7_partenum_join(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
