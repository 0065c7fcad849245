"""Key-based upsert and comparison of two versions of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallbook.operators.keys import match_keys
from stallbook.operators.quality import dedupe, repeated_keys
from stallbook.session import settle


def one_of_each(new: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ()) -> DataFrame:
    """The rows of a batch with one row per key: the last by ``order``; without an order a
    repeated key is refused with an error.  A key with a null matches nothing, so it may repeat.
    """
    if order:
        last = [(F.col(c) if isinstance(c, str) else c).desc_nulls_last() for c in order]
        whole = reduce(and_, [F.col(k).isNotNull() for k in keys])
        return dedupe(new.filter(whole), keys, last).union(new.filter(~whole))
    found = repeated_keys(new, keys).select(*keys).first()
    if found:
        raise ValueError(f"the key {found.asDict()} comes more than once; an order says which row counts")
    return new


def upsert(
    old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ()
) -> DataFrame:
    """New rows plus the old rows whose key is not among them.

    Columns only one side has are kept, null on the other side.  Of repeated keys among the
    new rows the last by ``order`` counts (:func:`one_of_each`).
    """
    return replace_rows(old, one_of_each(new, keys, order), keys)


def replace_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for rows whose keys are known not to repeat."""
    kept = old.join(new.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def append_evolving(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append; columns that are new or missing are filled with null."""
    return old.unionByName(new, allowMissingColumns=True)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inserted, updated and deleted rows between two versions.

    Updates and inserts carry the new values, deletes the old ones; ``copies``
    says how often the row was added or removed.  A column that only one version
    has is null in the other, so a row that had a value there has changed.

    What is shuffled of unchanged rows is their key and a hash of 128 bits.  Equal
    rows cancel out in aggregates, so nothing is paired up and a repeated or null
    key cannot multiply.  Only rows of keys with a hash left over are read whole,
    compared whole and looked at by key.
    """
    columns = [*new.columns, *[c for c in old.columns if c not in new.columns]]
    absent = {c: (new if c in new.columns else old).schema[c].dataType for c in columns}

    def side(df: DataFrame, sign: int) -> DataFrame:
        whole = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(absent[c]).alias(c) for c in columns])
        return whole.withColumn("_sign", F.lit(sign))

    both = side(new, 1).union(side(old, -1))
    values = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    marks = [F.xxhash64(F.lit(i), *values).alias(f"_hash_{i}") for i in range(2)]
    left_over = both.select(*keys, *marks, "_sign").groupBy(*keys, "_hash_0", "_hash_1").agg(F.sum("_sign").alias("_n"))
    # hashes are taken once; rows of a changed key that are equal on both sides cancel out below
    left_over = settle(left_over.filter("_n <> 0").select(*keys).distinct(), "changed_keys")
    whole = match_keys(both, left_over, keys, "left_semi").groupBy(*columns).agg(F.sum("_sign").alias("_n"))
    changed = settle(whole.filter(F.col("_n") != 0), "changed_rows")
    on_both = (
        changed.groupBy(*keys)
        .agg(F.bool_or(F.col("_n") > 0).alias("added"), F.bool_or(F.col("_n") < 0).alias("removed"))
        .filter("added AND removed")
        .select(*keys, F.lit(True).alias("_both"))
    )
    updated = F.coalesce("_both", F.lit(False))
    return (
        match_keys(changed, on_both, keys, "left")
        .filter(~updated | (F.col("_n") > 0))
        .withColumn(
            "change",
            F.when(updated, "update").when(F.col("_n") > 0, "insert").otherwise("delete"),
        )
        .select(*columns, "change", F.abs("_n").alias("copies"))
    )
