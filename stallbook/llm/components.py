"""Connected components of links that are only known as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.session import settle


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is linked to by any path, for all
    nodes of ``links`` (``a``, ``b``, numbers).

    Every round a node takes the smallest root among its own and its neighbours',
    then its root's root, so paths shrink by half or more; each round is stored.
    """
    both = links.where("a <> b").select("a", "b")
    both = settle(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root"))
    roots = settle(roots, "roots")
    while True:
        seen = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node"))
        least = seen.agg(F.min("root").alias("near"))
        nearer = roots.join(least, "node").select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root")
        )
        nearer = settle(nearer, "nearer")
        jump = nearer.select(F.col("node").alias("root"), F.col("root").alias("far"))
        after = nearer.join(jump, "root", "left").select("node", "old", F.least("root", "far").alias("root"))
        after = settle(after, "roots")
        roots = after.select("node", "root")
        if not after.where("old <> root").limit(1).count():
            return roots
