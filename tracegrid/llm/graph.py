"""Connected components of a large graph, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.operators.storage import materialize

# Far above the rounds any graph needs: their number grows with the logarithm of the longest path.
MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """The nodes of ``a`` - ``b`` edges as ``node``, ``component`` (its smallest node).

    Alternates two steps that keep components as they are: every node hangs its
    larger neighbours on its smallest one, then every node hangs itself and its
    smaller neighbours on the smallest. Both are an aggregate, combined before
    the shuffle, and a join that is unique on one side, so a node with very many
    neighbours is split like any other skewed key. Each round is written to the
    shared folder; what travels to the driver is one count.
    """
    a, b = F.col("a"), F.col("b")
    tree = materialize(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = tree.unionByName(tree.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(a, F.min("b")).alias("m")).select(a.alias("node"), "m")
        large = both.where(b > a).join(least, a == F.col("node")).select(b.alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(a.alias("node"), "m")
        joined = large.join(least, a == F.col("node"))
        small = joined.where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        tree = materialize(small.unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct())
        # A forest of stars is reached when a round leaves the edges as they are.
        now = tree.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = tree.select(b.alias("node"), b.alias("component")).distinct()
    return tree.select(a.alias("node"), b.alias("component")).unionByName(roots)
