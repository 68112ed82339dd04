"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node for every node that has a link.

    ``edges`` has two long columns ``a`` and ``b``; repeated rows, loops and either direction are allowed,
    rows with a null are ignored. Returns ``node``, ``component`` for the nodes of proper links. Each step is a
    partially aggregated minimum and an equi-join that adaptive execution may split, and is written to the shared
    folder, so that a lost executor costs one step at most. Stars are stable once every node points at the
    smallest node of its component, which takes a logarithmic number of rounds.
    """
    current = staged(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        current = staged(_small_star(_large_star(current).distinct()).distinct(), "links")
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
