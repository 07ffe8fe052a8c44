"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buzzlens.session import shared_dir


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node``, ``root`` for every node of an edge: the smallest node it can reach.

    ``edges`` has two bigint columns ``a``, ``b``; loops and repeats are
    harmless, no edges give no rows. Alternating star operations: each node
    first hands its larger neighbours, then all its neighbours, to the smallest
    one, until nothing changes (about log2 of the longest path in rounds). Each
    round's edges are checkpointed in the shared folder, and a star with very
    many leaves is a join key that Spark can split, never one group.
    """
    shared_dir(edges.sparkSession)

    def state(df: DataFrame):
        row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        return row["n"], row["x"]

    # Larger node first from here on.
    now = (
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
        .checkpoint()
    )
    before = state(now)
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = (
            small.filter("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .distinct()
            .checkpoint()
        )
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
