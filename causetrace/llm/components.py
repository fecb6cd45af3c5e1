"""Connected components with DataFrame operations only: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causetrace.llm.common import stage, unstage


def _fingerprint(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge set: two longs, whatever the size."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every node that has a link.

    ``edges`` holds columns ``a`` and ``b`` (of one type that has an order: longs, or structs of them; any order, repeats and self links allowed;
    a link with a null end is none). Returns ``node, component`` where component is the smallest node id of the component; nodes
    without a link to another node are absent. An empty input gives an empty result.

    Each round replaces links by links to the smallest neighbour (large-star), then to the smallest
    smaller neighbour (small-star); the set shrinks to one star per component in a number of rounds
    that grows with the logarithm of the component size. Neighbour minima are partial aggregates, and
    rows meet them in sort-merge joins that adaptive execution can split, so a hub does not sit in one task.
    """
    now = stage(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    mark = _fingerprint(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select("u", "v", "m")
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        then = stage(small, "small")
        unstage(large)
        seen, mark = mark, _fingerprint(then)
        unstage(now)
        now = then
        if mark == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
