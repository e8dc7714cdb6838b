"""Connected components by distributed union-find: large-star and small-star rounds over an edge table.

Every round is one table written to the shared folder, so a lost executor costs one round at most. Nodes are
bigint; the root of a component is its smallest node. Degrees of hub nodes are reduced by map-side minima, and
the joins are plain equi-joins that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import Scratch, growing


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(growing(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    out = edges.join(growing(least), "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.union(least.select("a", F.col("m").alias("b")))


def roots(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node but the roots themselves. Null ends and loops are left out."""
    now = scratch.write(
        edges.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b"))
        .distinct(),
        "edges",
    )
    seen = _signature(now)
    while seen[0]:
        new = scratch.write(_small_star(_large_star(now)).distinct(), "edges")
        got = _signature(new)
        scratch.drop(now)
        now = new
        if got == seen:
            break
        seen = got
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
