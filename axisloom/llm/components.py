"""Connected components of an edge table, without ever bringing a component together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import drop_stored, stored


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, component`` (the smallest node) for every node with an edge; edges: u, v BIGINT.

    Rounds of large stars and small stars: every node hands its neighbours to the
    smallest of them, until each component is a star around its smallest node.
    Each round is written to the shared folder.  Loops and repeated edges do no harm.
    """
    spark = edges.sparkSession
    u, v = F.col("u"), F.col("v")
    start = edges.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    at, path = stored(start, "edges")
    sign = None
    for _ in range(max_rounds):
        both = at.unionAll(at.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").filter(v > u).select(v.alias("u"), F.least("m", u).alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter(v != F.col("m")).select("v", "m").unionAll(least.select("u", "m"))
        after, new = stored(small.toDF("u", "v").distinct(), "edges")
        now = tuple(after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        drop_stored(spark, path)
        at, path = after, new
        if now == sign:
            return at.select(u.alias("node"), v.alias("component")).unionAll(
                at.select(v.alias("node"), v.alias("component")).distinct()
            )
        sign = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
