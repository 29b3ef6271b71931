"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import remove, written


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One step over edges (u, v) with u > v. Each node's neighbours are tied to the smallest of them and it.

    The minimum is a partial aggregate and the join back may be split by Spark where one node has many neighbours.
    """
    if small:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        both = edges.join(least, "u")
        out = both.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u > v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (u, v), both long; the root is the smallest node that can be reached.

    Loops and repeated edges do no harm. Each round is written to the shared folder, so nothing is computed twice
    and a lost executor costs one round at most; a round's predecessor is deleted. Rounds end when a round changes nothing, some log of the longest path.
    """
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        large = written(_stars(now, False), "large")
        before, now = now, written(_stars(large, True), "small")
        remove(before)
        remove(large)
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("v")).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
