"""Connected components of a graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linefacts.llm._shared import written


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of each vertex of ``edges`` (a long, b long); root is the component's smallest vertex.

    Each round is two joins on a vertex; a vertex with very many neighbours is
    reduced by partial minima and its rows can be split by adaptive execution.
    Rounds are written out, so a lost executor costs one round at most.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = written(small, "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(e.select(F.col("v"), F.col("v").alias("root")).distinct())
