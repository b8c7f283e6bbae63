"""Reachability over a directed graph of modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linefacts.sources.workdir import drop, written

#: Rounds after which the tables of what is seen become one.
ROUNDS = 8


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(root, node): what each (root, node) seed reaches over (src, dst) edges, cycles included.

    A semi-naive fixpoint: each round joins only the frontier, and what is new
    is written to the shared folder, so rounds don't pile up lineage; edges are
    distinct once, and after ``ROUNDS`` rounds what is seen is one table again.
    """
    edges = written(edges.select("src", "dst").distinct(), "reach-edges")
    seen = frontier = written(seeds.select("root", "node").distinct(), "reach")
    old: list[str] = []
    n = 0
    while frontier.limit(1).count():
        step = frontier.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        frontier = written(step.join(seen, ["root", "node"], "left_anti"), "reach")
        seen, n = seen.unionByName(frontier), n + 1
        if n % ROUNDS == 0:
            before, seen = seen, written(seen, "reach-seen")
            frontier = written(frontier, "reach")  # of a table of its own, so that the old ones can go
            old = sorted({f.rsplit("/", 1)[0] for f in before.inputFiles()})
            drop(seeds.sparkSession, old)
    return seen


def module_files(declared: DataFrame, files: DataFrame) -> DataFrame:
    """Where each external module (id, base, name, explicit) lives: ``base/name.rs`` or ``base/name/mod.rs``; both or none is an error.

    An explicit path is looked up alone. (id, path, problem)
    """
    known = files.select(F.col("path").alias("found")).distinct()
    flat = declared.withColumn("a", F.coalesce("explicit", F.concat_ws("/", "base", F.concat("name", F.lit(".rs"))))).withColumn("b", F.when(F.col("explicit").isNull(), F.concat_ws("/", "base", "name", F.lit("mod.rs"))))
    a, b = known.select(F.col("found").alias("fa")), known.select(F.col("found").alias("fb"))
    held = flat.join(a, F.col("a") == F.col("fa"), "left").join(b, F.col("b") == F.col("fb"), "left")
    problem = F.when(F.col("fa").isNotNull() & F.col("fb").isNotNull(), "ambiguous").when(F.col("fa").isNull() & F.col("fb").isNull(), "not-found")
    return held.select("id", F.when(problem.isNull(), F.coalesce("fa", "fb")).alias("path"), problem.alias("problem"))
