"""What changed between two manifests, and fingerprints of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Raised whenever a rule that results depend on changes.
POLICY = "1"


def manifest_diff(before: DataFrame, after: DataFrame, key: str = "path", stamp: str = "stamp") -> DataFrame:
    """(key, change): added, removed, changed or unchanged."""
    b, a = before.select(key, F.col(stamp).alias("b__"), F.lit(True).alias("had")), after.select(key, F.col(stamp).alias("a__"), F.lit(True).alias("has"))
    change = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").when(F.col("a__").eqNullSafe(F.col("b__")), "unchanged").otherwise("changed")
    return b.join(a, key, "full_outer").select(key, change.alias("change"))


def fingerprint(files: DataFrame, path: str, content: str, *more: str) -> DataFrame:
    """One digest of all (path, content): sums of the parts of each file's digest, so that partial sums do the work and order doesn't matter."""
    one = F.sha2(F.concat_ws("\x00", F.length(path).cast("string"), path, F.sha2(F.coalesce(content, F.lit("")), 256)), 256)
    part = lambda i: F.sum(F.conv(F.substring("d", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    told = files.select(one.alias("d")).agg(F.count(F.lit(1)).cast("string").alias("n"), *(part(i).alias(f"p{i}") for i in range(4)))
    return told.select(F.sha2(F.concat_ws("|", F.lit(POLICY), *map(F.lit, more), "n", "p0", "p1", "p2", "p3"), 256).alias("fingerprint"))


def reusable(cache: DataFrame, now: DataFrame) -> DataFrame:
    """Cached results whose digest is still that of the input."""
    return cache.join(now, ["path", "digest"], "left_semi")


def dependencies(*sets: DataFrame) -> DataFrame:
    """The union of the paths that several results depend on."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.distinct()


def swept(cache: DataFrame, now: DataFrame, compute, *key: str) -> DataFrame:
    """The results of ``now``, which is the next cache too: marked are the keys that ``now`` asks for, what isn't is swept; only keys that the cache lacks are computed.

    Equal keys are computed once. ``compute`` gives a row for each distinct key.
    """
    asked = now.dropDuplicates(list(key))
    kept = cache.join(asked.select(*key), list(key), "left_semi")
    return kept.unionByName(compute(asked.join(cache.select(*key), list(key), "left_anti")).select(*cache.columns))
