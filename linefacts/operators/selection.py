"""Packages, targets, contexts and features that a request selects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def glob_pattern(glob: str) -> str:
    """A regular expression for a target-name glob with * and ? and [...]."""
    out, inside = "", False
    for c in glob:
        if inside:
            out += "\\" + c if c in "\\[&~" else c
            inside = c != "]"
        elif c == "[":
            out, inside = out + c, True
        else:
            out += {"*": ".*", "?": "."}.get(c, c if c.isalnum() or c == "_" else "\\" + c)
    return "^" + out.replace("[!", "[^") + "$"


def selected(packages: DataFrame, wanted: DataFrame, excluded: DataFrame) -> DataFrame:
    """(id): the union of members and resolved selectors, less exclusions."""
    return packages.select("id").union(wanted.select("id")).distinct().join(excluded, "id", "left_anti")


def members(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """The rows whose id is among ``ids``."""
    return rows.join(ids, on, "left_semi")


def with_contexts(targets: DataFrame, contexts_: DataFrame, *on: str) -> DataFrame:
    """Targets with the contexts that agree on the given columns."""
    return targets.join(contexts_, list(on))


def unmatched(requests: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Requests that nothing matches."""
    return requests.join(known, on, "left_anti")


def contexts(targets: DataFrame, triples: DataFrame) -> DataFrame:
    """Build contexts (target, kind, triple, role, provenance): host for build scripts and proc macros, else the triple.

    Provenance is production unless the context is a test or a bench. Both
    sides are small; each target meets each triple.
    """
    role = F.when((F.col("kind") == "build-script") | (F.col("crate_type") == "proc-macro"), "host").otherwise("target")
    provenance = F.when(F.col("context") == "production", "production").otherwise("test")
    return targets.crossJoin(F.broadcast(triples)).select("target", "kind", F.when(role == "host", F.lit("host")).otherwise(F.col("triple")).alias("triple"), role.alias("role"), provenance.alias("provenance")).distinct()


def interned(contexts_: DataFrame, part: str, *key: str) -> DataFrame:
    """Semantic contexts: distinct keys numbered from 0 within ``part``."""
    one = contexts_.select(part, *key).distinct()
    return one.withColumn("ctx_id", F.dense_rank().over(Window.partitionBy(part).orderBy(*key)) - 1)


def missing_features(required: Column, enabled: Column) -> Column:
    return F.array_sort(F.array_except(required, enabled))


def eligible(required: Column, enabled: Column) -> Column:
    return F.size(F.array_except(required, enabled)) == 0


def requested_features(requests: DataFrame, packages: DataFrame) -> DataFrame:
    """(request, id) for requests ``feature`` or ``package/feature``; id null where no package declares it."""
    has = F.col("request").contains("/")
    r = requests.withColumn("pkg", F.when(has, F.substring_index("request", "/", 1))).withColumn("feature", F.substring_index("request", "/", -1))
    p = packages.select("id", "name", F.explode("features").alias("feature"))
    out = r.alias("r").join(p.alias("p"), (F.col("r.feature") == F.col("p.feature")) & (F.col("r.pkg").isNull() | (F.col("r.pkg") == F.col("p.name"))), "left")
    return out.select("r.request", "p.id")


def less_exclusions(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """(target, kind, contexts array) less rules (kind, name): a bare test or bench takes that context from all targets; another bare kind, or a named one, takes the target."""
    bare = rules.where("name IS NULL AND kind IN ('test', 'bench')").agg(F.collect_set("kind").alias("gone")).select(F.coalesce("gone", F.array().cast("array<string>")).alias("gone"))
    kept = targets.crossJoin(F.broadcast(bare)).withColumn("contexts", F.array_except("contexts", "gone")).drop("gone")  # one row
    kinds = rules.where("name IS NULL AND kind NOT IN ('test', 'bench')").select("kind")
    named = rules.where("name IS NOT NULL").select("kind", F.col("name").alias("target"))
    return kept.join(kinds, "kind", "left_anti").join(named, ["kind", "target"], "left_anti").where(F.size("contexts") > 0)
