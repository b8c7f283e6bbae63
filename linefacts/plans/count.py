"""Counting a source tree: scan, boundaries, dedup, claims, ownership, routes, facts, validation, report rows.

Rust files that a package's targets reach are counted with their contexts;
other Rust files are counted whole, with test counts unavailable; everything
else is counted lexically. One physical file has one owner, one route and one
fact. Packages and contexts come from ``configure``, or are left out (then
every file is the root's).
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linefacts.functions import languages
from linefacts.operators import ledger, rust
from linefacts.operators.incremental import POLICY, swept
from linefacts.plans.configure import Configured
from linefacts.sources.tree import TreeSource
from linefacts.sources.workdir import ship, written

ROOT = "<root>"
FACT = ("identity", "scope", "language", "engine", "precision", "files", "lines", "blanks", "comments", "code", "test")
TARGETS = "path string, pkg string, ctx_id int, options array<string>, test boolean, harness boolean"


class CountError(RuntimeError):
    """A tree that can't be counted, or a count that breaks its own rules."""


@dataclass(frozen=True)
class Counted:
    """Facts by scope (a package's id, or ``<root>``), and what there is to warn of."""

    facts: DataFrame
    warnings: list[tuple[str, str]]
    results: DataFrame


def scanned(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the tree source with ``identity``, by way of a work table."""
    ship(spark)
    spark.dataSource.register(TreeSource)
    return written(spark.read.format("tree").load(root).withColumn("identity", F.concat_ws(":", "dev", "ino")), "tree")


def targets_of(spark: SparkSession, root: str, configured: Configured) -> tuple[DataFrame, dict]:
    """(roots of targets in their semantic contexts, what each package's predicates may ask). Contexts that agree within a package are one."""
    inside = lambda p: os.path.relpath(os.path.realpath(p) if not os.path.islink(p) else p, root)
    keys: dict[tuple, int] = {}
    rows, known = set(), {}
    for project in configured.projects:
        for p in project.packages:
            known[p.package.id] = p.names, p.pairs, frozenset(p.package.features)
            for c in p.contexts:
                n = keys.setdefault((p.package.id, c.semantic()), len(keys))
                options = tuple([f"{a}={b}" for a, b in c.options] + list(c.bare))
                rows.add((inside(c.path), p.package.id, n, options, c.provenance == "test", c.harness))
    return spark.createDataFrame([(*r[:3], list(r[3]), *r[4:]) for r in sorted(rows)], TARGETS), known


def counted(spark: SparkSession, root: str, configured: Configured | None = None, root_files: bool = True, cache: DataFrame | None = None) -> Counted:
    """Facts of the tree below ``root``; raises rather than give a part. ``cache``: results of an earlier count."""
    packages = [p for project in configured.projects for p in project.packages] if configured else []
    folder = lambda p: os.path.relpath(p, root).removeprefix(".")  # noqa: E731  (the root's own folder is the empty path)
    roots = spark.createDataFrame([(folder(p.package.folder), p.package.id) for p in packages], "root string, pkg string")
    bounds = [(folder(p.package.folder), True) for p in packages] + [(folder(u), False) for u in (configured.unselected if configured else ())]
    boundaries = spark.createDataFrame(bounds, "root string, selected boolean")
    tree = scanned(spark, root)

    held = ledger.within_selected(tree.where("NOT ignored"), boundaries, "path")
    targets, known = targets_of(spark, root, configured) if configured else (spark.createDataFrame([], TARGETS), {})
    text = F.decode("bytes", "UTF-8")
    if configured and packages:
        files = tree.where(F.col("path").endswith(".rs")).select("path", text.alias("text"), "outside")
        reached = written(rust.reachable_files(files, targets).select("path", "ctx_id").distinct(), "reached")
    else:
        reached = spark.createDataFrame([], "path string, ctx_id int")
    warnings = list(configured.warnings) if configured else []
    warnings += skipped(held, reached, tree, roots, root_files)

    ctx = targets.select("pkg", "ctx_id", "options", "test", "harness").distinct()
    one = F.struct(F.col("ctx_id").cast("int").alias("ctx_id"), "options", "test", "harness")
    claims = written(reached.join(tree.where("problem IS NULL"), "path").join(ctx, "ctx_id").select("identity", "path", "pkg", one.alias("context")), "claims")
    warnings += told(spark, claims, tree, packages, known)

    usable = held.where("problem IS NULL")
    book = usable.groupBy("identity").agg(F.min("path").alias("rep_path"), F.collect_set("path").alias("aliases"), F.min_by("bytes", "path").alias("bytes"))
    more = ledger.reconcile(book.select("identity", "aliases"), claims.select("identity", "path", "pkg")).select("identity", "aliases", "added")
    rest = claims.select("identity", "path").distinct().join(tree.select("path", "bytes"), "path").groupBy("identity").agg(F.min_by("bytes", "path").alias("claimed"))
    book = more.join(book.select("identity", "bytes"), "identity", "left").join(rest, "identity", "left").select("identity", "aliases", F.coalesce("bytes", "claimed").alias("bytes"), F.array_min("aliases").alias("path"))
    owners = ledger.deepest_owner(book.select("identity", F.explode("aliases").alias("path")), roots, "identity")
    scopes = ledger.resolve_scope(book, owners, claims.select("identity", "pkg"))

    empty = [p.package.id for p in packages if not p.package.targets]
    eligible = scopes.where(~F.col("scope").isin(empty)) if empty else scopes
    eligible = eligible if root_files else eligible.where(F.col("scope") != ROOT)
    contexts = claims.groupBy("identity").agg(F.array_sort(F.collect_set("context")).alias("contexts"))
    placed = book.join(eligible, "identity").join(contexts, "identity", "left")
    facts, results = contributions(placed, cache)
    facts = written(facts, "facts")
    wrong = ledger.partition_violations(eligible.select("identity"), facts).limit(1).collect()
    if wrong:
        raise CountError(f"file {wrong[0].identity}: {wrong[0].problem} facts")
    return Counted(facts, sorted(set(warnings)), results)


RESULT = "key string, files long, lines long, blanks long, comments long, code long, test long"


def contributions(placed: DataFrame, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(one fact a file of (identity, path, aliases, bytes, scope, contexts), results by key).

    A result's key is a digest of the content and of all that its route makes
    of it, so equal files are counted once; results in ``cache`` aren't
    counted again, and what nothing asks for leaves it.
    """
    spark = placed.sparkSession
    text = F.decode("bytes", "UTF-8")
    head = F.decode(F.substring("bytes", 1, 128), "ISO-8859-1")
    best = F.filter(F.transform(F.array_sort("aliases"), lambda p: languages.language_of(p, head)), lambda x: x.isNotNull())
    named = placed.withColumn("found", F.get(best, F.lit(0)))
    named = named.withColumn("route", ledger.route(F.col("contexts").isNotNull(), F.col("aliases"), F.col("found").isNotNull())).where("route IS NOT NULL")
    configured, lexical = F.col("route") == "configured-rust", F.col("route") == "lexical"
    semantic = F.transform("contexts", lambda c: F.struct(F.array_sort(c["options"]).alias("o"), c["test"].alias("t"), c["harness"].alias("h")))
    how = F.to_json(F.struct("route", F.when(lexical, F.col("found")).alias("found"), F.array_sort(F.array_distinct(semantic)).alias("contexts")))
    named = written(named.withColumn("key", F.sha2(F.concat_ws("|", F.lit(POLICY), F.sha2("bytes", 256), how), 256)), "named")

    def compute(rows: DataFrame) -> DataFrame:
        # An error names the file; a key stands for it on the way.
        rusty = rust.with_counts(rows.where("route LIKE '%rust'").select(F.concat_ws("\n", "path", "key").alias("path"), text.alias("text"), "contexts"))
        rusty = rusty.withColumn("key", F.substring_index("path", "\n", -1))
        plain = languages.with_lexical_counts(rows.where("route = 'lexical'").select("key", F.col("found").alias("language"), "bytes"))
        plain = plain.withColumn("files", F.lit(1).cast("long")).withColumn("test", F.lit(None).cast("long"))
        cols = ["key", "files", "lines", "blanks", "comments", "code", "test"]
        return rusty.select(*cols).unionByName(plain.select(*cols))

    cache = spark.createDataFrame([], RESULT) if cache is None else cache
    results = written(swept(cache, named, compute, "key"), "results")
    facts = named.select("identity", "scope", "key", "route", "found").join(results, "key")
    facts = facts.withColumn("language", F.when(configured, "Rust").when(lexical, F.col("found")).otherwise("Rust (unconfigured)"))
    facts = facts.withColumn("engine", F.when(lexical, "tokei").otherwise("rust")).withColumn("precision", F.when(configured, "configuration-aware").when(lexical, "lexical").otherwise("unconfigured"))
    return facts.select(*FACT), results


def candidate(path) -> F.Column:
    """Files that may be counted by their names: Rust, a known language, or no extension (then the first line decides)."""
    bare = ~F.element_at(F.split(path, "/"), -1).contains(".")
    return path.endswith(".rs") | languages.is_candidate(path) | bare


def skipped(held: DataFrame, reached: DataFrame, tree: DataFrame, roots: DataFrame, root_files: bool) -> list[tuple[str, str]]:
    """A warning for each file that is left out; one that can't be read but would count raises."""
    bad = held.where("problem IS NOT NULL").where(candidate(F.col("path"))).join(reached.select("path").distinct(), "path", "left_anti")
    owned = ledger.deepest_owner(bad, roots, "path")
    rows = bad.join(owned, "path", "left").select("path", "problem", "detail", "owner").orderBy("path").collect()
    for r in rows:
        if r.problem == "source-unreadable" and (r.owner is not None or root_files):
            raise CountError(f"{r.path}: {r.detail}")
    out = [(r.problem, f"skipped `{r.path}`: {r.detail}") for r in rows]
    links = tree.where("outside").join(reached.select("path").distinct(), "path").select("path", "detail").orderBy("path").collect()
    return out + [("source-symlink-outside-root", f"skipped Rust source symlink `{r.path}` because {r.detail}") for r in links]


def told(spark: SparkSession, claims: DataFrame, tree: DataFrame, packages: list, known: dict) -> list[tuple[str, str]]:
    """Warnings of sources that several packages reach, and of predicates that no modelled option answers."""
    if not packages:
        return []
    by_id = {p.package.id: p.package for p in packages}
    shared = claims.join(ledger.shared_sources(claims), "identity").groupBy("identity").agg(F.min("path").alias("path"), F.array_sort(F.collect_set("pkg")).alias("pkgs")).collect()
    out = []
    for r in shared:
        names = ", ".join(f"`{by_id[i].name}` ({by_id[i].manifest})" for i in r.pkgs)
        out.append(("source-shared-between-packages", f"source `{r.path}` is reachable from selected Packages {names}"))
    each = claims.groupBy("pkg", "path").agg(F.collect_list("context").alias("contexts")).join(tree.select("path", F.decode("bytes", "UTF-8").alias("text")), "path")
    for r in rust.unknown_cfgs(each, known).collect():
        out.append(("unknown-cfg", f"cfg predicate `{r.predicate}` in Package `{by_id[r.pkg].name}` may depend on an unmodeled build script or compiler flag"))
    return out


def scopes_of(spark: SparkSession, root: str, configured: Configured | None) -> DataFrame:
    """(scope, label, name, manifest_path, project_root) of every package and of the root."""
    rows = [(p.package.id, p.package.name, os.path.relpath(p.package.folder, root).removeprefix("."), p.package.manifest, project.project.root) for project in (configured.projects if configured else ()) for p in project.packages]
    named = ledger.qualified_labels(spark.createDataFrame(rows, "id string, name string, qualifier string, manifest_path string, project_root string"))
    out = named.select(F.col("id").alias("scope"), "label", "name", "manifest_path", "project_root")
    return out.unionByName(spark.createDataFrame([(ROOT, ROOT, None, None, None)], out.schema))
