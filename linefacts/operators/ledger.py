"""One row a physical file, and who owns it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linefacts.functions.text import ancestors, sanitized


def dedup(files: DataFrame, identity: str = "identity", path: str = "path", *carried: str, least: tuple[str, ...] = ()) -> DataFrame:
    """(identity, rep_path, aliases, n_aliases, carried...): aliases are merged before anything costly; the smallest path represents them. Of ``least`` each column's smallest value stays."""
    best = [F.min_by(c, path).alias(c) for c in carried] + [F.min(c).alias(c) for c in least]
    return files.groupBy(identity).agg(F.min(path).alias("rep_path"), F.array_sort(F.collect_set(path)).alias("aliases"), F.count(F.lit(1)).alias("n_aliases"), *best)


def reconcile(ledger: DataFrame, claims: DataFrame) -> DataFrame:
    """Full outer join of (identity, aliases) and (identity, path, pkg) claims: claimed files that the scan ignored come in, known ones gain an alias."""
    one = claims.groupBy("identity").agg(F.array_sort(F.collect_set("path")).alias("claimed"), F.array_sort(F.collect_set("pkg")).alias("pkgs"))
    none = F.array().cast("array<string>")
    both = ledger.join(one, "identity", "full_outer")
    return both.select("identity", F.array_sort(F.array_union(F.coalesce("aliases", none), F.coalesce("claimed", none))).alias("aliases"), F.coalesce("pkgs", none).alias("pkgs"), F.col("aliases").isNull().alias("added"))


def containing(files: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """Every (file, root above it), as an equi-join on exploded ancestors: no nested loop, whatever the number of roots.

    A root's depth is its number of components; the empty path is above all.
    """
    up = files.withColumn("up__", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col(path)))))
    return up.join(roots, F.col("up__") == F.col(root)).withColumn("depth", F.when(F.col(root) == "", 0).otherwise(F.size(F.split(root, "/")))).drop("up__")


def deepest_owner(files: DataFrame, roots: DataFrame, key: str, path: str = "path", root: str = "root", pkg: str = "pkg") -> DataFrame:
    """(key, owner) of files below some root: the deepest root's package, of equally deep ones the smallest."""
    held = containing(files, roots, path, root)
    return held.groupBy(key).agg(F.min(F.struct((-F.col("depth")).alias("d"), F.col(pkg).alias("p"))).alias("b")).select(key, F.col("b.p").alias("owner"))


def resolve_scope(ledger: DataFrame, owners: DataFrame, claims: DataFrame, key: str = "identity") -> DataFrame:
    """(key, scope): the deepest owner, else the sole claimant, else ``<root>``."""
    sole = claims.groupBy(key).agg(F.count_distinct("pkg").alias("n"), F.min("pkg").alias("sole")).where("n = 1")
    return ledger.join(owners, key, "left").join(sole, key, "left").select(key, F.coalesce("owner", "sole", F.lit("<root>")).alias("scope"))


def within_selected(files: DataFrame, boundaries: DataFrame, key: str) -> DataFrame:
    """Drops files whose nearest boundary (root, selected) is unselected; files below none stay."""
    near = containing(files, boundaries).groupBy(key).agg(F.max_by("selected", "depth").alias("selected"))
    return files.join(near.where("NOT selected"), key, "left_anti")


def partition_violations(ledger: DataFrame, contributions: DataFrame) -> DataFrame:
    """(identity, problem): contributions of unknown identities, identities with several, and ones that aren't of one file."""
    unknown = contributions.join(ledger, "identity", "left_anti").select("identity", F.lit("unknown").alias("problem")).distinct()
    several = contributions.groupBy("identity").agg(F.count(F.lit(1)).alias("n"), F.sum("files").alias("f"))
    return unknown.unionByName(several.where("n > 1").select("identity", F.lit("duplicate").alias("problem"))).unionByName(several.where("n = 1 AND f <> 1").select("identity", F.lit("files").alias("problem")))


def shared_sources(claims: DataFrame, key: str = "identity", pkg: str = "pkg") -> DataFrame:
    """Identities that several packages claim."""
    return claims.groupBy(key).agg(F.count_distinct(pkg).alias("n_pkgs")).where("n_pkgs > 1")


def route(claimed: Column, aliases: Column, recognized: Column) -> Column:
    """Configured Rust if claimed, else unconfigured Rust if any alias ends so, else lexical if recognized; null: no contribution."""
    return F.when(claimed, "configured-rust").when(F.exists(aliases, lambda a: a.endswith(".rs")), "unconfigured-rust").when(recognized, "lexical")


def qualified_labels(scopes: DataFrame) -> DataFrame:
    """(id, name, qualifier) plus label: the name, qualified where several ids have it; then told apart by id where labels still look alike."""
    named = Window.partitionBy("name")
    ids = F.size(F.collect_set("id").over(named))
    label = F.when(ids > 1, F.concat("name", F.lit(" ("), F.coalesce(F.nullif(F.col("qualifier"), F.lit("")), "id"), F.lit(")"))).otherwise(F.col("name"))
    out = scopes.withColumn("label", label)
    seen = out.withColumn("shown", sanitized(F.col("label")))
    alike = F.size(F.collect_set("id").over(Window.partitionBy("shown")))
    return seen.withColumn("label", F.when(alike > 1, F.concat("shown", F.lit(" [scope:package:"), F.hex(F.col("id")), F.lit("]"))).otherwise(F.col("label"))).drop("shown")


def package_projection(files: DataFrame, packages: DataFrame, manifests: DataFrame) -> DataFrame:
    """(path, owner) of files that aren't Rust: the deepest package (root, pkg) above, unless a folder between it and the file has a manifest (folder) of its own."""
    held = containing(files.where(~F.col("path").endswith(".rs")), packages)
    owned = held.groupBy("path").agg(F.min(F.struct((-F.col("depth")).alias("d"), F.col("pkg").alias("p"))).alias("b"))
    nested = containing(owned, manifests.select(F.col("folder").alias("root"))).where(F.col("depth") > -F.col("b.d"))
    return owned.join(nested.select("path"), "path", "left_anti").select("path", F.col("b.p").alias("owner"))
