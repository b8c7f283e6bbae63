"""Sums of line counts by scope and language, and the order of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linefacts.functions.text import checked_sum, poisoning_sum

MEASURES = ("files", "lines", "blanks", "comments", "code")


def summed(facts: DataFrame, *keys: str) -> DataFrame:
    """Checked sums; ``test`` is unavailable if any part is."""
    sums = [checked_sum(F.col(m)).alias(m) for m in MEASURES] + [poisoning_sum(F.col("test")).alias("test")]
    return facts.groupBy(*keys).agg(*sums) if keys else facts.agg(*(F.coalesce(checked_sum(F.col(m)), F.lit(0)).alias(m) for m in MEASURES), sums[-1])


def package_rows(rust: DataFrame, lexical: DataFrame) -> DataFrame:
    """Report rows of counts that are a package's already: (scope, measures, test) of Rust, and (scope, language, measures) of the rest, whose test is unavailable."""
    one = rust.withColumn("language", F.lit("Rust")).select("scope", "language", *MEASURES, "test")
    rest = lexical.withColumn("test", F.lit(None).cast("long")).select("scope", "language", *MEASURES, "test")
    return summed(one.unionByName(rest), "scope", "language")


def percentiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, p50, p95, peak, n) by nearest rank."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")
    return rows.groupBy(key).agg(p(0.5).alias("p50"), p(0.95).alias("p95"), F.max(value).alias("peak"), F.count(F.lit(1)).alias("n"))


def united(*warnings: DataFrame) -> DataFrame:
    """Warnings (code, message) of all phases, in order."""
    out = warnings[0]
    for w in warnings[1:]:
        out = out.unionByName(w)
    return out.orderBy("code", "message")


def with_scope_totals(rows: DataFrame) -> DataFrame:
    return rows.withColumn("scope_lines", F.sum("lines").over(Window.partitionBy("scope")))


def report_order(rows: DataFrame) -> DataFrame:
    """Largest scope first; within a scope the most lines first; ties by language key in byte order: Rust's key is in lower case. ``pos`` counts from 1.

    Report rows are few (scopes times languages), whatever the corpus.
    """
    key = F.when(F.col("language") == "Rust", "rust").when(F.col("language") == "Rust (unconfigured)", "rust-unconfigured").otherwise(F.col("language"))
    order = [F.col("scope_lines").desc(), F.col("scope"), F.col("lines").desc(), key]
    out = with_scope_totals(rows)
    return out.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def first_row_labels(ordered: DataFrame) -> DataFrame:
    """The scope's label on its first row only."""
    before = F.lag("scope").over(Window.orderBy("pos"))
    return ordered.withColumn("label", F.when(before.eqNullSafe(F.col("scope")), F.lit("")).otherwise(F.col("scope")))


def with_total(rows: DataFrame) -> DataFrame:
    """Report rows and one row for all of them; all zeros if there are none."""
    total = summed(rows).select(F.lit("Total").alias("scope"), F.lit("All").alias("language"), *MEASURES, "test")
    return rows.select("scope", "language", *MEASURES, "test").unionByName(total)
