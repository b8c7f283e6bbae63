"""Incremental refresh: changed files arrive in rounds, each replaces its earlier fact.

The facts of all rounds are an append-only table read as a stream with
``Trigger.AvailableNow``; what stands is the last round's fact of each file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linefacts.sources.workdir import new_path


def refreshed(spark: SparkSession, rounds: list[DataFrame]) -> DataFrame:
    """(scope, language, lines, files) after all rounds of (doc_id, scope, language, lines)."""
    root = new_path(spark, "refresh")
    for n, r in enumerate(rounds):
        r.withColumn("round", F.lit(n)).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema("doc_id long, scope string, language string, lines long, round int").parquet(f"{root}/in")
        q = stream.writeStream.format("parquet").option("path", f"{root}/facts").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
        q.awaitTermination()
    facts = spark.read.parquet(f"{root}/facts")
    last = facts.groupBy("doc_id").agg(F.max_by(F.struct("scope", "language", "lines"), "round").alias("f"))
    return last.groupBy("f.scope", "f.language").agg(F.sum("f.lines").alias("lines"), F.count(F.lit(1)).alias("files"))
