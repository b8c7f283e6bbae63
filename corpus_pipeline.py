"""Corpus preparation in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession

from linefacts.llm._shared import drop, made, ship, written
from linefacts.llm.mixing import mixed
from linefacts.llm.near_duplicates import one_of_each
from linefacts.llm.packing import pack_documents
from linefacts.llm.quality import cleaned
from linefacts.llm.suffix_dedup import deduplicated


#: Pieces that a tokenizing worker keeps: fewer than alone, since the stages before have filled the executors' heaps.
KNOWN = 500_000
#: Work tables that a stage's result was read from, by the stage's name.
_left: dict[str, list[str]] = {}


def stage(f, after: str | None = None):
    """A stage: it first drops the work tables of the stage before, whose result has been written by then; not if ``docs`` still reads them."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        old = _left.pop(after, [])
        if old and not any(p.split("://")[-1].lstrip("/") in x for x in docs.inputFiles() for p in old):
            drop(spark, old)
        before = len(made())
        out = f(spark, docs, sf_dir)
        _left[f.__name__] = made()[before:]
        return out

    return run


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without lines that very many documents of their host hold."""
    return cleaned(docs)


@partial(stage, after="quality_rules")
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with word 5-gram similarity of 0.8 or more."""
    return one_of_each(docs)


@partial(stage, after="near_duplicates")
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that stand anywhere else too."""
    return deduplicated(docs)


@partial(stage, after="repeated_strings")
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shard after shard, shuffled within each."""
    return mixed(docs).select(*docs.columns)


@partial(stage, after="source_mix")
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences and places."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), known=KNOWN)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", packing),
]
#: SQL can't express hashed draws, token ids or packing; tests/llm has brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
