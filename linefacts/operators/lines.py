"""Lines, spans and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linefacts.functions.text import lines_of

#: Offsets in a bin of the overlap join.
BIN = 64


def exploded(files: DataFrame, text: str = "text") -> DataFrame:
    """A row for each physical line: line_no from 1, line."""
    return files.select("*", F.posexplode(lines_of(F.col(text))).alias("at__", "line")).withColumn("line_no", F.col("at__") + 1).drop("at__", text)


def with_offsets(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, start, end) in bytes; the end leaves out the line feed. Lengths of lines summed within the file: texts don't move."""
    rows = files.withColumn("file__", F.monotonically_increasing_id()).select(key, "file__", F.posexplode(lines_of(F.col(text))).alias("at__", "line__"))
    rows = rows.select(key, "file__", (F.col("at__") + 1).alias("line_no"), F.octet_length("line__").cast("long").alias("n__"))
    ahead = Window.partitionBy("file__").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n__") + 1).over(ahead), F.lit(0)).cast("long")
    return rows.withColumn("start", start).select(key, "line_no", "start", (F.col("start") + F.col("n__")).alias("end"))


def classified(line: Column, opener: str) -> Column:
    """blank, comment or code of one line, by what it begins with."""
    return F.when(F.trim(line) == "", "blank").when(F.ltrim(line).startswith(opener), "comment").otherwise("code")


def context_bits(rows: DataFrame, key: str, ctx: str, of: Column | None = None) -> DataFrame:
    """(key, word, any, none) of the contexts in the rows, as bits: 63 contexts a word, any number of words; ``any``: those that some row has, ``none``: those of the mask ``of`` that no row has."""
    word, bit = F.floor(F.col(ctx) / 63), F.expr(f"shiftleft(CAST(1 AS BIGINT), CAST({ctx} % 63 AS INT))")
    mask = F.lit((1 << 63) - 1) if of is None else of
    return rows.groupBy(key, word.alias("word")).agg(F.bit_or(bit).alias("any"), F.bit_and(mask.cast("long") - bit).alias("none"))


def production_wins(flags: DataFrame, *key: str) -> DataFrame:
    """Line flags (production, blank, comment, code) of several contexts joined by line: code of production, else test."""
    return flags.groupBy(*key).agg(
        F.bool_or("blank").alias("blank"),
        F.bool_or("comment").alias("comment"),
        F.bool_or(F.col("code") & F.col("production")).alias("is_code"),
        F.bool_or(F.col("code") & ~F.col("production")).alias("t"),
    ).select(*key, "blank", "comment", "is_code", (F.col("t") & ~F.col("is_code")).alias("is_test"))


def counted(lines: DataFrame, *key: str) -> DataFrame:
    """lines, blanks, comments, code, test of each key from ``production_wins``."""
    any_ = F.col("blank") | F.col("comment") | F.col("is_code") | F.col("is_test")
    return lines.groupBy(*key).agg(F.count_if(any_).alias("lines"), F.count_if("blank").alias("blanks"), F.count_if("comment").alias("comments"), F.count_if("is_code").alias("code"), F.count_if("is_test").alias("test"))


def active_spans(inactive: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Maximal spans of each (key, ctx) outside its inactive ranges [start, end) of a file of ``size`` bytes: a sweep over +1/-1 events."""
    part = [key, "ctx"]
    marks = files.select(*part, F.inline(F.array(F.struct(F.lit(0).cast("long").alias("off"), F.lit(0).alias("d")), F.struct(F.col("size").cast("long").alias("off"), F.lit(0).alias("d")))))
    ends = F.array(F.struct(F.col("start").cast("long").alias("off"), F.lit(1).alias("d")), F.struct(F.col("end").cast("long").alias("off"), F.lit(-1).alias("d")))
    events = inactive.select(*part, F.inline(ends)).unionByName(marks)
    w = Window.partitionBy(*part).orderBy("off")
    swept = events.groupBy(*part, "off").agg(F.sum("d").alias("d")).withColumn("depth", F.sum("d").over(w)).withColumn("end", F.lead("off").over(w))
    open_ = swept.where(F.col("end").isNotNull() & (F.col("end") > F.col("off")) & (F.col("depth") == 0))
    # Spans that touch are one.
    fresh = F.when(F.lag("end").over(w).eqNullSafe(F.col("off")), 0).otherwise(1)
    runs = open_.withColumn("new", fresh).withColumn("run", F.sum("new").over(w))
    return runs.groupBy(*part, "run").agg(F.min("off").alias("start"), F.max("end").alias("end")).drop("run")


def overlaps(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """Pairs of spans of one key that overlap: an equi-join on the key and on bins of ``BIN`` offsets that both touch; a pair is told in the bin where its overlap begins."""
    binned = lambda df: df.where(F.col("start") < F.col("end")).withColumn("bin__", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN))))
    start, end = F.greatest("l.start", "r.start"), F.least("l.end", "r.end")
    on = (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l.bin__") == F.col("r.bin__")) & (F.col("l.start") < F.col("r.end")) & (F.col("r.start") < F.col("l.end")) & (F.floor(start / BIN) == F.col("l.bin__"))
    return binned(left).alias("l").join(binned(right).alias("r"), on).select(F.col(f"l.{key}").alias(key), F.col(f"l.{left_id}").alias(left_id), F.col(f"r.{right_id}").alias(right_id), start.alias("start"), end.alias("end"))


def touched_lines(spans: DataFrame, first: str = "first_line", last: str = "last_line") -> DataFrame:
    """A row for each line that a span touches."""
    return spans.withColumn("line_no", F.explode(F.sequence(first, last)))
