"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree; DataFrame functions only.

1. Targets: weights share out ``share`` of all sizes; a source's target stops
   at ``cap`` times its size and the excess is shared again (water-filling, in
   closed form over the sources).
2. Blocks: a hash of the document deals each source's documents to blocks of
   about ``BLOCK``, a random permutation that reruns repeat. A target takes
   whole passes over the source, and of one more pass a quota of blocks: as
   many as fit even if they were the source's longest. Quotas are exact
   integers.
3. Splitting tree: the quotas of all sources, those of whole passes and those
   of the last pass, are split between the two halves of the output shards,
   and so on down to single shards. A node's split is a draw from the
   multivariate hypergeometric distribution (one quota after another, each a
   hypergeometric draw given what is left), as if all blocks had been shuffled
   and cut; the counts add up exactly.
4. Draws: a shard's quota of whole passes is a range of them. Its quota of the
   last pass is drawn from its own range of the source's permuted blocks, cut
   in proportion to the quotas of the shards, those with the smallest hashes
   within the range first. So draws are disjoint, and which documents a source
   gives in its last pass is what the tree's quotas say.
5. What the quota leaves of a target (blocks differ in words) is filled with
   blocks that nothing drew, in their permuted order, and of the next ``PICK``
   with the documents that still fit, longest first. A second tree deals those
   to the shards.
6. Each shard orders its rows by a hash: ``place``.

Sources are a dimension: their quotas travel as one array a tree node. Blocks
of one hot source are numbered and summed by strips of ``STRIP`` blocks, so
nothing but a row a strip meets by source.

Cases: null text has size 0. Null source is a source of its own, last in order.
Null or repeated doc_ids are rows of their own; fully equal rows share one
entry with a count and are told apart only at the end. A source without words
has target 0. No rows: no rows. Columns of the input whose names clash with
the result's are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linefacts.llm._shared import written

WORD = r"[^\x20\x09-\x0D]+"
#: Documents in a block, on average; blocks in a strip.
BLOCK, STRIP = 8, 1024
#: Blocks from which documents are picked one by one, of each source.
PICK = 8
#: Output shards, at least; more if one would hold more than so many words.
SHARDS, SHARD_WORDS = 64, 20_000_000
#: Levels of the tree that one task grows; those below are grown by many.
ALONE = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row for each source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(cap))
    all_, upto = Window.partitionBy(), Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(all_) * F.lit(share)
    # What a unit of weight would get if all before this one were capped.
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("total", total).withColumn("full", F.col("most") <= F.col("w") * level)
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(all_), F.lit(0.0))
    open_ = F.sum(F.when(~F.col("full"), F.col("w"))).over(all_)
    return s.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.least(F.col("most"), left * F.col("w") / open_)).alias("target"))


def hypergeometric(n: Column, k: Column, of: Column, u: Column) -> Column:
    """A draw from 0..: how many of ``k`` marked among ``n`` drawn of ``of``; by inversion at ``u`` in [0, 1).

    The weights run from 10 + 9 standard deviations below the mode to as many
    above; beyond that they are under 1e-16 of the whole.
    """
    d = lambda c: c.cast("double")
    lo, hi = F.greatest(F.lit(0).cast("long"), n - (of - k)), F.least(n, k)
    mode = F.floor(d(n + 1) * d(k + 1) / d(of + 2)).cast("long")
    sd = F.sqrt(d(n) * d(k) / d(F.greatest(of, F.lit(1))) * d(of - k) / d(F.greatest(of, F.lit(1))) * d(of - n) / d(F.greatest(of - 1, F.lit(1))))
    reach = F.ceil(sd * 9).cast("long") + 10
    steps = F.struct(F.greatest(lo, mode - reach).alias("a"), F.least(hi, mode + reach).alias("b"))

    def draw(s: Column) -> Column:
        ratio = lambda x: d(k - x) * d(n - x) / (d(x + 1) * d(of - k - n + x + 1))
        walk = F.when(s["b"] > s["a"], F.sequence(s["a"], s["b"] - 1)).otherwise(F.array().cast("array<bigint>"))
        whole = F.aggregate(walk, F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("all")), lambda t, x: F.struct((t["w"] * ratio(x)).alias("w"), (t["all"] + t["w"] * ratio(x)).alias("all")))["all"]
        first = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("all"), s["a"].alias("at"))
        goal = u * whole

        def on(t: Column, x: Column) -> Column:
            w = t["w"] * ratio(x)
            return F.struct(w.alias("w"), (t["all"] + w).alias("all"), F.when(t["all"] > goal, t["at"]).otherwise(x + 1).alias("at"))

        return F.aggregate(walk, first, on)["at"]

    return _let(steps, draw)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def unit(*what: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*what), 11) / F.lit(float(1 << 53))


def splitting_tree(quotas: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """(shard, quotas) from one row (quotas: array of long by source): every shard's quota of each source.

    Shards get equal numbers of blocks, but for rounding.
    """
    node = quotas.select(F.col("quotas").cast("array<bigint>").alias("quotas"), F.lit(0).alias("shard"), F.lit(shards).alias("width"))
    depth = max(0, (shards - 1).bit_length())
    for level in range(depth):
        if level == ALONE:
            node = node.repartition(min(shards, 1024), "shard")
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)
        left_width = (F.col("width") / 2).cast("int")
        first = F.struct(F.floor(total * left_width / F.col("width")).cast("long").alias("n"), total.alias("of"), F.array().cast("array<bigint>").alias("out"))

        def step(t: Column, k: Column) -> Column:
            x = hypergeometric(t["n"], k, t["of"], unit(F.lit(seed), F.lit(level), F.col("shard"), F.size(t["out"])))
            return _let(x, lambda got: F.struct((t["n"] - got).alias("n"), (t["of"] - k).alias("of"), F.concat(t["out"], F.array(got)).alias("out")))

        left = F.aggregate("quotas", first, step)["out"]
        node = node.withColumn("left", F.when(F.col("width") > 1, left).otherwise(F.col("quotas"))).withColumn("half", left_width)
        halves = F.array(
            F.struct(F.col("left").alias("quotas"), F.col("shard").alias("shard"), F.when(F.col("width") > 1, F.col("half")).otherwise(F.lit(1)).alias("width")),
            F.struct(F.zip_with("quotas", "left", lambda a, b: a - b).alias("quotas"), (F.col("shard") + F.col("half")).alias("shard"), (F.col("width") - F.col("half")).alias("width")),
        )
        halves = F.when(F.col("width") > 1, halves).otherwise(F.slice(halves, 1, 1))
        node = node.select(F.inline(halves))
    return node.select("shard", "quotas")


def running(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds what the source's earlier blocks add up to. Sums by strip first: a window holds a strip, or a row for each strip."""
    sums = rows.groupBy("sid", "strip").agg(F.sum(value).alias("v__"))
    ahead = Window.partitionBy("sid").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "strip", F.coalesce(F.sum("v__").over(ahead), F.lit(0)).cast("long").alias("v__"))
    within = Window.partitionBy("sid", "strip").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("w__", F.coalesce(F.sum(value).over(within), F.lit(0)).cast("long"))
    return own.join(sums, ["sid", "strip"]).withColumn(name, F.col("v__") + F.col("w__")).drop("v__", "w__")


def last_quota(blocks: DataFrame) -> DataFrame:
    """(sid, quota): how many blocks of the last pass fit into ``rest`` even if they are the source's longest; by sizes of blocks, not by blocks."""
    sizes = blocks.groupBy("sid", "words", "rest").agg(F.count(F.lit(1)).alias("n"))
    longer = Window.partitionBy("sid").orderBy(F.col("words").desc()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.coalesce(F.sum(F.col("n") * F.col("words")).over(longer), F.lit(0))
    fit = F.when(left < 0, 0).when(F.col("words") == 0, F.col("n")).otherwise(F.least(F.col("n"), F.floor(left / F.col("words")))).cast("long")
    return sizes.withColumn("fit", fit).groupBy("sid").agg(F.sum("fit").alias("quota"))


def dealt(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, of, q, to) from (of, quota): the tree's share of each quota for each shard, and where it ends in the order of shards."""
    listed = F.sort_array(F.collect_list(F.struct("of", "quota")))
    one = quotas.agg(listed.alias("l")).select(F.col("l.of").alias("names"), F.col("l.quota").alias("quotas"))
    tree = splitting_tree(one.select("quotas"), shards, seed)
    part = tree.crossJoin(one.select("names")).select("shard", F.explode(F.arrays_zip("names", "quotas")).alias("x"))  # one row holds the names
    part = part.select("shard", F.col("x.names").alias("of"), F.col("x.quotas").alias("q")).where("q > 0")
    return part.withColumn("to", F.sum("q").over(Window.partitionBy("of").orderBy("shard")).cast("long"))


def numbers(rows: DataFrame, start: Column, end: Column, name: str) -> DataFrame:
    """A row for each number in [start, end), unfolded in two steps so that no row holds a long array."""
    step = 1 << 12
    rows = rows.withColumn("s__", start.cast("long")).withColumn("e__", end.cast("long")).where("e__ > s__")
    rows = rows.withColumn("a__", F.explode(F.sequence(F.col("s__"), F.col("e__") - 1, F.lit(step).cast("long"))))
    return rows.withColumn(name, F.explode(F.sequence(F.col("a__"), F.least(F.col("a__") + step, F.col("e__")) - 1))).drop("s__", "e__", "a__")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 7, shards: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sources, drawn).

    rows: doc_id, source, size, h and ``n``, how many equal rows there are.
    sources: source, source_size, target. drawn: a row for each document and
    pass that takes it: doc_id, source, size, h, ``k``, how many of the equal
    rows it takes, ``pass`` and ``shard``.
    """
    rows, sources, draws, picked = plan(docs, key, text, source, weights, share, cap, seed, shards)
    inside = ["sid", "block"]
    whole = rows.join(draws.where("whole"), inside).select("doc_id", "source", "size", "h", F.col("n").alias("k"), "pass", "shard")
    some = picked.join(draws.where("NOT whole"), inside).join(sources.select("sid", "source"), "sid").select("doc_id", "source", "size", "h", "k", "pass", "shard")
    return rows.drop("sid", "block"), sources, whole.unionByName(some)


def places(seed: int, h: str, entries: str, copy: str) -> Column:
    """(shard, place) of each time that the ``copy``-th of equal rows is taken, from (pass, shard, k) of its document."""
    taken = F.filter(F.array_sort(entries), lambda x: x["k"] >= F.col(copy))
    return F.transform(taken, lambda x: F.struct(x["shard"].alias("shard"), F.xxhash64(F.lit(seed + 1), h, x["pass"], copy).alias("place")))


def shard_count(sources: DataFrame, share: float) -> int:
    words = sources.agg(F.sum("source_size").alias("w")).first().w or 0
    return max(SHARDS, -(-int(words * share) // SHARD_WORDS))


def plan(docs: DataFrame, key: str, text: str, source: str, weights, share: float, cap: float, seed: int, shards: int | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows with their blocks, sources, draws of blocks (sid, block, pass, shard, whole, part), documents picked of blocks that are drawn in part).

    ``part`` names the tree that dealt a draw: 0 whole passes, 1 the last pass, 2 what fills up.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("h"))
    rows = written(rows.groupBy("doc_id", "source", "size", "h").agg(F.count(F.lit(1)).alias("n")), "mix-rows")
    told = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    goals = targets(told.select("source", "source_size"), weights, share, cap)
    same = F.col("g.source").eqNullSafe(F.col("t.source"))
    sid = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long")
    sources = goals.alias("g").join(told.alias("t"), same).select("g.*", "t.docs").withColumn("sid", sid)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long")
    sources = sources.withColumn("passes", passes).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
    sources = written(sources.withColumn("dealt", F.ceil(F.col("docs") / BLOCK).cast("long")), "mix-sources")
    shards = shards or shard_count(sources, share)

    same = F.col("r.source").eqNullSafe(F.col("s.source"))
    rows = rows.alias("r").join(sources.select("source", "sid", "dealt").alias("s"), same).select("r.*", "s.sid", F.pmod(F.col("r.h"), F.col("s.dealt")).alias("block"))
    blocks = rows.groupBy("sid", "block").agg(F.sum(F.col("size") * F.col("n")).alias("words")).withColumn("strip", F.floor(F.col("block") / STRIP))
    blocks = written(running(blocks, F.lit(1), "idx").join(sources.select("sid", "passes", "rest"), "sid"), "mix-blocks")

    held = blocks.groupBy("sid").agg(F.count(F.lit(1)).alias("blocks"), F.max("passes").alias("passes"))
    held = written(held.join(last_quota(blocks), "sid"), "mix-quotas")
    both = held.select("sid", F.explode(F.array(F.struct(F.lit(0).alias("part"), (F.col("passes") * F.col("blocks")).alias("quota")), F.struct(F.lit(1).alias("part"), F.col("quota").alias("quota")))).alias("x"))
    part = dealt(both.select((F.col("sid") * 2 + F.col("x.part")).alias("of"), F.col("x.quota").alias("quota")), shards, seed)
    part = written(part.withColumn("sid", F.floor(F.col("of") / 2)).withColumn("part", (F.col("of") % 2).cast("int")).join(held, "sid"), "mix-shards")

    # Whole passes: the n-th draw is of block n modulo their number.
    full = numbers(part.where("part = 0"), F.col("to") - F.col("q"), F.col("to"), "j").select("sid", "shard", (F.col("j") % F.col("blocks")).alias("idx"), F.floor(F.col("j") / F.col("blocks")).alias("pass"))
    full = full.join(blocks.select("sid", "idx", "block"), ["sid", "idx"]).select("sid", "block", "pass", "shard", F.lit(True).alias("whole"), F.lit(0).alias("part"))
    # The last pass: a shard draws its quota from its own range of blocks, which holds as many at least.
    edge = lambda at: F.floor(at * F.col("blocks") / F.col("quota"))
    at = lambda x: x.cast("decimal(20,0)")  # noqa: E731  (products beyond 64 bits stay exact)
    own = numbers(part.where("part = 1"), edge(at(F.col("to") - F.col("q"))), edge(at(F.col("to"))), "idx").join(blocks.select("sid", "idx", "block", "words"), ["sid", "idx"])
    nth = F.row_number().over(Window.partitionBy("sid", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "shard", "block"), "block"))
    last = written(own.withColumn("nth", nth).where("nth <= q").select("sid", "block", "words", "shard"), "mix-last")

    # What is left of a target: blocks that nothing drew, the last of them in part.
    drew = last.groupBy("sid").agg(F.sum("words").alias("drew"))
    free = blocks.join(last.select("sid", "block"), ["sid", "block"], "left_anti").join(drew, "sid", "left").withColumn("rest", F.col("rest") - F.coalesce("drew", F.lit(0)))
    free = running(running(free.where("words > 0 AND rest > 0"), F.col("words"), "before"), F.lit(1), "j")
    fits = F.col("before") + F.col("words") <= F.col("rest")
    full_ = free.where(fits).groupBy("sid").agg(F.count(F.lit(1)).alias("fit"), F.sum("words").alias("filled"))
    free = free.join(full_, "sid", "left").withColumn("fit", F.coalesce("fit", F.lit(0)))
    free = free.where(F.col("j") < F.col("fit") + PICK).withColumn("room", F.col("rest") - F.coalesce("filled", F.lit(0)))
    free = written(free.withColumn("whole", F.col("j") < F.col("fit")).where("whole OR room > 0"), "mix-free")
    more = dealt(free.groupBy(F.col("sid").alias("of")).agg(F.count(F.lit(1)).alias("quota")), shards, seed + 3)
    more = numbers(more, F.col("to") - F.col("q"), F.col("to"), "j").select(F.col("of").alias("sid"), "j", "shard")
    passes = sources.select("sid", F.col("passes").alias("pass"))
    fill = free.join(more, ["sid", "j"]).join(passes, "sid").select("sid", "block", "pass", "shard", "whole", F.lit(2).alias("part"))
    late = last.join(passes, "sid").select("sid", "block", "pass", "shard", F.lit(True).alias("whole"), F.lit(1).alias("part"))
    draws = written(full.unionByName(late).unionByName(fill), "mix-draws")
    return rows, sources, draws, _picked(rows, free.where("NOT whole").select("sid", "block", "room"))


def _picked(rows: DataFrame, last: DataFrame) -> DataFrame:
    """Of the ``PICK`` blocks of each source that are drawn in part: k of each row's equals, longest first, as they fit."""
    held = rows.where("size > 0").join(last, ["sid", "block"])
    item = F.struct((-F.col("size")).alias("s"), "h", "doc_id", "n", "block")
    held = held.groupBy("sid").agg(F.max("room").alias("room"), F.sort_array(F.collect_list(item)).alias("items"))
    first = F.struct(F.col("room").alias("room"), F.array().cast("array<bigint>").alias("k"))

    def fit(t: Column, x: Column) -> Column:
        take = F.least(x["n"], F.floor(F.greatest(t["room"], F.lit(0.0)) / (-x["s"])).cast("long"))
        return _let(take, lambda k: F.struct((t["room"] + k * x["s"]).alias("room"), F.concat(t["k"], F.array(k)).alias("k")))

    held = held.withColumn("ks", F.aggregate("items", first, fit)["k"])
    x = held.select("sid", F.explode(F.arrays_zip("items", "ks")).alias("p")).select("sid", "p.items.*", F.col("p.ks").alias("k"))
    return x.select("sid", "block", "doc_id", (-F.col("s")).alias("size"), "h", "k").where("k > 0")


def _entries(drawn: DataFrame, *keys: str) -> DataFrame:
    """(pass, shard, k) of each document: as many as it is taken times."""
    return drawn.groupBy(*keys).agg(F.collect_list(F.struct("pass", "shard", "k")).alias("entries__"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, **how) -> DataFrame:
    """The documents of the mix, a row for each copy, with all their columns and ``shard`` and ``place``; shards are whole and in their order."""
    _, sources, drawn = mix(docs, key, text, source, seed=seed, **how)
    shards = how.get("shards") or shard_count(sources, how.get("share", 1.5))
    keys = ["i__", "j__", "s__", "t__", "h__"]
    named = lambda i, s, h: [F.coalesce(i.cast("string"), F.lit("")).alias("i__"), i.isNull().alias("j__"), F.coalesce(s.cast("string"), F.lit("")).alias("s__"), s.isNull().alias("t__"), h.alias("h__")]
    went = _entries(drawn.select(*named(F.col("doc_id"), F.col("source"), F.col("h")), "pass", "shard", "k"), *keys)
    rows = docs.select("*", *named(F.col(key), F.col(source), F.xxhash64(F.lit(seed), F.col(key), F.col(text))))
    rows = rows.repartition(2 * shards, *keys)  # whole texts: as many tasks as their size asks for
    rows = rows.withColumn("copy__", F.row_number().over(Window.partitionBy(*keys).orderBy("h__")).cast("long"))
    out = rows.join(went, keys).withColumn("at__", F.explode(places(seed, "h__", "entries__", "copy__")))
    out = out.select(*(c for c in docs.columns if c not in ("shard", "place")), F.col("at__.shard").alias("shard"), F.col("at__.place").alias("place"))
    # A task holds a shard or few, however many there are.
    return out.repartition(2 * shards, "shard").sortWithinPartitions("shard", "place")


def op7_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``shards`` and ``places``: where a document's copies go, joined by commas; empty if it isn't taken."""
    rows, sources, drawn = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    same = F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("r.h") == F.col("t.h"))
    out = rows.alias("r").join(_entries(drawn, "doc_id", "source", "h").alias("t"), same, "left").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    out = out.select("r.doc_id", "r.size", "r.h", "r.n", "s.source_size", "s.target", F.coalesce("t.entries__", F.array()).alias("entries__"))
    out = numbers(out, F.lit(1), F.col("n") + 1, "copy").withColumn("at", places(7, "h", "entries__", "copy"))
    text = lambda field: F.array_join(F.transform(f"at.{field}", lambda x: x.cast("string")), ",")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("at")).cast("long").alias("taken"), text("shard").alias("shards"), text("place").alias("places"))
