"""Order MinHash fingerprints; DataFrame functions only.

A text is a sequence of tokens (words; Han, kana and Hangul characters one by
one). Its k-mers are numbered by occurrence, so that the second ``a b c`` is
another element than the first. Elements are dealt by their hash to ``parts``
equal ranges; of each range the ``least`` elements with the smallest hashes are
taken, put back into the order in which they stand in the text, and the tuple
is hashed. The set of (range, tuple hash) is the signature. A tuple agrees only
if the same elements stand in the same order, so the share of agreeing ranges
falls with edits and with moved passages alike. (One hash cut into ranges
stands for ``parts`` hash functions, as in one-permutation MinHash: each
element is hashed once whatever the number of ranges.)

Likeness: agreeing ranges over ranges that either text fills; 1 for two texts
without elements.

Cases: null text is empty. A text of fewer than k tokens has one element, all
its tokens; one without tokens has none, and the fingerprint ``""``. Rows with
the same doc_id and text count as one document in the order of documents (each
row still gets its result); rows that share a doc_id alone are ordered by a
hash of their texts. Null doc_ids come first. Of a text of more than 16 million
tokens, those that share a place are ordered by their hashes. A sole document follows itself.
No rows: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linefacts.llm._shared import written

K, PARTS, LEAST = 3, 64, 2
#: Bits: 6 of the range, 33 of the hash within it, 24 of the place.
PLACE = 24
#: Characters that are tokens by themselves.
ALONE = r"([぀-ヿ㐀-鿿가-힯])"


def tokens(text: Column) -> Column:
    spaced = F.when(text.rlike(ALONE), F.regexp_replace(text, ALONE, " $1 ")).otherwise(text)
    return F.filter(F.split(spaced, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def kmers(words: Column, k: int = K) -> Column:
    """(39 bits of hash, place) of each k-mer, packed in a long."""
    last = F.greatest(F.size(words) - k, F.lit(0))
    at = F.when(F.size(words) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    n = F.size(words)

    def place(i: Column) -> Column:
        # Of a text with more places than there are numbers, neighbours share one: the order stays.
        return F.when(n <= 1 << PLACE, i.cast("long")).otherwise(F.floor(i.cast("long") * (1 << PLACE) / n))

    def one(i: Column) -> Column:
        # get() gives null past the end; the hash skips nulls, and no other k-mer of the text is that short.
        h = F.xxhash64(*(F.get(words, i + j) for j in range(k)))
        return F.shiftleft(F.shiftrightunsigned(h, 25), PLACE).bitwiseOR(place(i))

    return F.transform(at, one)


def elements(sorted_kmers: Column) -> Column:
    """Occurrence-numbered elements, (range and hash, place) packed in a long, from sorted k-mers."""
    name = lambda x: F.shiftrightunsigned(x, PLACE)
    n = F.size(sorted_kmers)
    all_ = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(all_, lambda i: (i == 0) | (name(F.get(sorted_kmers, i)) != name(F.get(sorted_kmers, i - 1))))

    def of_runs(s: Column) -> Column:
        def run(from_: Column, j: Column) -> Column:
            to = F.coalesce(F.get(s, j + 1), n) - 1

            def element(i: Column) -> Column:
                x = F.get(sorted_kmers, i)
                h = F.xxhash64(name(x), i - from_)
                return F.coalesce(F.shiftleft(F.shiftrightunsigned(h, 25), PLACE).bitwiseOR(x.bitwiseAND(F.lit((1 << PLACE) - 1))), F.lit(0).cast("long"))

            return F.transform(F.sequence(from_, to), element)

        return F.flatten(F.transform(s, run))

    return F.transform(F.array(starts), of_runs)[0]


def signature(sorted_elements: Column, least: int = LEAST) -> Column:
    """A 32-bit entry (6 bits of the range, 26 of the tuple's hash) for each range that has elements."""
    part = lambda x: F.shiftrightunsigned(x, PLACE + 33)
    # The first `least` of a range: the one `least` places before is of another range.
    best = F.filter(sorted_elements, lambda x, i: (i < least) | (part(F.get(sorted_elements, i - least)) != part(x)))

    def entries(b: Column) -> Column:
        heads = F.filter(b, lambda x, i: (i == 0) | (part(F.get(b, i - 1)) != part(x)))

        def entry(x: Column) -> Column:
            where = F.array_position(b, x).cast("int")
            own = F.filter(F.slice(b, where, least), lambda y: part(y) == part(x))
            # In the order of the text: place first, then the hash.
            turned = F.transform(own, lambda y: F.shiftleft(y.bitwiseAND(F.lit((1 << PLACE) - 1)), 39).bitwiseOR(F.shiftrightunsigned(y, PLACE)))
            tuple_ = F.transform(F.array_sort(turned), lambda y: y.bitwiseAND(F.lit((1 << 39) - 1)))
            return F.shiftleft(part(x), 26).bitwiseOR(F.shiftrightunsigned(F.xxhash64(tuple_), 38)).cast("long")

        return F.transform(heads, entry)

    return F.transform(F.array(best), entries)[0]


def with_signature(df: DataFrame, text: str, name: str, k: int = K, least: int = LEAST) -> DataFrame:
    """Adds the signature of ``text``, an array of longs. Sorts are over plain long arrays at the top of a projection."""
    df = df.withColumn("k__", F.transform(F.array(tokens(F.col(text))), lambda w: kmers(w, k))[0])
    df = df.withColumn("k__", F.sort_array("k__")).withColumn("k__", elements(F.col("k__")))
    df = df.withColumn("k__", F.sort_array("k__")).withColumn(name, signature(F.col("k__"), least))
    return df.drop("k__")


def as_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    part = lambda s: F.transform(s, lambda x: F.shiftrightunsigned(x, 26))
    either = F.size(F.array_union(part(a), part(b)))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(1.0))


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n, next_id, next_h, prev_id, prev_h, prev_n) of each distinct (doc_id, text) in the order of documents.

    Only keys move. A window runs within each range of keys; what stands at
    the ends of ranges is one row a range.
    """
    one = docs.groupBy("doc_id", "h").agg(F.max("n").alias("n"))
    key = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    one = written(one.repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "order")
    at = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "h", "n")
    ends = one.groupBy("part").agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    all_ = Window.orderBy("part")  # a row for each range
    whole = Window.partitionBy()
    ends = ends.select("part", F.coalesce(F.lead("lo").over(all_), F.min("lo").over(whole)).alias("after"), F.coalesce(F.lag("hi").over(all_), F.max("hi").over(whole)).alias("ahead"))
    w = Window.partitionBy("part").orderBy(*key)
    one = one.withColumn("at", at).withColumn("nx", F.lead("at").over(w)).withColumn("pv", F.lag("at").over(w)).join(F.broadcast(ends), "part")
    one = one.withColumn("nx", F.coalesce("nx", "after")).withColumn("pv", F.coalesce("pv", "ahead"))
    return one.select("doc_id", "h", "n", F.col("nx.doc_id").alias("next_id"), F.col("nx.h").alias("next_h"), F.col("pv.doc_id").alias("prev_id"), F.col("pv.h").alias("prev_h"), F.col("pv.n").alias("prev_n"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, least: int = LEAST) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likenesses.

    The text moves once, with a quarter of the next one; then signatures do.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    order = written(neighbours(docs.select("doc_id", "h", F.length("text").cast("long").alias("n"))), "neighbours")
    own = F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("d.h") == F.col("o.h"))
    placed = docs.alias("d").join(order.hint("shuffle_hash").alias("o"), own).select("o.*", "d.text")
    # What the document before takes of this one: a row for each distinct document.
    lent = placed.groupBy("prev_id", "prev_h").agg(F.max(F.expr("substring(text, 1, CAST(prev_n DIV 4 AS INT))")).alias("lent"))
    here = F.col("p.doc_id").eqNullSafe(F.col("l.prev_id")) & (F.col("p.h") == F.col("l.prev_h"))
    both = placed.alias("p").join(lent.alias("l"), here).select("p.doc_id", "p.h", "p.n", "p.prev_id", "p.prev_h", "p.text", "l.lent")
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, CAST(n - n DIV 4 AS INT))"), F.expr("substring(lent, 1, CAST(n DIV 4 AS INT))")))
    both = both.withColumn("edited_sha256", F.sha2("edited", 256))
    both = with_signature(with_signature(both, "text", "sig", k, least), "edited", "esig", k, least)
    # Each signature goes to its own key and, for comparison, to the one before: one shuffle.
    to = F.array(
        F.struct(F.col("doc_id").alias("to_id"), F.col("h").alias("to_h"), F.lit(True).alias("own")),
        F.struct(F.col("prev_id").alias("to_id"), F.col("prev_h").alias("to_h"), F.lit(False).alias("own")),
    )
    sent = both.select("doc_id", "n", "edited_sha256", "sig", "esig", F.explode(to).alias("t"))
    sent = sent.select("t.*", "n", "sig", F.when(F.col("t.own"), F.col("edited_sha256")).alias("edited_sha256"), F.when(F.col("t.own"), F.col("esig")).alias("esig"))
    after = F.max(F.when(~F.col("own"), F.col("sig"))).over(Window.partitionBy("to_id", "to_h"))
    out = sent.withColumn("next_sig", after).where("own")
    return out.select(
        F.col("to_id").alias("doc_id"),
        F.col("n").alias("n_chars"),
        "edited_sha256",
        as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("esig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("esig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
