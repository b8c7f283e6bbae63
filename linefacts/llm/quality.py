"""Quality rules with cross-document line frequency.

Base rules look at one document: how many words it has, and how many stand in
a three-word window that the document has twice or more.

Line frequency looks at all documents of a host: each line with a word is
normalised (its words joined by single spaces, A-Z lower-cased) and hashed; a
line that more than ``limit`` distinct documents of the host hold is boilerplate,
however large the host, and is removed from all of them. Documents with equal
texts are one document, so that copies make no boilerplate of their own lines
(the README has figures). A document that keeps less than ``left`` of its words
this way is depleted and rejected.

Cases: null text has no words (and fails the base rule). Null host is a host of
its own. Repeated rows are judged alike and count once.
No rows: no rows. Columns of other names are carried only by ``cleaned``.
"""

from __future__ import annotations

from collections import Counter

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linefacts.llm._chunks import by_chunk, chunk_count, into_chunks, read_chunk

LEAST_WORDS = 50
REPEATED = 50  # per cent of the words
LIMIT, LEFT = 10, 0.5
#: The symbols counted, and white space.
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def line_hash(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words).lower()) - (1 << 63)


def repeated_words(words: list[bytes], k: int = 3) -> int:
    """Words in k-word windows that come twice or more."""
    windows = list(zip(*(words[i:] for i in range(k))))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    covered, to = 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered += i + k - max(i, to)
            to = i + k
    return covered


def measure(raw: bytes) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """The base figures of one text, and the hash and words of each of its lines with a word."""
    words = raw.split()
    chars = len(raw.decode()) - sum(raw.count(bytes([c])) for c in WHITE)
    symbols = sum(raw.count(bytes([c])) for c in SYMBOLS)
    hashes, sizes, seen, dup = [], [], set(), 0
    for line in raw.split(b"\n"):
        of = line.split()
        if of:
            dup += line in seen
            seen.add(line)
            hashes.append(line_hash(of))
            sizes.append(len(of))
    return len(words), chars, symbols, dup, repeated_words(words), hashes, sizes


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> tuple[DataFrame, str]:
    """(rows, root of the chunks): for each document doc_id, host, base figures, a digest of the text, and its lines as arrays."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        texts = table.column(text).cast("binary").to_pylist()
        cols = list(zip(*(measure(t or b"") for t in texts)))
        out = {"at": np.arange(len(texts)), "doc_id": table.column(key).cast("int64"), "host": table.column(host).cast("string")}
        out |= {n: pa.array(c, pa.int64()) for n, c in zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), cols)}
        digest = [xxhash.xxh64_intdigest(t or b"") - (1 << 63) for t in texts]
        return out | {"digest": pa.array(digest, pa.int64()), "lines": pa.array(cols[5], pa.list_(pa.int64())), "sizes": pa.array(cols[6], pa.list_(pa.int32()))}

    return into_chunks(docs, run, f"at long, doc_id long, host string, {BASE}, digest long, lines array<long>, sizes array<int>", "quality", text)


def judged(rows: DataFrame, limit: int = LIMIT, left: float = LEFT) -> DataFrame:
    """``measured`` rows with ``base_failed``, ``removed`` (hashes of the lines to remove), ``n_removed_words`` and ``kept``."""
    each = rows.select("host", "digest", F.explode(F.array_distinct("lines")).alias("line"))
    # Distinct (host, line, text) before (host, line): a line of very many copies is few rows.
    over = each.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("host", "line")
    held = rows.select("chunk", "at", "host", F.explode(F.arrays_zip("lines", "sizes")).alias("x")).select("chunk", "at", "host", F.col("x.lines").alias("line"), F.col("x.sizes").alias("words"))
    hit = held.alias("h").join(over.alias("o"), (F.col("h.line") == F.col("o.line")) & F.col("h.host").eqNullSafe(F.col("o.host")))
    gone = hit.groupBy("h.chunk", "h.at").agg(F.sum("h.words").alias("n_removed_words"), F.collect_set("h.line").alias("removed"))
    out = rows.drop("lines", "sizes", "digest").join(gone, ["chunk", "at"], "left")
    gone_words = F.coalesce("n_removed_words", F.lit(0).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    out = out.withColumn("n_removed_words", gone_words).withColumn("removed", F.coalesce("removed", F.array().cast("array<bigint>"))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= F.lit(left) * F.col("n_words")))


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The documents that pass, with all their columns, without the lines that are above the limit."""
    rows, root = measured(docs, key, text, host)
    chunks = chunk_count(rows)
    verdict = judged(rows, **limits).where("kept").select("chunk", "at", "removed")
    names = docs.columns

    def cut(table):
        import pyarrow as pa

        docs = read_chunk(root, table.column("chunk")[0].as_py()).take(table.column("at"))
        texts = docs.column(text).to_pylist()
        for i, gone in enumerate(table.column("removed").to_pylist()):
            if gone:
                gone = set(gone)
                texts[i] = "\n".join(x for x in texts[i].split("\n") if not (w := x.encode().split()) or line_hash(w) not in gone)
        out = {n: docs.column(n) for n in names} | {text: pa.array(texts, pa.string())}
        if "n_chars" in out:
            out["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
        return pa.table(out)

    return by_chunk(verdict, chunks).applyInArrow(cut, docs.schema)


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = judged(measured(docs)[0])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT doc_id, source, t, l, i, array_to_string(regexp_extract_all(l, '[^\x20\x09-\x0D]+'), ' ') AS j, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS nw
  FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d)
), held AS (
  SELECT *, translate(j, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM lines WHERE nw > 0
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM held GROUP BY doc_id
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), freq AS (
  SELECT source, norm, count(DISTINCT t) AS n FROM held GROUP BY source, norm
), over_ AS (
  SELECT * FROM freq WHERE n > 10
), gone AS (
  SELECT h.doc_id, sum(h.nw) AS n FROM held h JOIN over_ o ON h.source IS NOT DISTINCT FROM o.source AND h.norm = o.norm GROUP BY h.doc_id
), base AS (
  SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(length(array_to_string(d.w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS removed
  FROM d LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id LEFT JOIN gone ON d.doc_id = gone.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed >= 0.5 * n_words AS kept
FROM base
"""
