"""Removal of repeated byte strings by bucket-pointer refinement, distributed.

A byte goes if a string of ``length`` bytes that covers it starts anywhere
else too. Two strings are equal if refinement leaves them in one bucket, so
buckets are refined in three rounds, each of which drops what has become alone:

1. Initial buckets are of q-grams. Every window of ``length`` bytes points at
   its smallest q-gram by hash, its anchor; equal windows have equal anchors.
   Successive windows with one anchor are a run, one row with the anchor as
   bucket and a sub-bucket name made from the bucket identifiers of later
   offsets (8, 16, 32, ... bytes on, each made from two of half the depth).
2. Runs are sorted by bucket and sub-bucket. Anchors with one run are alone. A
   sub-bucket with two runs or more is settled: all its windows repeat. What is
   left are runs at the edges of repeats.
3. The bytes of those runs, and of one run of each settled sub-bucket beside
   them, are sorted together by plain bucket-pointer refinement of their
   suffixes up to the length of a window: ranks of q-grams first, then of pairs
   of ranks at doubling offsets, recursively, in buckets that still have two
   members. Windows that share a bucket at the end repeat.

Texts stay in chunk files. A row stands for all equal runs of a chunk, so a
passage that very many documents share is a row a chunk, and those meet in
partial sums. A bucket with more than ``HOT`` different runs is dealt out by
window instead of by anchor, and a task of round 3 holds ``RUNS`` runs or one
bucket at a time. Anchors and names are 64-bit hashes: windows count as
settled if two such names agree (128 bits), and runs at edges are compared
byte by byte. Pointers are renewed between the passes of a refinement, not
inside one: a pointer that had run ahead of its pass would stand for more bytes
than a window has, and tell equal windows apart.

Cases: null text is empty. Matches don't cross documents; repeated rows are
documents of their own (and so repeat each other). Texts shorter than a window
stay whole. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linefacts.llm._chunks import by_chunk, chunk_count, into_chunks, read_chunk, streamed
from linefacts.llm._hash import U, buffer_of, lanes, mix, pair
from linefacts.llm._shared import trim, written

LENGTH, Q = 200, 48
CHUNK = 2 << 20
HOT = 20_000
#: Bytes of runs that one task sorts in round 3, and how many of its runs at a time (whole buckets).
TASK, RUNS = 6 << 20, 4096
#: Odd factors of the levels: a position's identifier at a depth is the sum of its parts' times these.
FACTOR = mix(np.arange(101, 113, dtype=U)) | U(1)


def _join(a: np.ndarray, step: int, k: int) -> np.ndarray:
    """Identifiers from those of half the depth, there and ``step`` on."""
    out = a.copy()
    out[: len(a) - step] += a[step:] * FACTOR[k]
    return out


def identifiers(data: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers of each position at depth q and at depth ``length``; right only where so many bytes follow."""
    now, depth, k, out = mix(lanes(data)), 8, 0, {}
    for goal in (q, length):
        while depth * 2 <= goal:
            now, depth, k = _join(now, depth, k), depth * 2, k + 1
        out[goal] = now if depth == goal else _join(now, goal - depth, 10 + (goal == length))
    return out[q], out[length]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, x = 1, x.copy()
    while have * 2 <= width:
        np.minimum(x[:-have], x[have:], out=x[:-have])
        have *= 2
    if width > have:
        step = width - have
        np.minimum(x[:-step], x[step:], out=x[:-step])
    return x


def runs_of(data: np.ndarray, edges: np.ndarray, length: int, q: int) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: first and last window, document, anchor, name, and whether the anchor occurs twice in a window."""
    sizes = np.maximum(np.diff(edges) - 1 - length + 1, 0)
    if not sizes.sum():
        z = np.zeros(0, np.int64)
        return {"first": z, "last": z, "doc": z, "anchor": z, "name": z, "tie": z.astype(bool), "whole": np.zeros(0, U)}
    short, whole = identifiers(data, length, q)
    short = mix(short) & ~U(255)
    at = np.arange(len(data), dtype=np.int64).astype(np.uint8).astype(U)
    width = length - q + 1
    low, high = _sliding_min(short | at, width), _sliding_min(short | (U(255) - at), width)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    p = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + edges[doc]
    m, tie = low[p] >> U(8), (low[p] & U(255)) != U(255) - (high[p] & U(255))
    new = np.ones(len(p), bool)
    new[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, len(p)))
    if (n > width).any():  # a run that goes on is cut, so that its name covers it
        parts = -(-n // width)
        start = np.repeat(start, parts) + (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)) * width
    end = np.append(start[1:], len(p)) - 1
    first, last = p[start], p[end]
    name = pair(pair(mix(whole[first]), mix(whole[last])), (last - first).astype(U))
    return {"first": first, "last": last, "doc": doc[start], "anchor": m[start].astype(np.int64), "name": name.view(np.int64), "tie": np.logical_or.reduceat(tie, start), "whole": whole}


def _sorted_runs(r: dict, *more: str) -> tuple[np.ndarray, np.ndarray]:
    """An order by (anchor, name) and where each group begins in it."""
    order = np.lexsort((r["name"], r["anchor"]))
    a, n = r["anchor"][order], r["name"][order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (n[1:] != n[:-1])
    return order, np.flatnonzero(new)


SETTLED, OPEN, SAMPLE = 1, 2, 3


def _verdicts(rows: DataFrame) -> DataFrame:
    """(chunk, anchor, name, verdict, hot) of the runs that aren't alone.

    In two stages of partial sums, so that no task holds a bucket: anchors that
    occur twice; then their sub-buckets, whatever the number of chunks that have
    each; then what a bucket's sub-buckets say together.
    """
    runs = rows.where("n > 0")
    alive = runs.groupBy("anchor").agg(F.sum("n").alias("n"), F.bool_or("tie").alias("tie")).where("n > 1 OR tie")
    held = written(runs.join(written(alive.select("anchor"), "anchors"), "anchor").select("chunk", "anchor", "name", "n"), "runs")
    subs = written(held.groupBy("anchor", "name").agg(F.sum("n").alias("n"), F.min("chunk").alias("first")), "sub-buckets")
    buckets = subs.groupBy("anchor").agg(F.bool_or(F.col("n") < 2).alias("open"), (F.count(F.lit(1)) > HOT).alias("hot"))
    told = subs.join(buckets, "anchor").select("anchor", "name", "first", (F.col("n") >= 2).alias("settled"), "open", "hot")
    sample = F.col("open") & (F.col("chunk") == F.col("first"))
    verdict = F.when(F.col("settled"), F.when(sample, SAMPLE).otherwise(SETTLED)).otherwise(OPEN)
    return held.join(told, ["anchor", "name"]).select("chunk", "anchor", "name", verdict.cast("int").alias("verdict"), "hot")


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching ranges of a document, joined."""
    if not len(doc):
        return doc, start, end
    o = np.lexsort((start, doc))
    doc, start, end = doc[o], start[o], end[o]
    span = int(end.max()) + 2
    reach = np.maximum.accumulate(doc * span + end)  # ends of earlier documents are below this one's starts
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] * span + start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(end, at)


def refine(data: np.ndarray, windows: np.ndarray, length: int, q: int = 32) -> np.ndarray:
    """Bucket-pointer refinement up to ``length``: for each of ``windows``, whether another one has the same bytes.

    Buckets are ranks of q-grams (of their identifiers), then of pairs of the
    ranks there and at the depth so far; only buckets with two members or more
    are sorted again, and what the others point at stays as it is.
    """
    size, q = len(data), min(q, length)
    reach = np.zeros(size + 1, np.int64)
    np.add.at(reach, windows, 1)
    np.add.at(reach, np.minimum(windows + length - q + 1, size), -1)
    used = np.flatnonzero(np.cumsum(reach[:size]) > 0)  # whole q-grams within windows
    bucket = np.zeros(size + length, np.int64)
    _, bucket[used] = np.unique(identifiers(data, q, q)[0][used], return_inverse=True)
    depth = q
    while depth < length:
        step = min(depth, length - depth)
        n = np.bincount(bucket[used])
        active = used[n[bucket[used]] > 1]
        if not len(active):
            break
        top = len(n)
        _, rank = np.unique(bucket[active] * (top + 1) + bucket[active + step], return_inverse=True)
        bucket[active] = rank + top  # beyond the identifiers of those that stay
        depth += step
    _, rank, n = np.unique(bucket[windows], return_inverse=True, return_counts=True)
    return n[rank] > 1


def _settle(rows: DataFrame, length: int) -> DataFrame:
    """Repeated ranges of the open runs: (chunk, at, start, end)."""
    total = rows.agg(F.sum(F.length("bytes"))).first()[0] or 0
    parts = max(1, -(-total // TASK))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for t in streamed(batches, "key", RUNS):
            data, edges = buffer_of(t.column("bytes").to_pylist())
            sizes = np.diff(edges) - 1 - length + 1
            doc = np.repeat(np.arange(len(sizes)), sizes)
            w = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + edges[doc]
            hit = refine(data, w, length)
            doc, at = doc[hit], (w - edges[doc])[hit]
            d, s, e = merged(doc, at, at + length)
            base = t.column("start").to_numpy()[d]
            yield from pa.table({"chunk": t.column("chunk").to_numpy()[d], "at": t.column("at").to_numpy()[d], "start": base + s, "end": base + e}).to_batches(max_chunksize=100_000)
            del t, data, doc, at, w, hit
        trim()

    return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "chunk long, at long, start long, end long")


def repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, q: int = Q) -> tuple[DataFrame, str, int]:
    """(ranges, root of the chunks, about how many): chunk, at, start, end of what repeats, and one row with ``at`` -1 for each chunk."""

    def survey(table):
        data, edges = buffer_of(table.column(text).cast("binary").to_pylist())
        r = runs_of(data, edges, length, q)
        order, begin = _sorted_runs(r)
        n = np.diff(np.append(begin, len(order)))
        tie = np.logical_or.reduceat(r["tie"][order], begin) if len(begin) else np.zeros(0, bool)
        one = order[begin]
        # The last row tells of the chunk itself.
        return {"anchor": np.append(r["anchor"][one], 0), "name": np.append(r["name"][one], 0), "n": np.append(n, 0).astype(np.int32), "tie": np.append(tie, False)}

    rows, root = into_chunks(docs, survey, "anchor long, name long, n int, tie boolean", "runs", text, CHUNK)

    def expand(table):
        import pyarrow as pa

        chunk = table.column("chunk")[0].as_py()
        raws = read_chunk(root, chunk, [text]).column(text).cast("binary").to_pylist()
        data, edges = buffer_of(raws)
        r = runs_of(data, edges, length, q)
        told = pair(table.column("anchor").to_numpy().view(U), table.column("name").to_numpy().view(U))
        o = np.argsort(told)
        told = told[o]
        own = pair(r["anchor"].view(U), r["name"].view(U))
        k = np.minimum(np.searchsorted(told, own), len(told) - 1)
        known = told[k] == own
        verdict = np.where(known, table.column("verdict").to_numpy()[o][k], 0)
        hot = known & table.column("hot").to_numpy(zero_copy_only=False)[o][k]
        s = (verdict == SETTLED) | (verdict == SAMPLE)
        d, a, z = merged(r["doc"][s], r["first"][s] - edges[r["doc"][s]], r["last"][s] + length - edges[r["doc"][s]])
        out = [pa.table({"chunk": np.full(len(d), chunk, np.int64), "at": d, "start": a, "end": z, "key": np.zeros(len(d), np.int64), "bytes": pa.nulls(len(d), pa.binary())})]
        go = np.flatnonzero((verdict == OPEN) | (verdict == SAMPLE))
        if len(go):
            _, once = np.unique(own[go], return_index=True)  # equal runs of a chunk go once; OPEN ones are single
            go = go[np.sort(once)]
            first, last, key, doc = r["first"][go], r["last"][go], r["anchor"][go], r["doc"][go]
            if (h := hot[go]).any():  # a row for each window, by its own bytes
                n = (last - first + 1)[h]
                w = np.repeat(first[h], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                more = pair(np.repeat(key[h], n).view(U), mix(r["whole"][w])).view(np.int64)
                first, last = np.concatenate([first[~h], w]), np.concatenate([last[~h], w])
                key, doc = np.concatenate([key[~h], more]), np.concatenate([doc[~h], np.repeat(doc[h], n)])
            raw = data.tobytes()
            out.append(pa.table({"chunk": np.full(len(first), chunk, np.int64), "at": doc, "start": first - edges[doc], "end": last + length - edges[doc], "key": key, "bytes": pa.array([raw[x:y] for x, y in zip(first.tolist(), (last + length).tolist())], pa.binary())}))
        del data, r, raws, own
        trim()
        return pa.concat_tables(out)

    chunks = chunk_count(rows)
    told = written(by_chunk(_verdicts(rows), chunks).applyInArrow(expand, "chunk long, at long, start long, end long, key long, bytes binary"), "open-runs")
    found = told.where("bytes IS NULL").select("chunk", "at", "start", "end").unionByName(_settle(told.where("bytes IS NOT NULL"), length))
    every = rows.where("n = 0").select("chunk", F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))
    return found.unionByName(every), root, chunks


def _cut(table, root: str, columns: list[str] | None, text: str):
    """(documents of the chunk, their bytes, removed ranges of each)."""
    docs = read_chunk(root, table.column("chunk")[0].as_py(), columns)
    at, start, end = (table.column(c).to_numpy() for c in ("at", "start", "end"))
    own = at >= 0
    d, s, e = merged(at[own], start[own], end[own])
    ranges: list[list[tuple[int, int]]] = [[] for _ in range(len(docs))]
    for k, a, z in zip(d.tolist(), s.tolist(), e.tolist()):
        ranges[k].append((a, z))
    return docs, [t or b"" for t in docs.column(text).cast("binary").to_pylist()], ranges


def without(raw: bytes, ranges: list[tuple[int, int]]) -> bytes:
    if not ranges:
        return raw
    at, out = 0, []
    for a, z in ranges:
        out.append(raw[at:a])
        at = z
    return b"".join([*out, raw[at:]])


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """What is removed from each document, with the ranges."""
    found, root, chunks = repeats(docs, text, **how)

    def tell(table):
        import pyarrow as pa

        docs, raws, ranges = _cut(table, root, [key, text], text)
        return pa.table({
            "doc_id": docs.column(key).cast("int64"),
            "n_bytes": pa.array([len(x) for x in raws], pa.int64()),
            "n_removed": pa.array([sum(z - a for a, z in r) for r in ranges], pa.int64()),
            "n_spans": pa.array([len(r) for r in ranges], pa.int64()),
            "kept_sha256": [hashlib.sha256(without(x, r)).hexdigest() for x, r in zip(raws, ranges)],
            "spans": pa.array([[y for x in r for y in x] for r in ranges], pa.list_(pa.int64())),
        })

    return by_chunk(found, chunks).applyInArrow(tell, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")


def deduplicated(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The documents without what repeats, with all their columns; half characters at a cut go too. n_chars follows the text."""
    found, root, chunks = repeats(docs, text, **how)
    names, schema = docs.columns, docs.schema

    def cut(table):
        import pyarrow as pa

        docs, raws, ranges = _cut(table, root, None, text)
        texts = [None if t is None else without(x, r).decode("utf-8", "ignore") for t, x, r in zip(docs.column(text).to_pylist(), raws, ranges)]
        out = {n: docs.column(n) for n in names} | {text: pa.array(texts, pa.string())}
        if "n_chars" in out:
            out["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
        return pa.table(out)

    return by_chunk(found, chunks).applyInArrow(cut, schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return removed(docs).drop("spans")
