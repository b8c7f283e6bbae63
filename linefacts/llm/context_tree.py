"""Language-model scores by context-tree weighting, learnt from all training documents.

The model predicts the bytes of a text (A-Z lower-cased, then an end byte that
UTF-8 lacks), each as eight binary decisions down a tree of 255 nodes, given up
to ``depth`` bytes before it. For every context of every depth and every node,
the Krichevsky-Trofimov estimate of what training saw there is mixed with what
the longer contexts say: a node's weighted block probability is half its own
estimate and half the product of its children's, and the share of its own half
is its weight when it predicts. A context that training never saw adds nothing.

Work is divided like this. Chunks of documents count their own (depth + 1)-grams
of bytes; totals add up all training documents. Grams are dealt by their three
nearest bytes and sorted by them; a task streams them, and holds some such
triples at a time. What contexts of three bytes add up to for those of two is a
partial sum for each triple, so a very common pair of bytes is dealt to as many
tasks as it has triples; the pairs' nodes go back to each of their triples. What
pairs add up to for contexts of one byte and none is at most 65,280 rows, which
the driver weighs and gives back. Each chunk then gets the log-probability of
each of its grams and sums up its documents. Nothing is sampled, and no table
of the corpus is broadcast.

The base score counts words: add-one estimates of all training tokens.

Cases: null text is empty (only the end is scored). Null doc_id counts as
training (its number as text is empty). Repeated rows count as often as they
are there. No training documents: every bit has probability one half. No rows:
no rows. Words are told apart by a 64-bit hash and their length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linefacts.llm._chunks import by_chunk, chunk_count, into_chunks, read_chunk, streamed
from linefacts.llm._hash import Lookup, U, buffer_of, lanes, word_hashes, words_of
from linefacts.llm._shared import trim, written

DEPTH = 5
CHUNK = 16 << 20
BLOCK = 1 << 20
#: Contexts of so many bytes and more are weighed where their triple is; grams that a task weighs at a time.
LOW, GRAMS = 3, 1 << 18
WORD, GRAM, TOLD = 0, 1, 2


def held_out(doc_id: int | None, of: int = 7, at: int = 2) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % of == at


def lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0: Stirling's series at x + 8."""
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k) if k < 4 else shift
    log = np.log(shift)
    for k in range(4, 8):
        log = log + np.log(x + k)
    y = x + 8
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z / 1260)) / y - log


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - math.log(math.pi) - lgamma(n0 + n1 + 1.0)


def weigh(n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log of the weighted probability, share of the own estimate)."""
    own = log_kt(n0, n1) - math.log(2)
    out = np.logaddexp(own, below - math.log(2))
    return out, np.exp(own - out)


def blocks_of(raws: list[bytes | None], depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, where each document's begin) for blocks of documents; a document has a gram for each byte and one for its end."""
    at, mask = 0, U((1 << 8 * (depth + 1)) - 1)
    while at < len(raws):
        to, size = at, 0
        while to < len(raws) and (size < BLOCK or to == at):
            size += len(raws[to] or b"")
            to += 1
        pad = b"\xff" * depth
        texts = [(t or b"").lower() for t in raws[at:to]]
        data = np.frombuffer(b"".join(pad + t + b"\xff" for t in texts), np.uint8)
        n = np.array([len(t) + 1 for t in texts])
        begin = np.cumsum(n) - n
        place = np.arange(int(n.sum())) + np.repeat(np.arange(len(n)) * depth, n)  # of the gram's first byte
        yield lanes(data)[place] & mask, begin
        at = to


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        return np.unique(keys, return_counts=True)
    k, back = np.unique(keys, return_inverse=True)
    return k, np.bincount(back, weights, len(k)).astype(np.int64)


def gram_counts(raws: list[bytes | None], train: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a chunk and how often its training documents have each."""
    parts = []
    order = [i for i in range(len(raws)) if train[i]], [i for i in range(len(raws)) if not train[i]]
    for learn, own in zip((1, 0), order):
        for grams, _ in blocks_of([raws[i] for i in own], depth):
            k, n = _counted(grams)
            parts.append((k, n * learn))
    return _counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, U), np.zeros(0, np.int64))


def word_blocks(raws: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash of each word, its document) for blocks of documents."""
    at = 0
    while at < len(raws):
        to, size = at, 0
        while to < len(raws) and (size < BLOCK or to == at):
            size += len(raws[to] or b"")
            to += 1
        data, edges = buffer_of([(t or b"").lower() for t in raws[at:to]])
        s, e = words_of(data)
        yield word_hashes(data, s, e), np.searchsorted(edges, s, "right") - 1 + at
        at = to


def word_counts(raws: list[bytes | None], train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of a chunk and how often its training documents have each."""
    parts = [_counted(h, train[doc]) for h, doc in word_blocks(raws)]
    return _counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, U), np.zeros(0, np.int64))


class Nodes:
    """The binary nodes of one context depth in a partition: for each gram and bit, its node; counts by node."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, context_bytes: int, depth: int):
        x = (grams >> U(8 * depth)) & U(255)
        ctx = (grams >> U(8 * (depth - context_bytes))) & U((1 << 8 * context_bytes) - 1) if context_bytes else np.zeros(len(grams), U)
        keys = np.empty((8, len(grams)), U)
        for j in range(8):
            keys[j] = (ctx << U(8)) | U(1 << j) | (x >> U(8 - j))
        self.keys, node = np.unique(keys.ravel(), return_inverse=True)
        self.node = node.reshape(8, -1)
        bit = np.stack([(x >> U(7 - j)) & U(1) for j in range(8)]).ravel().astype(bool)
        w = np.tile(n.astype(float), 8)
        self.n1 = np.bincount(node, w * bit, len(self.keys))
        self.n0 = np.bincount(node, w * ~bit, len(self.keys))
        self.bit = bit.reshape(8, -1)

    def above(self, other: "Nodes") -> np.ndarray:
        """For each node, the node of ``other``, whose contexts are a byte shorter."""
        out = np.empty(len(self.keys), np.int64)
        out[self.node.ravel()] = other.node.ravel()
        return out


def tree(grams: np.ndarray, n: np.ndarray, depth: int) -> list[tuple[Nodes, np.ndarray, np.ndarray]]:
    """(nodes, log weighted probability, share) of the contexts of ``LOW`` to ``depth`` bytes; the longest first."""
    out, below = [], None
    for d in range(depth, LOW - 1, -1):
        nodes = Nodes(grams, n, d, depth)
        if below is None:
            logs = log_kt(nodes.n0, nodes.n1)
            share = np.ones(len(logs))
        else:
            longer, long_logs = below
            logs, share = weigh(nodes.n0, nodes.n1, np.bincount(longer.above(nodes), long_logs, len(nodes.keys)))
        out.append((nodes, logs, share))
        below = nodes, logs
    return out


def _kt(n0, n1, bit):
    return (np.where(bit, n1, n0) + 0.5) / (n0 + n1 + 1.0)


def gram_logs(grams: np.ndarray, n: np.ndarray, own: np.ndarray, pairs: np.ndarray, top: dict[str, np.ndarray], depth: int) -> np.ndarray:
    """log10 of the probability of each gram's last byte after its others. pairs: (n0, n1, share) of 256 nodes for some pairs of bytes; ``own``: which of them a gram has."""
    p = seen = None
    for nodes, _, share in tree(grams, n, depth):
        n0, n1 = nodes.n0[nodes.node], nodes.n1[nodes.node]
        kt = _kt(n0, n1, nodes.bit)
        w = share[nodes.node]
        p = kt if p is None else np.where(seen, w * kt + (1 - w) * p, kt)
        seen = n0 + n1 > 0
        bit = nodes.bit
    x = ((grams >> U(8 * depth)) & U(255)).astype(np.int64)
    near = ((grams >> U(8 * (depth - 1))) & U(255)).astype(np.int64)
    node = np.stack([(1 << j) | (x >> (8 - j)) for j in range(8)])
    for n0, n1, w in ((pairs[0][own, node], pairs[1][own, node], pairs[2][own, node]), (top["n0"][near, node], top["n1"][near, node], top["share"][near, node]), (top["r0"][node], top["r1"][node], top["root"][node])):
        kt = _kt(n0, n1, bit)
        p = np.where(seen, w * kt + (1 - w) * p, kt)
        seen = n0 + n1 > 0
    return np.log10(p).sum(axis=0)


def _table(batches: Iterator):
    import pyarrow as pa

    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def _totals(rows: DataFrame) -> DataFrame:
    """For each word that more than one chunk has: its total, for each such chunk. And, with chunk -1, how many training words a partition has."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        t = _table(batches)
        if t is None:
            return
        key, back, rows = np.unique(t.column("key").to_numpy(), return_inverse=True, return_counts=True)
        n = np.bincount(back, t.column("n").to_numpy(), len(key))
        many = rows[back] > 1
        yield from pa.table({"chunk": np.append(t.column("chunk").to_numpy()[many], -1), "key": np.append(t.column("key").to_numpy()[many], 0), "value": np.append(n[back][many], (n > 0).sum()).astype(float)}).to_batches(max_chunksize=200_000)

    return rows.repartition("key").mapInArrow(run, "chunk long, key long, value double")


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, of: int = 7, at: int = 2) -> DataFrame:
    spark = docs.sparkSession

    def survey(table):
        raws = table.column(text).cast("binary").to_pylist()
        train = np.array([not held_out(i, of, at) for i in table.column(key).to_pylist()])
        word, n = word_counts(raws, train)
        gram, m = gram_counts(raws, train, depth)
        kind = np.concatenate([np.full(len(word), WORD), np.full(len(gram), GRAM), [TOLD]]).astype(np.int32)
        tokens = int(n.sum()) + int(train.sum())
        return {"kind": kind, "key": np.concatenate([word.view(np.int64), gram.view(np.int64), [tokens]]), "n": np.concatenate([n, m, [int(train.sum())]])}

    rows, root = into_chunks(docs.select(key, text), survey, "kind int, key long, n long", "counts", text, CHUNK)
    told = rows.where(F.col("kind") == TOLD).agg(F.sum("key"), F.sum("n")).first()
    tokens, ends, chunks = int(told[0] or 0), int(told[1] or 0), chunk_count(rows.where(F.col("kind") == TOLD))

    words = written(_totals(rows.where(F.col("kind") == WORD)), "words")
    distinct = int(words.where("chunk = -1").agg(F.sum("value")).first()[0] or 0) + (ends > 0)

    grams = written(rows.where(F.col("kind") == GRAM).groupBy("key").agg(F.sum("n").alias("n")), "grams")
    triple = F.shiftright("key", 8 * (depth - LOW)).bitwiseAND(F.lit(0xFFFFFF)).cast("int")

    def upward(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, found = [], 0

        def told():
            to, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            sums = [np.bincount(back, np.concatenate([h[k] for h in held])) for k in (1, 2, 3)]
            return pa.RecordBatch.from_pydict(dict(zip(("node", "logs", "n0", "n1"), (to, *sums))))

        for t in streamed(batches, "triple", GRAMS):
            nodes, logs, _ = tree(t.column("key").to_numpy().view(U), t.column("n").to_numpy(), depth)[-1]
            # (the two nearest bytes, node) of each node of three-byte contexts
            node, pair_ = (nodes.keys & U(255)).astype(np.int64), (nodes.keys >> U(16)).astype(np.int64)
            to, back = np.unique(pair_ * 256 + node, return_inverse=True)
            held.append((to, np.bincount(back, logs), np.bincount(back, nodes.n0), np.bincount(back, nodes.n1)))
            found += len(to)
            if found > GRAMS:
                yield told()
                held, found = [], 0
        if held:
            yield told()

    placed = grams.withColumn("triple", triple)
    sums = placed.repartition("triple").sortWithinPartitions("triple").mapInArrow(upward, "node long, logs double, n0 double, n1 double").groupBy("node").agg(*(F.sum(c).alias(c) for c in ("logs", "n0", "n1")))

    def weighed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            n0, n1 = b.column("n0").to_numpy(), b.column("n1").to_numpy()
            logs, share = weigh(n0, n1, b.column("logs").to_numpy())
            node = b.column("node").to_numpy()
            yield pa.RecordBatch.from_pydict({"pair": (node >> 8).astype(np.int32), "node": node & 255, "logs": logs, "n0": n0, "n1": n1, "share": share})

    pairs = written(sums.mapInArrow(weighed, "pair int, node long, logs double, n0 double, n1 double, share double"), "pairs")
    first = (F.shiftright("pair", 8) * 256 + F.col("node")).alias("node")
    up = pairs.groupBy(first).agg(F.sum("logs"), F.sum("n0"), F.sum("n1")).collect()  # 65,280 rows at most
    top = {k: np.zeros((256, 256)) for k in ("logs", "n0", "n1")}
    for node, logs, n0, n1 in up:
        top["logs"].flat[node], top["n0"].flat[node], top["n1"].flat[node] = logs, n0, n1
    one, top["share"] = weigh(top["n0"], top["n1"], top["logs"])
    top["r0"], top["r1"] = top["n0"].sum(axis=0), top["n1"].sum(axis=0)
    _, top["root"] = weigh(top["r0"], top["r1"], one.sum(axis=0))

    # A pair's nodes, 255 at most, for each of its triples: the first row of the triple.
    told = pairs.groupBy("pair").agg(F.flatten(F.collect_list(F.array(F.col("node").cast("double"), "n0", "n1", "share"))).alias("nodes"))
    heads = placed.select("triple").distinct().withColumn("pair", F.shiftright("triple", 8)).join(told, "pair")
    both = placed.select("triple", "key", "n", F.lit(None).cast("int").alias("pair"), F.lit(None).cast("array<double>").alias("nodes")).unionByName(heads.select("triple", F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("n"), "pair", "nodes"))

    def downward(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for t in streamed(batches, "triple", GRAMS):
            own, head = t.column("triple").to_numpy(), t.column("nodes").is_valid().to_numpy()
            seen = np.unique(own[head] >> 8)
            pairs = np.zeros((3, len(seen), 256))
            done: set[int] = set()
            for p, nodes in zip((own[head] >> 8).tolist(), t.column("nodes").filter(t.column("nodes").is_valid())):
                if p not in done:
                    done.add(p)
                    x = nodes.values.to_numpy().reshape(-1, 4)
                    pairs[:, np.searchsorted(seen, p), x[:, 0].astype(np.int64)] = x[:, 1:].T
            g = t.column("key").to_numpy()[~head]
            n = t.column("n").to_numpy()[~head]
            value = gram_logs(g.view(U), n, np.searchsorted(seen, own[~head] >> 8), pairs, top, depth)
            yield from pa.table({"key": g, "value": value}).to_batches(max_chunksize=200_000)

    model = both.repartition("triple").sortWithinPartitions("triple").mapInArrow(downward, "key long, value double")
    asked = rows.where(F.col("kind") == GRAM).select("chunk", "key").join(model, "key").select("chunk", F.lit(GRAM).alias("kind"), "key", "value")
    known = words.where("chunk <> -1").select("chunk", F.lit(WORD).alias("kind"), "key", "value")
    every = rows.where(F.col("kind") == TOLD).select("chunk", F.lit(TOLD).alias("kind"), F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("value"))

    def score(table):
        import pyarrow as pa

        docs = read_chunk(root, table.column("chunk")[0].as_py())
        raws, ids = docs.column(text).cast("binary").to_pylist(), docs.column(key).to_pylist()
        out = np.array([held_out(i, of, at) for i in ids], bool)
        kind, keys, value = (table.column(c).to_numpy() for c in ("kind", "key", "value"))
        mine, c = word_counts(raws, ~out)  # of this chunk alone; others tell the rest
        c = c.astype(float)
        c[np.searchsorted(mine, keys[kind == WORD].view(U))] = value[kind == WORD]
        end = math.log10((ends + 1) / (tokens + distinct + 1))
        n, have, base = np.zeros(len(raws), np.int64), np.full(len(raws), int(ends > 0)), np.full(len(raws), end)
        for h, doc in word_blocks(raws):
            total = c[np.searchsorted(mine, h)]
            n += np.bincount(doc, minlength=len(raws))
            have += np.bincount(doc, total > 0, len(raws)).astype(np.int64)
            base += np.bincount(doc, np.log10((total + 1) / (tokens + distinct + 1)), len(raws))
        del mine, c
        found, parts = Lookup(keys[kind == GRAM].view(U), value[kind == GRAM]), []
        del table, kind, keys, value
        for grams, begin in blocks_of(raws, depth):
            parts.append(np.add.reduceat(found.get(grams), begin))
        model = np.concatenate(parts) if parts else np.zeros(0)
        size = np.array([len(t or b"") for t in raws], np.int64)
        del found, parts
        trim()
        return pa.table({
            "doc_id": docs.column(key).cast("int64"),
            "held_out": pa.array(out),
            "n_tokens": (n + 1).astype(np.int64),
            "n_known": have,
            "train_tokens": np.full(len(raws), tokens, np.int64),
            "base_score": base,
            "score": model,
            "bits_per_byte": -model / math.log10(2) / np.maximum(size, 1),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return by_chunk(asked.unionByName(known).unionByName(every), chunks).applyInArrow(score, schema)


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
