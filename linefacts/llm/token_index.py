"""Token ids as raw binary shards with a minimal perfect hash index.

Layout of a store (all files in the shared folder):

* ``ids-*.bin``: the ids of a shard's documents, one after another, as
  little-endian unsigned integers of ``width`` bytes (2 if the vocabulary has
  no more than 65,536 ids, else 4) and nothing else;
* ``off-*.bin``: n + 1 little-endian unsigned 64-bit positions into it;
* ``mph-*.npz``: for each bucket of keys, the bit levels of a minimal perfect
  hash function and, in its order, a 32-bit fingerprint of the key, the shard,
  the document's place in it and how many rows have that key.

A lookup hashes the key to a bucket, finds the one set bit among the levels,
takes its rank as the slot, compares the fingerprint, and reads the document's
range of the shard: constant time, whatever the number of keys.

Cases: null text is an empty document (its end id alone). Keys are integers;
null is a key too (it sorts first). Rows that share a key are adjacent (in the
order of their texts' hashes); a lookup gives all of them. No rows: a store
without shards. Other columns of the input are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linefacts.llm._hash import U, mix
from linefacts.llm._shared import filesystem, new_path, written
from linefacts.llm._tok import encoder

#: Keys in a bucket of the index, on average.
BUCKET = 200_000
#: Bits for each key on a level.
GAMMA = 2.0
#: Documents that are encoded at once.
BATCH = 256
#: Bytes after which a shard ends and the next begins; shards of one task at most (far beyond what one writes).
SHARD, ROLLS = 256 << 20, 1 << 20
#: Documents with gaps of at most so many bytes are read at once, up to so many bytes.
GAP, SPAN = 64 << 10, 4 << 20


def build_mph(hashes: np.ndarray) -> dict[str, np.ndarray]:
    """Bit levels for distinct 64-bit hashes: a hash has the first level where no other falls on its bit."""
    words, sizes, rest, level = [], [], hashes, 0
    while len(rest):
        m = max(64, int(len(rest) * GAMMA) + 63) // 64 * 64
        at = _bit(rest, level, m)
        alone = np.bincount(at, minlength=m) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        sizes.append(m)
        rest = rest[~alone[at]]
        level += 1
    packed = np.concatenate(words) if words else np.zeros(0, "<u8")
    ranks = np.zeros(len(packed) + 1, np.int64)
    np.cumsum(np.bitwise_count(packed), out=ranks[1:])
    return {"bits": packed, "ranks": ranks, "sizes": np.array(sizes, np.int64)}


def _bit(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(hashes + U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % U(size)).astype(np.int64)


def slot_of(mph: dict[str, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """The slot of each hash; -1 where no level has its bit (a key that was not built in)."""
    out, rest, base = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), 0
    bits, ranks = mph["bits"], mph["ranks"]
    for level, size in enumerate(mph["sizes"].tolist()):
        if not len(rest):
            break
        at = _bit(hashes[rest], level, size)
        word, bit = base // 64 + at // 64, U(1) << (at % 64).astype(U)
        hit = (bits[word] & bit) != 0
        out[rest[hit]] = ranks[word[hit]] + np.bitwise_count(bits[word[hit]] & (bit[hit] - U(1)))
        rest, base = rest[~hit], base + size
    return out


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ U(0xA5A5A5A5DEADBEEF)) >> U(32)).astype(np.uint32)


def key_hash(keys: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(U))


@dataclass
class TokenStore:
    spark: SparkSession
    root: str
    shards: DataFrame  # shard, ids_path, off_path, n_docs, n_tokens, base (ids before it)
    index: DataFrame  # bucket, index_path, n_keys
    buckets: int
    width: int

    def lookup(self, keys: DataFrame, key: str = "doc_id") -> DataFrame:
        """(key, shard, at, rows) of each distinct key of ``keys`` that the store has."""
        held = keys.select(F.col(key).cast("long").alias("key")).distinct().withColumn("bucket", _bucket("key", self.buckets))
        held = held.join(self.index, "bucket")

        def find(table):
            import pyarrow as pa

            ix = _load(table.column("index_path")[0].as_py())
            keys = table.column("key")
            if table.column("bucket")[0].as_py() < 0:
                slot = np.zeros(len(table), np.int64)
            else:
                h = key_hash(keys.to_numpy())
                slot = slot_of(ix, h)
                slot[(slot >= 0) & (ix["prints"][slot] != fingerprint(h))] = -1
            ok = slot >= 0
            return pa.table({"key": keys.filter(pa.array(ok)), "shard": ix["shard"][slot[ok]], "at": ix["at"][slot[ok]], "rows": ix["rows"][slot[ok]]})

        return held.groupBy("bucket").applyInArrow(find, "key long, shard long, at long, rows long")

    def read(self, found: DataFrame, with_ids: bool = False) -> DataFrame:
        """The documents that ``lookup`` found: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids' bytes."""
        n = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))
        rows = found.withColumn("n", n).select("key", "shard", (F.col("at") + F.col("n")).alias("at")).join(self.shards, "shard")
        rows = rows.withColumn("doc", F.col("first_doc") + F.col("at"))
        names = ["key", "doc", F.col("shard").alias("to"), "first_doc", "base", "ids_path", "off_path"]
        here = rows.where("at < n_docs").select(*names)
        # Rows of a repeated key may go on in later shards; those are found by blocks of document numbers.
        block = lambda c: F.shiftright(c, 20)
        later = rows.where("at >= n_docs").select("key", "doc", block("doc").alias("block"))
        spread = self.shards.where("n_docs > 0").withColumn("block", F.explode(F.sequence(block("first_doc"), block(F.col("first_doc") + F.col("n_docs") - 1))))
        over = later.join(spread, "block").where((F.col("doc") >= F.col("first_doc")) & (F.col("doc") < F.col("first_doc") + F.col("n_docs"))).select(*names)
        placed = here.unionByName(over)

        def load(batches: Iterator) -> Iterator:
            import pyarrow as pa

            files: dict[str, tuple] = {}
            for b in batches:
                for path, sub in _by_path(b):
                    if path not in files:
                        for f in files.values():
                            f[0].close()
                        fs, p = filesystem(path)
                        fo, po = filesystem(sub.column("off_path")[0].as_py())
                        with fo.open_input_stream(po) as s:
                            files = {path: (fs.open_input_file(p), np.frombuffer(s.read(), "<u8").astype(np.int64))}
                    f, off = files[path]
                    at = sub.column("doc").to_numpy() - sub.column("first_doc").to_numpy()
                    crc, ids = [], []
                    for raw in _ranges(f, off[at], off[at + 1], width):
                        raw = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
                        crc.append(zlib.crc32(raw))
                        if with_ids:
                            ids.append(raw)
                    out = {"doc_id": sub.column("key"), "start": sub.column("base").to_numpy() + off[at], "n_tokens": off[at + 1] - off[at], "ids_crc32": np.array(crc, np.int64)}
                    yield from pa.table(out | ({"ids": ids} if with_ids else {})).to_batches()

        width = self.width
        near = placed.repartition("to").sortWithinPartitions("to", "doc")
        return near.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def _ranges(f, start: np.ndarray, end: np.ndarray, width: int) -> Iterator[bytes]:
    """The bytes of each range of ids, in their order; ranges that lie close together are one read."""
    at = 0
    while at < len(start):
        a, z, to = int(start[at]), int(end[at]), at + 1
        while to < len(start) and a <= int(start[to]) <= z + GAP // width and (int(end[to]) - a) * width <= SPAN:
            z, to = max(z, int(end[to])), to + 1
        raw = f.read_at((z - a) * width, a * width)
        for x, y in zip(start[at:to].tolist(), end[at:to].tolist()):
            yield raw[(x - a) * width : (y - a) * width]
        at = to


def _by_path(batch):
    import pyarrow as pa

    paths = batch.column(batch.schema.get_field_index("ids_path")).to_pylist()
    at = [i for i in range(len(paths)) if not i or paths[i] != paths[i - 1]] + [len(paths)]
    for a, b in zip(at, at[1:]):
        yield paths[a], pa.Table.from_batches([batch.slice(a, b - a)]).combine_chunks()


def _bucket(key: str, n: int):
    return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def _load(path: str) -> dict[str, np.ndarray]:
    import io

    fs, p = filesystem(path)
    with fs.open_input_stream(p) as s:
        return dict(np.load(io.BytesIO(s.read())))


def _save(path: str, raw: bytes) -> None:
    fs, p = filesystem(path)
    fs.create_dir(p.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(p) as s:
        s.write(raw)


def write_store(docs: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text") -> TokenStore:
    """Encodes every whole text, appends ``end_id``, writes shards in ascending order of the key, and indexes every key.

    One shuffle by ranges of the key moves the texts; a shard is a range.
    """
    width = 2 if max(len(encoder(vocabulary).length), end_id + 1) <= 1 << 16 else 4
    spark, root = docs.sparkSession, new_path(docs.sparkSession, "tokens")
    # The hash of the text spreads a key that very many rows share, and orders its rows.
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(F.col("key").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"))

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shard, mark = TaskContext.get().partitionId() * ROLLS, uuid.uuid4().hex[:12]
        path = lambda what: f"{root}/{what}-{shard:012d}-{mark}.bin"
        encode, end, out, at, place, offsets = encoder(vocabulary), np.array([end_id], f"<u{width}").tobytes(), None, 0, 0, [np.zeros(1, "<u8")]
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                part = b.slice(i, BATCH)
                ids = encode(part.column("text").cast("binary").to_pylist())
                if at * width >= SHARD:  # the range goes on in the next shard
                    out.close()
                    _save(path("off"), np.concatenate(offsets).tobytes())
                    shard, out, at, place, offsets = shard + 1, None, 0, 0, [np.zeros(1, "<u8")]
                if out is None:
                    fs, p = filesystem(path("ids"))
                    fs.create_dir(p.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(p)
                for raw in ids:
                    out.write(np.frombuffer(raw, "<u4").astype(f"<u{width}").tobytes())
                    out.write(end)
                n = np.array([len(x) // 4 + 1 for x in ids], np.int64)
                ends = at + np.cumsum(n)
                offsets.append(ends.astype("<u8"))
                yield pa.RecordBatch.from_pydict({"shard": np.full(len(ids), shard, np.int64), "ids_path": [path("ids")] * len(ids), "off_path": [path("off")] * len(ids), "key": part.column("key"), "at": np.arange(place, place + len(ids)), "n_tokens": n})
                at, place = int(ends[-1]), place + len(ids)
        if out is not None:
            out.close()
            _save(path("off"), np.concatenate(offsets).tobytes())

    told = written(rows.mapInArrow(write, "shard long, ids_path string, off_path string, key long, at long, n_tokens long"), "token-rows")
    # A row for each shard; the driver adds them up.
    shards = sorted(told.groupBy("shard", "ids_path", "off_path").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).collect())
    held, base, first = [], 0, 0
    for s in shards:
        held.append((s.shard, s.ids_path, s.off_path, s.n_docs, s.n_tokens, base, first))
        base, first = base + s.n_tokens, first + s.n_docs
    table = spark.createDataFrame(held, "shard long, ids_path string, off_path string, n_docs long, n_tokens long, base long, first_doc long")
    buckets = max(1, -(-first // BUCKET))
    keys = told.groupBy("key").agg(F.min(F.struct("shard", "at")).alias("at"), F.count(F.lit(1)).alias("rows")).select("key", "at.shard", "at.at", "rows", _bucket("key", buckets).alias("bucket"))

    def build(table):
        import io

        import pyarrow as pa

        bucket = table.column("bucket")[0].as_py()
        shard, at, rows = (table.column(c).to_numpy() for c in ("shard", "at", "rows"))
        if bucket < 0:
            kept = {"shard": shard, "at": at, "rows": rows}
        else:
            h = key_hash(table.column("key").to_numpy())
            mph = build_mph(h)
            order = np.argsort(slot_of(mph, h))
            kept = mph | {"prints": fingerprint(h)[order], "shard": shard[order], "at": at[order], "rows": rows[order]}
        raw = io.BytesIO()
        np.savez(raw, **kept)
        path = f"{root}/mph-{bucket:06d}-{uuid.uuid4().hex[:12]}.npz"
        _save(path, raw.getvalue())
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "index_path": [path], "n_keys": [len(table)]})

    index = written(keys.groupBy("bucket").applyInArrow(build, "bucket int, index_path string, n_keys long"), "token-index")
    return TokenStore(spark, root, table, index, buckets, width)


def op1_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = write_store(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return store.read(store.lookup(docs))
