"""Vector best-fit packing of token sequences.

Every bin has three capacities: tokens, documents and attention cost (the sum
of squared piece lengths). Pieces come in decreasing order of length. Of the
bins that have room under every constraint, a piece takes one by

* ``norm``: the least weighted squared norm of what would be left, or
* ``dot``: the greatest weighted dot product of the piece's demand and what is
  left, each as a share of its capacity.

Bins with the same room are one state with a count, so a piece is compared
with states, not bins. Pieces are packed in groups of up to ``GROUP``; a group
leaves at most a bin or so less full than one packing of all would.

Cases: a null text is an empty document (its end id alone). Only documents of
more than ``size`` tokens are cut; their first piece has what is over. No rows:
no rows. Rows that repeat a doc_id are separate documents. Other columns of the
input are ignored unless named in ``keep``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linefacts.llm._shared import trim, written
from linefacts.llm._tok import KNOWN, encoder

GROUP = 65_536
#: Documents that are encoded at once.
BATCH = 256
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack(lengths: np.ndarray, size: int, max_docs: int, max_cost: int, by: str = "norm", weights=(1.0, 1.0, 1.0)) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. ``lengths``: 1 to ``size`` each."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    cap = np.array([size, max_docs, max_cost], np.float64)
    w = np.asarray(weights, np.float64)
    room = np.zeros((1024, 3))  # a row for each state
    members: list[list[int]] = []  # the bins of a state
    state: dict[tuple[int, int, int], int] = {}
    free: list[int] = []
    used = 0  # rows of `room` in use
    n_bins = 0
    filled: list[int] = []

    def put(bin_: int, left: tuple[int, int, int]) -> None:
        nonlocal room, used
        if left[0] < least or left[1] < 1 or left[2] < least * least:
            return  # no later piece fits
        k = state.get(left)
        if k is None:
            if free:
                k = free.pop()
            else:
                if used == len(room):
                    room = np.vstack([room, np.zeros_like(room)])
                k = used
                used += 1
                members.append([])
            state[left] = k
            room[k] = left
        members[k].append(bin_)

    least = int(lengths.min()) if len(lengths) else 0
    for i in order.tolist():
        n = int(lengths[i])
        need = np.array([n, 1, n * n], np.float64)
        k = -1
        if used:
            left = room[:used] - need
            fits = np.flatnonzero((left >= 0).all(axis=1))
            if len(fits):
                score = ((left[fits] / cap) ** 2 @ w) if by == "norm" else -((room[fits] / cap) @ (w * need / cap))
                k = int(fits[np.argmin(score)])
        if k < 0:
            b, had = n_bins, (size, max_docs, max_cost)
            n_bins += 1
            filled.append(0)
        else:
            had = tuple(map(int, room[k]))
            b = members[k].pop()
            if not members[k]:
                del state[had]
                room[k] = -1
                free.append(k)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += n
        put(b, (had[0] - n, had[1] - 1, had[2] - n * n))
    return bins, offsets


def pieces_of(docs: DataFrame, vocabulary: str, end_id: int, size: int, key: str = "doc_id", text: str = "text", with_ids: bool = False, known: int = KNOWN) -> DataFrame:
    """Each document's ids with the end id, cut if longer than ``size``."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode, end = encoder(vocabulary, known), np.array([end_id], "<u4").tobytes()
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                part = b.slice(i, BATCH)
                rows: list[tuple] = []
                for key_, raw in zip(part.column("doc_id").to_pylist(), encode(part.column("text").cast("binary").to_pylist())):
                    raw += end
                    n = len(raw) // 4
                    at, k = 0, 0
                    while at < n:
                        to = at + (min(n, size) if n <= size else (n % size or size) if not k else size)
                        rows.append((key_, k, at, to - at, zlib.crc32(raw[at * 4 : to * 4]), raw[at * 4 : to * 4] if with_ids else None))
                        at, k = to, k + 1
                cols = list(zip(*rows))
                out = {"doc_id": pa.array(cols[0], pa.int64()), "piece": pa.array(cols[1], pa.int32()), "start": pa.array(cols[2], pa.int64()), "length": pa.array(cols[3], pa.int64()), "ids_crc32": pa.array(cols[4], pa.int64())}
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(cols[5], pa.binary())} if with_ids else {}))
            rows = cols = out = None
            trim()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECE + ", ids binary" * with_ids)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, size: int = 1024, max_docs: int | None = None, max_cost: int | None = None, by: str = "norm", weights=(1.0, 1.0, 1.0), with_ids: bool = False, known: int = KNOWN) -> DataFrame:
    """Pieces with their sequence and place. The default document and attention capacities never bind, so bins are as few as can be.

    Texts don't move: a piece is a row of 40 bytes (without its ids).
    """
    max_docs, max_cost = max_docs or size, max_cost or size * size
    pieces = written(pieces_of(docs, vocabulary, end_id, size, with_ids=with_ids, known=known).withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // GROUP))

    def fill(table):
        import pyarrow as pa

        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        bins, offsets = pack(table.column("length").to_numpy(), size, max_docs, max_cost, by, weights)
        group = table.column("group").to_numpy()
        table = table.append_column("sequence_id", pa.array(group * (1 << 32) + bins)).append_column("offset", pa.array(offsets))
        return table.drop_columns(["row", "group"])

    schema = PIECE + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return pieces.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("group").applyInArrow(fill, schema)


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
