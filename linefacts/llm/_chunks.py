"""Documents in chunk files of a few megabytes in the shared folder.

A first pass writes the chunks and emits rows about them; what the cluster
decides about those rows comes back grouped by chunk, and a later pass reads
the chunk's file. So texts move through no shuffle, a task holds one chunk,
and what one chunk says about a hot key is one row, however many of its
documents have it.

A chunk's name is drawn by the task attempt that writes it and the rows that
name it are committed with it, so a rerun task leaves unnamed files at worst.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from linefacts.llm._shared import filesystem, new_path, trim, written

CHUNK = 4 << 20


def chunk_file(root: str, chunk: int) -> str:
    return f"{root}/{chunk & (2**64 - 1):016x}.parquet"


def read_chunk(root: str, chunk: int, columns: list[str] | None = None):
    import pyarrow.parquet as pq

    fs, p = filesystem(chunk_file(root, chunk))
    with fs.open_input_file(p) as f:
        return pq.read_table(f, columns=columns)


def chunk_count(rows: DataFrame) -> int:
    """About how many chunks the rows name."""
    return max(1, rows.agg(F.approx_count_distinct("chunk").alias("n")).first().n)


def by_chunk(rows: DataFrame, chunks: int) -> GroupedData:
    """Rows grouped by chunk, with two tasks for each chunk, so that few get more than one: the rows are small and the work is not, so their size says nothing."""
    return rows.repartition(2 * chunks, "chunk").groupBy("chunk")


def streamed(batches: Iterator, by: str, size: int) -> Iterator:
    """Tables of whole runs of equal ``by``, of about ``size`` rows; runs come one after another."""
    import numpy as np
    import pyarrow as pa

    held, rows = [], 0
    for b in batches:
        at = 0
        if rows + b.num_rows > size and b.num_rows:
            key = b.column(by).to_numpy()
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            if held and held[-1].column(by)[-1].as_py() != key[0].item():
                cuts = np.append(0, cuts)
            for c in cuts.tolist():
                if rows + c - at >= size or c == cuts[-1]:
                    held.append(b.slice(at, c - at))
                    if (t := pa.Table.from_batches(held)).num_rows:
                        yield t.combine_chunks()
                    held, rows, at = [], 0, c
        held.append(b.slice(at))
        rows += b.num_rows - at
    if held and rows:
        yield pa.Table.from_batches(held).combine_chunks()


def into_chunks(docs: DataFrame, work: Callable, schema: str, name: str, text: str = "text", size: int = CHUNK) -> tuple[DataFrame, str]:
    """(rows, root): what ``work`` says of each chunk's table, with the chunk's number in ``chunk``.

    ``work`` takes a pyarrow table with the columns of ``docs`` and returns a
    dict of columns in the order of ``schema``, or an iterator of such.
    """
    root = new_path(docs.sparkSession, f"{name}-chunks")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        held, room = [], size

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            chunk = uuid.uuid4().int >> 65
            fs, p = filesystem(chunk_file(root, chunk))
            fs.create_dir(p.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(p) as f:
                pq.write_table(table, f, compression="zstd", compression_level=1, use_dictionary=False, write_statistics=False)
            out = work(table)
            for cols in [out] if isinstance(out, dict) else out:
                n = len(next(iter(cols.values())))
                yield from pa.table({"chunk": np.full(n, chunk, np.int64)} | cols).to_batches(max_chunksize=200_000)

        for b in batches:
            if not b.num_rows:
                continue
            sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
            ends, at = np.cumsum(sizes), 0
            while at < b.num_rows:
                base = int(ends[at - 1]) if at else 0
                to = min(b.num_rows, int(np.searchsorted(ends, base + room, "left")) + 1)
                held.append(b.slice(at, to - at))
                room -= int(ends[to - 1]) - base
                at = to
                if room <= 0:
                    yield from flush()
                    held, room = [], size
                    trim()
        if held:
            yield from flush()
        held = None
        trim()

    return written(docs.mapInArrow(run, "chunk long, " + schema), name), root
