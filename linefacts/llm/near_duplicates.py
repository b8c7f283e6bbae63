"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

1. Each document's set of word n-grams is hashed; equal sets are one class.
2. A forest of ``trees`` prefix tries: each class has a label of ``depth``
   MinHash values in every tree, and a trie is its tree's labels in sorted
   order. Neighbours in that order share the longest prefixes; a run of labels
   with a common prefix is a node of the trie, a bucket of candidates.
3. Matched prefixes are shortened adaptively, from the full depth on. At each
   depth the classes that are still open ask for what shares so long a prefix
   with them and no longer one; those pairs are verified exactly. A class's
   links of similarity s stand for 1 / P(s) links each, P(s) being the chance
   of meeting at that depth in some tree; with one more link assumed at the
   threshold, it closes when the links that it is likely to lack are less than
   ``1 - recall`` of all. At the depth at which a pair at the threshold meets
   with probability ``recall``, all close. So classes in large groups of near
   copies stop at long, selective prefixes, and those with few links go on.
4. Pairs never leave a task. Classes that buckets tie together, directly or by
   others, are verified as one group, in pairs of blocks of at most about
   ``BLOCK`` classes; a group so large and loose that its buckets are cheaper is
   verified bucket by bucket, a pair in the first tree where it meets. Either
   way only pairs that meet are compared. What leaves is counts for each class
   and a spanning forest.
5. Components of the true links are the result's classes.

Cases: null text is empty; a text without words has no n-grams, no links and
its own class; fewer than n words make one n-gram. Rows that repeat a doc_id
are documents of their own. Null doc_ids take part; a class's id is its
smallest doc_id that isn't null. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linefacts.llm._chunks import by_chunk, chunk_count, into_chunks, read_chunk
from linefacts.llm._components import components
from linefacts.llm._hash import U, buffer_of, mix, pair, word_hashes, words_of
from linefacts.llm._shared import trim, written

N, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 24, 6, 0.9999
#: Classes, and n-grams, of a block of a component.
BLOCK, BLOCK_GRAMS = 1024, 1 << 21


def gram_sets(texts: list[bytes | None], n: int = N) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's n-grams of words."""
    data, edges = buffer_of(texts)
    starts, ends = words_of(data)
    h = word_hashes(data, starts, ends)
    at = np.searchsorted(starts, edges)
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        w = h[a:b]
        k = min(n, len(w))
        if not k:
            out.append(np.zeros(0, U))
            continue
        g = np.full(len(w) - k + 1, k, U)
        for j in range(k):
            g = pair(g, w[j : len(w) - k + 1 + j])
        out.append(np.unique(g))
    return out


def labels_of(sets: list[np.ndarray], trees: int, depth: int) -> np.ndarray:
    """(sets, trees * depth) MinHash values of 16 bits; empty sets have zeros."""
    out = np.zeros((len(sets), trees * depth), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    x = np.concatenate([sets[i] for i in full])
    x = (x ^ (x >> U(32))).astype(np.uint32)
    sizes = np.array([len(sets[i]) for i in full])
    at = np.cumsum(sizes) - sizes
    seeds = mix(np.arange(1, 2 * trees * depth + 1, dtype=U)).astype(np.uint32)
    for k in range(trees * depth):
        v = x * (seeds[2 * k] | np.uint32(1))
        v ^= seeds[2 * k + 1]
        v *= np.uint32(0x9E3779B1)
        v ^= v >> np.uint32(15)
        low = np.minimum.reduceat(v, at)
        out[full, k] = (low * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.uint16)
    return out


def depth_for(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix with which a pair at the threshold meets in some tree with probability ``recall``."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def sketched(docs: DataFrame, key: str, text: str, n: int, trees: int, depth: int) -> tuple[DataFrame, str]:
    def run(table):
        import pyarrow as pa

        raws, out = table.column(text).cast("binary").to_pylist(), []
        sets = gram_sets(raws, n)
        labels = labels_of(sets, trees, depth)
        name = [np.array([mix(s).sum(dtype=U) for s in sets], U), np.array([mix(s ^ U(0x5555)).sum(dtype=U) for s in sets], U)]
        del out
        return {
            "at": np.arange(len(raws)),
            "doc_id": table.column(key).cast("int64"),
            "s1": name[0].view(np.int64),
            "s2": name[1].view(np.int64),
            "grams": np.array([len(s) for s in sets], np.int64),
            "labels": pa.array([x.tobytes() for x in labels], pa.binary()),
        }

    return into_chunks(docs, run, "at long, doc_id long, s1 long, s2 long, grams long, labels binary", "sketch", text)


def met_chance(s, trees: int, depth: int):
    """The chance that a pair of similarity s shares so long a prefix in some tree."""
    return 1 - (1 - s**depth) ** trees


def prefix_hashes(labels: np.ndarray, depth: int) -> np.ndarray:
    """(classes, trees) names of the labels' prefixes, from (classes, trees, values)."""
    h = np.broadcast_to(np.arange(1, labels.shape[1] + 1, dtype=U), labels.shape[:2])
    for j in range(depth):
        h = pair(h, labels[:, :, j].astype(U))
    return h


def _labels(column, trees: int, depth: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, trees, depth)


def tries(classes: DataFrame, trees: int, full: int, least: int) -> DataFrame:
    """(depth, a, b): for each depth from ``least`` on, each class of a run of labels with a common prefix and the run's smallest class.

    Labels of all trees are sorted over the cluster, by tree, label and class,
    so that a run of any size is dealt to many tasks; a task streams its part
    of the order, a batch at a time, and runs that go on in the next batch or
    task are tied by a pointer between the parts' smallest classes.
    """

    def spread(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x = _labels(b.column("labels"), trees, full)
            raw = x.byteswap().tobytes()  # big-endian: bytes sort as values do
            size = 2 * full
            yield pa.RecordBatch.from_pydict({"tree": pa.array(np.tile(np.arange(trees, dtype=np.int32), b.num_rows)), "label": pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary()), "cls": np.repeat(b.column("cls").to_numpy(), trees)})

    depths = range(least, full + 1)

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, reps, first = None, {}, None  # the row before, the smallest class of its run at each depth, and the first row's
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column("label").to_pylist()), ">u2").reshape(-1, full)
            tree, cls = b.column("tree").to_numpy(), b.column("cls").to_numpy()
            row = np.column_stack([tree, x])
            before = np.vstack([row[:1] - 1 if last is None else last[None], row[:-1]])
            shared = np.cumprod(row == before, axis=1).sum(axis=1) - 1  # values in common with the row before; -1 in another tree
            out = []
            for d in depths:
                new = shared < d
                new[0] = True
                at = np.flatnonzero(new)
                low = np.minimum.reduceat(cls, at)
                rep = np.repeat(low, np.diff(np.append(at, len(cls))))
                if last is not None and shared[0] >= d and reps[d] != low[0]:
                    out.append((d, np.array([max(reps[d], low[0])]), np.array([min(reps[d], low[0])])))
                own = cls != rep
                out.append((d, cls[own], rep[own]))
                reps[d] = low[-1] if len(at) > 1 or last is None or shared[0] < d else min(reps[d], low[0])
                if first is None or len(first[1]) < len(depths):
                    first = (row[0], {}) if first is None else first
                    first[1].setdefault(d, low[0])
            last = row[-1]
            a = np.concatenate([o[1] for o in out])
            yield pa.RecordBatch.from_pydict({"part": pa.nulls(len(a), pa.int32()), "depth": np.repeat(np.array([o[0] for o in out], np.int32), [len(o[1]) for o in out]), "a": a, "b": np.concatenate([o[2] for o in out]), "row": pa.nulls(len(a), pa.binary()), "head": pa.nulls(len(a), pa.bool_())})
        if last is not None:  # the two ends of this part, at each depth
            ends = [(part, d, int(rep[d]), int(rep[d]), r.astype("<i8").tobytes(), head) for r, rep, head in ((first[0], first[1], True), (last, reps, False)) for d in depths]
            c = list(zip(*ends))
            yield pa.RecordBatch.from_pydict({"part": pa.array(c[0], pa.int32()), "depth": pa.array(c[1], pa.int32()), "a": pa.array(c[2], pa.int64()), "b": pa.array(c[3], pa.int64()), "row": pa.array(c[4], pa.binary()), "head": pa.array(c[5], pa.bool_())})

    rows = classes.where("grams > 0").select("cls", "labels").mapInArrow(spread, "tree int, label binary, cls long")
    order = ["tree", "label", "cls"]
    found = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(walk, "part int, depth int, a long, b long, row binary, head boolean"), "tries")
    # Two rows a task and depth: where the order goes on in the next task that has rows.
    ends: dict[tuple[int, bool], dict] = {}
    for e in found.where("part IS NOT NULL").select("part", "depth", "a", "row", "head").collect():
        ends.setdefault((e.part, e.head), {})[e.depth] = (e.a, np.frombuffer(bytes(e.row), "<i8"))
    parts, ties = sorted({p for p, _ in ends}), []
    for p, q in zip(parts, parts[1:]):
        for d in depths:
            (a, x), (b, y) = ends[p, False][d], ends[q, True][d]
            if (x[: d + 1] == y[: d + 1]).all() and a != b:
                ties.append((d, max(a, b), min(a, b)))
    spark = classes.sparkSession
    return found.where("part IS NULL").select("depth", "a", "b").unionByName(spark.createDataFrame(ties, "depth int, a long, b long"))


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each of ``left`` has in common with each of ``right``."""
    a, b = np.concatenate(left), np.concatenate(right)
    ia, ib = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    if len(left) * len(right) <= 64:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left])
    both = np.intersect1d(a, b)
    ca, cb = np.searchsorted(both, a), np.searchsorted(both, b)
    ka, kb = np.append(both, U(0))[ca] == a, np.append(both, U(0))[cb] == b
    ia, ca, ib, cb = ia[ka], ca[ka], ib[kb], cb[kb]
    out, step = np.zeros((len(left), len(right)), np.float64), 4096
    for lo in range(0, len(both), step):
        x, y = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        p, q = (ca >= lo) & (ca < lo + step), (cb >= lo) & (cb < lo + step)
        x[ia[p], ca[p] - lo] = 1
        y[ib[q], cb[q] - lo] = 1
        out += x @ y.T
    return out.astype(np.int64)


def linked(sets_a: list[np.ndarray], sets_b: list[np.ndarray], met: np.ndarray, num: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of the pairs that meet are links, their similarities), both as matrices."""
    na, nb = np.array([len(x) for x in sets_a]), np.array([len(x) for x in sets_b])
    share = np.zeros(met.shape)
    i, j = np.nonzero(met)
    if len(i) * 64 < met.size:  # few pairs: one by one
        c = np.array([len(np.intersect1d(sets_a[p], sets_b[q], assume_unique=True)) for p, q in zip(i.tolist(), j.tolist())], np.int64)
    else:
        c = shared_counts(sets_a, sets_b)[i, j]
    union = na[i] + nb[j] - c
    link = np.zeros(met.shape, bool)
    link[i, j] = c * 1000 >= num * union
    share[i, j] = c / np.maximum(union, 1)
    return link, share


def _verify(rows: DataFrame, threshold: float, trees: int, full: int, depth: int, deeper: int | None) -> DataFrame:
    """(cls, links, n, missed, to) from rows of (g, i, j, blk, cls, docs, open, tree, labels, grams): partial counts, and a spanning forest.

    Verified are pairs that share a prefix of ``depth`` values, none of
    ``deeper``, and of which one is open; in a group of one tree's bucket, only
    if no earlier tree has them together.
    """
    num = round(threshold * 1000)

    def judge(t, i: int, j: int, tree: int) -> list[tuple]:
        cls, docs, blk, open_ = (t.column(c).to_numpy(zero_copy_only=False) for c in ("cls", "docs", "blk", "open"))
        left = np.flatnonzero(blk == i)
        right = left if i == j else np.flatnonzero(blk == j)
        if not len(left) or not len(right):
            return []
        labels = _labels(t.column("labels").combine_chunks(), trees, full)
        met = np.zeros((len(left), len(right)), bool)
        h = prefix_hashes(labels, depth)
        for k in range(trees) if tree < 0 else (tree,):
            met |= h[left, k][:, None] == h[right, k][None, :]
        for k in range(max(tree, 0)):
            met &= h[left, k][:, None] != h[right, k][None, :]
        if deeper is not None:
            h = prefix_hashes(labels, deeper)
            for k in range(trees):
                met &= h[left, k][:, None] != h[right, k][None, :]
        met &= open_[left][:, None] | open_[right][None, :]
        if i == j:
            np.fill_diagonal(met, False)
        if not met.any():
            return []
        raws = t.column("grams").to_pylist()
        link, share = linked([np.frombuffer(raws[k], U) for k in left], [np.frombuffer(raws[k], U) for k in right], met, num)
        missed = np.where(link, 1 / np.maximum(met_chance(share, trees, depth), 1e-9) - 1, 0.0)
        out = [(cls[left], link @ docs[right], link.sum(axis=1), missed.sum(axis=1), cls[left])]
        if i != j:
            out.append((cls[right], link.T @ docs[left], link.sum(axis=0), missed.sum(axis=0), cls[right]))
        a, b = _forest(link, cls[left], cls[right])
        z = np.zeros(len(a))
        return [*out, (a, z, z, z, b)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, rows = [], 0

        def flush():
            cls, links, n, missed, to = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_pydict({"cls": cls, "links": links.astype(np.int64), "n": n.astype(np.int64), "missed": missed.astype(float), "to": to})

        for (_, i, j), t in _groups(batches, ("g", "i", "j")):
            got = [tuple(y[keep] for y in x) for x in judge(t, i, j, int(t.column("tree")[0].as_py())) if (keep := (x[2] > 0) | (x[0] != x[4])).any()]
            held += got
            rows += sum(len(x[0]) for x in got)
            if rows > 20_000:
                yield flush()
                held, rows = [], 0
        if held:
            yield flush()
        trim()

    return rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(run, "cls long, links long, n long, missed double, to long")


def _forest(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges that join what ``link`` joins, found breadth first; as many as there are vertices, at most twice."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    seen_left, seen_right = ~link.any(axis=1), ~link.any(axis=0)
    for k in np.flatnonzero(~seen_left).tolist():
        if seen_left[k]:
            continue
        front = np.zeros(len(left), bool)
        front[k] = seen_left[k] = True
        while front.any():
            over = link[front].any(axis=0) & ~seen_right
            seen_right |= over
            front = link[:, over].any(axis=1) & ~seen_left
            seen_left |= front
            got = np.concatenate([right[over], left[front]])
            a.append(got)
            b.append(np.full(len(got), left[k], np.int64))
    return np.concatenate(a), np.concatenate(b)


def _groups(batches: Iterator, keys: tuple[str, ...]) -> Iterator:
    """((key values), table) of each run of rows with equal keys; one run is held at a time."""
    import pyarrow as pa

    held, now = [], None
    for b in batches:
        if not b.num_rows:
            continue
        cols = np.stack([b.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            key = tuple(cols[:, a].tolist())
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.slice(a, z - a))
    if held:
        yield now, pa.Table.from_batches(held)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> tuple[DataFrame, str, int]:
    """(rows, root of the chunks, about how many there are). rows: chunk, at, doc_id, class_id, n_links and ``first``, whether the row stands for its class."""
    rows, root = sketched(docs, key, text, n, trees, depth)
    chunks = chunk_count(rows)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "chunk", "at")
    # Copies meet in partial sums: a group of any size is a row a task.
    classes = rows.where("grams > 0").groupBy("s1", "s2", "grams").agg(F.min(F.struct(order.alias("o"), "labels")).alias("f"), F.count(F.lit(1)).alias("docs"))
    classes = written(classes.select("s1", "s2", "grams", "docs", "f.o", "f.labels").withColumn("cls", F.monotonically_increasing_id()), "classes")

    least = depth_for(threshold, trees, depth, recall)
    pointers = tries(classes, trees, depth, least)
    found, closed = [], None
    for use in range(depth, least - 1, -1):
        here = pointers.where(F.col("depth") == use).select("a", "b").distinct()
        groups = _groups_of(components(here), classes, closed, trees, depth, use)
        found.append(written(_verify(_blocks(groups, root, text, n, chunks), threshold, trees, depth, use, use + 1 if use < depth else None), "links"))
        if use > least:
            rare = 1 - met_chance(threshold, trees, use)  # one more link, at the threshold
            told = _union(found).groupBy("cls").agg(F.sum("n").alias("n"), F.sum("missed").alias("missed"))
            closed = written(told.where((F.col("n") > 0) & (F.col("missed") + rare <= (1 - recall) * (F.col("n") + F.col("missed") + rare))).select("cls"), "closed")

    all_ = _union(found)
    final = components(all_.where("cls <> to").select(F.col("cls").alias("a"), F.col("to").alias("b")))
    counts = all_.groupBy("cls").agg(F.sum("links").alias("links"))
    named = classes.join(final.withColumnRenamed("v", "cls"), "cls", "left").join(counts, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    heads = named.groupBy("root").agg(F.min("o").alias("head"))
    named = named.join(heads, "root").select("s1", "s2", "grams", "head", (F.col("docs") - 1 + F.coalesce("links", F.lit(0).cast("long"))).alias("links"))
    out = rows.drop("labels").join(named, ["s1", "s2", "grams"], "left")
    is_head = F.coalesce((F.col("head.chunk") == F.col("chunk")) & (F.col("head.at") == F.col("at")), F.lit(True))
    own = F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id"))
    return out.select("chunk", "at", "doc_id", own.alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), is_head.alias("first")), root, chunks


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _groups_of(comps: DataFrame, classes: DataFrame, closed: DataFrame | None, trees: int, full: int, depth: int) -> DataFrame:
    """(g, tree, blocks, blk) and what verification needs of each class: groups with an open class, cut into blocks.

    A component goes as one group (``tree`` -1) if its classes travel less often
    so, once for each of its blocks, than bucket by bucket.
    """
    held = comps.withColumnRenamed("v", "cls").withColumnRenamed("root", "comp").join(classes.select("cls", "docs", "grams", "o.chunk", "o.at", "labels"), "cls")
    if closed is None:
        held = held.withColumn("open", F.lit(True))
    else:
        held = held.join(closed.withColumn("shut", F.lit(True)), "cls", "left").withColumn("open", F.col("shut").isNull()).drop("shut")
    parts = lambda: F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("grams") / BLOCK_GRAMS)).cast("long").alias("blocks")
    size = written(held.groupBy("comp").agg(parts(), F.bool_or("open").alias("any"), F.count(F.lit(1)).alias("members")).where("any").select("comp", "blocks", "members"), "components")
    kept = ["chunk", "at", "cls", "docs", "open", "labels"]
    small = size.where(F.col("blocks") <= trees)
    whole = held.join(small, "comp").withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("blocks"))).select(F.col("comp").alias("g"), F.lit(-1).alias("tree"), "blocks", "blk", *kept)
    if size.where(F.col("blocks") > trees).limit(1).count() == 0:
        return whole

    def buckets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            h = prefix_hashes(_labels(b.column("labels"), trees, full), depth)
            yield pa.RecordBatch.from_pydict({"cls": np.repeat(b.column("cls").to_numpy(), trees), "comp": np.repeat(b.column("comp").to_numpy(), trees), "grams": np.repeat(b.column("grams").to_numpy(), trees), "open": np.repeat(b.column("open").to_numpy(zero_copy_only=False), trees), "tree": np.tile(np.arange(trees, dtype=np.int32), b.num_rows), "g": np.ascontiguousarray(h).ravel().view(np.int64)})

    large = held.join(size.where(F.col("blocks") > trees), "comp")
    inside = written(large.select("cls", "comp", "grams", "open", "labels").mapInArrow(buckets, "cls long, comp long, grams long, open boolean, tree int, g long"), "buckets")
    each = inside.groupBy("comp", "g").agg(parts(), F.bool_or("open").alias("any"), F.count(F.lit(1)).alias("n")).where("n > 1 AND any")
    cost = each.groupBy("comp").agg(F.sum(F.col("n") * F.col("blocks")).alias("cost"))
    loose = large.select("comp", "blocks", "members").distinct().join(cost, "comp", "left").where(F.coalesce("cost", F.lit(0)) < F.col("members") * F.col("blocks")).select("comp")
    loose = written(loose, "loose")
    tight = held.join(size.where(F.col("blocks") > trees), "comp").join(loose, "comp", "left_anti").withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("blocks"))).select(F.col("comp").alias("g"), F.lit(-1).alias("tree"), "blocks", "blk", *kept)
    dealt = inside.join(loose, "comp", "left_semi").select("cls", "comp", "tree", "g").join(each.select("comp", "g", "blocks"), ["comp", "g"])
    dealt = dealt.join(held.select(*kept), "cls").withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("blocks"))).select("g", "tree", "blocks", "blk", *kept)
    return whole.unionByName(tight).unionByName(dealt)


def _blocks(groups: DataFrame, root: str, text: str, n: int, chunks: int) -> DataFrame:
    """The n-grams of each class of a group, once for every pair of blocks that its block is in."""

    def grams(table):
        import pyarrow as pa

        chunk = table.column("chunk")[0].as_py()
        at, where = np.unique(table.column("at").to_numpy(), return_inverse=True)
        raws = read_chunk(root, chunk, [text]).column(text).take(pa.array(at)).cast("binary").to_pylist()
        sets = pa.array([s.tobytes() for s in gram_sets(raws, n)], pa.binary())
        blocks, blk = table.column("blocks").to_numpy(), table.column("blk").to_numpy()
        row = np.repeat(np.arange(table.num_rows), blocks)
        other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        mine = blk[row]
        take = lambda c: table.column(c).take(pa.array(row))
        return pa.table({"g": take("g"), "i": np.minimum(mine, other), "j": np.maximum(mine, other), "blk": mine, "cls": take("cls"), "docs": take("docs"), "open": take("open"), "tree": take("tree"), "labels": take("labels"), "grams": sets.take(pa.array(where[row]))})

    return by_chunk(groups, chunks).applyInArrow(grams, "g long, i long, j long, blk long, cls long, docs long, open boolean, tree int, labels binary, grams binary")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents that stand for their class, with all their columns."""
    rows, root, chunks = near_duplicates(docs, key, text, **how)
    names = docs.columns

    def pick(table):
        return read_chunk(root, table.column("chunk")[0].as_py()).take(table.column("at")).select(names)

    return by_chunk(rows.where("first").select("chunk", "at"), chunks).applyInArrow(pick, docs.schema)


def op6_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs)[0].select("doc_id", "class_id", "n_links")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT x, y FROM c JOIN n p ON c.x = p.doc_id JOIN n q ON c.y = q.doc_id WHERE 5 * c.c >= 4 * (p.n + q.n - c.c)
), reach AS (
  SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(y) FROM reach r WHERE r.x = d.doc_id), d.doc_id)) AS class_id,
       (SELECT count(*) FROM link l WHERE l.x = d.doc_id) AS n_links
FROM documents d
"""
