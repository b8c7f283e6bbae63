"""The stages one after another: on the smallest table, on odd rows, and on nothing; each against brute force on what it was given."""

from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
from test_llm import SCHEMA, WORD, brute_base, brute_removed, edge_rows, fill

from linefacts.llm import quality
from linefacts.llm._tok import Encoder


def jaccard_groups(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in map(WORD.findall, texts)]
    group = list(range(len(texts)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                group[top(i)] = top(j)
    return [top(i) for i in range(len(texts))]


def lines_over(rows):
    """(host, normalised line) in more distinct texts of the host than the limit."""
    held = defaultdict(set)
    for r in rows:
        for line in (r.text or "").split("\n"):
            if w := WORD.findall(line):
                key = r.source, "".join(c.lower() if "A" <= c <= "Z" else c for c in " ".join(w))
                held[key].add(r.text)
    return {k for k, v in held.items() if len(v) > quality.LIMIT}


def check(name, before, after):
    """What each stage makes of its own input, worked out in plain Python."""
    if name == "quality rules":
        over, want = lines_over(before), Counter()
        for r in before:
            words, _, _, _, rep = brute_base(r.text or "")
            lines = (r.text or "").split("\n")
            gone = [x for x in lines if (w := WORD.findall(x)) and (r.source, "".join(c.lower() if "A" <= c <= "Z" else c for c in " ".join(w))) in over]
            left = words - sum(len(WORD.findall(x)) for x in gone)
            if words >= 50 and 100 * rep <= 50 * words and left >= quality.LEFT * words:
                want[r.doc_id, "\n".join(x for x in lines if x not in gone) if gone else r.text] += 1
        assert Counter((r.doc_id, r.text) for r in after) == want
    elif name == "n-gram Jaccard join":
        groups = jaccard_groups([r.text or "" for r in before])
        assert len(after) == len(set(groups)) and not Counter(map(tuple, after)) - Counter(map(tuple, before))
        where = defaultdict(set)
        for r, g in zip(before, groups):
            where[r.doc_id, r.text].add(g)
        assert len({min(where[r.doc_id, r.text]) for r in after}) == len({min(x) for x in where.values()})
    elif name == "suffix-array dedup":
        raws = [(r.text or "").encode() for r in before]
        left = Counter()
        for r, raw, mask in zip(before, raws, brute_removed(raws)):
            left[r.doc_id, None if r.text is None else bytes(x for x, y in zip(raw, mask) if not y).decode("utf-8", "ignore")] += 1
        assert Counter((r.doc_id, r.text) for r in after) == left
    elif name == "mixing sources to target weights":
        size, took = Counter(), Counter()
        for r in before:
            size[r.source] += len(WORD.findall(r.text or ""))
        for r in after:
            took[r.source] += len(WORD.findall(r.text or ""))
        names = sorted(size, key=lambda s: (s is None, s or ""))
        goal = fill(size, 1.5 * sum(size.values()), {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}) if sum(size.values()) else {}
        most = max((len(WORD.findall(r.text or "")) for r in before), default=0)
        assert all(0 <= goal[s] - took[s] + 1e-6 and goal[s] - took[s] <= most for s in goal)
        n, m = Counter((r.doc_id, r.text) for r in before), Counter((r.doc_id, r.text) for r in after)
        assert all(m[k] <= 2 * n[k] for k in m)
    else:
        tok = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
        want = Counter((r.doc_id, len(x) // 4 + 1) for r, x in zip(before, tok([(r.text or "").encode() for r in before])))
        rows, total = defaultdict(list), defaultdict(int)
        for p in after:
            rows[p.sequence_id].append((p.offset, p.length))
            total[p.doc_id] += p.length
        for s in rows.values():
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
            assert at <= 1024
        sums = defaultdict(int)
        for (i, n), k in want.items():
            sums[i] += n * k
        assert dict(total) == dict(sums)


def through(spark, docs, sf_dir):
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), "t-" + name.replace(" ", "-"))
        after = docs.collect()
        counts.append((len(before), len(after)))
        if stage is not corpus_pipeline.packing:
            assert docs.columns == columns
        yield name, before, after


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    for name, before, after in through(spark, spark.read.parquet(f"{d}/documents.parquet"), d):
        assert after
        check(name, before, after)


@pytest.mark.parametrize("rows", [edge_rows(), [], [(None, None, None, None, None, *[None] * 8)] * 3], ids=["odd", "none", "nulls"])
def test_stages_on_odd_rows(spark, rows):
    more = [(50 + i, "long word " + "z" * 60_000 + f" {i} " + " ".join(f"q{i}x{k}" for k in range(80)), "en", "src1", 1, *[None] * 8) for i in range(3)] if len(rows) > 3 else []
    docs = spark.createDataFrame([*rows, *more], SCHEMA).repartition(3)
    for name, before, after in through(spark, docs, "/nowhere"):
        check(name, before, after)
