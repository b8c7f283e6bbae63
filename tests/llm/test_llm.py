"""Each operator against brute force, on a fixture with every odd case, and on nothing."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import public_tokenizers
from linefacts.llm import archives, context_tree, mixing, near_duplicates, order_minhash, packing, quality, suffix_dedup, token_index, toxicity
from linefacts.llm._components import components
from linefacts.llm._hash import Lookup, U, buffer_of, word_hashes, words_of
from linefacts.llm._tok import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, at int, h string, n int, key double, size string, block int, removed__ int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(r, n):
    syllables = ["the", "er", "on", "an", "ti", "öß", "ré", "th", "ing", "ou"]
    words = ["".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(n)]
    return "".join(w + (".\n" if r.random() < 0.08 else " ") for w in words).strip()


def edge_rows():
    r = random.Random(5)
    base = [prose(r, 90) for _ in range(12)]
    passage = prose(r, 70)
    near = base[1].split(" ")
    near[40] = "changed"
    texts = [*base, base[0], " ".join(near), base[3] + "\n" + passage, base[4] + " " + passage, "ab" * 150, "", None, "one", "  \n\t ", "日本語 テキスト " * 30, prose(r, 4000), base[0]]
    rows = [(i, t, "en", f"src{i % 3}", 0, "c", 1, "h", 2, 0.5, "s", 3, 4) for i, t in enumerate(texts)]
    rows += [(None, base[5], None, None, None, None, None, None, None, None, None, None, None), rows[2], rows[2], (7, "another text under an id that is there", None, None, 1, "c", 1, "h", 2, 0.5, "s", 3, 4)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return edge_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- shared parts ---


def test_words_and_hashes():
    texts = [b"a  bb\tccc", b"", None, "é x".encode(), b"longer than eight bytes, longer than eight"]
    data, edges = buffer_of(texts)
    s, e = words_of(data)
    got = [bytes(data[a:b]) for a, b in zip(s, e)]
    assert got == [w for t in texts for w in (t or b"").split()]
    h = word_hashes(data, s, e)
    assert len({(x, y) for x, y in zip(got, h.tolist())}) == len(set(got)) == len(set(h.tolist()))
    assert list(edges) == list(np.cumsum([0] + [len(t or b"") + 1 for t in texts]))


def test_lookup_finds_all_and_only_its_keys():
    k = np.random.default_rng(1).integers(0, 2**63, 5000).astype(U)
    k = np.unique(k)
    t = Lookup(k[::2], np.arange(len(k[::2])))
    assert (t.get(k[::2], -1) == np.arange(len(k[::2]))).all() and (t.get(k[1::2], -1) == -1).all()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert set(got) == {*range(21), *range(100, 130)} and all(v == (0 if k < 21 else 100) for k, v in got.items())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_encode_like_whole_texts(name, rows):
    odd = ["  a  b ", "a\n\nb\n", "\ta　b c", "it's 'll <|endoftext|> x<|startoftext|>y", "é ́x Σας ΑΣ", "a\r\nb\x1cc \x1c!", "\n x", " ", "a b— c d", "x\ny z.\n\nW"]
    texts = odd + [r[1] or "" for r in rows]
    e = Encoder(public_tokenizers.path(name))
    for _ in range(2):
        assert e([t.encode() for t in texts]) == e._raw(texts)


# --- 1 ---


def test_token_index(docs, rows, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Encoder(path)
    store = token_index.write_store(docs, path, 1)
    got = sorted(map(tuple, store.read(store.lookup(docs), with_ids=True).collect()), key=lambda r: r[1])
    assert len(got) == len(rows)
    at = 0
    want = Counter()
    for r in rows:
        raw = tok._raw([r[1] or ""])[0] + np.array([1], "<u4").tobytes()
        want[(r[0], len(raw) // 4, zlib.crc32(raw), raw)] += 1
    assert Counter((r[0], r[2], r[3], bytes(r[4])) for r in got) == want
    for r in got:
        assert r[1] == at
        at += r[2]
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    missing = docs.sparkSession.createDataFrame([(10**9,), (-5,)], "doc_id long")
    assert store.lookup(missing).count() == 0
    empty = token_index.write_store(nothing, path, 1)
    assert empty.read(empty.lookup(docs)).count() == 0


def test_a_key_that_goes_on_in_other_shards(spark):
    rows = [(i, f"t {i}") for i in range(30)] + [(15, f"again {i}") for i in range(60)]
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        store = token_index.write_store(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), 1)
        assert store.shards.where("n_docs > 0").count() > 2
        got = store.read(store.lookup(spark.createDataFrame([(15,), (3,)], "doc_id long"))).collect()
    finally:
        spark.conf.unset(name)
    assert Counter(r.doc_id for r in got) == {15: 61, 3: 1} and len({r.start for r in got}) == 62


def test_minimal_perfect_hash_is_a_bijection():
    h = token_index.key_hash(np.arange(30_000))
    m = token_index.build_mph(h)
    assert sorted(token_index.slot_of(m, h).tolist()) == list(range(30_000))


# --- 2 ---


def test_packing(docs, rows, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Encoder(path)
    got = packing.pack_documents(docs, path, with_ids=True).collect()
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    whole = sum(len(tok._raw([r[1] or ""])[0]) // 4 + 1 for r in rows)
    assert sum(r.length for r in got) == whole and len(seqs) <= -(-whole // 1024) + 1
    long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 22)
    assert len(long) > 1 and all(n == 1024 for _, _, n in long[1:]) and [s for _, s, _ in long] == list(np.cumsum([0] + [n for _, _, n in long[:-1]]))
    assert packing.pack_documents(nothing, path).count() == 0


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_every_constraint_holds(by):
    n = np.random.default_rng(3).integers(1, 101, 500)
    bins, off = packing.pack(n, 100, 4, 4000, by)
    for b in set(bins.tolist()):
        own = n[bins == b]
        assert own.sum() <= 100 and len(own) <= 4 and ((own**2).sum() <= 4000 or len(own) == 1)


@pytest.mark.parametrize("by", ["norm", "dot"])
@pytest.mark.parametrize(("size", "docs", "cost", "weights"), [(100, 100, 10_000, (1, 1, 1)), (100, 4, 4000, (1, 1, 1)), (60, 5, 2000, (2, 0.5, 1)), (20, 20, 400, (1, 1, 1))])
def test_best_fit_against_all_bins(by, size, docs, cost, weights):
    """Every piece goes where a plain search over all bins would put it, up to bins with the same room; ties in length too."""
    n = np.random.default_rng(7).integers(1, size // 2, 300)
    bins, off = packing.pack(n, size, docs, cost, by, weights)
    cap, w = np.array([size, docs, cost], float), np.array(weights, float)
    left: list[np.ndarray] = []
    where = {}
    for i in np.argsort(-n, kind="stable").tolist():
        need = np.array([n[i], 1, n[i] ** 2], float)
        fits = [k for k, x in enumerate(left) if (x >= need).all()]
        score = {k: float((((left[k] - need) / cap) ** 2 @ w) if by == "norm" else -((left[k] / cap) @ (w * need / cap))) for k in fits}
        if not fits:
            assert bins[i] not in where
            where[bins[i]] = len(left)
            left.append(cap.copy())
        k = where[bins[i]]
        if fits:
            assert math.isclose(score[k], min(score.values()), abs_tol=1e-12)
        assert off[i] == size - left[k][0]
        left[k] -= need
    assert len(left) == len(set(bins.tolist()))


# --- 3 ---


def spark_hash(*parts):
    """The engine's 64-bit hash of strings and longs, chained by seeds; nulls are skipped."""
    h = 42
    for p in parts:
        for x in p if isinstance(p, list) else [p]:
            if x is not None:
                h = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else int(x).to_bytes(8, "little", signed=x < 0) if not isinstance(x, np.int32) else int(x).to_bytes(4, "little"), h)
    return h


def brute_signature(text, k=3, least=2):
    """Order MinHash as its text says: elements by occurrence, the least of each range, in the order of the text."""
    words = WORD.findall(re.sub(r"([぀-ヿ㐀-鿿가-힯])", r" \1 ", text))
    seen, parts = Counter(), defaultdict(list)
    for i in range(max(1, len(words) - k + 1) if words else 0):
        gram = spark_hash(*words[i : i + k]) >> 25
        h = spark_hash(gram, np.int32(seen[gram])) >> 25
        seen[gram] += 1
        parts[h >> 33].append((h & (2**33 - 1), i, h))
    out = []
    for p in sorted(parts):
        kept = sorted((place, h) for _, place, h in sorted(parts[p])[:least])
        out.append(p << 26 | spark_hash([h for _, h in kept]) >> 38)
    return out


def test_fingerprints_against_brute_force(spark):
    r = random.Random(21)
    w = [f"w{r.randrange(40)}" for _ in range(500)]
    texts = [prose(r, 300), " ".join(w), "a b c a b c a b c", "one", "one two", "", None, "日本語 テキスト x", "x" * 5000, "tab\there\x0bno\u00a0break", "a b c " * 900]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one")]
    got = sorted(order_minhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda x: x.doc_id)
    whole = [t or "" for t in texts]
    sig = [brute_signature(t) for t in whole]
    shown = lambda s: "".join(f"{x:08x}" for x in s)

    def like(a, b):
        either = {x >> 26 for x in a} | {x >> 26 for x in b}
        return len(set(a) & set(b)) / len(either) if either else 1.0

    for x in got:
        i = x.doc_id
        t, nxt = whole[i], whole[(i + 1) % len(whole)]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert x.fingerprint == shown(sig[i]) and x.edited_fingerprint == shown(brute_signature(edited))
        assert math.isclose(x.near_edited, like(sig[i], brute_signature(edited))) and math.isclose(x.near_next, like(sig[i], sig[(i + 1) % len(whole)]))
    assert len(got) == len(rows)


def test_places_keep_the_order_of_texts_with_more_tokens_than_places(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "PLACE", 4)
    words = [f"t{i}" for i in range(90)]
    row = spark.createDataFrame([(words,)], "w array<string>").select(order_minhash.kmers(order_minhash.F.col("w")).alias("k")).first()
    place = [x & 15 for x in row.k]
    assert place == sorted(place) and set(place) == set(range(16))


def omh(text, k=3, parts=64, least=2):
    """The signature's shape by brute force: which elements each range keeps, in order; hashes by name."""
    words = WORD.findall(text)
    seen = Counter()
    out = []
    for i in range(max(1, len(words) - k + 1) if words else 0):
        g = tuple(words[i : i + k])
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def test_fingerprints(docs, rows, nothing):
    got = order_minhash.fingerprints(docs).collect()
    assert len(got) == len(rows)
    order = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    texts = defaultdict(list)
    for k, (_, i, t) in enumerate(order):
        n, q = len(t), len(t) // 4
        nxt = order[(k + 1) % len(order)][2]
        if i not in (0, 7):  # null and the shared id are ordered by hash
            e = t[: n - q] + nxt[:q]
            texts[(i, n)].append(hashlib.sha256(e.encode()).hexdigest())
    for r in got:
        if r.doc_id not in (None, 0, 7, 6) and (r.doc_id, r.n_chars) in texts:
            assert r.edited_sha256 in texts[(r.doc_id, r.n_chars)]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by = {(r.doc_id, r.n_chars): r for r in got}
    assert by[(0, len(rows[0][1]))].fingerprint == by[(12, len(rows[12][1]))].fingerprint
    assert by[(18, 0)].fingerprint == "" and by[(17, 0)].near_edited == 1.0
    assert order_minhash.fingerprints(nothing).count() == 0


def test_likeness_falls_with_edits_and_with_order(spark):
    r = random.Random(1)
    w = [f"w{r.randrange(10**6)}" for _ in range(400)]
    texts = {"same": w, "edit": w[:200] + ["x"] + w[201:], "half": w[:200] + [f"v{i}" for i in range(200)], "other": [f"u{i}" for i in range(400)]}
    df = spark.createDataFrame([(k, " ".join(v), " ".join(w)) for k, v in texts.items()], "k string, a string, b string")
    df = order_minhash.with_signature(order_minhash.with_signature(df, "a", "x"), "b", "y")
    got = dict(df.select("k", order_minhash.likeness(df.x, df.y)).collect())
    assert got["same"] == 1 and 0.9 < got["edit"] < 1 and 0.1 < got["half"] < 0.6 and got["other"] == 0
    # Elements are numbered by occurrence: as many as there are windows.
    e = spark.createDataFrame([("a b c a b c a b c",)], "t string").select(order_minhash.elements(order_minhash.F.sort_array(order_minhash.kmers(order_minhash.tokens(order_minhash.F.col("t"))))).alias("e")).first().e
    assert len(set(e)) == len(omh("a b c a b c a b c")) == 7


# --- 4 ---


def brute_removed(texts, length=200):
    count = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        m = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                m[p : p + length] = b"\1" * length
        out.append(m)
    return out


@pytest.mark.parametrize("hot", [10**6, 1])
def test_repeated_strings(docs, rows, nothing, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter()
    for r, t, m in zip(rows, texts, brute_removed(texts)):
        spans = len(re.findall(b"\1+", bytes(m)))
        want[(r[0], len(t), sum(m), spans, hashlib.sha256(bytes(x for x, y in zip(t, m) if not y)).hexdigest())] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(docs).collect())
    assert got == want and any(k[2] for k in want)
    assert suffix_dedup.removed(nothing).count() == 0
    assert suffix_dedup.deduplicated(docs).columns == docs.columns


def test_refinement_alone():
    r = random.Random(9)
    data = bytes(r.choices(b"ab", k=3000)) + bytes(r.choices(b"abcdefgh", k=3000))
    data += data[4000:4300] + data[100:180]
    for length in (20, 33, 64):
        w = np.arange(len(data) - length + 1)
        count = Counter(data[p : p + length] for p in w)
        assert suffix_dedup.refine(np.frombuffer(data, np.uint8), w, length, 8).tolist() == [count[data[p : p + length]] > 1 for p in w]


# --- 5 ---


def test_quality(docs, rows, nothing):
    got = quality.judged(quality.measured(docs)[0]).collect()
    assert len(got) == len(rows)
    for r in got:
        t = [x[1] or "" for x in rows if x[0] == r.doc_id]
        words = [WORD.findall(x) for x in t]
        assert r.n_words in map(len, words)
    r = next(r for r in got if r.doc_id == 21)
    assert r.n_repeat_words == 60 and r.base_failed and not r.kept
    assert quality.repeated_words(b"a b c d a b c x".split()) == 6
    assert quality.judged(quality.measured(nothing)[0]).count() == 0


def brute_base(t):
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_base_figures_of_all_columns(spark):
    odd = ["", None, "a", "a\nb\na\n", " x\nx\n x\n\n", "#*$%&|<> ｜", "é\u0301 \u00a0 y\x0b z\r\nz", "a b c a b c", "w " * 3000, "y" * 30_000, "日本語\n日本語", "\x1c \x85 \u2028 a\x85b", "l one two\n" * 40]
    rows = [(i, t, None if i % 3 else "h") for i, t in enumerate(odd)] + [(1, "again", "h"), (1, "again", "h"), (None, "n b c", None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, line long, host string")
    got = quality.judged(quality.measured(docs)[0]).collect()
    want = Counter((i, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]) for i, t, _ in rows for b in [brute_base(t or "")])
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_frequent_lines_go_and_clean_documents_stay(spark):
    r = random.Random(2)
    rows = []
    for i in range(40):
        rows.append((i, prose(r, 80) + "\nAll rights  RESERVED.\n" + prose(r, 10), "h"))
    footer = "\n".join(prose(r, 9).replace("\n", " ") for _ in range(12))
    rows += [(100 + i, footer + "\nown " + prose(r, 12), "h") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {x.doc_id: x.text for x in quality.cleaned(docs).collect()}
    assert set(out) == set(range(40)) and not any("RESERVED" in t for t in out.values())


@pytest.mark.parametrize("hold", [0.002, 0.01, 0.05, 0.2])
def test_the_limit_is_the_same_in_a_host_of_thousands(spark, hold):
    """A line that so large a share of 3,000 texts holds; copies of one text don't count."""
    n = 3000
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)) + ("\nRead  more HERE" if i < hold * n else ""), "h") for i in range(n)]
    rows += [(n + i, rows[-1][1] + "\nonly in copies", "h") for i in range(40)] + [(9000 + i, "z " * 60 + "\nread more here", "other") for i in range(10)]
    out = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x.n_removed_words for x in quality.judged(quality.measured(out)[0]).collect()}
    assert sum(got.values()) == (3 * int(hold * n) if hold * n > quality.LIMIT else 0)


# --- 6 ---


def test_near_duplicates(docs, rows, nothing):
    def grams(t):
        w = WORD.findall(t or "")
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(r[1]) for r in rows]
    link = [[i != j and a and b and 5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[i], *(group[j] for j, x in enumerate(link[i]) if x)]) for i in range(len(rows))]
    named = defaultdict(list)
    for i, g in enumerate(group):
        named[g].append(rows[i][0])
    want = Counter((rows[i][0], min((x for x in named[g] if x is not None), default=None), sum(map(bool, link[i]))) for i, g in enumerate(group))
    got = near_duplicates.near_duplicates(docs)[0]
    got = got.collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want
    assert sum(r["first"] for r in got) == len(named)
    assert near_duplicates.near_duplicates(nothing)[0].count() == 0
    assert near_duplicates.one_of_each(docs).columns == docs.columns


def test_a_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 20)
    r = random.Random(4)
    base = prose(r, 200).split(" ")
    rows = []
    for i in range(70):
        w = list(base)
        for k in r.sample(range(len(w)), 3):
            w[k] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    grams = [{tuple(WORD.findall(t)[i : i + 5]) for i in range(len(WORD.findall(t)) - 4)} for _, t in rows]
    want = {i: sum(i != j and 5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(grams)) for i, a in enumerate(grams)}
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()
    assert {x.doc_id: x.n_links for x in got} == want and len({x.class_id for x in got}) < 70


def brute_links(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(WORD.findall, texts)]
    return {i: {j for j, b in enumerate(sets) if i != j and 5 * len(a & b) >= 4 * len(a | b)} for i, a in enumerate(sets)}


@pytest.mark.parametrize("block", [4, 1024])
def test_a_chain_is_verified_bucket_by_bucket_and_a_dense_group_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    r = random.Random(14)
    w = [f"v{r.randrange(10**6)}" for _ in range(460)]
    chain = [" ".join(w[3 * i : 3 * i + 60]) for i in range(130)]  # each like its next ones alone, all in one component
    base = [f"u{r.randrange(10**6)}" for _ in range(300)]
    dense = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(120)]
    texts = chain + dense
    want = brute_links(texts)
    got = {x.doc_id: x for x in near_duplicates.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))[0].collect()}
    assert {i: x.n_links for i, x in got.items()} == {i: len(x) for i, x in want.items()}
    assert {x.class_id for x in got.values()} == {0, 130}


def test_classes_with_many_near_links_close_early(spark, monkeypatch):
    seen = []
    keep = near_duplicates._groups_of
    monkeypatch.setattr(near_duplicates, "_groups_of", lambda comps, classes, closed, *a: seen.append(closed and closed.count()) or keep(comps, classes, closed, *a))
    r = random.Random(15)
    base = [f"u{r.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(40)] + [prose(r, 80) for _ in range(20)]
    near_duplicates.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))[0].count()
    assert seen == [None, 40]


def test_prefix_is_shortened_to_the_recall():
    assert near_duplicates.depth_for(0.8, 24, 6, 0.9999) == 5 and near_duplicates.depth_for(0.8, 24, 6, 0.5) == 6


# --- 7 ---


def fill(sizes, total, weights, cap=2):
    target, open_ = {}, set(sizes)
    while True:
        left = total - sum(target.values())
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > cap * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / w for s in open_}
        target |= {s: cap * sizes[s] for s in over}
        open_ -= over


def test_mix(docs, rows, nothing):
    _, sources, drawn = mixing.mix(docs)
    size = Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = fill(size, 1.5 * sum(size.values()), {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)})
    got = {r.source: (r.source_size, r.target) for r in sources.collect()}
    assert {s: v[0] for s, v in got.items()} == dict(size)
    assert all(math.isclose(got[s][1], want[s], abs_tol=1e-6) for s in size)
    taken, per = Counter(), Counter()
    for r in drawn.collect():
        taken[r.source] += r.size * r.k
        for c in range(r.k):
            per[(r.doc_id, r.source, r.h, c)] += 1
    # Documents are taken whole: the longest one has 4,000 words.
    assert max(per.values()) <= 2 and all(abs(taken[s] - want[s]) <= 2000 for s in size)
    again = mixing.mix(docs)[2]
    assert sorted(map(str, drawn.collect())) == sorted(map(str, again.collect()))
    assert mixing.mix(nothing)[2].count() == 0
    out = mixing.mixed(docs)
    assert set(out.columns) == {*docs.columns, "shard", "place"} and out.count() == sum(per.values())


@pytest.fixture(scope="module")
def many(spark):
    r = random.Random(12)
    return spark.createDataFrame([(i, "w " * r.randint(1, 40), f"s{i % 5}") for i in range(2000)], "doc_id long, text string, source string").persist()


def test_shards_hold_what_the_tree_deals_them(many):
    shards, share = 6, 1.5
    rows, sources, draws, _ = mixing.plan(many, "doc_id", "text", "source", (3.0, 1.0, 2.0), share, 2.0, 7, shards)
    got = Counter((r.sid, r.part, r.shard) for r in draws.collect())
    assert len({(r.sid, r.block, r["pass"]) for r in draws.collect()}) == sum(got.values())
    for part, of in (((0, 1), lambda s, p: 2 * s + p), ((2,), lambda s, p: s)):
        sums = Counter()
        for (s, p, _), n in got.items():
            if p in part:
                sums[of(s, p)] += n
        names = sorted({2 * r.sid + p for r in sources.collect() for p in (0, 1)}) if part == (0, 1) else sorted(sums)
        quotas = many.sparkSession.createDataFrame([([sums[k] for k in names],)], "quotas array<long>")
        tree = {r.shard: dict(zip(names, r.quotas)) for r in mixing.splitting_tree(quotas, shards, 7 if part == (0, 1) else 10).collect()}
        assert {k: v for k, v in got.items() if k[1] in part} == {(s, p, h): n for h, q in tree.items() for s in range(5) for p in part if (n := q.get(of(s, p), 0))}


def test_the_draw_decides_what_is_taken(many, monkeypatch):
    taken = lambda: {(r.doc_id, r["pass"]) for r in mixing.mix(many, shards=6)[2].collect()}
    one = taken()
    monkeypatch.setattr(mixing, "hypergeometric", lambda n, k, of, u: mixing.F.greatest(mixing.F.lit(0).cast("long"), n - (of - k)))
    assert one != taken()


def test_one_row_that_is_a_third_of_all(spark):
    rows = [(1, "a b c d e", "s")] * 600 + [(i, "a b c " * (i % 7), f"t{i % 2}") for i in range(2, 1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    _, sources, drawn = mixing.mix(docs)
    goal = {r.source: r.target for r in sources.collect()}
    took = Counter()
    for r in drawn.collect():
        took[r.source] += r.k * r.size
    assert all(abs(took[s] - goal[s]) < 20 for s in goal) and mixing.mixed(docs).count() == sum(r.k for r in drawn.collect())


def test_splitting_tree_is_exact_and_hypergeometric(spark):
    q = [5, 0, 1000, 37, 4000]
    got = np.array([r.quotas for r in mixing.splitting_tree(spark.createDataFrame([(q,)], "quotas array<long>"), 13).collect()])
    assert got.sum(axis=0).tolist() == q and len(got) == 13 and np.ptp(got.sum(axis=1)) <= 2
    F = mixing.F
    lit = lambda x: F.lit(x).cast("long")
    x = spark.range(20_000).select(mixing.hypergeometric(lit(30), lit(12), lit(50), mixing.unit(F.col("id"), F.lit(3))).alias("x")).groupBy("x").count().collect()
    p = {k: math.comb(12, k) * math.comb(38, 30 - k) / math.comb(50, 30) for k in range(13)}
    assert sum((r["count"] - 20_000 * p[r.x]) ** 2 / (20_000 * p[r.x]) for r in x if 20_000 * p[r.x] > 5) < 30


# --- 8 ---


def test_archives(spark):
    rows = [(3, "http://a/ b", "<p>" + "x" * 200), (1, "http://b", "<p>" + "x" * 200), (2, None, None), (4, "", "short"), (5, "u", "short"), (None, "n", "<p>" + "x" * 200), (6, "e", "é" * 60), (6, "e", "é" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    root = archives.new_path(spark, "t")
    got = archives.read_warcs(archives.convert(archives.write_arcs(pages, root), root)).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows)
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == Counter([(1, "response", None), (3, "revisit", 1), (None, "revisit", 1), (2, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (6, "revisit", 6)])
    assert archives.read_warcs(archives.convert(archives.write_arcs(pages.withColumn("digest", archives.F.lit(1)).withColumn("arc_path", archives.F.lit("x")), root), root)).count() == len(rows)
    none = archives.convert(archives.write_arcs(pages.where("false"), root), root)
    assert archives.read_warcs(none).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_header_lines(version):
    raw = archives.arc_head(version, "f.arc") + archives.arc_record(version, "http://x/a b", 9, b"body", "f.arc", 0)
    (info, told), (fields, block) = archives.parse_arc(raw)
    assert archives.kind_of(info, told) == "warcinfo" and info["Content-type"] == "text/plain" and told.startswith(b"%d 0 " % version)
    assert fields["URL"] == "http://x/a%20b" and int(fields["Archive-length"]) == len(block) and archives.http_parts(block)[2] == b"body"
    assert archives.date_of(fields["Archive-date"]) == "2001-02-03T04:05:06Z"
    with pytest.raises(ValueError):
        list(archives.parse_arc(raw[:-4]))


def test_what_is_not_http_becomes_a_resource(spark, tmp_path):
    answer, odd = b"20010203040506\nexample.org. 60 IN A 192.0.2.1\n", b"HTTP-like but not, " * 9
    page = lambda v, i: archives.arc_record(v, f"http://x/{i}", i, b"p" * 150, "f", 0, archives.stamp_after(i))
    for v in (1, 2):
        records = [archives.arc_head(v, f"{v}.arc"), archives.arc_block(v, "dns:example.org", "text/dns", answer, "f", 0), page(v, v), archives.arc_block(v, "http://x/raw", "application/x", odd, "f", 0), archives.arc_block(v, "http://x/raw", "application/x", odd, "f", 0)]
        (tmp_path / f"{v}.arc.gz").write_bytes(b"".join(map(archives._member, records)))
    arcs = spark.createDataFrame([(f"file://{tmp_path}/{v}.arc.gz", v, 4) for v in (1, 2)], "arc_path string, version int, records long")
    warcs = archives.convert(arcs, f"file://{tmp_path}")
    got = archives.read_warcs(warcs).collect()
    assert Counter((r.record_type, r.target_uri) for r in got) == Counter({("resource", "dns:example.org"): 2, ("resource", "http://x/raw"): 4, ("response", "http://x/1"): 1, ("revisit", "http://x/2"): 1})
    assert {r.warc_date for r in got if r.target_uri == "http://x/2"} == {"2001-02-03T04:05:08Z"} and len({r.record_id for r in got}) == 8
    assert {r.payload_digest for r in got if r.target_uri.startswith("dns")} == {hashlib.sha256(answer).hexdigest()}
    # Every record is a member of its own, and the first one tells of the file.
    raw = open(warcs.first().warc_path.removeprefix("file://"), "rb").read()
    one = [dict(archives.parse_warc(m).__next__()[0]) for m in archives.members(raw)]
    assert len(one) == 5 and one[0]["WARC-Type"] == "warcinfo" and one[0]["Content-Type"] == "application/warc-fields" and one[1]["Content-Type"] == "text/dns"


# --- 9 ---


def brute_ctw(train, texts, depth):
    """Context-tree weighting by recursion over dictionaries."""
    count = defaultdict(lambda: [0, 0])
    below = defaultdict(set)

    def steps(t):
        b = b"\xff" * depth + t.lower() + b"\xff"
        for i in range(depth, len(b)):
            for j in range(8):
                yield b[i - depth : i], (1 << j) | (b[i] >> (8 - j)), (b[i] >> (7 - j)) & 1

    for t in train:
        for ctx, node, bit in steps(t):
            for d in range(depth + 1):
                count[(ctx[depth - d :], node)][bit] += 1
                if d:
                    below[(ctx[depth - d + 1 :], node)].add(ctx[depth - d :])

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    memo = {}

    def pw(ctx, node):
        if (ctx, node) not in memo:
            own = kt(*count[(ctx, node)])
            if len(ctx) == depth:
                memo[(ctx, node)] = own, 1.0
            else:
                rest = sum(pw(c, node)[0] for c in below[(ctx, node)])
                p = np.logaddexp(own - math.log(2), rest - math.log(2))
                memo[(ctx, node)] = p, math.exp(own - math.log(2) - p)
        return memo[(ctx, node)]

    out = []
    for t in texts:
        s = 0.0
        for ctx, node, bit in steps(t):
            p = None
            for d in range(depth, -1, -1):
                c = ctx[depth - d :]
                a = count[(c, node)] if (c, node) in count else [0, 0]
                own = (a[bit] + 0.5) / (sum(a) + 1)
                longer = count.get((ctx[depth - d - 1 :], node)) if d < depth else None
                p = own if p is None or not longer or not sum(longer) else pw(c, node)[1] * own + (1 - pw(c, node)[1]) * p
            s += math.log10(p)
        out.append(s)
    return out


@pytest.mark.parametrize("grams", [7, 1 << 18])
def test_context_tree(spark, nothing, monkeypatch, grams):
    r = random.Random(3)
    rows = [(i, prose(r, 12)) for i in range(14)] + [(20, None), (21, ""), (None, "A b a B"), (3, "again an id")]
    train = [(t or "").encode() for i, t in rows if not context_tree.held_out(i)]
    want = brute_ctw(train, [(t or "").encode() for _, t in rows], context_tree.DEPTH)
    monkeypatch.setattr(context_tree, "GRAMS", grams)
    got = context_tree.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    tokens = Counter(w for t in train for w in [*t.lower().split(), None])
    n, v = sum(tokens.values()), len(tokens)
    base = [sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in [*(t or "").encode().lower().split(), None]) for _, t in rows]
    exact = sorted((i or -1, round(s, 6), round(b, 6)) for (i, _), s, b in zip(rows, want, base))
    assert sorted((x.doc_id or -1, round(x.score, 6), round(x.base_score, 6)) for x in got) == exact
    assert {x.train_tokens for x in got} == {n}
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 7 == 2) for x in got if x.doc_id is not None)
    assert context_tree.scores(nothing).count() == 0


def test_context_tree_without_training_rows(spark):
    ids = [i for i in range(60) if context_tree.held_out(i)]
    got = context_tree.scores(spark.createDataFrame([(i, "ab c", "x", 1) for i in ids], "doc_id long, text string, chunk string, key int")).collect()
    # Every bit of four bytes and an end has probability one half.
    assert len(got) == len(ids) and all(x.held_out and x.train_tokens == x.n_known == 0 and math.isclose(x.score, 40 * math.log10(0.5)) for x in got)


# --- 10 ---


def test_toxicity(spark, docs, nothing):
    r = random.Random(6)
    bad = ["blorg", "grumf", "snark"]
    rows, labels = [], []
    for i in range(900):
        w = prose(r, 60).split(" ")
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(bad) + r.choice(["", "", "ish", "er"])
        rows.append((i, " ".join(w)))
        if i % 2 == 0 or toxic:
            labels.append((i, 1, int(toxic)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(df, lab).collect()
    wrong = [x.doc_id for x in got if x.predicted != (x.doc_id % 6 == 0)]
    assert len(got) == 900 and len(wrong) < 20 and all(0 <= x.score <= 1 for x in got)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    odd = toxicity.toxicity(docs, spark.createDataFrame([(0, 1, None), (None, 1, 1), (1, 1, 1), (1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int"))
    assert odd.count() == docs.count()
    assert toxicity.toxicity(docs, lab.where("false")).count() == docs.count()
    assert toxicity.toxicity(nothing, lab).count() == 0


def test_label_model_against_brute_force():
    """Evidence and posteriors document by document, accuracies of voters that are independent given the label, and the classifier's score equations."""
    r = np.random.default_rng(5)
    terms = [f"{c * 4}x" for c in "abcdefghijklmnopqrst"] + ["aaaay"]
    v = toxicity.Voters(terms)
    assert v.family[0] == v.family[-1] and v.bloc[0] == v.bloc[-1] and len(set(v.family.tolist())) == 20
    y = r.random(20_000) < 0.2
    high, low = r.uniform(0.2, 0.5, 21), r.uniform(0.005, 0.02, 21)
    votes = r.random((20_000, 21)) < np.where(y[:, None], high, low)
    import pyarrow as pa

    lists = [np.flatnonzero(x).tolist() for x in votes]
    batch = pa.RecordBatch.from_pydict({"votes": pa.array(lists, pa.list_(pa.int32()))})
    x = np.zeros((len(y), toxicity.BLOCS))
    for g in range(toxicity.BLOCS):
        x[:, g] = votes[:, v.bloc == g].any(axis=1)
    both = np.array([[(votes[:, k] & (x[:, g] > 0)).sum() for g in range(toxicity.BLOCS)] for k in range(21)])
    yes, silent = toxicity.label_model(len(y), votes.sum(axis=0), both, x.T @ x, v.bloc, np.full(21, 99.0), 0.2)
    assert np.abs(yes - np.log(high / low)).max() < 1.2 and np.median(np.abs(yes - np.log(high / low))) < 0.5 and silent < -1
    told, families = toxicity.evidence(batch, yes, v.family)
    for k in range(300):
        best = {}
        for i in lists[k]:
            best[v.family[i]] = max(best.get(v.family[i], 0.0), yes[i])
        assert math.isclose(told[k], sum(best.values()), abs_tol=1e-9) and families[k] == len(best)
    p = toxicity.posterior(told, families, silent, 0.2)
    z = math.log(0.25) + (told[0] if families[0] else silent)
    assert math.isclose(p[0], 1 / (1 + math.exp(-z)))
    none = votes.sum(axis=1) == 0
    assert p[y & ~none].mean() > 0.9 and p[none].max() < 0.05 and p[~y].mean() < 0.3
    f = toxicity.features(told, families, np.zeros(len(y), int), families, np.full(len(y), 50))
    w = toxicity.fit_logistic(f, p)
    keep = np.ones(f.shape[1])
    keep[-1] = 1e-6
    assert np.abs(f.T @ (p - 1 / (1 + np.exp(-f @ w))) - keep * w).max() < 1e-4


def test_the_ratio_is_chosen_on_training_rows_alone(spark):
    """Words of toxic rows that some clean rows have too cost the low ratios; held-out labels change nothing."""
    r = random.Random(9)
    sure, loose = ["".join(r.choices("bcdfgkmpz", k=7)) for _ in range(5)], ["".join(r.choices("vwxq", k=8)) for _ in range(5)]
    rows, labels = [], []
    for i in range(6000):
        y = i % 10 == 0
        words = ["plain"] * 20 + ([r.choice(sure)] if y else []) + ([r.choice(loose)] if r.random() < (0.9 if y else 0.05) else [])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(y)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known = toxicity.labelled(df, lab)
    ratio = toxicity.cross_validated(known, toxicity.term_counts(known))
    assert ratio >= 30
    out = spark.createDataFrame([(i, q, 1 - y if toxicity.held_out(i) else y) for i, q, y in labels], "doc_id long, quality int, toxic int")
    a, b = (sorted(map(tuple, toxicity.toxicity(df, x).collect())) for x in (lab, out))
    assert a == b and all(p == (i % 10 == 0) for i, _, _, p in a)


def test_every_significant_word_votes_whatever_the_sample(spark):
    r = random.Random(8)
    bad = ["".join(r.choices("bcdfgkmpz", k=7)) for _ in range(80)]
    rows = [(i, prose(r, 30) + (" " + bad[i // 3 % 80] if i % 3 == 0 else "")) for i in range(14400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = df.selectExpr("doc_id", "1 AS quality", "CAST(doc_id % 3 = 0 AS INT) AS toxic")
    got = toxicity.toxicity(df, lab, fit=300).collect()
    assert len(got) == 14400 and all(x.predicted == (x.doc_id % 3 == 0) for x in got)


def test_capitals_are_counted_over_the_whole_text():
    assert toxicity.Voters([])("Ba" * 2500)[1] & 1 == 0
    assert toxicity.Voters([])("BaB" * 2500)[1] & 1 == 1
