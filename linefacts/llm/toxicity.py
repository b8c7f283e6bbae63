"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. Voters. All labelled training rows count words and word beginnings; each that
   toxic rows hold more often, by the likelihood-ratio statistic with a bound
   for the number of candidates and by a ratio of rates, becomes a lexicon voter
   (a word) or a pattern voter (words that begin so). The ratio is the one of
   ``RATIOS`` that does best (by F1) when terms of either half of the training
   rows judge the other half. Of forms that begin alike and stand in the same
   rows, one votes. A few fixed patterns look at style; they are features of the
   classifier alone.
2. Label model. Every document votes. Voters are put into blocs by their first
   letters, so that forms of a word share one; how often a voter votes, and how
   often with each bloc, is all that is counted, over all documents. Of a voter
   and two other blocs that are independent given the label, the covariances
   give the voter's accuracy (its difference between labels); the median over
   pairs of blocs is kept, but no voter counts for more than labelled training
   rows say. In a document, voters of the same first letters count as one, the
   strongest. A voter's silence counts only where all are silent, by blocs. The
   label's frequency comes from training rows.
3. Classifier. A logistic regression of evidence, density and style features is
   fitted to the label model's posteriors of a bounded sample of documents (the
   ``FIT`` with the smallest hashes), and scores every document.

Labels are used only from rows that aren't held out; lang, source and doc_id
are inputs of no score (doc_id's hash picks the sample).

Cases: null text is empty. A null doc_id is a training row without label.
Repeated rows are scored alike; of labels repeated with different values the
greater counts, null labels count for nothing. Without any toxic training label
no voters are found and all scores are the prior. No rows: no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linefacts.llm._shared import written

#: Rows, at most, of the sample that the classifier is fitted to.
FIT = 40_000
#: A voter is so many times likelier in toxic rows than in clean ones: cross-validation takes one of these, the first of them if nothing tells.
RATIOS = (10.0, 30.0, 100.0, 300.0, 1000.0)
BLOCS = 16
#: Terms that a task counts before it hands them on.
HELD = 1_000_000
#: Lengths of word beginnings that may become patterns.
STEMS = (4, 5, 6, 7)
LETTERS = re.compile(r"[^\W\d_]+").findall
STYLE = ("mostly capitals", "many exclamation marks", "many symbols")


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 3 == 1


def terms_of(text: str | None) -> set[str]:
    """Words, and beginnings of longer words (marked by *)."""
    words = set(LETTERS((text or "").lower()))
    return words.union(w[:n] + "*" for w in words for n in STEMS if len(w) > n)


class Voters:
    """The votes of one text: the numbers of the terms that vote; bits of the style patterns; and how many words voted for."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.words = {t: i for i, t in enumerate(terms) if not t.endswith("*")}
        self.stems = {t[:-1]: i for i, t in enumerate(terms) if t.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems})
        # Terms with the same first letters are a family; families are dealt to blocs.
        names = [t.rstrip("*")[: STEMS[0]] for t in terms]
        number = {f: i for i, f in enumerate(dict.fromkeys(names))}
        self.family = np.array([number[f] for f in names], np.int64)
        self.bloc = np.array([zlib.crc32(f.encode()) % BLOCS for f in names], np.int64)

    def __call__(self, text: str | None) -> tuple[list[int], int, int, int]:
        """(votes, style, hits, words)."""
        text = text or ""
        count = Counter(LETTERS(text.lower()))
        style = 0
        known, stems = self.words, self.stems
        found: set[str] = set(known.keys() & count.keys())
        votes = {known[w] for w in found}
        for n in self.lengths:
            for w in count:
                if len(w) > n and (i := stems.get(w[:n])) is not None:
                    votes.add(i)
                    found.add(w)
        hits = sum(count[w] for w in found)
        n = len(text)
        upper = sum(map(str.isupper, text))
        if n >= 20 and upper * 2 > n:
            style |= 1
        if text.count("!") * 50 > n > 0:
            style |= 2
        if sum(text.count(c) for c in "#*$%&") * 25 > n > 0:
            style |= 4
        return sorted(votes), style, hits, sum(count.values())


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, half) of all labelled training rows."""
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    training = part != 1
    one = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & training).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Texts are streamed past the labels of their partition, not sorted.
    return docs.where(training).join(one.hint("shuffle_hash"), "doc_id").select("text", "toxic", (part / 2).cast("int").alias("half"))


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, a0, b0, a1, b1): how many toxic and clean rows of either half have each term; the empty term stands for all rows."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def counts():
            names = list(set().union(*held))
            columns = {c: pa.array([h[x] for x in names], pa.int64()) for c, h in zip(("a0", "b0", "a1", "b1"), held)}
            yield from pa.table({"term": pa.array(names, pa.string())} | columns).to_batches(max_chunksize=100_000)

        held = [Counter() for _ in range(4)]
        for b in batches:
            for t, y, half in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "half"))):
                held[2 * half + (not y)].update(terms_of(t) | {""})
                if sum(map(len, held)) > HELD:
                    yield from counts()
                    held = [Counter() for _ in range(4)]
        yield from counts()

    told = rows.mapInArrow(count, "term string, a0 long, b0 long, a1 long, b1 long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("a0", "b0", "a1", "b1")))
    return written(told, "terms")


def mined(told: DataFrame, halves: tuple[int, ...] = (0, 1), ratio: float = RATIOS[0]) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """(terms of the voters, the log-likelihood ratio that the rows of these halves bear out for each, its ratio of rates, share of toxic rows)."""
    a, b = (sum((F.col(f"{x}{h}") for h in halves), F.lit(0)).cast("double") for x in "ab")
    told = told.select("term", a.alias("a"), b.alias("b")).where("a + b > 0")
    whole = told.where("term = ''").first()
    if whole is None or not whole.a or not whole.b:
        return [], np.zeros(0), np.zeros(0), (0.5 if whole is None else whole.a / max(1, whole.a + whole.b))
    ya, yb = whole.a, whole.b
    limit = 2 * math.log(10.0 * max(2, told.count()))
    a, b = F.col("a"), F.col("b")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    n, all_ = a + b, ya + yb
    g2 = 2 * (part(a, n * ya / all_) + part(b, n * yb / all_) + part(ya - a, (all_ - n) * ya / all_) + part(yb - b, (all_ - n) * yb / all_))
    rates = (a / ya) / ((b + 0.5) / yb)
    # Of the logarithm of how much likelier a term is in toxic rows, two standard errors below the estimate are evidence.
    llr = F.log(((a + 0.5) / (ya + 1)) / ((b + 0.5) / (yb + 1))) - 2 * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    best = told.where("term <> ''").where((g2 > limit) & (rates > ratio)).select("term", "a", "b", llr.alias("llr"), rates.alias("rates")).orderBy("term").toArrow().to_pylist()
    stands = {r["term"]: (r["a"], r["b"]) for r in best}

    def repeats(t: str) -> bool:
        """A shorter beginning holds all rows of the term, so with equal counts it stands in the same."""
        bare = t.rstrip("*")
        return any(stands.get(bare[:n] + "*") == stands[t] for n in STEMS if n < len(bare))

    kept = [r for r in best if not repeats(r["term"])]
    return [r["term"] for r in kept], np.array([r["llr"] for r in kept]), np.array([r["rates"] for r in kept]), ya / all_


def cross_validated(rows: DataFrame, told: DataFrame) -> float:
    """The ratio whose terms, mined from one half of the training rows, best tell the toxic rows of the other; of equals the greatest."""
    models = [mined(told, (h,)) for h in (0, 1)]
    voters, rates = [Voters(m[0]) for m in models], [m[2] for m in models]
    steps = np.array(RATIOS)

    def judge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: Counter = Counter()
        for b in batches:
            for t, y, half in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "half"))):
                votes = voters[1 - half](t)[0]
                seen[bool(y), int((steps < rates[1 - half][votes].max()).sum()) if votes else 0] += 1
        c = list(seen.items())
        yield pa.RecordBatch.from_pydict({"toxic": pa.array([k[0] for k, _ in c], pa.bool_()), "passed": pa.array([k[1] for k, _ in c], pa.int32()), "n": pa.array([n for _, n in c], pa.int64())})

    count = np.zeros((2, len(steps) + 1))
    for r in rows.mapInArrow(judge, "toxic boolean, passed int, n long").groupBy("toxic", "passed").agg(F.sum("n").alias("n")).collect():  # a row for each ratio and label
        count[int(r.toxic), r.passed] = r.n
    hit, wrong = (count[y, ::-1].cumsum()[::-1][1:] for y in (1, 0))
    f1 = 2 * hit / np.maximum(count[1].sum() + hit + wrong, 1)
    return float(steps[np.flatnonzero(f1 == f1.max())[-1]]) if f1.max() > 0 else RATIOS[0]


def flat(batch) -> tuple[np.ndarray, np.ndarray]:
    """(document's row in the batch, voter) of all votes."""
    votes = batch.column("votes")
    return np.repeat(np.arange(batch.num_rows), votes.value_lengths().to_numpy(zero_copy_only=False)), votes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def moments(votes: DataFrame, bloc: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(documents, votes of each voter, votes of each together with each bloc, votes of each two blocs together), over all documents."""
    m = len(bloc)

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out, blocs, n = np.zeros((m, BLOCS + 1)), np.zeros((BLOCS, BLOCS)), 0
        for b in batches:
            doc, voter = flat(b)
            x = np.zeros((b.num_rows, BLOCS), np.float32)
            x[doc, bloc[voter]] = 1
            blocs += x.T @ x
            out[:, BLOCS] += np.bincount(voter, minlength=m)
            for g in range(BLOCS):
                out[:, g] += np.bincount(voter, x[doc, g], m)
            n += b.num_rows
        every = np.concatenate([[n], blocs.ravel(), out.ravel()])
        cell = np.flatnonzero(every)
        yield from pa.table({"cell": cell, "n": every[cell]}).to_batches(max_chunksize=200_000)

    rows = votes.select("votes").mapInArrow(add, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # BLOCS + 1 rows a voter
    every = np.zeros(1 + BLOCS * BLOCS + m * (BLOCS + 1))
    every[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    both = every[1 + BLOCS * BLOCS :].reshape(m, BLOCS + 1)
    return float(every[0]), both[:, BLOCS], both[:, :BLOCS], every[1 : 1 + BLOCS * BLOCS].reshape(BLOCS, BLOCS)


def label_model(n: float, count: np.ndarray, both: np.ndarray, blocs: np.ndarray, bloc: np.ndarray, llr: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """(evidence of each voter's vote, evidence of no vote at all), as log-likelihood ratios."""
    n = max(n, 1)
    own = np.diag(blocs) / n

    def rates(mean: np.ndarray, with_: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rate under either label of what votes so often, and so often together with the blocs; ``at``: its own bloc."""
        cov = with_ / n - np.outer(mean, own)
        sure = cov > 3 * np.sqrt(np.maximum(np.outer(mean, own), 1e-12) / n)
        sure[np.arange(len(mean)), at] = False
        found = []
        for g in range(BLOCS):
            for h in range(g + 1, BLOCS):
                c = blocs[g, h] / n - own[g] * own[h]
                if c > 3 * math.sqrt(max(own[g] * own[h], 1e-12) / n):
                    found.append(np.where(sure[:, g] & sure[:, h], cov[:, g] * cov[:, h] / c, np.nan))
        held = np.array(found).reshape(len(found), len(mean))
        some = ~np.isnan(held).all(axis=0) if len(held) else np.zeros(len(mean), bool)
        # A voter that no two blocs corroborate keeps what its own rate allows under the prior.
        delta = np.minimum(mean / prior, 1.0) * 0.9
        if some.any():
            delta[some] = np.sqrt(np.maximum(np.nanmedian(held[:, some], axis=0), 0) / (prior * (1 - prior)))
        high = np.clip(mean + (1 - prior) * delta, 1e-9, 1 - 1e-4)
        return high, np.clip(mean - prior * delta, 1e-9, high)

    high, low = rates(count / n, both, bloc)
    yes = np.minimum(np.log(high / low), llr)
    high, low = rates(own, blocs, np.arange(BLOCS))
    return yes, float(np.log((1 - high) / (1 - low)).sum())


def evidence(batch, yes: np.ndarray, family: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(summed evidence, families that vote) of each document; of a family, its strongest voter counts."""
    doc, voter = flat(batch)
    key, back = np.unique(doc * (len(yes) + 1) + family[voter], return_inverse=True)
    most = np.zeros(len(key))
    np.maximum.at(most, back, yes[voter])
    at = key // (len(yes) + 1)
    return np.bincount(at, most, batch.num_rows), np.bincount(at, minlength=batch.num_rows)


def posterior(told: np.ndarray, families: np.ndarray, silent: float, prior: float) -> np.ndarray:
    """P(toxic). Silence counts where nothing votes: each voter fits few texts."""
    z = math.log(prior / (1 - prior)) + np.where(families > 0, told, silent)
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def features(told: np.ndarray, families: np.ndarray, style: np.ndarray, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    x = [np.minimum(told, 30) / 10, families > 0, np.log1p(families), np.log1p(hits), np.log1p(1000 * hits / np.maximum(words, 1))]
    return np.stack([*x, *((style >> i) & 1 for i in range(len(STYLE))), np.ones(len(told))], axis=1).astype(float)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton's method on the cross-entropy against posterior labels."""
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", fit: int = FIT, ratio: float | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted). ``ratio``: of a term's rates in toxic and clean rows, instead of cross-validation."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = labelled(docs, labels)
    told = term_counts(known)
    terms, llr, _, prior = mined(told, ratio=cross_validated(known, told) if ratio is None else ratio)
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    voters = Voters(terms)

    def vote(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ids = b.column("doc_id").to_pylist()
            cols = list(zip(*map(voters, b.column("text").to_pylist()))) or [(), (), (), ()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "held_out": [held_out(i) for i in ids], "votes": pa.array(cols[0], pa.list_(pa.int32())), "style": pa.array(cols[1], pa.int32()), "hits": pa.array(cols[2], pa.int64()), "words": pa.array(cols[3], pa.int64())})

    votes = written(docs.mapInArrow(vote, "doc_id long, held_out boolean, votes array<int>, style int, hits long, words long"), "votes")
    if len(terms):
        yes, silent = label_model(*moments(votes, voters.bloc), voters.bloc, llr, prior)
        fitted = votes.where("NOT held_out").orderBy(F.xxhash64("doc_id"), "doc_id").select("votes", "style", "hits", "words").limit(fit).toArrow().combine_chunks().to_batches()
    else:
        yes, silent, fitted = np.zeros(0), 0.0, []
    family = voters.family

    def read(batch) -> tuple[np.ndarray, ...]:
        return *evidence(batch, yes, family), *(batch.column(c).to_numpy() for c in ("style", "hits", "words"))

    if fitted:
        seen = read(fitted[0])
        w = fit_logistic(features(*seen), posterior(*seen[:2], silent, prior))
    else:
        w = np.zeros(6 + len(STYLE))
        w[-1] = math.log(prior / (1 - prior))

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            z = features(*read(b)) @ w
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": p, "predicted": (p >= 0.7).astype(np.int32)})

    return votes.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def op10_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
