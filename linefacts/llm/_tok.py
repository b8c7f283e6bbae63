"""Exact whole-text encoding with a public BPE file, reusing the ids of pieces already met.

Both kinds of vocabulary split a text before they merge, and never across the
places where a text is cut here, so the ids of a text are the ids of its pieces:

* ``drop``: white space is dropped by the pre-tokenizer. Every run of ASCII
  white space is a cut.
* ``keep``: a word takes the one space before it. A lone space or line feed
  between two characters that aren't white space is a cut; a text with any
  other white space is cut by a pattern with the same three branches as the
  tokenizer's own.

New pieces of a batch are encoded together, joined, and told apart afterwards:
``keep`` by the byte lengths of the tokens, ``drop`` by end-of-word tokens.
The table of known pieces is emptied when it is full; results don't depend on it.
"""

from __future__ import annotations

import re

import numpy as np

from linefacts.llm._hash import MASK, U, buffer_of, lanes, mix, word_hashes, words_of

KNOWN = 2_000_000
#: Unicode's White_Space characters, as the tokenizers' patterns see them.
WHITE = "\x09-\x0d\x20\x85\xa0  -     　"
ODD = re.compile(rf"[{WHITE.replace(chr(32), '')}]").search
#: Those beyond ASCII in UTF-8: first bytes that hint at them, and exactly.
UTF8_WHITE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
ODD_BYTES = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80").search
PIECES = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall
PLAIN_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+([.,!?;:]*)").fullmatch

_open: dict[str, "Encoder"] = {}


def encoder(path: str, known: int = KNOWN) -> "Encoder":
    """The worker's encoder for a vocabulary file; opened once for each process. ``known``: pieces that it keeps at most."""
    if path not in _open:
        _open[path] = Encoder(path)
    _open[path].known = known
    return _open[path]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.known = KNOWN

        self.tok = Tokenizer.from_file(path)
        if hasattr(self.tok.model, "_resize_cache"):
            self.tok.model._resize_cache(0)  # it would only hold what `known` holds
        vocab = self.tok.get_vocab()
        size = max(vocab.values()) + 1
        self.length, self.ends = np.zeros(size, np.int64), np.zeros(size, bool)
        for token, i in vocab.items():
            self.length[i] = len(token)
            self.ends[i] = token.endswith("</w>")
        self.drop = bool(self.ends.any())
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        """Known pieces: a row for each (hash, first 8 bytes, length, start in the pool of ids, ids), found by open addressing."""
        self.rows, self.n = np.zeros((1 << 12, 5), U), 0
        self.slots, self.bits = np.full(1 << 13, -1, np.int32), 13
        self.pool, self.used = np.zeros(1 << 14, "<u4"), 0

    def _place(self, rows: np.ndarray) -> None:
        """Puts rows into the slots after their hashes' own that are free."""
        at = (self.rows[rows, 0] >> U(64 - self.bits)).astype(np.int64)
        while len(rows):
            free = self.slots[at] < 0
            self.slots[at[free]] = rows[free]  # of several the last wins
            left = self.slots[at] != rows
            rows, at = rows[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        raw, at = ids.tobytes(), [0, *(ends * 4).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def _encode(self, new: list[str]) -> list[bytes]:
        """The ids of each piece; a ``keep`` piece has the white space before it."""
        known: dict[str, bytes] = {}
        plain, marks, other = [], [], []
        whole = "\x00".join(new)
        special = [x for x in self.special if x in whole]
        odd = bool(ODD(whole.replace("\n", ""))) if not self.drop else False
        for x in new:
            if special and any(s in x for s in special):
                other.append(x)
            elif self.drop:
                if m := PLAIN_WORD(x):
                    plain.append(x)
                    marks.append(2 if m[1] else 1)
                else:
                    other.append(x)
            elif x[0] == " " and x[1:2] not in ("", " ", "\n") and not (odd and ODD(x)):
                plain.append(x)
            else:
                other.append(x)
        if plain:
            e = self.tok.encode_batch_fast([(" " if self.drop else "").join(plain)], add_special_tokens=False)[0]
            ids = np.array(e.ids, "<u4")
            if self.drop:
                ends = np.flatnonzero(self.ends[ids]) + 1
                per = np.cumsum(marks)
                fits = len(ends) == (per[-1] if len(per) else 0)
                ends = ends[per - 1] if fits else None
            else:
                reach = np.cumsum(self.length[ids])
                per = np.cumsum([len(x.encode()) for x in plain])
                at = np.searchsorted(reach, per)
                fits = len(reach) and reach[-1] == per[-1] and bool((reach[at] == per).all())
                ends = at + 1 if fits else None
            if ends is None:  # a vocabulary that breaks the rules above: encode one by one
                other += plain
            else:
                known.update(zip(plain, self._cut(ids, ends)))
        if other:
            known.update(zip(other, self._raw(other)))
        return [known[x] for x in new]

    def _slow(self, texts: list[str]) -> list[bytes]:
        """Texts with white space that the fast cut doesn't cover."""
        cut = [PIECES(t) for t in texts]
        new = list(set().union(*cut))
        known = dict(zip(new, self._encode(new)))
        return [b"".join(map(known.__getitem__, c)) for c in cut]

    def _find(self, hashes: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of each piece, and which have none."""
        out = np.zeros(len(hashes), np.int64)
        new = np.ones(len(hashes), bool)
        rest, at = np.arange(len(hashes)), (hashes >> U(64 - self.bits)).astype(np.int64)
        while len(rest):
            row = self.slots[at]
            there = row >= 0
            rest, at, row = rest[there], at[there], row[there]
            own = self.rows[row, 0] == hashes[rest]
            hit = rest[own]
            out[hit] = row[own]
            new[hit] = False
            rest, at = rest[~own], (at[~own] + 1) & ((1 << self.bits) - 1)
        known = self.rows[out]
        new |= (known[:, 1] != first) | (known[:, 2] != size.astype(U))
        return out, new

    def _learn(self, hashes, first, size, pieces) -> None:
        ids = self._encode(pieces)
        n = np.array([len(x) // 4 for x in ids], np.int64)
        end = self.used + np.cumsum(n)
        to = self.n + len(pieces)
        while to > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        while len(n) and end[-1] > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        raw = b"".join(ids)
        self.pool[self.used : self.used + len(raw) // 4] = np.frombuffer(raw, "<u4")
        self.rows[self.n : to] = np.stack([hashes, first, size.astype(U), (end - n).astype(U), n.astype(U)], axis=1)
        new = np.arange(self.n, to)
        self.n, self.used = to, self.used + len(raw) // 4
        if 2 * to > len(self.slots):
            while 2 * to > 1 << self.bits:
                self.bits += 1
            self.slots = np.full(1 << self.bits, -1, np.int32)
            new = np.arange(to)
        self._place(new.astype(np.int32))

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each whole UTF-8 text as little-endian unsigned 32-bit integers; null: none.

        A piece is known by a 64-bit hash, its length and its first 8 bytes.
        """
        data, edges = buffer_of(texts)
        starts, ends = words_of(data)
        doc = np.searchsorted(edges, starts, "right") - 1
        hashes, before, odd = word_hashes(data, starts, ends), None, []
        if not self.drop:
            first = np.ones(len(starts), bool)
            first[1:] = doc[1:] != doc[:-1]
            gap = starts - np.where(first, edges[doc], np.concatenate([[0], ends[:-1]])[: len(starts)])
            char = data[np.maximum(starts - 1, 0)]
            before = np.where(gap == 0, 0, np.where((gap == 1) & (char == 32), 1, np.where((gap == 1) & (char == 10), 2, 3)))
            last = np.zeros(len(texts), np.int64)
            last[doc] = ends  # the last word of a text wins
            bad = np.zeros(len(texts), bool)
            bad[doc[before == 3]] = True
            bad |= (last != edges[1:] - 1) & (np.diff(edges) > 1)
            if any(x in data.tobytes() for x in UTF8_WHITE):
                bad |= np.array([ODD_BYTES(t) is not None if t else False for t in texts])
            odd = np.flatnonzero(bad).tolist()
            hashes = hashes ^ mix(before.astype(U))
        size = ends - starts
        lead = lanes(data)[starts] & MASK[np.minimum(size, 8)]
        at, new = self._find(hashes, lead, size)
        if new.any():
            if self.n + int(new.sum()) > self.known:
                self._forget()
                new[:] = True
            _, one = np.unique(hashes[new], return_index=True)
            one = np.flatnonzero(new)[one]
            raw = data.tobytes()
            pieces = [raw[a:b].decode() for a, b in zip(starts[one].tolist(), ends[one].tolist())]
            if before is not None:
                pieces = [("", " ", "\n", "")[k] + x for k, x in zip(before[one].tolist(), pieces)]
            self._learn(hashes[one], lead[one], size[one], pieces)
            at, new = self._find(hashes, lead, size)
            if new.any():  # two pieces with one hash
                odd = sorted({*odd, *doc[new].tolist()})
        n, from_, pool = self.rows[at, 4].astype(np.int64), self.rows[at, 3].astype(np.int64), self.pool
        place = np.repeat(from_ - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out, total = pool[place].tobytes(), np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.bincount(doc, n, len(texts)).astype(np.int64) * 4, out=total[1:])
        got = [out[a:b] for a, b in zip(total.tolist(), total[1:].tolist())]
        for k, x in zip(odd, self._slow([texts[k].decode() for k in odd]) if odd else []):
            got[k] = x
        return got
