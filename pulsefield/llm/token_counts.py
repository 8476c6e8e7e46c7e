"""Token counts by rank-synchronous array merging of a word-end BPE vocabulary.

Pre-tokens are held as one ragged numpy array of symbol ids. In each round every sequence applies its own lowest-rank
pair at all its places at once (leftmost first where places overlap), so a batch needs as many rounds as its longest
merge chain, not as its longest text; what survives is the count. Distinct pre-tokens are merged once per worker.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pulsefield.llm.common import map_text, sums

NONE = np.int32(2**31 - 1)
#: Pre-tokens whose counts a worker keeps, and the most bytes of one; the store is emptied when full.
STORE, SHORT = 1 << 20, 64
_LETTER, _DIGIT, _SPACE, _OTHER = 1, 2, 3, 0
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Texts with characters beyond these go through the library's own normaliser.
_PLAIN = regex.compile("[^\u0000-ɏ -⁯₠-⃏]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


@lru_cache(1)
def classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        out[c] = _LETTER if k == "L" else _DIGIT if k == "N" else _OTHER
    out[_WHITE] = _SPACE
    return out


def pre_tokens(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pattern 's|'t|'re|'ve|'m|'ll|'d|letters|digit|other, over code points of texts on end."""
    kind = classes()[cp]
    n = len(cp)
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    start[off[:-1][off[:-1] < n]] = True
    wall = np.zeros(n + 3, bool)  # a text ends before here
    wall[off[1:]] = True
    # An apostrophe that opens a run of others may be a contraction: it and its letters are one token then.
    q = np.flatnonzero(start & (cp == 39))
    if len(q):
        x = np.concatenate([cp, np.zeros(3, cp.dtype)])
        a, b = x[q + 1], x[q + 2]
        one = ~wall[q + 1] & np.isin(a, [115, 116, 109, 100])
        two = ~wall[q + 1] & ~wall[q + 2] & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))
        start[q[one | two] + 1] = False
        for hit, k in ((one, 2), (two, 3)):
            to = q[hit] + k
            start[to[to < n]] = True
    at = np.flatnonzero(start)
    end = np.append(at[1:], n)
    word = kind[at] != _SPACE
    return at[word], end[word]


class Merger:
    """A word-end BPE vocabulary file as arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        chars = byte_symbols()
        self.inner = np.array([vocab.get(c, -1) for c in chars], np.int32)
        self.last = np.array([vocab.get(c + end, -1) for c in chars], np.int32)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.normalize = Tokenizer.from_file(path).normalizer.normalize_str
        self.store: dict[bytes, int] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word after all merges."""
        size = np.array([len(w) for w in words], np.int64)
        out, ids = np.zeros(len(words), np.int64), np.flatnonzero(size)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(size[ids])
        sym = self.inner[data]
        sym[ends - 1] = self.last[data[ends - 1]]
        known = sym >= 0  # bytes the vocabulary lacks give no symbol
        owner = np.repeat(np.arange(len(ids)), size[ids])[known]
        sym = sym[known]
        while len(sym):
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            if "r" not in locals() or len(r) != len(sym):
                r = np.full(len(sym), NONE)
                inner = np.flatnonzero(owner[1:] == owner[:-1])
                r[inner] = self.rank(sym[inner], sym[inner + 1])
            low = np.minimum.reduceat(r, start)
            size_now = np.diff(np.append(start, len(sym)))
            over = low == NONE
            if over.any():
                out[ids[owner[start[over]]]] = size_now[over]
                stay = np.repeat(~over, size_now)
                sym, owner, r = sym[stay], owner[stay], r[stay]
                if not len(sym):
                    break
                low, size_now = low[~over], size_now[~over]
            hit = r == np.repeat(low, size_now)
            run = hit & np.append(False, hit[:-1])
            if run.any():  # equal pairs that overlap: every second one, from the left
                k = np.flatnonzero(hit)
                first = np.append(True, np.diff(k) > 1)
                nth = np.arange(len(k)) - np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
                hit[k[nth % 2 == 1]] = False
            at = np.flatnonzero(hit)
            sym[at] = self.made[r[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            new = np.cumsum(stay)[at] - 1
            sym, owner, r = sym[stay], owner[stay], r[stay]
            fix = np.unique(np.concatenate([new, new[new > 0] - 1]))
            pair = (fix + 1 < len(sym)) & (owner[np.minimum(fix + 1, len(sym) - 1)] == owner[fix])
            r[fix] = NONE
            r[fix[pair]] = self.rank(sym[fix[pair]], sym[fix[pair] + 1])
        return out

    def of_texts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        extra = np.zeros(len(texts), np.int64)
        pieces, owner = [], []
        for i, t in enumerate(texts):
            parts = [t]
            if self.special and self.special.search(t):
                parts = self.special.split(t)
                extra[i] = len(parts) - 1
            for p in parts:
                pieces.append(p.lower() if p.isascii() else self.normalize(p) if _PLAIN.search(p) else unicodedata.normalize("NFC", p).lower())
                owner.append(i)
        line = "".join(pieces)
        cp = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
        off = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        start, end = pre_tokens(cp, off)
        if not len(start):
            return extra
        # Distinct pre-tokens, told apart by their bytes.
        place = np.concatenate([[0], np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000))])
        edge = np.zeros(place[-1] + 1, np.int8)
        edge[place[start]] += 1
        edge[place[end]] -= 1
        letters = np.frombuffer(line.encode("utf-8", "surrogatepass"), np.uint8)[np.cumsum(edge[:-1], dtype=np.int8) > 0]
        bounds = np.concatenate([[0], np.cumsum(place[end] - place[start])])
        each = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
        words, back = each.dictionary.to_pylist(), each.indices.to_numpy()
        found = np.fromiter((self.store.get(w, -1) for w in words), np.int64, len(words))
        miss = np.flatnonzero(found < 0).tolist()
        if miss:
            new = [words[i] for i in miss]
            found[miss] = self.counts(new)
            if len(self.store) + len(miss) > STORE:
                self.store.clear()
            self.store.update((w, n) for w, n in zip(new, found[miss].tolist(), strict=True) if len(w) <= SHORT)
        per_piece = sums(found[back], np.searchsorted(start, off))
        np.add.at(extra, np.array(owner), per_piece)
        return extra


@lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


def count_tokens(df: DataFrame, path: str, limit: int = 2048, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows stay; an empty table gives no rows; other input
    columns, whatever their names, are not read.
    """

    def make():
        m = merger(path)

        def fn(texts):
            got = [t or "" for t in texts.to_pylist()]
            n = m.of_texts(got)
            return [pa.array([len(t.encode()) for t in got], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)]

        return fn

    return map_text(df, make, [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())], text, keep, 4 << 20)
