"""Byte-level BPE encoding by tree concatenation, and decoding.

Long text is halved down to leaves that are encoded in parallel; up the tree, a growing window around each join is
encoded anew until its outer tokens are those of both sides. BPE output is valid when each neighbouring pair of tokens
is, and every pair then stands inside one encoding, so the joined ids are exact.
"""

from __future__ import annotations

import base64
import hashlib
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pulsefield.llm.common import map_text

#: Texts of more characters than this are halved.
LEAF = 4096
#: The pre-token pattern of this vocabulary family (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"


class Codec:
    def __init__(self, path: str, special_id: int = 50256, leaf: int = LEAF):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {i: b for b, i in ranks.items()} | {special_id: SPECIAL.encode()}
        self.special_id, self.leaf = special_id, leaf
        self.pool = ThreadPoolExecutor(2)
        self.decimal = [str(i) for i in range(max(self.bytes) + 1)]

    def plain(self, text: str) -> list[int]:
        """Ids of text without special strings."""
        if len(text) <= self.leaf:
            return self.core.encode_ordinary(text)
        parts = [text]
        while len(parts[0]) > self.leaf:
            parts = [h for p in parts for h in (p[: (len(p) + 1) // 2], p[(len(p) + 1) // 2 :])]
        done = list(self.pool.map(self.core.encode_ordinary, parts))
        while len(done) > 1:
            done = [self.join(a, b) for a, b in zip(done[::2], done[1::2], strict=True)]
        return done[0]

    def whole(self, ids: list[int], at: int) -> bool:
        """Whether a character starts at token `at`."""
        return at in (0, len(ids)) or self.bytes[ids[at]][0] & 0xC0 != 0x80

    def join(self, a: list[int], b: list[int]) -> list[int]:
        if not a or not b:
            return a or b
        k = 4
        while True:
            i, j = max(0, len(a) - k), min(len(b), k)
            while not self.whole(a, i):
                i -= 1
            while not self.whole(b, j):
                j += 1
            window = b"".join([self.bytes[t] for t in a[i:] + b[:j]]).decode()
            new = self.core.encode_ordinary(window)
            if (not i or new[0] == a[i]) and (j == len(b) or new[-1] == b[j - 1]):
                return a[:i] + new + b[j:]
            k *= 2

    def encode(self, text: str) -> list[int]:
        """Ids as the library gives them by default: special strings inside text are their id."""
        first, *rest = text.split(SPECIAL)
        ids = self.plain(first)
        for part in rest:
            ids = [*ids, self.special_id, *self.plain(part)]
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def round_trip(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """keep columns, n_tokens, SHA-256 of the comma-joined ids and of the decoded text, and the ids and decoded text if asked.

    Null and empty texts have no ids and decode to the empty text; repeated rows stay; an empty table gives no rows;
    other input columns, whatever their names, are not read.
    """
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    if ids:
        fields += [("ids", T.ArrayType(T.IntegerType(), False)), ("decoded", T.StringType())]

    def make():
        c = codec(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

        def fn(texts):
            got = [c.encode(t or "") for t in texts.to_pylist()]
            back = [c.decode(g) for g in got]
            cols = [pa.array(map(len, got), pa.int64()), pa.array([sha(",".join(map(c.decimal.__getitem__, g))) for g in got], pa.string()), pa.array(map(sha, back), pa.string())]
            return [*cols, pa.array(got, pa.list_(pa.field("element", pa.int32(), False))), pa.array(back, pa.string())] if ids else cols

        return fn

    return map_text(df, make, fields, text, keep)
