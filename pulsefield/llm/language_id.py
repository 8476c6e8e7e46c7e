"""Language identification in two levels: the family first, then one-versus-one linear SVMs inside it.

Features are frequencies of hashed byte trigrams of letters and blanks over the whole text. All machines, those between
families and those between the languages of a family, are linear in them, so a text is one gather and one ragged sum.
They are fitted in the driver on the trigram counts of a bounded sample of labelled rows (per_lang rows a language, chosen
by a hash).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsefield.llm.common import LOWER, map_arrow, map_text, pack, small_batches, squeeze, sums, trim, unsqueeze

WIDTH = 4096
#: Families of closely related languages; a language of none is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def crc_part(doc: str, parts: int) -> Column:
    """crc32 of the column as text, modulo parts."""
    return F.crc32(F.col(doc).cast("string").cast("binary")) % parts


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of texts on end, each text between two blanks, and their offsets."""
    n = len(off) - 1
    x = np.full(len(data) + 2 * n, 0x20, np.uint8)
    x[np.arange(len(data)) + 2 * np.repeat(np.arange(n), np.diff(off)) + 1] = _FOLD[data]
    x = x.astype(np.uint32)
    own = np.ones(len(x), bool)  # a text's last two places have no trigram inside it
    own[(off[1:] + 2 * np.arange(1, n + 1))[:, None] - [2, 1]] = False
    at = np.flatnonzero(own)
    return (x[at] * np.uint32(0x9E3779B1) + x[at + 1] * np.uint32(0x85EBCA77) + x[at + 2] * np.uint32(0xC2B2AE3D)) >> np.uint32(20), off


def fit_svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-3, rounds: int = 120) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss by accelerated gradient descent."""
    n, d = x.shape
    v = np.ones(d, np.float32)
    for _ in range(8):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-12
    rate = 1 / (2 * float(np.linalg.norm(x @ v) ** 2) / n * 1.2 + 2 + reg)
    w = z = np.zeros(d, np.float32)
    b = zb = 0.0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z + zb)) * weight * y
        nw, nb = z + rate * (2 * (x.T @ slack) - reg * z), zb + rate * 2 * float(slack.sum())
        m = k / (k + 3)
        z, zb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return w, b


def features(text: str) -> list[np.ndarray]:
    """Trigram counts of a text and, if it is long, of a short piece of it too, as texts can be short."""
    raw = text.encode()
    parts = [raw]
    if len(raw) > 160:
        at = zlib.crc32(raw) % (len(raw) - 120)
        parts.append(raw[at : at + 120])
    return [np.bincount(trigrams(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0], minlength=WIDTH).astype(np.uint32) for r in parts]


class Model:
    """languages, their families, and machines: (left set, right set) with weights over trigrams."""

    def __init__(self, texts: list[str], langs: list[str]):
        rows = [(f, lang) for t, lang in zip(texts, langs, strict=True) for f in features(t)]
        self.learn([f for f, _ in rows], [lang for _, lang in rows])

    @staticmethod
    def of(counts: Iterable[np.ndarray], langs: list[str]) -> Model:
        """A model of texts that are known by their trigram counts, which are held one at a time."""
        out = Model.__new__(Model)
        out.learn(counts, langs)
        return out

    def learn(self, rows: Iterable[np.ndarray], labels: list[str]) -> None:
        self.langs = sorted(set(labels))
        family = {lang: next((f for f, m in FAMILIES.items() if lang in m), f"only-{lang}") for lang in self.langs}
        self.families = {f: [x for x in self.langs if family[x] == f] for f in sorted(set(family.values()))}
        x = np.zeros((len(labels), WIDTH), np.float32)
        for i, f in enumerate(rows):
            x[i] = f / max(1, int(f.sum()))
        mean = x.mean(0) if len(labels) else np.zeros(WIDTH, np.float32)
        # Some columns at a time: std() copies what it is given.
        scale = 1 / (np.concatenate([x[:, k : k + 256].std(0) for k in range(0, WIDTH, 256)]) + 1e-4) / np.sqrt(WIDTH) if len(labels) else mean
        x -= mean
        x *= scale
        labels = np.array(labels)
        fam = np.array([family[v] for v in labels])
        self.pairs, ws, bs = [], [], []
        for key, groups in [(fam, list(self.families))] + [(labels, m) for m in self.families.values()]:
            for a, b in combinations(groups, 2):
                use = (key == a) | (key == b)
                w, c = fit_svm(x if use.all() else x[use], np.where(key[use] == a, 1, -1).astype(np.float32))
                self.pairs.append((a, b))
                ws.append(w * scale)
                bs.append(c - float(mean @ (w * scale)))
        self.w = np.stack(ws, 1).astype(np.float64) if ws else np.zeros((WIDTH, 0))
        self.b = np.array(bs)

    def margins(self, texts: pa.Array) -> np.ndarray:
        h, off = trigrams(*pack(texts))
        n = np.maximum(1, np.diff(off))
        out = np.empty((len(texts), len(self.pairs)))
        for k in range(len(self.pairs)):
            out[:, k] = sums(np.take(self.w[:, k], h), off) / n + self.b[k]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        margins = self.margins(texts)
        where = {p: k for k, p in enumerate(self.pairs)}

        def best(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """The member with most one-versus-one votes (then the larger margins), and its least margin."""
            votes, least = np.zeros((len(texts), len(names))), np.full((len(texts), len(names)), np.inf)
            for (i, a), (j, b) in combinations(enumerate(names), 2):
                m = margins[:, where[a, b]]
                for k, s in ((i, m), (j, -m)):
                    votes[:, k] += (s > 0) + 1e-3 * np.tanh(s)
                    least[:, k] = np.minimum(least[:, k], s)
            at = votes.argmax(1)
            return at, least[np.arange(len(texts)), at]

        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        fam, sure = best(list(self.families))
        pick, score = np.zeros(len(texts), object), np.zeros(len(texts))
        for f, members in enumerate(self.families.values()):
            rows = np.flatnonzero(fam == f)
            at, m = best(members)
            pick[rows] = np.array(members, object)[at[rows]]
            score[rows] = np.minimum(sure, m)[rows]
        score = 1 / (1 + np.exp(-4 * np.clip(score, -20, 20)))
        lettered = [bool(t and _LETTER.search(t)) for t in texts.to_pylist()]
        return [p if ok else UNKNOWN for p, ok in zip(pick, lettered, strict=True)], np.where(lettered, score, 0.0)


def fit(df: DataFrame, text: str = "text", lang: str = "lang", doc: str = "doc_id", parts: int = 4, held: int = 2, per_lang: int = 500) -> Model:
    """A model of the rows outside the held-out part; about per_lang rows of each language, chosen by a hash, bound the sample."""
    rows = df.select(F.col(doc).alias("d"), F.col(lang).cast("string").alias("l"), F.col(text).cast("string").alias("t")).where((crc_part(doc, parts) != held) & F.col(lang).isNotNull())
    count = {r.l: r["count"] for r in rows.groupBy("l").count().collect()}
    if not count:
        return Model([], [])
    span = 1 << 30
    upto = F.create_map(*[F.lit(v) for k, n in count.items() for v in (k, min(span, per_lang * span // n))])
    some = rows.where((F.pmod(F.xxhash64("d", F.lit(5)), F.lit(span)) < upto[F.col("l")]) & F.col("t").isNotNull()).select("l", "t")

    def count(batches):  # so that the driver gets counts of one size, however long the texts are
        for b in batches:
            got = [(lang, squeeze(f)) for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for f in features(t)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.binary())], names=["l", "f"])

    small_batches(df.sparkSession)
    got = sorted(map_arrow(some, count, "l string, f binary").collect(), key=lambda r: (r.l, bytes(r.f)))
    model = Model.of((unsqueeze(r.f, np.uint32) for r in got), [r.l for r in got])
    del got
    trim()  # the driver goes on to other work
    return model


def identify(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, lang_pred and score (0 to 1: how far the closest machine that decides is from its boundary).

    Null texts and texts without a letter are 'und' with score 0, as are all if nothing was learned; repeated rows stay;
    an empty table gives no rows; other input columns, whatever their names, are not read.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def fn(texts):
            lang, score = sent.value.predict(texts)
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

        return fn

    return map_text(df, make, [("lang_pred", T.StringType()), ("score", T.DoubleType())], text, keep)
