"""Scores under a log-bilinear neural language model trained with noise-contrastive estimation.

Word counts come from all training texts. The most frequent V**(2/3) of V words are leaves of the model, dealt by
frequency into about as many groups as a group has leaves; every other word belongs to one of as many shapes, by its
last letters and length, inside which it has its unigram probability. A context of two tokens predicts
q = c1 * r[first] + c2 * r[second]; groups and shapes score q . t[class] + b[class], and the leaves of a group likewise,
so a token's probability is that of its class times its own inside, and the model is a proper distribution over all
words. Both levels are trained by noise-contrastive estimation and normalised exactly by batched matrix products.

Training rows are dealt by a hash of id and text into shards, as many as their tokens ask for, so copies spread out. Each shard trains a model on all its
tokens in the order of that hash, from one start, and the weighted mean of the shards' models is the model; so scores do
not depend on how the table is partitioned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsefield.llm.common import SPACES, checkpoint, coded_words, hashes_of, map_arrow, mix, remove, slices, small_batches, squeeze, stored, unsqueeze

#: Most frequent words whose counts every task holds (all leaves at least); all others get theirs over a join.
HEAD = 1 << 20
WIDTH = 16
BATCH, NOISE, WITHIN, RATE = 4096, 32, 3, 0.3
#: Training tokens of a shard, of its part in minibatches of a quarter, and of a draw of minibatches.
SHARD, RAMP, DRAW = 1 << 22, 1 << 19, 1 << 18
END = mix(np.array([0xE4D], np.uint64))[0]
FAN_IN = 8


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each token's place among the distinct ones, n+1 offsets, and the distinct tokens' hashes and shapes; the last is END."""
    codes, off, distinct = coded_words(texts, SPACES)
    n = len(off) - 1
    out = np.full(len(codes) + n, len(distinct), np.int32)
    out[np.arange(len(codes)) + np.repeat(np.arange(n), np.diff(off))] = codes
    return out, off + np.arange(n + 1), np.append(hashes_of(distinct), END), np.append(shapes_of(distinct), np.int32(0))


def shapes_of(distinct: pa.Array) -> np.ndarray:
    """A number for the last two bytes and the length (up to 15) of each word, scattered over 20 bits."""
    _, bounds, data = distinct.buffers()
    bounds = np.frombuffer(bounds, np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    size, end = np.diff(bounds), bounds[1:]
    last = [np.where(size > k, data[np.maximum(end - 1 - k, 0)], 0).astype(np.uint64) for k in (0, 1)]
    return (mix(last[0] << np.uint64(16) | last[1] << np.uint64(8) | np.minimum(size, 15).astype(np.uint64)) >> np.uint64(44)).astype(np.int32)


def count_words(df: DataFrame) -> DataFrame:
    """h, shape, c: training occurrences of each word hash. df: t, held."""

    def run(batches):
        keys, shapes, counts, held = [], [], [], 0

        def merged():
            k, s, c = np.concatenate(keys), np.concatenate(shapes), np.concatenate(counts)
            k, first, back = np.unique(k, return_index=True, return_inverse=True)
            return k, s[first], np.bincount(back, c).astype(np.int64)

        def batch_of(k, s, c):
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(s), pa.array(c)], names=["h", "shape", "c"])

        for batch in batches:
            batch = batch.filter(pc.invert(batch.column(1)))
            for s in slices(batch, 0, 4 << 20):
                w, _, h, shape = tokens(s.column(0))
                keys.append(h)
                shapes.append(shape)
                counts.append(np.bincount(w, minlength=len(h)))
                held += len(h)
            if held > 2_000_000:
                k, s, c = merged()
                if len(k) > 1_000_000:
                    yield batch_of(k, s, c)
                    keys, shapes, counts, held = [], [], [], 0
                else:
                    keys, shapes, counts, held = [k], [s], [c], len(k)
        if keys:
            yield batch_of(*merged())

    return map_arrow(df, run, "h long, shape int, c long").groupBy("h").agg(F.max("shape").alias("shape"), F.sum("c").alias("c"))


class Head:
    """The most frequent words: sorted hashes with counts and leaves (-1: none), found by their top bits."""

    def __init__(self, h: np.ndarray, c: np.ndarray, shape: np.ndarray, leaves: int):
        order = np.argsort(h)
        self.h, self.c, self.shape = h[order], c[order], shape[order]
        self.top = np.lexsort((self.h, -self.c))[:leaves]
        self.leaf = np.full(len(h), -1, np.int32)
        self.leaf[self.top] = np.arange(len(self.top))
        at = np.searchsorted(self.h, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44))
        self.first = np.append(at, len(h)).astype(np.int32)
        self.most = int(np.diff(self.first).max()) if len(h) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes, -1 where absent."""
        out = np.full(len(h), -1, np.int32)
        if not len(self.h):
            return out
        at = self.first[(h >> np.uint64(44)).astype(np.int64)]
        todo = np.arange(len(h))
        for _ in range(self.most):
            inside = at < len(self.h)
            todo, at = todo[inside], at[inside]
            x, want = self.h[at], h[todo]
            out[todo[x == want]] = at[x == want]
            more = x < want
            todo, at = todo[more], at[more] + 1
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)) in place."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):  # 1 / (1 + inf) is 0
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def log_softmax(q: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithm of entry at[i] of the softmax of q[i] @ weights."""
    s = q @ weights
    mine = s[np.arange(len(s)), at]
    with np.errstate(over="ignore"):
        z = np.exp(s, out=s) @ np.ones(s.shape[1], np.float32)
    far = np.flatnonzero(~((z > 1e-25) & (z < 1e25)))  # only these need their largest score taken off first
    z[far] = 1
    out = mine - np.log(z)
    if len(far):
        x = (q[far] @ weights).astype(np.float64)
        x -= x.max(1, keepdims=True)
        out[far] = x[np.arange(len(far)), at[far]] - np.log(np.exp(x).sum(1))
    return out


class Bilinear:
    """Leaves 0 to len(counts) - 1 by falling count, in groups, and then shapes; both are classes."""

    def __init__(self, counts: np.ndarray, shape_mass: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        k, n_shapes = len(counts), len(shape_mass)
        mass = np.sqrt(counts)  # so that groups of frequent words are small
        n = max(1, math.isqrt(k))
        group = np.minimum((np.cumsum(mass) - mass) * n // max(1e-9, mass.sum()), n - 1).astype(np.int64) if k else np.zeros(0, np.int64)
        _, self.group = np.unique(group, return_inverse=True)
        self.n_groups = int(self.group.max()) + 1 if k else 0
        self.first = np.searchsorted(self.group, np.arange(self.n_groups + 1))
        self.cls = np.concatenate([self.group, self.n_groups + np.arange(n_shapes)]).astype(np.int32)
        of_group = np.bincount(self.group, counts, self.n_groups)
        self.noise = np.concatenate([of_group, shape_mass])
        self.noise = self.noise / self.noise.sum()
        self.inner = counts / of_group[self.group] if k else np.zeros(0)
        self.cum = np.concatenate([[0.0], np.cumsum(counts)])
        self.size = np.diff(self.first)
        # A group's mass in as many cells as it has leaves, and the leaf in which each cell begins.
        cell = self.cum[self.first[self.group]] + of_group[self.group] * ((np.arange(k) - self.first[self.group]) / self.size[self.group])
        self.guide = np.minimum(np.searchsorted(self.cum, cell, "right") - 1, max(0, k - 1))
        self.ends = np.append(self.cum[1:-1], np.inf)
        self.place = np.zeros(k + n_shapes, np.int64)
        self.expected = np.log(NOISE * self.noise).astype(np.float32), np.log(WITHIN * self.inner).astype(np.float32)
        draw = lambda n: rng.normal(0, 0.1, (n, WIDTH)).astype(np.float32)
        # contexts r, classes t and b, leaves u and a, and the weights of the two places
        self.p = [draw(k + n_shapes), draw(len(self.noise)), np.log(self.noise).astype(np.float32), draw(k), np.log(self.inner).astype(np.float32), np.ones(WIDTH, np.float32), np.full(WIDTH, 0.5, np.float32)]
        self.g = [np.full(x.shape, 0.1, np.float32) for x in self.p]

    def move(self, ks: tuple[int, ...], ids: np.ndarray, grads: list[np.ndarray], n: int) -> None:
        """Adagrad on the rows of parameters that a minibatch touched; a gradient has a column for each of ids."""
        k = len(self.p[ks[0]])
        if k < 2048:
            rows, back = np.arange(k), ids
        else:  # the distinct ids in order, without a sort
            touched = np.zeros(k, bool)
            touched[ids] = True
            rows = np.flatnonzero(touched)
            self.place[rows] = np.arange(len(rows))
            back = self.place.take(ids)
        for k, grad in zip(ks, grads, strict=True):
            if grad.ndim == 1:
                g = np.bincount(back, grad, len(rows)).astype(np.float32)
            else:
                g = np.empty((len(rows), len(grad)), np.float32)
                for j, column in enumerate(grad):
                    g[:, j] = np.bincount(back, column, len(rows))
            g /= n
            s = g * g
            s *= 400
            s += self.g[k].take(rows, 0)
            self.g[k][rows] = s
            g *= RATE * 20
            g /= np.sqrt(s, out=s)
            g += self.p[k].take(rows, 0)
            self.p[k][rows] = g

    def others(self, g: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The leaves at shares u of the groups' mass; each row of u is for one of the groups g."""
        first, last = self.first.take(g)[:, None], self.first.take(g + 1)[:, None] - 1
        low, high = self.cum.take(first), self.cum.take(last + 1)
        key = (low + u * (high - low)).ravel()
        out = self.guide.take(first + (u * (last + 1 - first)).astype(np.int64)).ravel()
        out -= self.cum.take(out) > key  # a cell's start may have been rounded up
        todo = np.flatnonzero(self.ends.take(out) <= key)
        while len(todo):
            out[todo] += 1
            todo = todo[self.ends.take(out[todo]) <= key[todo]]
        return np.clip(out.reshape(u.shape), first, last)

    def step(self, c1: np.ndarray, c2: np.ndarray, w: np.ndarray, rng) -> None:
        """One minibatch of noise-contrastive estimation: of classes against shared noise, of leaves inside their groups."""
        r, t, b, u, a, m1, m2 = self.p
        n = len(w)
        lk, li = self.expected
        noise = rng.choice(len(b), NOISE, p=self.noise)
        r1, r2, cls = r.take(c1, 0), r.take(c2, 0), self.cls.take(w)
        q = r1 * m1
        q += r2 * m2
        across = np.ascontiguousarray(q.T)
        tw, tn = t.take(cls, 0), t[noise]
        up = sigmoid((lk - b).take(cls) - np.einsum("ij,ij->i", q, tw))  # 1 - P(data)
        down = q @ tn.T
        down += b[noise] - lk[noise]
        down = sigmoid(down)  # P(data) of noise
        dq = up[:, None] * tw
        dq -= down @ tn
        moves = [((1, 2), np.concatenate([cls, noise]), [np.concatenate([up * across, -(across @ down)], 1), np.concatenate([up, -down.sum(0)])])]
        own = np.flatnonzero(w < len(u))
        own = own[self.size.take(cls.take(own)) > 1]
        if len(own):
            x = w.take(own)
            other = self.others(cls.take(own), rng.random((len(own), WITHIN)))
            z, ux, un = q.take(own, 0), u.take(x, 0), u.take(other, 0)
            less = a - li
            up = sigmoid(-less.take(x) - np.einsum("ij,ij->i", z, ux))
            down = np.einsum("ijk,ik->ij", un, z)
            down += less.take(other)
            down = sigmoid(down)
            ux *= up[:, None]
            ux -= np.einsum("ij,ijk->ik", down, un)
            dq[own] += ux
            shares = np.concatenate([up[None], -down.T])
            grad = shares * across.take(own, 1)[:, None, :]
            moves.append(((3, 4), np.concatenate([x[None], other.T]).ravel(), [grad.reshape(WIDTH, -1), shares.ravel()]))
        back = np.ascontiguousarray(dq.T)
        moves.append(((0,), np.concatenate([c1, c2]), [np.concatenate([back * m1[:, None], back * m2[:, None]], 1)]))
        moves.append(((5, 6), np.arange(WIDTH), [np.einsum("ij,ij->j", dq, r1), np.einsum("ij,ij->j", dq, r2)]))
        for ks, ids, grads in moves:
            self.move(ks, ids, grads, n)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for i, x in enumerate(self.p):
            self.p[i] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def log10(self, c1: np.ndarray, c2: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of the class, and for a leaf of the leaf, after c2, c1 (c1 is the nearer)."""
        r, t, b, u, a, m1, m2 = self.p
        out, q = np.empty(len(w)), np.ones((len(w), WIDTH + 1), np.float32)  # the last column meets the biases
        tb, ua = np.column_stack([t, b]).T, np.column_stack([u, a]).T
        step = max(256, (1 << 19) // max(1, len(b)))  # scores that stay in a processor's cache
        for i in range(0, len(w), step):
            at = slice(i, i + step)
            np.add(r.take(c1[at], 0) * m1, r.take(c2[at], 0) * m2, out=q[at, :-1])
            out[at] = log_softmax(q[at], tb, self.cls.take(w[at]))
        own = np.flatnonzero(w < len(u))
        own = own[np.argsort(self.cls[w[own]], kind="stable")]
        g = self.cls[w[own]]
        for rows in np.split(own, np.flatnonzero(np.diff(g)) + 1) if len(own) else []:
            k = self.cls[w[rows[0]]]
            lo, hi = self.first[k], self.first[k + 1]
            step = max(256, (1 << 19) // (hi - lo))
            for i in range(0, len(rows) if hi - lo > 1 else 0, step):
                o = rows[i : i + step]
                out[o] += log_softmax(q.take(o, 0), ua[:, lo:hi], w[o] - lo)
        return out / math.log(10)


def contexts(w: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The token before each one and the token before that; `end` before a text's start."""
    before = []
    for k in (1, 2):
        c = np.full(len(w), end, np.int32)
        c[k:] = w[: len(w) - k]
        for j in range(k):
            p = off[:-1] + j
            c[p[p < off[1:]]] = end
        before.append(c)
    return before[0], before[1]


def train(rows: DataFrame, start, end: int, n_tokens: int, shard_tokens: int) -> np.ndarray | None:
    """The token-weighted mean of the shards' models, None without tokens. rows: key, ids of all training texts; start: the broadcast first model."""
    n_shards = max(1, n_tokens // shard_tokens)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(n_shards))).repartitionByRange(n_shards, "part").sortWithinPartitions("part", "key")

    def run(batches):
        model, part, seen, held, waiting, rng = None, None, 0, [], 0, None

        def learn():
            off = np.concatenate([[0], np.cumsum([len(x) for x in held])])
            w = np.concatenate(held)
            c1, c2 = contexts(w, off, end)
            order, i = rng.permutation(len(w)), 0
            while i < len(order):  # a shard begins with small minibatches
                o = order[i : i + (BATCH // 4 if seen + i < RAMP else BATCH)]
                model.step(c1[o], c2[o], w[o], rng)
                i += len(o)
            return len(w)

        def done():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([float(seen)]), pa.array([squeeze(model.flat())], pa.binary())], names=["part", "weight", "v"])

        for batch in batches:
            for p, ids in zip(batch.column("part").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if p != part:
                    if part is not None:
                        seen += learn() if held else 0
                        yield done()
                    model, part, seen, held, waiting, rng = start.value(), p, 0, [], 0, np.random.default_rng(p)
                held.append(unsqueeze(ids, np.int32))
                waiting += len(held[-1])
                if waiting >= DRAW:
                    seen += learn()
                    held, waiting = [], 0
        if part is not None:
            seen += learn() if held else 0
            yield done()

    def mean(weights: list[float], models: list[np.ndarray]) -> np.ndarray:
        total = np.zeros(len(models[0]))
        for w, v in zip(weights, models, strict=True):
            total += w * v
        return (total / sum(weights)).astype(np.float32)

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        weights = group.column("weight").to_pylist()
        v = mean(weights, [unsqueeze(c, np.float32) for c in group.column("v").to_pylist()])
        return pa.table({"part": group.column("part")[:1], "weight": [sum(weights)], "v": pa.array([squeeze(v)], pa.binary())})

    schema = "part long, weight double, v binary"
    out = map_arrow(dealt.select("part", "ids"), run, schema)
    while n_shards > FAN_IN:
        n_shards = -(-n_shards // FAN_IN)
        out = out.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("part").applyInArrow(add, schema)
    got = sorted(out.collect(), key=lambda r: r.part)  # at most FAN_IN models
    return mean([r.weight for r in got], [unsqueeze(r.v, np.float32) for r in got]) if got else None


class Start:
    """Makes the model that every shard starts from."""

    def __init__(self, counts: np.ndarray, shape_mass: np.ndarray):
        self.counts, self.shape_mass = counts, shape_mass

    def __call__(self) -> Bilinear:
        return Bilinear(self.counts, self.shape_mass)


def score(df: DataFrame, held: Column, text: str = "text", doc: str = "doc_id", head: int = HEAD, shard_tokens: int = SHARD) -> DataFrame:
    """doc, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; rows not `held` are learned from.

    Null and empty texts are one END token; a null `held` counts as training; repeated rows stay and count as often;
    with nothing to learn from every token scores 0; an empty table gives no rows; other input columns, whatever their
    names, are not read.
    """
    spark = df.sparkSession
    small_batches(spark)
    src = df.select(F.col(text).cast("string").alias("t"), F.coalesce(held, F.lit(False)).alias("held"), F.col(doc).alias("doc"), F.xxhash64(F.col(doc), F.col(text)).alias("key"), F.monotonically_increasing_id().alias("rid"))
    counts, counted = stored(count_words(src.select("t", "held")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    leaves = min(v, max(256, math.ceil(v ** (2 / 3))))
    n_shapes = max(16, math.isqrt(leaves) // 2)
    level = F.floor(F.log2("c") * 16)
    least, taken = 0, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some hundred levels
        if taken >= leaves and taken + r["count"] > head:
            least = r.level + 1
            break
        taken += r["count"]
    top = counts.where(level >= least).toArrow()
    top = Head(top.column("h").to_numpy().astype(np.int64).view(np.uint64), top.column("c").to_numpy().astype(np.int64), top.column("shape").to_numpy().astype(np.int64), leaves)
    head_sent = spark.sparkContext.broadcast(top)
    whole = n + 0.1 * (v + 1)
    # What words that are no leaves weigh, by shape; each shape has room for one word that no training text has.
    shape_mass = np.full(n_shapes, 0.1)
    for r in counts.groupBy((F.col("shape") % n_shapes).alias("s")).agg((F.sum("c") + 0.1 * F.count(F.lit(1))).alias("m")).collect():
        shape_mass[r.s] += r.m
    np.subtract.at(shape_mass, top.shape[top.top] % n_shapes, top.c[top.top] + 0.1)
    shape_mass = np.maximum(shape_mass, 0.1)

    longs, ints = T.ArrayType(T.LongType(), False), T.ArrayType(T.IntegerType(), False)
    names = [("n_tokens", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("inside", T.DoubleType()), ("ids", T.BinaryType()), ("hs", longs), ("ns", ints)]
    schema = T.StructType([src.schema["rid"], src.schema["key"], src.schema["doc"], src.schema["held"], *(T.StructField(a, b) for a, b in names)])

    def encode(batches):
        """Token ids, sums of log10 counts of words in the head (base; inside: those that are no leaves), and the other words."""
        head = head_sent.value
        logs = np.log10(head.c + 0.1)
        of_shape = np.log10(shape_mass)
        for batch in batches:
            for s in slices(batch, 0, 2 << 20):
                word, off, h, shape = tokens(s.column(0))
                rows = off[:-1]
                # What is known of each distinct word, then of each token.
                at = head.find(h)
                known = at >= 0
                base = np.where(known, logs[at], 0.0) if len(logs) else np.zeros(len(h))
                leaf = np.where(known, head.leaf[at], -1) if len(logs) else np.full(len(h), -1, np.int32)
                other = leaf < 0
                inside = np.where(other, base - of_shape[shape % n_shapes], 0.0)[word]
                w = np.where(other, leaves + shape % n_shapes, leaf).astype(np.int32)[word]
                base, known, h = base[word], known[word], h[word]
                lost = np.flatnonzero(~known)
                doc = np.searchsorted(off, lost, "right") - 1
                o = np.lexsort((h[lost], doc))
                x, d = h[lost][o], doc[o]
                fresh = np.append(True, (x[1:] != x[:-1]) | (d[1:] != d[:-1])) if len(o) else np.zeros(0, bool)
                first = np.flatnonzero(fresh)
                many = np.diff(np.append(first, len(o)))
                to = pa.array(np.searchsorted(d[first], np.arange(len(off))), pa.int32())
                of = lambda values, kind: pa.ListArray.from_arrays(to, values, type=pa.list_(pa.field("element", kind, False)))
                total = lambda z: pa.array(np.add.reduceat(z, rows) if len(rows) else z)
                ids = pa.array([squeeze(w[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [s.column(4), s.column(3), s.column(2), s.column(1), pa.array(np.diff(off)), total(known.astype(np.int64)), total(base), total(inside), ids, of(pa.array(x[first].view(np.int64)), pa.int64()), of(pa.array(many, pa.int32()), pa.int32())],
                    names=schema.names,
                )

    rows, encoded = stored(map_arrow(src, encode, schema))
    end = int(top.leaf[top.find(np.array([END], np.uint64))[0]]) if n else 0
    end = end if end >= 0 else leaves
    start = spark.sparkContext.broadcast(Start(top.c[top.top] + 0.1, shape_mass))
    learned = train(rows.where("not held").select("key", "ids"), start, end, n, shard_tokens)
    model = Start(top.c[top.top] + 0.1, shape_mass)()
    if learned is not None:
        model.load(learned)
    model.g, model.guide, model.ends, model.place = [], None, None, None
    model_sent = spark.sparkContext.broadcast(model)

    judged = rows.select("rid", "doc", "held", "n_tokens", "known", "base", "inside", "ids")
    keep = judged.columns[:-1]
    with_lm = T.StructType([*(judged.schema[c] for c in keep), T.StructField("lm", T.DoubleType())])

    def judge(batches):
        for batch in batches:
            got = [unsqueeze(x, np.int32) for x in batch.column("ids").to_pylist()]
            off = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)
            out, at = np.zeros(len(got)), 0
            while at < len(got):  # about a million tokens at a time
                to = max(at + 1, int(np.searchsorted(off, off[at] + (1 << 20), "right")) - 1)
                w, o = np.concatenate(got[at:to]), off[at : to + 1] - off[at]
                out[at:to] = np.add.reduceat(model_sent.value.log10(*contexts(w, o, end), w), o[:-1])
                at = to
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out)], names=with_lm.names)

    rare = rows.select("rid", F.explode(F.arrays_zip("hs", "ns")).alias("x")).select("rid", F.col("x.hs").alias("h"), F.col("x.ns").alias("m"))
    rare = rare.join(counts.where(level < least).select("h", "c"), "h", "left")
    rare = rare.groupBy("rid").agg(F.sum(F.col("m") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1).cast("double"))).alias("s"), F.sum(F.when(F.col("c").isNotNull(), F.col("m")).otherwise(0)).alias("k"))
    out = map_arrow(judged, judge, with_lm).join(rare.withColumnRenamed("rid", "id"), F.col("rid") == F.col("id"), "left")
    s = F.coalesce("s", F.lit(0.0))
    out = out.select(
        F.col("doc").alias(doc),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + s - F.col("n_tokens") * math.log10(whole)).alias("base_score"),
        ((F.col("lm") + F.col("inside") + s) if n else F.lit(0.0)).alias("score"),
    )
    out = checkpoint(out)
    for path in (counted, encoded):
        remove(spark, path)
    return out
