"""Removal of repeated byte strings with a sparse suffix array.

Suffixes are sampled where a hash of the next GRAM bytes is least among `length - GRAM + 1` neighbours, so two equal
strings of `length` bytes hold equal sampled suffixes at equal places. Suffixes whose GRAM bytes occur once are dropped;
each remaining group, with its bytes to the left and right, is put in suffix order by deep-shallow sorting: multikey
quicksort down to a shallow depth, then blind tries for what still shares a prefix. Neighbours' common prefixes build
up intervals from the longest down; as two intervals meet, each suffix of the smaller looks at its neighbours in the
other by left context, which finds for every suffix how far some match reaches to each side.

Suffixes with equal bytes all around (by hash) need no sorting: what is around them repeats as a whole, and one of them
stands for all in its group; so a group grows with its different surroundings, not with its copies. A group of more than
HOT of these is not sorted in one task: the 128-bit digests of all its windows are counted instead, with partial sums,
which gives the same bytes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsefield.llm.common import BROADCAST_BYTES, checkpoint, map_arrow, mix, pack, prefix_hash, remove, slices, small_batches, span_hash, stored

LENGTH, GRAM = 400, 144
#: Bytes that multikey quicksort looks at beyond the common GRAM bytes, eight at a time.
SHALLOW = 16
HOT = 20_000
#: Tables beside the texts are broadcast up to this size only; texts of more than a few MB are shuffled at every size alike, so
#: that the shuffle grows in proportion to the input.
BESIDE_TEXTS = 2 << 20


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions, their gram hashes and the prefix hash of texts on end."""
    n, w = len(data), length - gram + 1
    prefix = prefix_hash(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), prefix
    at = np.arange(n - gram + 1)
    h = span_hash(prefix, at, at + gram)
    bits = np.uint64(n.bit_length())
    key = (h >> bits) << bits | at.astype(np.uint64)
    m = len(key)
    rows = -(-m // w)
    grid = np.full(rows * w, np.uint64(2**64 - 1))
    grid[:m] = key
    grid = grid.reshape(rows, w)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.arange(n - length + 1)
    ends = np.repeat(off[1:], np.diff(off))
    start = start[start + length <= ends[: len(start)]]
    least = np.minimum(tail[start], head[start + w - 1])
    pos = np.unique((least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))
    return pos, h[pos], prefix


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class Trie:
    """A blind trie: inner nodes know a depth, only leaves know strings."""

    def __init__(self, first: bytes):
        self.root: list | bytes = first

    @staticmethod
    def letter(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def add(self, s: bytes) -> None:
        node = self.root
        while isinstance(node, list):  # blind: any child will do where the letter is missing
            kids = node[1]
            node = kids.get(self.letter(s, node[0])) or next(iter(kids.values()))
        depth = common(s, node)
        if depth == len(s) == len(node):
            return
        known, up, node = node, None, self.root
        while isinstance(node, list) and node[0] < depth:
            up, node = node, node[1][self.letter(s, node[0])]
        if isinstance(node, list) and node[0] == depth:
            node[1][self.letter(s, depth)] = s
            return
        new = [depth, {self.letter(known, depth): node, self.letter(s, depth): s}]
        if up is None:
            self.root = new
        else:
            up[1][self.letter(s, up[0])] = new

    def in_order(self) -> list[bytes]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out.append(node)
        return out


def deep_shallow(strings: list[bytes], depth: int, shallow: int = SHALLOW) -> list[bytes]:
    """Distinct strings that share their first `depth` bytes, in order."""
    stop, out, stack = depth + shallow, [], [(strings, depth)]
    while stack:
        part, d = stack.pop()
        if len(part) <= 1:
            out += part
        elif d >= stop or len(part) == 2:
            trie = Trie(part[0])
            for s in part[1:]:
                trie.add(s)
            out += trie.in_order()
        else:
            pivot = part[len(part) // 2][d : d + 8]
            less, same, more, done = [], [], [], []
            for s in part:
                x = s[d : d + 8]
                (less if x < pivot else more if x > pivot else same if len(s) >= d + 8 else done).append(s)
            stack += [(more, d), (same, d + 8), (done, stop), (less, d)]
    return out


def reach(lefts: list[bytes], rights: list[bytes], length: int, gram: int) -> list[tuple[int, int]]:
    """How far repeated strings of `length` bytes reach to the left and right of each suffix, (0, 0) if none do.

    lefts are reversed; all rights share `gram` bytes. No two suffixes are compared unless they are neighbours.
    """
    m = len(lefts)
    far = [(0, 0)] * m
    by_left = sorted(range(m), key=lefts.__getitem__)
    rank = [0] * m
    for r, i in enumerate(by_left):
        rank[i] = r

    def meet(i: int, j: int, right: int) -> None:
        left = common(lefts[i], lefts[j])
        if left + right >= length:
            for x in (i, j):
                a, b = far[x]
                far[x] = (max(a, left), max(b, right))

    members: dict[bytes, list[int]] = {}
    for i, s in enumerate(rights):
        members.setdefault(s, []).append(i)
    order = deep_shallow(list(members), gram)
    sets = []
    for s in order:
        ranks = sorted(rank[i] for i in members[s])
        for a, b in zip(ranks, ranks[1:]):
            meet(by_left[a], by_left[b], len(s))
        sets.append(ranks)
    home = list(range(len(order)))

    def find(x: int) -> int:
        while home[x] != x:
            home[x] = home[home[x]]
            x = home[x]
        return x

    joins = sorted(((common(order[k], order[k + 1]), k) for k in range(len(order) - 1)), key=lambda t: -t[0])
    for right, k in joins:
        a, b = find(k), find(k + 1)
        small, large = (a, b) if len(sets[a]) <= len(sets[b]) else (b, a)
        to = sets[large]
        for r in sets[small]:
            p = bisect_left(to, r)
            if p:
                meet(by_left[r], by_left[to[p - 1]], right)
            if p < len(to):
                meet(by_left[r], by_left[to[p]], right)
        if len(sets[small]) > 32:
            to = sorted(to + sets[small])
        else:
            for r in sets[small]:
                insort(to, r)
        sets[large], sets[small] = to, []
        home[small] = large
    return far


def sampled(df: DataFrame, length: int, gram: int) -> DataFrame:
    """h, a, pos, ctx, lo, size: sampled suffixes with a hash of the bytes around them, which start at lo and are `size`
    long; and stretches that a text repeats in itself (h and ctx 0). df: a, t."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for s in slices(batch, 1):
                keys = s.column(0).to_numpy(zero_copy_only=False)
                fresh = np.zeros(len(keys), bool)
                for i, k in enumerate(keys.tolist()):
                    if k not in seen:
                        seen.add(k)
                        fresh[i] = True
                s = s.filter(pa.array(fresh))
                keys = keys[fresh]
                data, off = pack(s.column(1))
                pos, h, prefix = anchors(data, off, length, gram)
                doc = np.searchsorted(off, pos, "right") - 1
                lo, hi = pos - (length - gram), pos + length
                full = (lo >= off[doc]) & (hi <= off[doc + 1])
                # A text's equal whole contexts (runs, periods) are settled here; one of them stands for all.
                start, end = np.maximum(lo, off[doc]), np.minimum(hi, off[doc + 1])
                around = mix(span_hash(prefix, start, end) + (pos - start).astype(np.uint64))
                order = np.flatnonzero(full)
                _, first, back, many = np.unique(around[order] + doc[order].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True, return_inverse=True, return_counts=True)
                again = many[back] > 1
                keep = np.ones(len(pos), bool)
                keep[order] = False
                keep[order[first]] = True
                own = order[again]
                a, b = [], []
                for x, y, d in zip(lo[own].tolist(), hi[own].tolist(), doc[own].tolist(), strict=True):
                    if b and x <= b[-1][0] and b[-1][1] == d:
                        b[-1] = (y, d)
                    else:
                        a.append(x)
                        b.append((y, d))
                where = np.array([d for _, d in b], np.int64)
                runs, ends = np.array(a, np.int64), np.array([e for e, _ in b], np.int64)
                none, at = np.zeros(len(a), np.int64), off[doc]
                cols = [(h[keep].view(np.int64), none), (keys[doc[keep]], keys[where]), ((pos - at)[keep], runs - off[where]), (around[keep].view(np.int64), none), ((start - at)[keep], runs - off[where]), ((end - start)[keep], ends - runs)]
                kinds = (np.int64, np.int64, np.int32, np.int64, np.int32, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k)) for c, k in zip(cols, kinds, strict=True)], names=["h", "a", "pos", "ctx", "lo", "size"])

    return map_arrow(df.select("a", "t").where(F.octet_length("t") >= length), run, "h long, a long, pos int, ctx long, lo int, size int")


def contexts(found: DataFrame, docs: DataFrame, length: int, gram: int, broadcast_bytes: int) -> DataFrame:
    """h, a, pos, left (reversed) and right bytes of the suffixes found: h, a, pos."""
    per_text = checkpoint(found.groupBy("a").agg(F.collect_list("h").alias("hs"), F.collect_list("pos").alias("ps")).withColumnRenamed("a", "of"))
    size = per_text.agg(F.coalesce(F.sum(24 * F.size("hs") + 128), F.lit(0))).first()[0]
    reps = docs.groupBy("a").agg(F.min("doc").alias("rep")) if size > min(broadcast_bytes, BESIDE_TEXTS) else None
    if reps is None:
        rows = docs.join(F.broadcast(per_text), F.col("a") == F.col("of"))
    else:
        per_text = per_text.join(reps, F.col("of") == F.col("a")).drop("a")
        rows = docs.join(per_text, (F.col("a") == F.col("of")) & F.col("doc").eqNullSafe(F.col("rep")))
    rows = rows.select("a", "t", "hs", "ps")

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for s in slices(batch, 1):
                out: list[list] = [[], [], [], [], []]
                for a, t, hs, ps in zip(*(c.to_pylist() for c in s.columns), strict=True):
                    if a in seen:
                        continue
                    seen.add(a)
                    raw = t.encode()
                    for h, p in zip(hs, ps, strict=True):
                        for col, v in zip(out, (h, a, p, raw[max(0, p - (length - gram)) : p][::-1], raw[p : p + length]), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["h", "a", "pos", "left", "right"])

    return map_arrow(rows, run, "h long, a long, pos int, left binary, right binary")


SPAN = "a long, pos int, size int"


def spans_of(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    a, p, n = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(p, pa.int32()), pa.array(n, pa.int32())], names=["a", "pos", "size"])


def sorted_spans(ctx: DataFrame, length: int, gram: int) -> DataFrame:
    """Repeated stretches around each suffix, group by group in suffix order."""

    def solve(group: dict[str, list]) -> list[tuple[int, int, int]]:
        one = {(a, p): (x, y) for a, p, x, y in zip(group["a"], group["pos"], group["left"], group["right"], strict=True)}
        ids = list(one)
        if len(ids) < 2:
            return []
        far = reach([one[i][0] for i in ids], [one[i][1] for i in ids], length, gram)
        return [(a, p - left, left + right) for (a, p), (left, right) in zip(ids, far, strict=True) if right]

    def run(batches):
        names = ("a", "pos", "left", "right")
        open_h, group, out = None, None, []
        for batch in batches:
            cols = batch.to_pydict()
            hs = cols["h"]
            i = 0
            while i < len(hs):
                j = i
                while j < len(hs) and hs[j] == hs[i]:
                    j += 1
                if hs[i] != open_h:
                    if group:
                        out += solve(group)
                    open_h, group = hs[i], {n: [] for n in names}
                for n in names:
                    group[n] += cols[n][i:j]
                i = j
            if len(out) > 10_000:
                yield spans_of(out)
                out = []
        if group:
            out += solve(group)
        yield spans_of(out)

    return map_arrow(ctx.repartition("h").sortWithinPartitions("h"), run, SPAN)


def counted_spans(ctx: DataFrame, length: int, gram: int, broadcast_bytes: int) -> DataFrame:
    """The same stretches for groups of any size: a window is repeated if its hash stands at two places."""

    def emit(batches):
        for batch in batches:
            for s in slices(batch, 4, 1 << 18):
                w, a, p, at = [], [], [], []
                for x, q, left, right in zip(*(s.column(c).to_pylist() for c in ("a", "pos", "left", "right")), strict=True):
                    raw = left[::-1] + right
                    n = min(len(left), len(raw) - length) + 1
                    w += [xxhash.xxh3_128_digest(raw[i : i + length]) for i in range(n)]
                    a += [x] * n
                    p += [q] * n
                    at += range(-len(left), n - len(left))
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(a, pa.int64()), pa.array(p, pa.int32()), pa.array(at, pa.int32())], names=["w", "a", "pos", "at"])

    each = map_arrow(ctx, emit, "w binary, a long, pos int, at int").withColumn("place", F.col("pos") + F.col("at"))
    place = F.xxhash64("a", "place")
    twice = each.groupBy("w").agg(F.min(place).alias("p0"), F.max(place).alias("p1")).where("p0 <> p1").select("w")
    twice = checkpoint(twice)
    hint = F.broadcast if twice.count() * 32 <= broadcast_bytes else (lambda x: x)
    hit = each.join(hint(twice), "w")
    return hit.groupBy("a", "pos").agg(F.min("place").alias("lo"), (F.max("place") + length).alias("hi")).select("a", F.col("lo").alias("pos"), (F.col("hi") - F.col("lo")).cast("int").alias("size"))


def drop_repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, text: str = "text", doc: str = "doc_id", texts: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc, n_bytes, n_removed, n_spans, kept_sha256 of every row, and the kept bytes if asked.

    Bytes under any string of `length` bytes that also starts elsewhere in the column go. Null and empty texts have 0
    bytes and the digest of nothing; a repeated row repeats all its text; matches never cross texts; an empty table gives
    no rows; other input columns, whatever their names, are not read.
    """
    small_batches(df.sparkSession)
    t = F.col(text).cast("string")
    docs = df.select(F.col(doc).alias("doc"), F.xxhash64(t).alias("a"), F.xxhash64(F.lit(3), t).alias("b"), t.alias("t"))
    names = docs.where(F.octet_length("t") >= length).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b0"), F.max("b").alias("b1"))
    names = checkpoint(names.where("n > 1").select("a", F.expr("b0 <> b1").alias("clash")))
    if names.where("clash").limit(1).count():  # unequal texts under one hash go by their other one
        docs = docs.join(names.where("clash").select(F.col("a").alias("c")), F.col("a") == F.col("c"), "left").withColumn("a", F.when(F.col("c").isNull(), F.col("a")).otherwise(F.col("b"))).drop("c")
        names = checkpoint(docs.where(F.octet_length("t") >= length).groupBy("a").count().where("count > 1").select("a"))
    copies = names.select(F.col("a").alias("ca"), F.lit(True).alias("copied"))
    every, path = stored(sampled(docs, length, gram))
    suffixes = every.where("ctx <> 0 or h <> 0")
    place = F.xxhash64("a", "pos")
    again = checkpoint(suffixes.groupBy("h").agg(F.min(place).alias("p0"), F.max(place).alias("p1")).where("p0 <> p1").select("h"))
    hint = F.broadcast if again.count() * 16 <= broadcast_bytes else (lambda x: x)
    found = checkpoint(suffixes.join(hint(again), "h"))
    around = checkpoint(found.groupBy("h", "ctx").agg(F.min(F.struct("a", "pos")).alias("one"), F.max(F.struct("a", "pos")).alias("other")))
    # Suffixes whose surroundings another has too repeat them whole; the rest are sorted with one of each surroundings.
    twice = around.where("one <> other").select("h", "ctx")
    hint = F.broadcast if twice.count() * 24 <= broadcast_bytes else (lambda x: x)
    whole = found.join(hint(twice), ["h", "ctx"])
    groups = checkpoint(around.groupBy("h").agg(F.count(F.lit(1)).alias("g"), F.max(F.expr("one = other")).alias("alone")).where("g > 1 and alone").drop("alone"))
    hint = F.broadcast if groups.count() * 24 <= broadcast_bytes else (lambda x: x)
    reps = checkpoint(around.join(hint(groups), "h").select("h", "one.a", "one.pos", "g"))
    cold = contexts(reps.where(f"g <= {hot}"), docs, length, gram, broadcast_bytes)
    spans = every.where("ctx = 0 and h = 0").union(whole.select(*every.columns)).select("a", F.col("lo").alias("pos"), "size").union(sorted_spans(cold, length, gram))
    many = reps.where(f"g > {hot}")
    if many.limit(1).count():
        spans = spans.union(counted_spans(contexts(many, docs, length, gram, broadcast_bytes), length, gram, broadcast_bytes))
    gone = checkpoint(spans.groupBy("a").agg(F.collect_set(F.struct("pos", "size")).alias("s")).withColumnRenamed("a", "of"))
    size = gone.agg(F.coalesce(F.sum(48 * F.size("s") + 128), F.lit(0))).first()[0]
    remove(df.sparkSession, path)
    hint = F.broadcast if size <= min(broadcast_bytes, BESIDE_TEXTS) else (lambda x: x.hint("shuffle_merge"))
    hint2 = F.broadcast if copies.count() * 32 <= broadcast_bytes else (lambda x: x)
    rows = docs.join(hint2(copies), F.col("a") == F.col("ca"), "left")
    # Copies and short texts need no spans: keys of their own keep them from meeting in one task.
    own = F.col("copied").isNotNull() | F.coalesce(F.octet_length("t") < length, F.lit(True))
    rows = rows.withColumn("key", F.when(own, F.xxhash64(F.lit(5), "doc")).otherwise(F.col("a")))
    rows = rows.join(hint(gone), (F.col("key") == F.col("of")) & (F.col("a") == F.col("of")), "left")
    rows = rows.select(F.col("doc").alias(doc), "t", F.coalesce("copied", F.lit(False)).alias("copied"), F.col("s.pos").alias("ps"), F.col("s.size").alias("ns"))
    fields = [rows.schema[doc], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType(fields + [T.StructField("kept", T.BinaryType())] * texts)

    def cut(batches):
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                out = []
                for t, copied, ps, ns in zip(*(part.column(k).to_pylist() for k in range(1, 5)), strict=True):
                    raw = (t or "").encode()
                    if copied:
                        merged = [[0, len(raw)]]
                    else:
                        merged = []
                        for p, n in sorted(zip(ps or (), ns or (), strict=True)):
                            if merged and p <= merged[-1][1]:
                                merged[-1][1] = max(merged[-1][1], p + n)
                            else:
                                merged.append([p, p + n])
                    edges = [0, *(e for m in merged for e in m), len(raw)]
                    kept = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                    out.append((len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
                cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols[: len(schema) - 1]], names=schema.names)

    return map_arrow(rows, cut, schema)
