"""Exact Jaccard self-join of word n-gram sets, as components of the link graph.

Texts with equal sets are one node. Shingles are ordered rare first by sketches of word and shingle frequencies over the
whole corpus: a shingle's count is at most its own cell's and those of its words (a fixed number of cells; any one
order gives the same links, a good one gives short posting lists). Nodes meet where
their prefixes share a shingle; length, positional and suffix filters come before the one verification of a pair. The
suffix filter bounds the Hamming distance of two sets from below by the parities of their hash partitions: first of 256
partitions inside the join, then of two to four partitions a shingle, so that texts travel for few pairs in vain.

A list of g copies is not g*g pairs: first, twice, each node is verified against a few neighbours in random orders of
its lists and components are drawn; then every pair that shares a prefix shingle, passes the filters and still lies in
two components is verified, so no link between components is lost. A pair meets in the first list both are in, and in a
later one only if their few lists before it have none in common; a pair that was verified is not verified again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsefield.llm.common import BROADCAST_BYTES, SPACES, checkpoint, map_arrow, mix, slices, small_batches, squeeze, trim, unsqueeze, word_hashes
from pulsefield.llm.components import connected_components

#: Cells of the word and shingle sketches, and cells in one of their rows.
WORD_CELLS, CELLS, ROW = 1 << 22, 1 << 21, 1 << 14
#: Sketches that one task adds up.
FAN_IN = 64
#: Neighbours a node is verified against in a sparse round.
NEIGHBOURS = 3
#: A posting knows so many of its node's lists before it.
BEFORE = 4
FACTS = ("node", "pos", "comp", "n", "s0", "s1", "s2", "s3")


def grams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all word n-grams (of the whole sequence if it is shorter), n+1 offsets, the words' hashes, and for each
    n-gram its first word's place and its text's end."""
    w, off = word_hashes(texts, SPACES)
    size = np.diff(off)
    per = np.where(size >= n, size - n + 1, size > 0)
    to = np.concatenate([[0], np.cumsum(per)])
    at = np.repeat(off[:-1] - to[:-1], per) + np.arange(to[-1])
    last = np.repeat(off[1:], per)
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        inside = at + k < last
        h += np.where(inside, mix(w[np.minimum(at + k, max(0, len(w) - 1))] + np.uint64(2 * k + 1)) if len(w) else 0, np.uint64(0)) * np.uint64(2 * k + 3)
    return mix(h), to, w, at, last


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    return grams(texts, n)[:2]


def cells(h: np.ndarray, n: int) -> np.ndarray:
    return (h & np.uint64(n - 1)).astype(np.int64)


def rarity(counts: np.ndarray, h: np.ndarray, w: np.ndarray, at: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """The least of the sketched counts of each n-gram and its words."""
    out = counts[WORD_CELLS + cells(h, CELLS)]
    of_word = counts[cells(w, WORD_CELLS)]
    for k in range(n):
        inside = np.flatnonzero(at + k < last)
        out[inside] = np.minimum(out[inside], of_word[at[inside] + k])
    return out


def in_order(h: np.ndarray, off: np.ndarray, code: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) by text, then code, then hash: their order, and text numbers, and n+1 offsets."""
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.uint16 if len(off) < 1 << 16 else np.uint32), np.diff(off))
    o = np.argsort(h, kind="stable")
    if code is not None:
        o = o[np.argsort(code[o], kind="stable")]
    o = o[np.argsort(doc[o], kind="stable")]
    d, x = doc[o], h[o]
    fresh = np.ones(len(o), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    o, d = o[fresh], d[fresh]
    return o, d, np.searchsorted(d, np.arange(len(off)))


def sketch(df: DataFrame, n: int, text: str) -> np.ndarray:
    """Occurrences of words and then of shingles by hash cell over the whole corpus; sums go up a tree of tasks."""
    src = df.select(F.col(text).cast("string").alias("t"))
    schema = "row int, part bigint, cells binary"

    def count(batches):
        total = np.zeros(WORD_CELLS + CELLS, np.uint32)
        for batch in batches:
            for s in slices(batch, 0):
                h, _, w, _, _ = grams(s.column(0), n)
                np.add.at(total, np.concatenate([cells(w, WORD_CELLS), WORD_CELLS + cells(h, CELLS)]), np.uint32(1))
        if total.any():
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            for at in range(0, len(total) // ROW, 16):
                rows = range(at, min(at + 16, len(total) // ROW))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([part] * len(rows), pa.int64()), pa.array([squeeze(total[i * ROW : (i + 1) * ROW]) for i in rows], pa.binary())], names=["row", "part", "cells"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(ROW, np.uint64)
        for c in group.column("cells"):
            total += unsqueeze(c.as_py(), np.uint32)
        capped = squeeze(np.minimum(total, (1 << 32) - 1).astype(np.uint32))
        return pa.table({"row": group.column("row")[:1], "part": group.column("part")[:1], "cells": pa.array([capped], pa.binary())})

    out = map_arrow(src, count, schema)
    parts = src.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN_IN)
        out = out.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("row", "part").applyInArrow(add, schema)
    total = np.zeros(WORD_CELLS + CELLS, np.uint32)
    for r in out.collect():
        total[r.row * ROW : (r.row + 1) * ROW] += unsqueeze(r.cells, np.uint32)
    return total


def node_rows(df: DataFrame, n: int, num: int, den: int, text: str, doc: str) -> DataFrame:
    """doc, n, th, node and twin (two hashes of the set) of every row, with the set's parities s0..s3 (of 256 hash partitions) and sig (of 2n to 4n, a
    power of two), and its prefix, rarest first. A task gives the prefix of equal sets once; the others' are empty."""
    counts = sketch(df, n, text)
    codes = np.empty(len(counts), np.uint16)
    for k in range(0, len(codes), ROW):  # a piece at a time, as the driver's memory is small
        codes[k : k + ROW] = 256 * np.log2(1.0 + counts[k : k + ROW])
    del counts
    trim()
    sent = df.sparkSession.sparkContext.broadcast(codes)
    src = df.select(F.col(doc).alias("doc"), F.xxhash64(text).alias("th"), F.col(text).cast("string").alias("t"))
    longs = T.ArrayType(T.LongType(), False)
    schema = T.StructType([src.schema["doc"], src.schema["th"], T.StructField("n", T.LongType()), T.StructField("node", T.LongType()), T.StructField("twin", T.LongType()), *(T.StructField(f"s{k}", T.LongType()) for k in range(4)), T.StructField("sig", T.BinaryType()), T.StructField("prefix", longs)])

    def total(v, at):
        up = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(v, out=up[1:])
        return up[at[1:]] - up[at[:-1]]

    def run(batches):
        codes, seen = sent.value, set()
        for batch in batches:
            for s in slices(batch, 2):
                h, off, w, first, last = grams(s.column(2), n)
                o, d, at = in_order(h, off, rarity(codes, h, w, first, last, n))
                x, size = h[o], np.diff(at)
                node, twin = (mix(total(mix(x ^ np.uint64(salt)), at) + size.astype(np.uint64)) for salt in (0x5851F42D4C957F2D, 0x9FB21C651E98DF25))
                odd = np.bincount(d.astype(np.int64) * 256 + (x >> np.uint64(56)).astype(np.int64), minlength=256 * len(size)) & 1
                sig = np.packbits(odd.astype(np.uint8).reshape(-1, 256), axis=1).view(np.int64).reshape(-1, 4)
                width = 1 << np.ceil(np.log2(np.maximum(64, 2 * size))).astype(np.int64)
                base = np.concatenate([[0], np.cumsum(width)])
                cell = (mix(x ^ np.uint64(0x2545F4914F6CDD1D)) & (width[d] - 1).astype(np.uint64)).astype(np.int64)
                fine = np.packbits((np.bincount(base[d] + cell, minlength=base[-1]) & 1).astype(np.uint8))
                fine = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((base // 8).astype(np.int32)), pa.py_buffer(fine)])
                first = np.array([not (k in seen or seen.add(k)) for k in zip(node.tolist(), twin.tolist(), strict=True)], bool)
                take = np.where((size > 0) & first, size - -(-num * size // den) + 1, 0)
                to = np.concatenate([[0], np.cumsum(take)])
                pick = np.repeat(at[:-1] - to[:-1], take) + np.arange(to[-1])
                prefix = pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(x[pick].view(np.int64)), type=pa.list_(pa.field("element", pa.int64(), False)))
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(size, pa.int64()), pa.array(node.view(np.int64)), pa.array(twin.view(np.int64)), *(pa.array(sig[:, k].copy()) for k in range(4)), fine, prefix], names=schema.names)

    return map_arrow(src, run, schema)


def far_apart(pairs: DataFrame, attrs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs a, b that the parities of many hash partitions don't show to be too far apart."""
    left, right = (attrs.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}")) for k in "ab")
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches):
        for batch in batches:
            m, n = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            width = np.stack([pc.binary_length(batch.column(k)).to_numpy().astype(np.int64) for k in (4, 5)])
            low = width.min(0)
            ok = np.zeros(len(m), bool)
            for size in np.unique(low):
                rows = np.flatnonzero(low == size)
                bits = np.zeros((len(rows), size), np.uint8)
                for k in (0, 1):
                    for w in np.unique(width[k, rows]):  # parities of fewer partitions are those of more, added up
                        some = np.flatnonzero(width[k, rows] == w)
                        raw = b"".join(batch.column(4 + k).take(pa.array(rows[some])).to_pylist())
                        bits[some] ^= np.bitwise_xor.reduce(np.frombuffer(raw, np.uint8).reshape(len(some), -1, size), axis=1)
                least = -(-num * (m[rows] + n[rows]) // (num + den))
                ok[rows] = np.bitwise_count(bits).sum(1, dtype=np.int64) <= m[rows] + n[rows] - 2 * least
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return map_arrow(both, run, pairs.select("a", "b").schema)


def verified(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs a, b whose texts' sets reach the similarity; texts: node, t."""
    left, right = (texts.select(F.col("node").alias(k), F.col("t").alias(f"t{k}")) for k in "ab")
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            for s in slices(batch, 2):
                ha, oa = shingles(s.column(2), n)
                hb, ob = shingles(s.column(3), n)
                ka, da, fa = in_order(ha, oa)
                kb, db, fb = in_order(hb, ob)
                x, d = np.concatenate([ha[ka], hb[kb]]), np.concatenate([da, db])
                o = np.argsort(x, kind="stable")
                o = o[np.argsort(d[o], kind="stable")]
                x, d = x[o], d[o]
                twice = (x[1:] == x[:-1]) & (d[1:] == d[:-1])
                shared = np.bincount(d[1:][twice], minlength=len(s))
                link = den * shared >= num * (np.diff(fa) + np.diff(fb) - shared)
                yield s.select(["a", "b"]).filter(pa.array(link))

    return map_arrow(both, run, pairs.select("a", "b").schema)


def link_components(df: DataFrame, n: int = 3, num: int = 90, den: int = 100, text: str = "text", doc: str = "doc_id", broadcast_bytes: int = BROADCAST_BYTES, hashed: bool = False) -> DataFrame:
    """doc, n_shingles, component_id (the smallest doc linked with it over any number of links) and n_copies (rows of
    the same set) of every row.

    Sets link when den * |intersection| >= num * |union|. Null and empty texts have the empty set, link with nothing and
    are their own component; rows of equal sets share a component; a null doc is the component only where it has no
    other; an empty table gives no rows; other input columns, whatever their names, are not read.
    """
    small_batches(df.sparkSession)
    rows = checkpoint(node_rows(df, n, num, den, text, doc))
    some = rows.where("n > 0")
    clash = checkpoint(some.groupBy("node").agg(F.min("twin").alias("lo"), F.max("twin").alias("hi")).where("lo <> hi").select(F.col("node").alias("clash")))
    if clash.limit(1).count():  # unequal sets under one hash go by their other one
        apart = lambda t: t.join(clash, F.col("node") == F.col("clash"), "left").withColumn("node", F.when(F.col("clash").isNull(), F.col("node")).otherwise(F.col("twin"))).drop("clash")
        rows, some = apart(rows), apart(some)
    reps = checkpoint(some.groupBy("node").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies")))
    lists = some.select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "h"))
    alone = Window.partitionBy("h")
    by_size = alone.orderBy("n", "node")
    lists = lists.withColumns({"lo": F.min("node").over(alone), "hi": F.max("node").over(alone), "less": F.lag("n").over(by_size), "more": F.lead("n").over(by_size)})
    # A list's node without one of a size near its own has no partner there.
    lists = lists.where(f"lo <> hi and ({den} * less >= {num} * n or {den} * n >= {num} * more)")
    lists = checkpoint(lists.select("h", "node", "pos").distinct())
    facts = some.select("node", "doc", "th", "n", "s0", "s1", "s2", "s3", "sig").join(lists.select(F.col("node").alias("id")).distinct(), F.col("node") == F.col("id")).drop("id")
    facts = facts.join(reps.select(F.col("node").alias("id"), "rep"), (F.col("node") == F.col("id")) & F.col("doc").eqNullSafe(F.col("rep"))).drop("id", "rep")
    attrs = checkpoint(facts.dropDuplicates(["node"]))
    need = "({num} * (an + bn) + {both} - 1) div {both}".format(num=num, both=num + den)
    fits = " and ".join(
        [
            f"{den} * least(an, bn) >= {num} * greatest(an, bn)",
            f"least(apos, bpos) + least(an - apos, bn - bpos) >= {need}",
            f"{' + '.join(f'bit_count(as{k} ^ bs{k})' for k in range(4))} <= an + bn - 2 * ({need})",
        ]
    )

    tried = None

    def check(pairs: DataFrame) -> DataFrame:
        nonlocal tried
        pairs = checkpoint(pairs)
        tried = pairs if tried is None else tried.union(pairs)
        ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        want = attrs.select("node", "doc", "th").join(ids, "node")
        want = checkpoint(want)
        hint = F.broadcast if want.count() * 64 <= broadcast_bytes else (lambda x: x)
        src = df.select(F.col(doc).alias("d"), F.xxhash64(text).alias("h"), F.col(text).cast("string").alias("t"))
        texts = src.join(hint(want), (F.col("h") == F.col("th")) & F.col("d").eqNullSafe(F.col("doc"))).select("node", "t")
        return checkpoint(verified(pairs, texts, n, num, den), rows=64)  # two texts a row

    def met_pairs(met: DataFrame) -> DataFrame:
        """The pairs that met and have not been verified yet."""
        new = met.select(F.least("anode", "bnode").alias("a"), F.greatest("anode", "bnode").alias("b")).distinct()
        return new if tried is None else new.join(tried, ["a", "b"], "left_anti")

    def side(t: DataFrame, name: str) -> DataFrame:
        return t.select("h", *[F.col(c).alias(name + c) for c in FACTS], F.col("before").alias(name + "before"))

    def open_lists(comp: DataFrame | None) -> DataFrame:
        """Postings with their node's facts, of lists that touch more than one component."""
        facts = attrs.drop("doc", "th", "sig")
        facts = facts.withColumn("comp", F.col("node")) if comp is None else facts.join(comp, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
        full = lists.join(facts, "node")
        if comp is None:
            return full
        mixed = full.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h")
        return full.join(mixed, "h")

    links, comp = None, None
    for turn in range(2):
        full = open_lists(comp)
        row = F.struct(*[F.col(c) for c in FACTS])
        near = []
        for lag, keys in ((1, (F.col("n"), F.xxhash64("node", "h", F.lit(turn)))), (2, (F.col("n"), F.xxhash64("node", "h", F.lit(turn)))), (1, (F.xxhash64("node", "h", F.lit(turn + 7)),))):
            near.append(F.lag(row, lag).over(Window.partitionBy("h").orderBy(*keys)))
        met = full.withColumn("near", F.array_compact(F.array(*near))).select(*[F.col(c).alias("a" + c) for c in FACTS], F.explode("near").alias("o"))
        met = met.select("*", *[F.col(f"o.{c}").alias("b" + c) for c in FACTS]).where("acomp <> bcomp").where(fits)
        few = Window.partitionBy("a").orderBy(F.xxhash64("a", "b", F.lit(turn)))
        some_of = lambda p, most: p.withColumn("nth", F.row_number().over(few)).where(F.col("nth") <= most).drop("nth")  # noqa: B023, E731
        pairs = some_of(far_apart(some_of(met_pairs(met), 2 * NEIGHBOURS), attrs, num, den), NEIGHBOURS)
        found = check(pairs)
        links = found if links is None else links.union(found)
        comp = checkpoint(connected_components(links))
    # A pair of long sets shares many lists; it leaves those where both stood together a few places before.
    order = Window.partitionBy("node").orderBy("pos", "h")
    full = checkpoint(open_lists(comp).withColumn("before", F.array_compact(F.array(*[F.lag("h", k).over(order) for k in range(1, BEFORE + 1)]))))
    sizes = full.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("many")).groupBy("h").agg(F.max(F.struct("many", "comp")).alias("top")).select("h", F.col("top.comp").alias("top"))
    minor = side(full.join(sizes, "h").where("comp <> top"), "a")
    left = minor.join(side(full, "b"), "h").where("acomp <> bcomp").where(fits).where("not arrays_overlap(abefore, bbefore)")
    found = check(far_apart(met_pairs(left), attrs, num, den))
    comp = checkpoint(connected_components(links.union(found)))
    of = reps.join(comp, "node", "left").select("node", "rep", "copies", F.coalesce("root", "node").alias("root"))
    lowest = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = of.join(lowest, "root").select(F.col("node").alias("id"), "component_id", "copies", "root")
    out = rows.select("doc", "th", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(of, F.col("node") == F.col("id"), "left")
    return out.select(F.col("doc").alias(doc), F.col("n").alias("n_shingles"), F.when(F.col("id").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"), *(["root", "th"] if hashed else []))
