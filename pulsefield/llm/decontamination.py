"""Benchmark decontamination over a distributed positional inverted index.

The index is a stored table. Each row is a shard: some documents, the dictionary of their distinct words, and for every
word its postings, the places where it stands. A benchmark window starts from its rarest term in the shard, shifts that
posting list by the term's offset and intersects it with the other terms' lists from rare to common; what is left are
exact phrase occurrences. Proximity matches need three terms within `slop` words of their places: the window's rarest of
those that occur in the table, by the dictionaries' counts over all shards, so a match doesn't depend on what shares a
shard. Words are compared as bytes. Shards are cut by documents and never exchange postings, so the index is built and
searched without a shuffle; the benchmark goes to the shards in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulsefield.llm.common import checkpoint, coded_words, map_arrow, remove, slices, small_batches, squeeze, stored, unsqueeze

#: Bytes of benchmark text in one block, and of document text in one shard (a longer text is a shard of its own).
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 1 << 20
WINDOW = 10
#: Terms of a proximity match.
RAREST = 3

#: The bytes outside [0-9A-Za-z\x80-\xFF] stand between words.
APART = np.ones(256, bool)
APART[0x30:0x3A] = APART[0x41:0x5B] = APART[0x61:0x7B] = APART[0x80:] = False


class Shard:
    """Word offsets of a shard's documents, its dictionary and the postings of each of its words."""

    def __init__(self, off: np.ndarray, terms: pa.Array, count: np.ndarray, postings: np.ndarray):
        self.off, self.terms, self.count, self.postings = off, terms, count, postings

    @staticmethod
    def of(texts: pa.Array) -> Shard:
        codes, off, terms = coded_words(texts, APART)
        return Shard(off, terms, np.bincount(codes, minlength=len(terms)), np.argsort(codes, kind="stable"))

    def write(self) -> list[bytes]:
        """The columns off, letters, sizes, counts and postings."""
        sizes = pc.binary_length(self.terms).to_numpy(zero_copy_only=False).astype(np.int32)
        letters = np.frombuffer(b"".join(self.terms.to_pylist()), np.uint8)
        gaps = np.diff(self.postings, prepend=0)
        return [squeeze(x) for x in (self.off.astype(np.int32), letters, sizes, self.count.astype(np.int32), gaps.astype(np.int32))]

    @staticmethod
    def dictionary(letters: bytes, sizes: bytes) -> pa.Array:
        bounds = np.concatenate([[0], np.cumsum(unsqueeze(sizes, np.int32), dtype=np.int64)])
        return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(unsqueeze(letters, np.uint8))])

    @staticmethod
    def read(off: bytes, letters: bytes, sizes: bytes, counts: bytes, postings: bytes) -> Shard:
        return Shard(unsqueeze(off, np.int32).astype(np.int64), Shard.dictionary(letters, sizes), unsqueeze(counts, np.int32).astype(np.int64), np.cumsum(unsqueeze(postings, np.int32), dtype=np.int64))


class Block:
    """Windows of benchmark items as terms of a vocabulary."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW):
        terms, off, self.vocab = coded_words(pa.array(texts, pa.string()), APART)
        self.ids, self.window = ids, window
        size = np.diff(off)
        per = np.where(size >= window, size - window + 1, size > 0)
        self.item = np.repeat(np.arange(len(ids)), per)
        nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        start = off[:-1][self.item] + nth
        self.size = np.minimum(size[self.item], window)
        at = start[:, None] + np.arange(window)
        inside = np.arange(window) < self.size[:, None]
        self.terms = np.where(inside, terms[np.minimum(at, max(0, len(terms) - 1))] if len(terms) else -1, -1).astype(np.int64)

    def places_in(self, terms: pa.Array) -> np.ndarray:
        """Each vocabulary term's place in a shard's dictionary, -1 where it isn't there."""
        return pc.fill_null(pc.index_in(self.vocab, value_set=terms), -1).to_numpy(zero_copy_only=False)

    def rank(self, count: np.ndarray) -> None:
        """Each window's rarest terms and their offsets, by counts over all documents; terms that occur in none are left out."""
        most = np.iinfo(np.int64).max
        cost = np.where(self.terms >= 0, count[self.terms], 0)
        cost[cost == 0] = most
        self.rare_at = np.argsort(cost, axis=1, kind="stable")[:, :RAREST]
        cost = np.take_along_axis(cost, self.rare_at, 1)
        self.rare = np.where(cost < most, np.take_along_axis(self.terms, self.rare_at, 1), -1)
        self.rankable = np.flatnonzero((self.size > 0) & ((cost < most).sum(1) == np.minimum(self.size, self.rare.shape[1])))

    def search(self, shard: Shard, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Window and start word of each phrase match, window and place of each proximity match."""
        none = np.zeros(0, np.int64)
        at = self.places_in(shard.terms)
        held = np.flatnonzero(at >= 0)
        if not len(held):
            return none, none, none, none
        # The posting lists of the vocabulary's terms on end, and the same as one sorted list of (term, place).
        count = np.zeros(len(at), np.int64)
        count[held] = shard.count[at[held]]
        first = np.cumsum(count) - count
        which = np.repeat(held, count[held])
        nth = np.arange(len(which)) - first[which]
        postings = shard.postings[(np.cumsum(shard.count) - shard.count)[at[which]] + nth]
        lists = Lists(shard.off, postings, first, count, which * (shard.off[-1] + 1) + postings)
        near_w, near_p = self.near(lists, slop) if slop >= 0 else (none, none)
        cost = np.where(self.terms >= 0, count[self.terms], np.iinfo(np.int64).max)
        live = np.flatnonzero((cost.min(1) > 0) & (self.size > 0))
        order = np.argsort(cost[live], axis=1, kind="stable")  # offsets from the rarest term on
        terms = np.take_along_axis(self.terms[live], order, 1)
        who, place, low, high = lists.places(terms[:, 0])
        start = place - order[who, 0]
        fits = (start >= low) & (start + self.size[live][who] <= high)
        who, start = who[fits], start[fits]
        for k in range(1, self.window):
            t, want = terms[who, k], start + order[who, k]
            same = (t < 0) | (lists.upto(t, want) > lists.below(t, want))
            who, start = who[same], start[same]
        return live[who], start, near_w, near_p

    def near(self, lists: Lists, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows and places of their rarest term around which the next two rarest stand near where they belong."""
        live = self.rankable[((self.rare[self.rankable] < 0) | (lists.count[self.rare[self.rankable]] > 0)).all(1)]
        terms, at = self.rare[live], self.rare_at[live]
        who, place, low, high = lists.places(terms[:, 0])
        for k in range(1, terms.shape[1]):
            t = terms[who, k]
            want = place + at[who, k] - at[who, 0]
            ok = (t < 0) | (lists.upto(t, np.minimum(high - 1, want + slop)) > lists.below(t, np.maximum(low, want - slop)))
            who, place, low, high = who[ok], place[ok], low[ok], high[ok]
        return live[who], place


class Lists:
    """A shard's posting lists of a block's vocabulary."""

    def __init__(self, off: np.ndarray, postings: np.ndarray, first: np.ndarray, count: np.ndarray, keys: np.ndarray):
        self.off, self.postings, self.first, self.count, self.keys = off, postings, first, count, keys

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every posting of each term: the term's index, the place, and the bounds of its document."""
        n = self.count[terms]
        who = np.repeat(np.arange(len(terms)), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = self.postings[self.first[terms[who]] + nth]
        doc = np.searchsorted(self.off, place, "right") - 1
        return who, place, self.off[doc], self.off[doc + 1]

    def below(self, terms: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How many postings come before this place of the term's list."""
        return np.searchsorted(self.keys, terms * (self.off[-1] + 1) + place)

    def upto(self, terms: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, terms * (self.off[-1] + 1) + place, "right")


INDEX = ("off", "letters", "sizes", "counts", "postings")


def build_index(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The positional index of a table, one row a shard: its documents' `keep` columns as docs, and compressed arrays."""
    small_batches(df.sparkSession)
    src = df.select(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)]).alias("doc"), F.col(text).cast("string").alias("t"))
    docs = T.StructField("docs", T.ArrayType(src.schema["doc"].dataType))
    schema = T.StructType([docs, *(T.StructField(c, T.BinaryType()) for c in INDEX)])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, shard_bytes):
                own = part.column(0)
                docs = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), own, type=pa.list_(pa.field("element", own.type)))
                yield pa.RecordBatch.from_arrays([docs, *(pa.array([c], pa.binary()) for c in Shard.of(part.column(1)).write())], names=schema.names)

    return map_arrow(src, run, schema)


def count_terms(index: DataFrame, sent, n_terms: int) -> np.ndarray:
    """Occurrences of a block's terms over all documents, from the shards' dictionaries alone."""

    def run(batches):
        block = sent.value
        count = np.zeros(n_terms, np.int64)
        for batch in batches:
            for letters, sizes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = block.places_in(Shard.dictionary(letters, sizes))
                held = np.flatnonzero(at >= 0)
                count[held] += unsqueeze(counts, np.int32)[at[held]]
        seen = np.flatnonzero(count)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(count[seen])], names=["term", "n"])

    got = map_arrow(index.select("letters", "sizes", "counts"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(n_terms, np.int64)
    count[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return count


def blocks(benchmark: DataFrame, item: str, text: str, window: int, block_bytes: int):
    """The benchmark's rows in blocks of about block_bytes, each collected when its turn comes."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), F.col(text).cast("string").alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = -(-max(1, total) // block_bytes)
    for k in range(n):
        got = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").collect() if n > 1 else rows.orderBy("i", "t").collect()
        yield Block([r.i for r in got], [r.t for r in got], window)


def found_in(row: pa.RecordBatch, block: Block, slop: int) -> tuple[np.ndarray, list[dict[str, list]]]:
    """Word offsets of the documents of an index row, and its phrase matches (document, item, start and end word in the
    document) and proximity matches (start: the rarest term): those that other blocks found before, and this block's."""
    shard = Shard.read(*(row.column(c)[0].as_py() for c in INDEX))
    w, start, nw, near = block.search(shard, slop)
    out = []
    for name, who, at, end in (("hits", w, start, start + block.size[w]), ("nears", nw, near, near + 1)):
        doc = np.searchsorted(shard.off, at, "right") - 1
        new = {"doc": doc.tolist(), "item": [block.ids[i] for i in block.item[who].tolist()], "start": (at - shard.off[doc]).tolist(), "end": (end - shard.off[doc]).tolist()}
        old = row.column(name)[0].as_py() if name in row.schema.names else {}
        out.append({k: old.get(k, []) + v for k, v in new.items()})
    return shard.off, out


def search(index: DataFrame, sent, slop: int) -> DataFrame:
    """The index with what a block finds added to its columns hits and nears."""
    ints, strings = T.ArrayType(T.IntegerType(), False), T.ArrayType(T.StringType(), False)
    found = T.StructType([T.StructField(n, strings if n == "item" else ints) for n in ("doc", "item", "start", "end")])
    fields = [f for f in index.schema.fields if f.name not in ("hits", "nears")]
    schema = T.StructType([*fields, T.StructField("hits", found), T.StructField("nears", found)])
    kind = to_arrow_schema(schema).field("hits").type

    def run(batches):
        for batch in batches:
            for r in range(len(batch)):
                row = batch.slice(r, 1)
                _, found = found_in(row, sent.value, slop)
                yield pa.RecordBatch.from_arrays([*(row.column(f.name) for f in fields), *(pa.array([f], kind) for f in found)], names=schema.names)

    return map_arrow(index, run, schema)


def per_document(index: DataFrame, sent, slop: int, keep: tuple[str, ...]) -> DataFrame:
    """keep columns, n_words, spans, items, near, matches and near_matches of every document, after the last block's search."""
    ints, strings = T.ArrayType(T.IntegerType(), False), T.ArrayType(T.StringType(), False)
    match = T.ArrayType(T.StructType([T.StructField("item", T.StringType(), False), T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]), False)
    kinds = index.schema["docs"].dataType.elementType.fields
    extra = [("n_words", T.LongType()), ("spans", ints), ("items", strings), ("near", strings), ("matches", match), ("near_matches", match)]
    schema = T.StructType([*(T.StructField(f"__k{i}", f.dataType) for i, f in enumerate(kinds)), *(T.StructField(n, t) for n, t in extra)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for r in range(len(batch)):
                row = batch.slice(r, 1)
                off, found = found_in(row, sent.value, slop)
                own, size = row.column("docs")[0].values, np.diff(off)
                rows = [[{}, {}] for _ in size]  # of phrases and of proximity: distinct matches in order
                for kind, f in enumerate(found):
                    for d, i, a, b in sorted(zip(f["doc"], f["item"], f["start"], f["end"], strict=True), key=lambda m: (m[0], m[2], m[3], m[1])):
                        rows[d][kind][i, a, b] = None
                spans, items, near, matches = [], [], [], [[], []]
                for phrases, places in rows:
                    merged: list[int] = []
                    for _, a, b in phrases:
                        if merged and a <= merged[-1]:
                            merged[-1] = max(merged[-1], b)
                        else:
                            merged += [a, b]
                    spans.append(merged)
                    items.append(sorted({i for i, _, _ in phrases}))
                    near.append(sorted({i for i, _, _ in places}))
                    for into, some in zip(matches, (phrases, places), strict=True):
                        into.append([{"item": i, "start": a, "end": b} for i, a, b in some])
                keys = [own.field(k) for k in range(len(kinds))]
                cols = [size, spans, items, near, *matches]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, arrow.field(len(kinds) + n).type) for n, c in enumerate(cols))], names=schema.names)

    return map_arrow(index, run, schema).withColumnsRenamed({f"__k{i}": k for i, k in enumerate(keep)})


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = 5, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, matches: bool = False) -> DataFrame:
    """keep columns, n_words, n_hit, n_items, items_sha256, contaminated, n_near, spans, items and near of every row.

    spans are the hit words as flat disjoint [start, end) pairs; items and near are the ids of items with a phrase or a
    proximity match, sorted as strings; slop < 0 leaves proximity out; with `matches` also every match with its item and
    words. Null and empty texts have no words and no hits; an item of no words is no window; a null item id counts as
    'null'; repeated items count once; repeated rows stay; empty tables give no rows or no hits; other input columns,
    whatever their names, are not read.
    """
    spark = df.sparkSession
    index, path = stored(build_index(df, text, keep, shard_bytes))
    found, sent = index, None
    for block in blocks(benchmark, item, item_text, window, block_bytes):
        found = search(found, sent, slop) if sent else found
        sent = spark.sparkContext.broadcast(block)
        if slop >= 0:
            block.rank(count_terms(index, sent, len(block.vocab)))
            sent = spark.sparkContext.broadcast(block)
    covered = F.aggregate("spans", F.lit(0), lambda s, x: x - s)  # ends less starts, as pairs alternate
    out = per_document(found, sent, slop, keep).select(*keep, "n_words", covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"), "spans", "items", "near", *(["matches", "near_matches"] if matches else []))
    out = checkpoint(out)
    remove(spark, path)
    return out
