"""Operators that map each text by itself: codec, token counts, media, language, decontamination."""

import hashlib
import os
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pulsefield.llm import bpe_codec, common, decontamination, language_id, mpeg_audio, ngram_join, queries, token_counts
from pyspark.sql import functions as F

os.environ["TOKENIZERS_PARALLELISM"] = "false"
ALPHABET = ["a", "b", " ", "  ", "'s", "'", "!", "é", "你", "th", "er", "\n", "\U0001f600", "12", "<|endoftext|>", "'ll", "on", "É", "Σ", " ", "\x1c", "aaaa", "don't"]


def strings(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 90))) for _ in range(n)]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_codec_joins_exactly():
    lib, own = library("byte_bpe_50k.json"), bpe_codec.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), leaf=8)
    for t in [*strings(1500, 1), "ab" * 5000, "é" * 3000, "!" * 2000, " " * 999]:
        ids = own.encode(t)
        assert ids == lib.encode(t, add_special_tokens=False).ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_codec_query(spark, small):
    lib = library("byte_bpe_50k.json")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op7_bpe_codec(spark, small).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_counts_match_library():
    lib, own = library("word_bpe_49k.json"), token_counts.Merger(public_tokenizers.path("word_bpe_49k.json"))
    texts = [*strings(1500, 2), "'" * 50, "l'll'", "it's 'something' ''s <|startoftext|>x", "aa" * 300, "İstanbul ﬁ ǅ"]
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert own.of_texts(texts).tolist() == want
    assert [int(own.of_texts([t])[0]) for t in texts[:200]] == want[:200]


def twins(size=1024, letters="xe"):
    """A Thue-Morse word and the one with its two letters exchanged, on which hashes modulo 2**64 agree."""
    bits = [i.bit_count() & 1 for i in range(size)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


def test_words_of_like_shape_stay_apart(spark):
    a, b = twins()
    lib = library("word_bpe_49k.json")
    own = token_counts.Merger(public_tokenizers.path("word_bpe_49k.json"))
    assert [int(own.of_texts([t])[0]) for t in (a, b)] == [len(lib.encode(t, add_special_tokens=False).ids) for t in (a, b)]
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_join.link_components(df).collect()}
    assert [(got[k].component_id, got[k].n_copies) for k in (1, 2)] == [(1, 1), (2, 1)]
    hits = {r.doc_id: r.n_hit for r in decontamination.decontaminate(df, spark.createDataFrame([(1, a)], "item_id int, text string")).collect()}
    assert hits == {1: 1, 2: 0}
    raw = np.frombuffer((a + b).encode(), np.uint8)
    h = common.span_hash(common.prefix_hash(raw), np.array([0, len(a)]), np.array([len(a), len(raw)]))
    assert h[0] != h[1]


def test_span_hash_follows_the_bytes():
    rng = np.random.default_rng(3)
    raw = np.tile(rng.integers(0, 256, 300).astype(np.uint8), 3)
    prefix = common.prefix_hash(raw)
    start, size = np.arange(0, 250), 40
    h = [common.span_hash(prefix, start + k * 300, start + k * 300 + size) for k in range(3)]
    assert (h[0] == h[1]).all() and (h[0] == h[2]).all() and len(set(h[0].tolist())) == len(start)


def test_token_counts_query(spark, small):
    lib = library("word_bpe_49k.json")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op10_token_counts(spark, small).collect():
        n = len(lib.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 2048, len(texts[r.doc_id].encode()))


@pytest.mark.parametrize("t", ["", "a", "b" * 63, "c" * 64, "d" * 921, "é" * 5000])
def test_audio_round_trip(t):
    payload = mpeg_audio.pad(t.encode())
    stream = mpeg_audio.write(payload)
    got, p = mpeg_audio.read(stream)
    assert got == payload and len(payload) % 64 == 0 and payload
    assert p.bad_checksums == 0 and p.checked == len(p.frames) == p.table["frames"] and p.table["bytes"] == len(stream) - stream.index(b"\xff")
    assert p.seconds == 1152 * len(p.frames) / 48000


def test_audio_resynchronises():
    stream = mpeg_audio.write(b"x" * 4096)
    first = mpeg_audio.parse(stream)
    tag = stream.index(b"\xff")
    bent = stream[:tag] + b"junk\xff\xfbnoise" + stream[tag:] + b"TAG" + b"Title".ljust(30, b"\0") + bytes(95)
    p = mpeg_audio.parse(bent)
    assert len(p.frames) == len(first.frames) and p.skipped == 11 and p.tags["TAG"] == "Title"
    at = first.frames[1][0] + 10
    assert mpeg_audio.parse(stream[:at] + b"\x01" + stream[at + 1 :]).bad_checksums == 1


def test_audio_layers_and_delays():
    one, two = bytes([0xFF, 0xFF, 0x94, 0]), bytes([0xFF, 0xFD, 0xA4, 0])  # 48 kHz, 288 kbit/s in Layer I, 192 in Layer II
    for four, size, samples in ((one, 288, 384), (two, 576, 1152)):
        p = mpeg_audio.parse((four + bytes(size - 4)) * 5)
        assert [a for a, _ in p.frames] == [k * size for k in range(5)] and p.seconds == 5 * samples / 48000
    stream = mpeg_audio.write(b"x" * 4096)
    at = stream.index(b"Xing") + 4 + 4 + 4 + 4 + 100
    lame = b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    p = mpeg_audio.parse(stream[:at] + lame + stream[at + len(lame) :])
    assert p.table["delay"] == 576 and p.seconds == (1152 * len(p.frames) - 1576) / 48000


def test_audio_query(spark, small):
    import zlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op8_mpeg_audio(spark, small).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stream = mpeg_audio.write(payload)
        starts = [k for k in range(stream.index(b"Xing") - 38 + 192, len(stream) - 3) if stream[k : k + 2] == b"\xff\xfa"]
        assert (r.media_bytes, r.media_sha256, list(r.seek)) == (len(stream), hashlib.sha256(stream).hexdigest(), starts)
        assert r.seconds == 1152 * len(starts) / 48000
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_language(spark, small):
    sf = small.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op6_language_id(spark, sf).join(docs, "doc_id").where("held_out")
    assert got.count() > 150 and got.where("lang_pred = lang").count() >= 0.97 * got.count()
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_by_brute_force():
    """Votes and margins worked out text by text, from trigrams counted one by one and the machines' weights."""
    import math

    m = language_id.Model(["the and of it is that", "der und die das ist ein", "le la les est une des", "el los que una es por"] * 3, ["en", "de", "fr", "es"] * 3)
    texts = ["The end of it.", "und das ist!", "Les amis est une", "que los es", "zzz", "é", "Ab 12"]
    for t, lang, score in zip(texts, *m.predict(pa.array(texts)), strict=True):
        raw = [32, *(b if not b < 128 or chr(b).isalpha() else 32 for b in t.encode().translate(FOLD)), 32]
        grams = [((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32) >> 20 for a, b, c in zip(raw, raw[1:], raw[2:])]
        margin = {p: sum(m.w[g, k] for g in grams) / len(grams) + m.b[k] for k, p in enumerate(m.pairs)}

        def best(names):
            of = {n: [margin[p] * (1 if p[0] == n else -1) for p in margin if n in p and set(p) <= set(names)] for n in names}
            top = max(names, key=lambda n: sum((x > 0) + 1e-3 * math.tanh(x) for x in of[n]))
            return top, min(of[top], default=math.inf)

        family, sure = best(list(m.families))
        want, own = best(m.families[family])
        assert lang == want and abs(score - 1 / (1 + math.exp(-4 * max(-20, min(20, sure, own))))) < 1e-9


def test_language_needs_letters():
    m = language_id.Model(["the and of it is", "der und die das ist", "le la les est une", "el los que una es"] * 3, ["en", "de", "fr", "es"] * 3)
    pred, score = m.predict(pa.array([None, "", "123 !?", "the of and"]))
    assert pred[:3] == ["und"] * 3 and score[:3].tolist() == [0, 0, 0] and pred[3] == "en"
    assert language_id.Model([], []).predict(pa.array(["abc"]))[0] == ["und"]
    assert language_id.Model(["abc"], ["xx"]).predict(pa.array(["abc"]))[0] == ["xx"]


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))


def words(t):
    return WORD.findall((t or "").encode().translate(FOLD))


def brute_hits(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 23, 40])
def test_decontamination_brute_force(spark, block_bytes):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "é1", "D"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randint(1, 14))) for k in range(12)] + [(50, ""), (51, None), (52, "..."), (3, "b a")]
    docs = [(k, text(rng.randint(0, 60))) for k in range(40)] + [(90, None), (91, ""), (92, "x".join(t or "" for _, t in items))]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = decontamination.decontaminate(df, bench, block_bytes=block_bytes).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == brute_hits(docs, items)
    assert all(set(r["items"]) <= set(r.near) for r in got)


def test_decontamination_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op4_decontamination(spark, small).collect()}
    assert got == brute_hits(docs, items)


def test_proximity(spark):
    df = spark.createDataFrame([(1, "one two three x four five six seven eight nine ten"), (2, "far one " + "pad " * 40 + "ten")], "doc_id int, text string")
    bench = spark.createDataFrame([(7, "one two three four five six seven eight nine ten")], "item_id int, text string")
    got = {r.doc_id: (r.n_hit, r.n_near) for r in decontamination.decontaminate(df, bench).collect()}
    assert got == {1: (0, 1), 2: (0, 0)}


def test_proximity_in_any_layout(spark):
    """An edited passage matches whether or not a neighbour holds the word that was replaced."""
    df = spark.createDataFrame([(1, "one two three x four five six y eight nine ten"), (2, "seven"), (3, "far one " + "pad " * 40 + "ten")], "doc_id int, text string")
    bench = spark.createDataFrame([(7, "one two three four five six seven eight nine ten")], "item_id int, text string")
    for docs in (df.coalesce(1), df.repartitionByRange(3, "doc_id"), df.where("doc_id <> 2").coalesce(1)):
        got = {r.doc_id: (r.n_hit, r.n_near) for r in decontamination.decontaminate(docs, bench).collect()}
        assert got.pop(2, (0, 0)) == (0, 0) and got == {1: (0, 1), 3: (0, 0)}


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "beta gamma delta alpha beta gamma delta alpha beta gamma")], "item_id int, text string")
    model = language_id.fit(odd)
    runs = [lambda d: bpe_codec.round_trip(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), ids=True), lambda d: token_counts.count_tokens(d, public_tokenizers.path("word_bpe_49k.json")), lambda d: mpeg_audio.audio_columns(d, media=True), lambda d: language_id.identify(d, model), lambda d: decontamination.decontaminate(d, bench), lambda d: decontamination.decontaminate(d, bench.limit(0))]
    for run in runs:
        rows = run(odd).collect()
        assert len(rows) == 11 and sum(r.doc_id == 5 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
        assert run(none).count() == 0
    assert runs[4](odd).where(F.col("doc_id") == 6).first().n_hit > 100_000
    assert language_id.fit(none).langs == []


def test_language_model_holds_one_row_of_counts_at_a_time():
    """The counts may come one by one; while the model is fitted, less than twice its matrix is held."""
    import tracemalloc

    rng, n = np.random.default_rng(3), 600
    few = rng.integers(0, 9, (8, language_id.WIDTH)).astype(np.uint32)
    langs = ["en", "fr"] * (n // 2)
    tracemalloc.start()
    m = language_id.Model.of((few[k % 8].copy() for k in range(n)), langs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * n * language_id.WIDTH * 4
    assert np.array_equal(m.w, language_id.Model.of([few[k % 8] for k in range(n)], langs).w)
