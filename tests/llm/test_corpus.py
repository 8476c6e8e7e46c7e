"""Operators over the whole corpus: n-gram join, suffix deduplication, language model, and the pipeline."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pulsefield.llm import components, lm_scoring, ngram_join, queries, suffix_dedup
from pulsefield.llm.language_id import crc_part

FOLD = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall((t or "").encode().translate(FOLD))


def brute_components(docs, n, num, den):
    sets = {}
    for d, t in docs:
        w = words(t)
        sets[d] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    home = {d: d for d in sets}

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                a1, b1 = find(a), find(b)
                home[max(a1, b1)] = min(a1, b1)
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_texts(seed, groups=12, size=9):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 40)) for _ in range(rng.choice([2, 5, 40, 90]))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "new" + str(rng.randint(0, 5))
            out.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("n, num, seed", [(3, 90, 1), (5, 80, 2), (1, 60, 3)])
def test_join_brute_force(spark, n, num, seed):
    docs = [*near_texts(seed), (900, None), (901, ""), (902, "  "), (903, "one"), (904, "ONE")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(df, n, num).collect()}
    assert got == brute_components(docs, n, num, 100)


def test_join_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_ngram_join(spark, small).collect()}
    assert got == brute_components(docs, 3, 90, 100)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "a long, b long")
    one, many = ({r.node: r.root for r in components.connected_components(df, one_task=limit).collect()} for limit in (1 << 20, 0))
    assert one == many and one[340] == 300
    assert components.connected_components(df.limit(0)).count() == 0


def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + length] for r in raws for k in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        out.append((len(r), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(r) else 0, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot, broadcast, seed", [(20_000, 1 << 25, 1), (2, 1 << 25, 2), (3, 0, 3)])
def test_suffix_dedup_brute_force(spark, hot, broadcast, seed):
    rng = random.Random(seed)
    piece = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    shared = [piece(rng.randint(20, 90)) for _ in range(8)]
    texts = ["".join(rng.choice(shared) if rng.random() < 0.5 else piece(rng.randint(1, 40)) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    texts += ["z" * 300, "z" * 150 + "y" * 20 + "z" * 150, "xy" * 90, texts[3], None, "", "q" * 39]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = suffix_dedup.drop_repeats(df, 40, 14, hot, broadcast_bytes=broadcast).collect()
    want = brute_repeats(texts, 40)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == dict(enumerate(want))


def test_suffix_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op5_suffix_dedup(spark, small).collect()}
    assert got == {d.doc_id: w for d, w in zip(docs, brute_repeats([d.text for d in docs], 400), strict=True)}


def test_deep_shallow_sorts():
    rng = random.Random(6)
    for _ in range(30):
        strings = list({b"common" + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(60)})
        assert suffix_dedup.deep_shallow(strings, 6, 8) == sorted(strings)


@pytest.mark.parametrize("head", [1 << 20, 300])
def test_language_model(spark, small, head):
    df = spark.read.parquet(f"{small}/documents.parquet")
    tokens = {r.doc_id: [*words(r.text), b"\0"] for r in df.collect()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in tokens}
    c = Counter(w for d, t in tokens.items() if not held[d] for w in t)
    n, v = sum(c.values()), len(c)
    rows = lm_scoring.score(df, crc_part("doc_id", 10) == 0, head=head).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        t = tokens[r.doc_id]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(w in c for w in t), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0


def test_language_model_is_normalised():
    rng = np.random.default_rng(0)
    model = lm_scoring.Bilinear(np.array([9.0, 5, 5, 3, 2, 2, 1, 1, 1]), np.array([2.0, 0.1]))
    for _ in range(20):
        model.step(rng.integers(0, 11, 40), rng.integers(0, 11, 40), rng.integers(0, 11, 40), rng)
    assert model.n_groups == 3
    for a in range(11):
        logs = model.log10(np.full(11, a), np.full(11, 1), np.arange(11))
        assert abs((10**logs).sum() - 1) < 1e-5


def test_language_model_draws_by_mass():
    """A leaf drawn inside a group is the one that a search in the summed counts finds."""
    rng = np.random.default_rng(5)
    model = lm_scoring.Bilinear(np.sort(rng.pareto(0.7, 3000) * 40 + 0.1)[::-1], np.array([2.0, 0.1]))
    g, u = rng.integers(0, model.n_groups, 5000), rng.random((5000, 3))
    u[:200] = np.arange(600).reshape(200, 3) % 8 / 8
    low, high = model.cum[model.first[g]][:, None], model.cum[model.first[g + 1]][:, None]
    want = np.clip(np.searchsorted(model.cum, low + u * (high - low), "right") - 1, model.first[g][:, None], model.first[g + 1][:, None] - 1)
    assert (model.others(g, u) == want).all()


def test_language_model_step_brute_force():
    """A minibatch moves the parameters as the estimation's gradients say, token by token; tables over 2048 rows too."""
    for counts in (np.array([90.0, 50, 50, 30, 20, 20, 10, 1, 1]), np.sort(np.random.default_rng(1).pareto(0.8, 3000) + 1)[::-1]):
        rng, model = np.random.default_rng(2), lm_scoring.Bilinear(counts, np.array([20.0, 3]))
        k, scale = len(counts), model.noise
        c1, c2, w = (rng.integers(0, k + 2, 50) % np.array([k + 2, 9])[rng.integers(0, 2, 50)] for _ in range(3))
        r, t, b, u, a, m1, m2 = (x.astype(float) for x in model.p)
        grads = [np.zeros(x.shape) for x in model.p]
        seed = np.random.default_rng(3)
        model.step(c1, c2, w, seed)
        seed = np.random.default_rng(3)
        noise = seed.choice(len(b), lm_scoring.NOISE, p=scale)
        own = [i for i in range(50) if w[i] < k and model.size[model.group[w[i]]] > 1]
        inner = dict(zip(own, seed.random((len(own), lm_scoring.WITHIN)), strict=True))
        for i in range(50):
            q = r[c1[i]] * m1 + r[c2[i]] * m2
            dq = np.zeros(lm_scoring.WIDTH)
            g = model.cls[w[i]]
            pairs = [(t, b, grads[1], grads[2], scale * lm_scoring.NOISE, g, noise)]
            if i in inner:
                low, high = model.cum[model.first[g]], model.cum[model.first[g + 1]]
                drawn = np.searchsorted(model.cum, low + inner[i] * (high - low), "right") - 1
                pairs.append((u, a, grads[3], grads[4], model.inner * lm_scoring.WITHIN, w[i], drawn))
            for vectors, biases, gv, gb, expected, one, others in pairs:
                for j, is_data in [(one, 1), *((o, 0) for o in others)]:
                    d = is_data - 1 / (1 + np.exp(np.log(expected[j]) - vectors[j] @ q - biases[j]))
                    dq += d * vectors[j]
                    gv[j] += d * q
                    gb[j] += d
            grads[0][c1[i]] += dq * m1
            grads[0][c2[i]] += dq * m2
            grads[5] += dq * r[c1[i]]
            grads[6] += dq * r[c2[i]]
        for got, x, g in zip(model.p, (r, t, b, u, a, m1, m2), grads, strict=True):
            g /= 50
            assert np.allclose(got, x + lm_scoring.RATE * g * 20 / np.sqrt(0.1 + g * g * 400), rtol=1e-4, atol=1e-4)


def plain_scores(model, c1, c2, w):
    """Both softmaxes from the formula, the largest score of each row taken off first."""
    r, t, b, u, a, m1, m2 = model.p

    def log_softmax(s, at):
        s -= s.max(1, keepdims=True)
        mine = s[np.arange(len(s)), at]
        return mine - np.log(np.exp(s, out=s).sum(1))

    out, step = np.empty(len(w)), (1 << 19) // len(b)
    for i in range(0, len(w), step):
        at = slice(i, i + step)
        out[at] = log_softmax((r[c1[at]] * m1 + r[c2[at]] * m2) @ t.T + b, model.cls[w[at]])
    for k in range(model.n_groups):
        lo, hi = model.first[k], model.first[k + 1]
        o = np.flatnonzero((w >= lo) & (w < hi)) if hi - lo > 1 else []
        if len(o):
            out[o] += log_softmax((r[c1[o]] * m1 + r[c2[o]] * m2) @ u[lo:hi].T + a[lo:hi], w[o] - lo)
    return out / math.log(10)


def test_language_model_far_scores():
    """Scores beyond a float's exponent are normalised like others."""
    rng = np.random.default_rng(4)
    model = lm_scoring.Bilinear(np.sort(rng.pareto(0.8, 60) + 1)[::-1], np.array([2.0, 1]))
    for by in (1, 30, 3000):
        model.p = [(x * by).astype(np.float32) if i not in (5, 6) else x for i, x in enumerate(model.p)]
        c1, c2, w = (rng.integers(0, 62, 2000) for _ in range(3))
        want = plain_scores(model, c1, c2, w)
        assert np.allclose(model.log10(c1, c2, w), want, rtol=1e-4, atol=1e-3) and np.isfinite(want).all()


def test_language_model_cost():
    """A token is learned from and scored in under twice the CPU time of the plain softmaxes; it took 2.6 to 2.9 times that before."""
    rng = np.random.default_rng(6)
    counts = 1e6 / np.arange(1, 20_001)
    start = lambda: lm_scoring.Bilinear(counts, np.full(70, 2000.0))
    c1, c2, w = (rng.choice(20_000, 1 << 17, p=counts / counts.sum()).astype(np.int32) for _ in range(3))

    def learn():
        model, noise = start(), np.random.default_rng(0)
        began = time.thread_time()
        for i in range(0, len(w), 4096):
            model.step(c1[i : i + 4096], c2[i : i + 4096], w[i : i + 4096], noise)
        model.log10(c1, c2, w)
        return time.thread_time() - began

    def plain():
        model = start()
        began = time.thread_time()
        plain_scores(model, c1, c2, w)
        return time.thread_time() - began

    took, base = zip(*((learn(), plain()) for _ in range(5)), strict=True)
    assert min(took) < 2 * min(base)


def test_language_model_in_any_layout(spark, small):
    """Scores are those of one task and of many."""
    df = spark.read.parquet(f"{small}/documents.parquet")
    runs = [{r.doc_id: r.score for r in lm_scoring.score(d, crc_part("doc_id", 10) == 0, shard_tokens=20_000).collect()} for d in (df.coalesce(1), df.repartition(5))]
    assert all(abs(x - runs[1][i]) <= 1e-6 * abs(x) for i, x in runs[0].items())


def test_language_model_beats_unigrams(spark, small):
    """Held-out tokens gain over 0.1 in log10 on the base score."""
    out = queries.op9_lm_scoring(spark, small.replace("0.001", "0.01")).where("held_out").collect()
    assert sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out) > 0.1


def test_language_model_score_brute_force(spark):
    """Scores from the formula, token by token, with the model that one shard trains."""
    texts = ["the cat sat on the mat", "the dog sat", "a cat and a dog sat on a mat", "unheard words here", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = {r.doc_id: r for r in lm_scoring.score(df, crc_part("doc_id", 10) == 99).collect()}
    c = Counter(w for t in texts for w in [*words(t), None])
    hashes = {None: lm_scoring.END} | {w: int(h) for w, h in zip([w for w in c if w], lm_scoring.hashes_of(pa.array([w for w in c if w], pa.binary())), strict=True)}
    order = sorted(c, key=lambda w: (-c[w], hashes[w]))
    mass = np.full(16, 0.1)
    model = lm_scoring.Bilinear(np.array([c[w] + 0.1 for w in order]), mass)
    leaf = {w: i for i, w in enumerate(order)}
    keys = {r.doc_id: r.k for r in df.selectExpr("doc_id", "xxhash64(doc_id, text) as k").collect()}
    held = [np.array([leaf[w] for w in [*words(texts[i]), None]], np.int32) for i in sorted(keys, key=keys.get)]
    w, off = np.concatenate(held), np.concatenate([[0], np.cumsum([len(x) for x in held])])
    rng = np.random.default_rng(0)
    c1, c2 = lm_scoring.contexts(w, off, leaf[None])
    o = rng.permutation(len(w))
    model.step(c1[o], c2[o], w[o], rng)
    r, t, b, u, a, m1, m2 = (x.astype(float) for x in model.p)
    for i, text in enumerate(texts):
        before, total = [leaf[None], leaf[None]], 0.0
        for token in [*words(text), None]:
            x = leaf[token]
            q = r[before[1]] * m1 + r[before[0]] * m2
            for s, at in ((t @ q + b, model.group[x]), ((u @ q + a)[model.group == model.group[x]], x - model.first[model.group[x]])):
                total += (s[at] - np.log(np.exp(s).sum())) / math.log(10)
            before = [before[1], x]
        assert abs(rows[i].score - total) < 1e-4 * abs(total)


def test_odd_rows(odd, none):
    for run in (lambda d: ngram_join.link_components(d), lambda d: suffix_dedup.drop_repeats(d), lambda d: lm_scoring.score(d, crc_part("doc_id", 10) == 0)):
        rows = run(odd).collect()
        assert len(rows) == 11 and sum(r.doc_id == 5 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
        assert run(none).count() == 0
    joined = {r.doc_id: r for r in ngram_join.link_components(odd).collect()}
    assert joined[2].component_id == 2 and joined[5].n_copies == 2 and joined[6].n_shingles == 4


def test_pipeline(spark, small):
    """run() against each stage's rule by brute force, and its last digests against the library."""
    from pulsefield.llm import bpe_codec, language_id
    from public_tokenizers import path
    import pyarrow as pa
    from tests.llm.test_native import brute_lines
    from tests.llm.test_texts import brute_hits

    df = spark.read.parquet(f"{small}/documents.parquet")
    rows = [r.asDict() for r in df.collect()]
    pred, score = language_id.fit(df).predict(pa.array([r["text"] for r in rows], pa.string()))
    rows = [r for r, p, s in zip(rows, pred, score, strict=True) if p != "und" and s >= corpus_pipeline.LEAST_SCORE]
    for r, t in zip(rows, brute_lines([(r["source"], r["text"]) for r in rows], 0.03, 3), strict=True):
        r["text"] = t
    home = brute_components([(r["doc_id"], r["text"]) for r in rows], 5, 80, 100)
    rows = [r for r in rows if home[r["doc_id"]][1] == r["doc_id"]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    hits = brute_hits([(r["doc_id"], r["text"]) for r in rows], items)
    rows = [r for r in rows if not hits[r["doc_id"]][4]]
    codec = bpe_codec.codec(path("byte_bpe_50k.tiktoken"))
    want = {r["doc_id"]: codec.encode(r["text"]) for r in rows}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, small).collect()}
    assert got == want and 0 < len(got) < df.count()


def test_pipeline_rejects_what_is_no_language(spark, small):
    rng = random.Random(11)
    docs = spark.read.parquet(f"{small}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    letters = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(120)) for _ in range(5)]
    coded = [base64.b64encode(rng.randbytes(500)).decode() for _ in range(5)]
    foreign = ["Это предложение написано на русском языке, и машина его никогда не видела.", "Tämä lause on kirjoitettu suomeksi eikä kone ole koskaan nähnyt tätä kieltä."]
    bad = [(-1 - i, t, None, "s", len(t)) for i, t in enumerate(letters + coded + foreign)]
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.union(spark.createDataFrame(bad, docs.schema)), small).collect()}
    assert kept == {r.doc_id for r in docs.collect()}


def test_pipeline_keeps_one_of_each_copy_group(spark, small, tmp_path):
    """Copies within one small source don't make each other's lines boilerplate; a line of its other pages still is."""
    from pulsefield.llm import bpe_codec
    from public_tokenizers import path

    docs = spark.read.parquet(f"{small}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    vocabulary = sorted({w for r in docs.where("lang = 'en'").collect() for w in r.text.split() if w.isalpha()})
    rng = random.Random(12)
    page = lambda: [" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(6)]
    copied, others, menu = page(), [page() for _ in range(6)], "the menu of the tiny site"
    texts = ["\n".join(copied)] * 4 + ["\n".join([menu, *p]) for p in others]
    rows = [(10_000_000 + i, t, "en", "tiny", len(t)) for i, t in enumerate(texts)]
    docs.union(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    codec = bpe_codec.codec(path("byte_bpe_50k.tiktoken"))
    want = {10_000_000: codec.encode("\n".join(copied))} | {10_000_004 + i: codec.encode("\n".join(p)) for i, p in enumerate(others)}
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r.source == "tiny"} == want


def test_pipeline_near_copies_by_row(spark, small):
    """A copy takes no other text of its doc_id, or of null ids, with it; of copies under one doc_id one stays."""
    copy, clean, own = ("".join(f"{w}{i} " for i in range(40)) for w in "abc")
    rows = [(1, copy), (None, copy), (None, clean), (7, copy), (7, own), (9, "x y z " * 9 + "p"), (9, "x y z " * 9 + "p q"), (None, "u v w " * 9), (None, "u v w " * 8)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, small).collect()]
    ids = [i for i, _ in kept]
    assert sorted([k for k in kept if k in rows[:5]], key=str) == sorted([rows[0], rows[2], rows[4]], key=str)
    assert ids.count(9) == 1 and len(kept) == 5


def test_pipeline_odd_rows(spark, odd, small):
    docs = odd.select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert stage(spark, docs.limit(0), small).count() == 0
        if name != "tokens":
            assert out.columns == list(corpus_pipeline.COLUMNS)
    kept = [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, small).collect()]
    assert kept.count(5) == 1


def test_repeats_with_shuffled_texts(spark, monkeypatch):
    """Texts that meet their spans by a shuffle: copies, short and null texts have no spans, and the rows stay the same."""
    from pulsefield.llm import suffix_dedup as sd

    common = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(500))
    texts = ["x1 " + common + " y1", "zz2 " + common + " w2", "same " * 100, "same " * 100, "short", "short", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, sd.drop_repeats(df).collect()))
    assert [r[2] >= 500 for r in want] == [True, True, True, True, False, False, False, False]
    monkeypatch.setattr(sd, "BESIDE_TEXTS", 0)
    assert sorted(map(tuple, sd.drop_repeats(df).collect())) == want
