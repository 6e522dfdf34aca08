"""Classifiers and the mix against plain versions of what they compute."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from recordloom.llm import langid, mixing, quality, toxicity
from recordloom.llm.common import buffers
from tests.llm.test_operators import learnable, make

DOCS = "/root/testdata/sf0.001/documents.parquet"


def texts_of(spark, n=None):
    t = [(r.text or "").encode() for r in spark.read.parquet(DOCS).orderBy("doc_id").collect()]
    return [*t[:n], b"", b"\n", b"\n\n", b"one\n\none\none", b"A a a\xc3\xa9 | !! 12"]


def plain_lines(text):
    lines = text.split(b"\n")
    return lines[:-1] if len(lines) > 1 and lines[-1] == b"" else lines


def plain_own(lines):
    bags = [tuple(sorted(x.lower().split())) for x in lines]
    out = []
    for i, x in enumerate(lines):
        kinds = [int(quality.CLASSES[b]) for b in x]
        kinds += [int(quality.CLASSES[10])] if False else []
        count = [kinds.count(k) for k in range(quality.KINDS)]
        w = x.lower().split()
        n, words, letters = max(1, len(x)), max(1, len(w)), max(1, count[quality.UPPER] + count[quality.SMALL])
        repeats = sum(a == b for a, b in zip(w, w[1:], strict=False))
        own = [c / n for c in count] + [
            math.log1p(len(x)) / 5,
            count[quality.UPPER] / letters,
            repeats / words,
            min(1, count[quality.PIPE] / words * 2),
            min(1, (count[quality.BANG] + count[quality.ODD]) / words / 2),
            float(i > 0 and bool(w) and bags[i] == bags[i - 1]),
            (bags.count(bags[i]) - 1) / len(lines),
            letters / words / 10,
        ]
        out.append([min(3.0, max(0.0, v)) for v in own])
    return out


def test_line_features_are_those_of_plain_code(spark):
    texts = texts_of(spark)
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    x, lens, first = quality.line_features(data, off)
    for i, t in enumerate(texts):
        lines = [y + (b"\n" if k < t.count(b"\n") else b"") for k, y in enumerate(plain_lines(t))]
        assert lens[first[i] : first[i + 1]].tolist() == [len(y) for y in lines]
        own, zero = plain_own(lines), [0.0] * quality.OWN
        want = [own[k] + (own[k - 1] if k else zero) + (own[k + 1] if k + 1 < len(own) else zero) + [1.0] for k in range(len(own))]
        assert np.allclose(x[first[i] : first[i + 1]], want), t[:80]


def test_document_scores_are_those_of_plain_code(spark):
    texts, rng = texts_of(spark, 40), np.random.default_rng(2)
    model = {"weights": rng.normal(0, 0.5, 3 * quality.OWN + 1), "pair": rng.normal(0, 0.5, (2, 2))}
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    got = quality.document_scores(model, data, off)
    x, lens, first = quality.line_features(data, off)
    for i in range(len(texts)):
        u = (x @ model["weights"])[first[i] : first[i + 1]]
        n, pair = len(u), model["pair"]
        fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
        pot = np.stack([np.zeros(n), u], axis=1)
        for t in range(n):
            for b in (0, 1):
                fwd[t, b] = pot[t, b] + (np.logaddexp(fwd[t - 1, 0] + pair[0, b], fwd[t - 1, 1] + pair[1, b]) if t else 0)
        for t in range(n - 2, -1, -1):
            for a in (0, 1):
                bwd[t, a] = np.logaddexp(pair[a, 0] + pot[t + 1, 0] + bwd[t + 1, 0], pair[a, 1] + pot[t + 1, 1] + bwd[t + 1, 1])
        p = np.exp(fwd[:, 1] + bwd[:, 1] - np.logaddexp(*(fwd[0] + bwd[0])))
        w = np.maximum(1, lens[first[i] : first[i + 1]])
        assert np.isclose(got[i], (p * w).sum() / w.sum())


def test_convolution_is_the_plain_one(spark):
    texts, rng = texts_of(spark, 30), np.random.default_rng(3)
    model = {"table": rng.normal(size=(toxicity.BUCKETS, toxicity.SLOTS)).astype(np.float32), "out": rng.normal(size=len(toxicity.WIDTHS) * toxicity.FILTERS) / 20, "bias": 0.1}
    got = toxicity.scores(model, pa.array(texts, pa.binary()))
    for i, t in enumerate(texts):
        data, off = buffers(pa.array([t], pa.binary()))
        data = toxicity.LOWER[data]
        starts, ends, _ = toxicity.word_spans(data, off, toxicity.ALNUM)
        rows = [model["table"][ids].sum(axis=0) for ids in toxicity.pieces(data, starts, ends)]
        best, slot = [], 0
        for w in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                z = [sum(rows[k + j][slot + j * toxicity.FILTERS + f] for j in range(w) if k + j < len(rows)) for k in range(len(rows))]
                best.append(max([0.0, *z]))
            slot += w * toxicity.FILTERS
        assert np.isclose(got[i], 1 / (1 + math.exp(-float(np.dot(best, model["out"]) + model["bias"]))), atol=1e-5)


def test_chunks_change_no_score(spark, monkeypatch):
    texts, rng = texts_of(spark, 30), np.random.default_rng(4)
    model = {"table": rng.normal(size=(toxicity.BUCKETS, toxicity.SLOTS)).astype(np.float32), "out": rng.normal(size=len(toxicity.WIDTHS) * toxicity.FILTERS) / 20, "bias": 0.1}
    whole = toxicity.scores(model, pa.array(texts, pa.binary()))
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    assert np.allclose(whole, toxicity.scores(model, pa.array(texts, pa.binary())))


def test_thresholds_of_languages(spark):
    docs, marks = learnable(spark)
    model = toxicity.fit(docs, marks)
    assert set(model["thresholds"]) == {"en", "xx"}
    unknown = docs.where("doc_id < 5").withColumn("lang", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10_000)
    lang = {r.doc_id: r.lang for r in docs.union(unknown).collect()}
    got = toxicity.classify(docs.union(unknown), marks).collect()
    assert len(got) == 405
    for r in got:
        assert r.lang_threshold == model["thresholds"].get(lang[r.doc_id], 0.7) and r.flagged == (r.score >= r.lang_threshold) and r.predicted == int(r.score >= 0.7)


def test_string_kernel_is_that_of_sets(spark):
    docs, _ = learnable(spark)
    rows = sorted(((r.lang, r.doc_id, r.text.encode()) for r in docs.where("doc_id < 120 and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").collect()))
    model = langid.fit(docs.where("doc_id < 120"), landmarks=8)

    def grams(t):
        bucket = set()
        for k in range(1, langid.NGRAMS + 1):
            for i in range(len(t) - k + 1):
                h = 0
                for b in t[i : i + k].lower():
                    h = (h * 0x01000193 + b + 1) & 0xFFFFFFFF
                bucket.add(((h ^ (h >> 15)) * 0x9E3779B1 & 0xFFFFFFFF) >> (33 - langid.DIMS.bit_length()))
        return bucket

    sets, langs = [grams(t) for _, _, t in rows], model["langs"]
    y = np.array([langs.index(c) for c, _, _ in rows])
    marks = np.concatenate([np.flatnonzero(y == c)[:8] for c in range(len(langs))])
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    z = np.array([[kernel(sets[i], sets[j]) for j in marks] for i in marks])
    k = np.array([[kernel(s, sets[j]) for j in marks] for s in sets])
    values, vectors = np.linalg.eigh(z)
    phi = np.concatenate([k @ (vectors / np.sqrt(np.maximum(values, 1e-6))), np.ones((len(k), 1))], axis=1)
    weight = np.diag(1 / np.bincount(y)[y])
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    solved = np.linalg.solve(phi.T @ weight @ phi + 1e-2 * np.diag([1e-3] * (phi.shape[1] - 1) + [1e-9]), phi.T @ weight @ target)
    data, off = buffers(pa.array([t for _, _, t in rows], pa.binary()))
    p = langid.presence(data, off)
    assert [set(np.flatnonzero(r).tolist()) for r in p] == sets
    got = (p.astype(float) @ model["matrix"]) / np.sqrt(p.sum(axis=1, keepdims=True)) + model["bias"]
    assert np.allclose(got, phi @ solved, atol=5e-3)


def test_multipliers_by_bisection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cells = mixing.sizes(docs).groupBy("source", "size").agg(F.count("*").alias("docs"))
    per_source = cells.groupBy("source").agg(F.sum(F.col("docs") * F.col("size")).alias("source_size"), F.max("size").alias("longest"))
    targets = mixing.source_targets(per_source)
    lam = {r.source: r.lam for r in mixing.balance(cells, targets).collect()}
    rows = cells.collect()
    assert len(lam) > 2
    for t in targets.collect():
        own = [(r["size"], r.docs, 1 + math.log1p(r["size"]) / math.log1p(t.longest)) for r in rows if r.source == t.source]
        taken = lambda v: sum(n * s * min(3.0, math.exp(v * x)) for s, n, x in own)  # noqa: B023, E731
        lo, hi = -30.0, 30.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if taken(mid) < t.target else (lo, mid)
        if t.target < 3 * t.source_size * (1 - 1e-9):
            assert abs(lam[t.source] - lo) < 1e-7
        else:
            assert math.isclose(taken(lam[t.source]), t.target, rel_tol=1e-6)


def test_rates_are_tilted_before_the_residue_is_spread(spark):
    rows = [(i, "w " * (5 + i % 40), "en", f"s{i % 3}", 0) for i in range(3000)]
    got = mixing.mix(make(spark, rows)).collect()
    longest = 44
    for s in ("s0", "s1", "s2"):
        own = [r for r in got if r.source == s]
        ratios = {round(math.log(r.rate) / (1 + math.log1p(r["size"]) / math.log1p(longest)), 6) for r in own if r.rate < 3}
        assert len(ratios) <= 2  # one lambda a source, but for the longest size of the source
