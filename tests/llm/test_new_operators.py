"""Fill-in-middle, exact copies and vector codes against plain forms of the same, and on awkward input."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import exact_dedup, fim, vector_codes
from tests.llm.test_operators import awkward, by, clashing, make, small  # noqa: F401

TEXTS = ["", "x", "a😀b\n😀é", "one two  three\nfour. five!\n\n", "<P>", "a<M>b", "x<", "12ab34 ٣4", "퟿z\x00 y", " \n "]


def plain_fim(doc_id, text, seed=1):
    s = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h, t = [int(s[8 * k : 8 * k + 8], 16) for k in range(4)], text or ""
    lo, hi = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    p, m, x = t[:lo], t[lo:hi], t[hi:]
    if not t or any(mark in t for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, len(t), "plain", None, None, t)
    out = f"<S>{x}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{x}<M>{m}"
    return (doc_id, len(t), "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), out)


@pytest.mark.parametrize("grammar", list(fim.GRAMMARS))
def test_units_join_to_the_text(spark, grammar):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", fim.units(F.col("t"), grammar).alias("u"), F.transform(fim.blocks(F.col("t"), grammar, 2), lambda b: fim.units(b, grammar)).alias("b")).collect()
    for r in rows:
        assert "".join(r.u) == r.t and all(r.u) and [x for b in r.b for x in b] == r.u
    got = {r.t: r.u for r in rows}
    assert got[""] == []
    if grammar == "code points":
        assert all(u == list(t) for t, u in got.items())
    if grammar == "words":
        assert got["one two  three\nfour. five!\n\n"] == ["one ", "two  ", "three\n", "four. ", "five!\n\n"]
    if grammar == "lines":
        assert got["one two  three\nfour. five!\n\n"] == ["one two  three\n", "four. five!\n", "\n"]


@pytest.mark.parametrize("block", [3, fim.BLOCK])
def test_fill_in_middle(spark, small, awkward, block):  # noqa: F811
    rows = small + awkward + [(1000 + i, t, "en", "a", 0) for i, t in enumerate(TEXTS * 6)]
    found = fim.fill_in_middle(make(spark, rows), block=block).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert by(tuple(r)[:6] for r in found) == by(plain_fim(r[0], r[1]) for r in rows)
    assert by((r.doc_id, r.back) for r in found) == by((r[0], r[1] or "") for r in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_fill_in_middle_by_words_and_long_texts(spark):
    text = " ".join(f"w{i}é" for i in range(900_000))
    docs = make(spark, [(i, text if i < 3 else "ab cd\nef gh", "en", "a", 0) for i in range(40)])
    for r in fim.fill_in_middle(docs, "words", plain_from=100).where("doc_id < 3 or doc_id > 30").collect():
        back = r.output.replace("<P>", "|").replace("<S>", "|").replace("<M>", "|").split("|")
        prefix, middle = (back[1], back[3]) if r.form == "psm" else (back[2], back[3])
        assert r.n == (900_000 if r.doc_id < 3 else 4) and (len(prefix), len(middle)) == (r.prefix_chars, r.middle_chars)
        assert not prefix or prefix[-1] in " \n" or prefix in (text, "ab cd\nef gh")


def test_fill_in_middle_keeps_columns_and_takes_empty_tables(spark, small):  # noqa: F811
    docs = clashing(spark, small)
    out = fim.transformed(docs)
    assert out.columns == docs.columns and by(map(str, out.drop("text", "n_chars").collect())) == by(map(str, docs.drop("text", "n_chars").collect()))
    assert by((r.doc_id, r.text) for r in out.collect()) == by((p[0], p[5]) for p in (plain_fim(r[0], r[1]) for r in small))
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert by(map(str, fim.digests(docs).collect())) == by(map(str, fim.digests(make(spark, small)).collect()))
    assert fim.digests(make(spark, [])).count() == fim.transformed(make(spark, [])).count() == 0


def plain_exact(rows):
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        bare = "".join(c for c in r[1] or "" if c not in " \t\n\x0b\x0c\r")
        groups[bare].append((-len(r[1] or ""), r[0] is None, r[0] or 0, k, r[0]))
    out = []
    for bare, g in groups.items():
        first = min(g)
        out += [(x[4], first[4], len(g), hashlib.sha256(bare.encode()).hexdigest(), x[:3] == first[:3]) for x in g]
    return out


@pytest.mark.parametrize("hot", [3, exact_dedup.HOT])
def test_exact_groups(spark, small, awkward, hot):  # noqa: F811
    rng = random.Random(2)
    copies = [(2000 + i, rng.choice(["the same", "the  same", "thes ame\n", "another", " the same"]), "en", "a", 0) for i in range(300)]
    rows = small + awkward + copies + [(2000, "the  same", "en", "a", 0)] * 2
    docs = make(spark, rows).repartition(5)
    heavy = exact_dedup.heavy_winners(exact_dedup.digested(docs), hot, 64 if hot == 3 else exact_dedup.COUNTERS)
    assert heavy.count() == (1 if hot == 3 else len([g for g in {x[3]: x[2] for x in plain_exact(rows)}.values() if g * hot > len(rows)]))
    found = exact_dedup.exact_groups(docs, hot, 64 if hot == 3 else exact_dedup.COUNTERS).collect()
    want = plain_exact(rows)
    assert by(tuple(r)[:3] + (r.text_sha256,) for r in found) == by(x[:4] for x in want)
    # of rows alike in length and id exactly one is kept
    assert sum(r.kept for r in found) == len({x[3] for x in want}) == len({r.text_sha256 for r in found if r.kept})
    assert all(any(w[0] == r.doc_id and w[3] == r.text_sha256 and w[4] for w in want) for r in found if r.kept)


def test_exact_edges(spark, small, awkward):  # noqa: F811
    assert exact_dedup.exact_groups(make(spark, [])).count() == exact_dedup.deduplicated(make(spark, [])).count() == 0
    docs = clashing(spark, small)
    assert by(map(str, exact_dedup.exact_groups(docs).collect())) == by(map(str, exact_dedup.exact_groups(make(spark, small)).collect()))
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len({x[3] for x in plain_exact(small)})
    kept = exact_dedup.deduplicated(make(spark, awkward)).collect()
    assert len(kept) == len({x[3] for x in plain_exact(awkward)}) and sum(r.text == "no id here" for r in kept) == 1
    long = "a b" * 4_000_000
    got = {r.doc_id: r for r in exact_dedup.exact_groups(make(spark, [(1, long, "en", "a", 0), (2, long + "\n", "en", "a", 0)])).collect()}
    assert got[1].keep_id == got[2].keep_id == 2 and got[1].text_sha256 == hashlib.sha256(b"ab" * 4_000_000).hexdigest()


def test_exact_groups_stay_in_the_jvm(spark, small):  # noqa: F811
    plan = exact_dedup.exact_groups(make(spark, small))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas")) and "BroadcastHashJoin" in plan


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    book = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, p: min(range(len(book[p])), key=lambda e: (far(cut(v, p), book[p][e]), e))
    for _ in range(rounds):
        code = [[nearest(v, p) for p in range(parts)] for _, _, v in kept]
        for p in range(parts):
            for e in range(len(book[p])):
                own = [cut(v, p) for (_, _, v), c in zip(kept, code, strict=True) if c[p] == e]
                if own:
                    book[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    code = [[nearest(v, p) for p in range(parts)] for _, _, v in kept]
    error = [sum(far(cut(v, p), book[p][c[p]]) for p in range(parts)) for (_, _, v), c in zip(kept, code, strict=True)]
    label = defaultdict(int)
    for (_, lab, _), e in zip(kept, error, strict=True):
        label[lab] += e
    sha = hashlib.sha256(",".join(str(x) for b in book for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{x:02x}" for x in c), e, label[lab], sha) for (i, lab, _), c, e in zip(kept, code, error, strict=True)]


SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, size=32, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 0.02, (7, size))
    return [(i, (base[i % 7] + rng.normal(0, 0.004, size)).astype(np.float32).tolist(), None if i % 11 == 0 else i % 3) for i in range(n)]


@pytest.mark.parametrize("n", [1, 5, 200])
def test_codes(spark, n):
    rows = vectors(n)
    found = vector_codes.compressed(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert by(tuple(r) for r in found) == by(plain_codes(rows))


def test_codes_of_awkward_vectors(spark):
    rows = vectors(90, 16) + [(3, vectors(4, 16)[3][1], 1), (None, [0.5] * 16, None), (None, [0.5] * 16, None), (500, None, 1), (501, [None] + [0.0] * 15, 1), (502, [float("nan")] * 16, 2), (503, [float("inf")] + [0.0] * 15, 2), (504, [0.0] * 16, 1), (505, [-0.0] * 16, 1)]
    more = spark.createDataFrame([(*r, "k", b"c", 1, 2.0) for r in rows], SCHEMA + ", key string, code binary, error int, upper double")
    want = by(plain_codes(rows))
    assert by(tuple(r) for r in vector_codes.compressed(more).collect()) == want
    none = spark.createDataFrame([], SCHEMA)
    assert vector_codes.compressed(none).count() == vector_codes.compressed(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0
    blank = vector_codes.compressed(spark.createDataFrame([(1, [], 1), (2, [], None)], SCHEMA)).collect()
    assert by((r.vec_id, r.code, r.error) for r in blank) == [(1, "00" * 16, 0), (2, "00" * 16, 0)]
    short = vector_codes.compressed(spark.createDataFrame([(1, [0.25] * 16, 1), (2, [0.25] * 3, None), (3, [1e30] * 16, 2)], SCHEMA)).collect()
    assert [r.error for r in short] == [0, 0, 0]


def test_bounds_hold_and_spare_scans():
    rng = np.random.default_rng(5)
    for _ in range(60):
        k, w = int(rng.integers(1, 9)), int(rng.integers(1, 5))
        x, book = rng.integers(-6, 7, (80, w)), rng.integers(-6, 7, (k, w))
        code, upper, lower = vector_codes.scan(x, book)
        for _ in range(4):  # small whole numbers: many ties, also between equal entries
            new = book + rng.integers(-1, 2, book.shape) * rng.integers(0, 2)
            code, upper, lower, _ = vector_codes.moved(x, code, upper, lower, book, new)
            d = vector_codes.distances(x, new)
            assert (code == d.argmin(axis=1)).all() and (upper >= np.sqrt(d.min(axis=1))).all()
            rest = np.where(np.arange(k) == code[:, None], np.iinfo(np.int64).max, d).min(axis=1)
            assert k == 1 or (lower <= np.sqrt(rest.astype(float))).all()
            book = new
    x = np.concatenate([rng.integers(0, 40, (500, 4)), rng.integers(900, 940, (500, 4))])
    book = np.array([[20] * 4, [920] * 4])
    state = vector_codes.scan(x, book)
    assert vector_codes.moved(x, *state, book, book + 3)[3] == 0


def test_codes_stand_for_vectors(spark):
    rows = vectors(120, 32)
    state, book = vector_codes.codebooks(spark.createDataFrame(rows, SCHEMA))
    near = {r.vec_id: r.approx for r in vector_codes.reconstructed(state, book).collect()}
    whole = {i: np.floor(256 * np.array(v)) for i, v, _ in rows}
    error = {r.vec_id: r.error for r in vector_codes.errors(state, book).collect()}
    assert all(round(((whole[i] - 256 * np.array(near[i])) ** 2).sum()) == error[i] for i in whole)
