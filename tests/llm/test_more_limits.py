"""Many languages, repeated items, held tones, long labelled texts and hot windows."""

import random
import tracemalloc

import numpy as np
import pyspark.sql.functions as F

from recordloom.llm import chroma, decontam, quality, simhash, suffix_dedup, toxicity
from tests.llm.test_operators import by, make


def test_thresholds_of_two_thousand_languages(spark, monkeypatch):
    rows = [(i, "a mild text" if i % 2 else "a nasty vile text", f"l{i % 2000}", "s", 0) for i in range(2400)]
    marks = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(2400)], "doc_id long, toxic int")
    real = toxicity.fit

    def fit(*a, **k):
        model = real(*a, **k)
        model["thresholds"] = {f"l{i}": 0.5 + (i % 40) / 100 for i in range(2000)}
        return model

    monkeypatch.setattr(toxicity, "fit", fit)
    found = toxicity.classify(make(spark, rows), marks).collect()
    assert len(found) == 2400 and all(abs(r.lang_threshold - (0.5 + (r.doc_id % 2000 % 40) / 100)) < 1e-9 for r in found)


def test_blocks_of_repeated_items_stay_small(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(40))
    items = spark.createDataFrame([(1, text)] * 10_000 + [(i, f"other item {i} " + text[: i % 60]) for i in range(2, 60)], "item_id long, text string")
    sizes, real = [], decontam.phrase_book

    def book(rows, window):
        sizes.append(sum(len(t) for _, t in rows))
        return real(rows, window)

    monkeypatch.setattr(decontam, "phrase_book", book)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1000)
    found = decontam.contamination(make(spark, [(1, "x " + text, "en", "a", 0), (2, "clean", "en", "a", 0)]), items).collect()
    assert max(sizes) <= 1000 and {r.doc_id: r.n_hit for r in found} == {1: 40, 2: 0}


def test_votes_of_a_held_tone(monkeypatch):
    n = 20_000  # ten minutes
    code, heard = np.full(n, 7, np.uint32).tobytes(), np.ones(n, np.uint8).tobytes()
    book = chroma.query_book([("q", code[: 4 * 2000], heard[:2000])])
    tracemalloc.start()
    assert chroma.vote(book, code, heard, 8) == [(0, -18_000, 2000)]
    assert chroma.vote(book, np.full(9, 8, np.uint32).tobytes(), np.ones(9, np.uint8).tobytes(), 1) == []
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 << 20
    rng = np.random.default_rng(1)
    codes = [rng.integers(0, 5, 60).astype(np.uint32) for _ in range(9)]
    book = chroma.query_book([(str(i), c.tobytes(), np.ones(60, np.uint8).tobytes()) for i, c in enumerate(codes[:4])])
    whole = [chroma.vote(book, c.tobytes(), np.ones(60, np.uint8).tobytes(), 3) for c in codes]
    monkeypatch.setattr(chroma, "HITS", 17)
    assert [chroma.vote(book, c.tobytes(), np.ones(60, np.uint8).tobytes(), 3) for c in codes] == whole


def test_labelled_texts_that_are_all_long(spark):
    rng = random.Random(3)
    line = {1: "a well written sentence with words and a full stop.\n", 0: "!!! $$$ click 1234 http://x\n"}
    rows = [(i, "".join(line[i % 2] if rng.random() < 0.9 else "neutral line here\n" for _ in range(800)), "en", "a", 0) for i in range(60)]
    docs, marks = make(spark, rows), spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    assert min(len(r[1]) for r in rows) > 16_000
    for out in (quality.classify(docs, marks), toxicity.classify(docs, marks)):
        assert len({round(r.score, 2) for r in out.collect()}) > 1
    good = {r.doc_id: r.score for r in quality.classify(docs, marks).collect()}
    assert min(good[i] for i in range(1, 60, 2)) > max(good[i] for i in range(0, 60, 2))


def test_a_hot_window_stays_where_it_is(spark, monkeypatch):
    rows = [(i, 0, i, b"hot" * 40) for i in range(20_000)] + [(i, 1, 5, b"w%d" % (i // 3)) for i in range(600)]
    windows = spark.createDataFrame(rows, "doc long, sub long, span long, window binary").repartition(8)
    seen, real = [], simhash.with_owner

    def watched(marked, owner, key, total):
        seen.append(owner.where(F.col("n") * simhash.HOT > total).count())
        return real(marked, owner, key, total)

    monkeypatch.setattr(suffix_dedup, "with_owner", watched)
    found = suffix_dedup.later_windows(windows).collect()
    assert seen == [1] and len(found) == 19_999 + 400
    assert by(tuple(r) for r in found if r["sub"] == 1) == by((i, 1, 5) for i in range(600) if i % 3)
