"""Bounds on memory, blocks and bins change no result."""

import random

import numpy as np
import pyspark.sql.functions as F

from recordloom.llm import chroma, decontam, suffix_dedup, tokens
from recordloom.llm.common import least_hashed
from tests.llm.test_operators import SCHEMA, benchmark_items, brute_contamination, brute_dedup, by, make, rows_of, small  # noqa: F401


class Watched:
    """Counts the broadcasts that are alive at once."""

    def __init__(self, sc, monkeypatch):
        self.alive, self.most, self.made, make_one = 0, 0, 0, sc.broadcast

        def broadcast(value):
            b = make_one(value)
            end = b.destroy
            self.alive, self.made = self.alive + 1, self.made + 1
            self.most = max(self.most, self.alive)

            def destroy(*a, **k):
                self.alive -= 1
                end(*a, **k)

            b.destroy = destroy
            return b

        monkeypatch.setattr(sc, "broadcast", broadcast)


def test_benchmark_blocks_one_at_a_time(spark, small, benchmark_items, monkeypatch):  # noqa: F811
    items = spark.createDataFrame(benchmark_items, "item_id long, text string")
    docs = make(spark, small + small[:5])
    whole = rows_of(decontam.contamination(docs, items), "doc_id", "n_words", "n_hit", "items_sha256", "spans", "word_spans")
    kept = rows_of(decontam.decontaminated(docs, items), *docs.columns)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 60)
    seen = Watched(spark.sparkContext, monkeypatch)
    parts = decontam.contamination(docs, items)
    assert seen.made > 3 and seen.most == 1 and seen.alive == 0
    assert rows_of(parts, "doc_id", "n_words", "n_hit", "items_sha256", "spans", "word_spans") == whole
    assert rows_of(decontam.decontaminated(docs, items), *docs.columns) == kept
    assert rows_of(parts, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == by(brute_contamination(small + small[:5], benchmark_items))


def test_words_that_share_a_hash(monkeypatch):
    real = decontam.word_hashes

    def same(data, starts, ends, seed=0):
        h = real(data, starts, ends, seed)
        return h if seed else np.zeros_like(h)

    monkeypatch.setattr(decontam, "word_hashes", same)
    assert decontam.phrase_book([("1", b"one two")], 10)["seed"] > 0


def test_query_blocks_one_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i * 50, rng.normal(size=64).tolist()) for i in range(20)]
    audio = chroma.recordings(spark.createDataFrame([*rows, (3, rows[2][1])], "vec_id long, embedding array<double>"))
    whole = by(chroma.align(audio).collect())
    monkeypatch.setattr(chroma, "QUERY_BYTES", 1000)
    seen = Watched(spark.sparkContext, monkeypatch)
    assert by(chroma.align(audio).collect()) == whole
    assert seen.made > 3 and seen.most == 1 and seen.alive == 0


def common_line_docs(n):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    footer = "this is one common footer of a site ~~~~"
    docs = [(d, " ".join([*(word() for _ in range(30)), footer, *(word() for _ in range(30))]).encode()) for d in range(n)]
    again = [(n + k, docs[k][1][100:] + b" " + docs[k + 1][1][:150]) for k in range(0, n, 10)]
    return docs + again


def test_an_anchor_that_all_documents_share(spark):
    docs = common_line_docs(1500)
    df = make(spark, [(d, t.decode(), "en", "s", 0) for d, t in docs])
    want = brute_dedup(docs, 100)
    for sizes in ({}, {"bin_bytes": 20_000}, {"bin_bytes": 20_000, "most_parts": 3}, {"bin_bytes": 5_000_000, "most_parts": 2}):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.substring_dedup(df, **sizes).collect()}
        assert got == want, sizes


def test_a_bin_stays_small():
    docs = common_line_docs(1500)
    data = np.frombuffer(b"".join(t for _, t in docs), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for _, t in docs])])
    first, last, at, h = suffix_dedup.stretches(data, off, 100, 20)
    row = np.searchsorted(off, first, "right") - 1
    items = np.empty(len(first), suffix_dedup.FIELDS)
    items["doc"], items["sub"], items["at"], items["a"], items["b"] = row, 0, at - off[row], at - first, last + 100 - at
    held, given = suffix_dedup.Bin(100, 20, 10_000), 0
    for i in range(0, len(items), 500):
        part = np.arange(i, min(len(items), i + 500))
        _, blobs = suffix_dedup._blobs(np.zeros(len(part), np.int64), items[part], data, first[part])
        for rows, text in held.add(blobs[0]):
            given += len(rows) if text is not None else 0
    list(held.close())
    left = suffix_dedup.anchor_hashes(held.text[0], suffix_dedup._begins(held.items[0])[0], held.items[0], 20)
    lens = suffix_dedup._begins(held.items[0])[1]
    assert given > 300 and max(lens[left == x].sum() for x in np.unique(left)) <= 10_000


def test_partitions_do_not_follow_the_input(spark):
    df = make(spark, [(d, t.decode(), "en", "s", 0) for d, t in common_line_docs(200)])
    sizes = []
    place = type(df).repartitionById

    def noted(self, n, by):
        sizes.append(n)
        return place(self, n, by)

    try:
        type(df).repartitionById = noted
        suffix_dedup.substring_dedup(df, bin_bytes=2000, most_parts=10)
    finally:
        type(df).repartitionById = place
    assert sizes == [10]


def test_edits_of_one_leaf_are_made_together():
    enc, rng = tokens.encoder(), random.Random(11)
    letters = "ab cd  \n\t.,!'s 12é日x  ll"
    text_of = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(80):
        text = text_of(rng.choice([0, 3, 50, 2000, 6000]))
        places = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.choice([1, 2, 5, 40]))))
        edits = [(a, b, text_of(rng.choice([0, 1, 4, 40]))) for a, b in zip(places[::2], places[1::2], strict=False)]
        new, at = [], 0
        for a, b, ins in edits:
            new += [text[at:a], ins]
            at = b
        want = "".join([*new, text[at:]])
        tree = tokens.Tree(text, enc)
        enc.encoded = 0
        tree.edit_all(edits)
        assert (tree.text(), tree.n_tokens, tree.n_chars) == (want, len(enc.bpe.encode_ordinary(want)), len(want))
        assert enc.encoded <= len(tokens.CUT.findall(want)) + tokens.LEAF


def test_counts_document_by_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    enc = tokens.encoder()
    got = {r.doc_id: r for r in tokens.token_counts(docs).collect()}
    for d in docs.collect():
        edits, new, at = tokens.standard_edits(d.text or ""), [], 0
        for a, b, ins in edits:
            new += [d.text[at:a], ins]
            at = b
        after = "".join([*new, (d.text or "")[at:]])
        r, words = got[d.doc_id], tokens.CUT.findall(d.text or "")
        assert (r.n_tokens, r.n_edits, r.n_pretokens, r.n_tokens_after) == (len(enc.bpe.encode_ordinary(d.text or "")), len(edits), len(words), len(enc.bpe.encode_ordinary(after)))
        assert (r.n_reencoded > 0) == bool(edits and (words or after))
        if len(edits) == 1 and len(words) > 10 * tokens.LEAF:
            assert r.n_reencoded <= 4 * tokens.LEAF


def test_least_hashed_rows_of_each_class(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("mark"), (F.col("id") % 97 == 0).cast("long").alias("y"))
    hashes = {r[0]: r[1] for r in rows.select("doc_id", F.xxhash64("doc_id")).collect()}
    picked = least_hashed(rows, "y", 150)
    for c in (0, 1):
        ids = sorted((i for i in hashes if (i % 97 == 0) == bool(c)), key=lambda i: (hashes[i], i))[:150]
        assert [p[0] for p in picked if p[2] == c] == ids
    assert len(least_hashed(rows, "y", 150, 20)) == 20


def test_ids_that_several_texts_share(spark):
    from recordloom.llm import langid

    rows = [(i // 2, f"{'anna otto ' if i % 2 else 'lala lili '}{i}", "xx" if i % 2 else "yy", "s", 0) for i in range(200)]
    a, b = (langid.fit(make(spark, r)) for r in (rows, rows[::-1]))
    assert a["langs"] == b["langs"] and np.array_equal(a["matrix"], b["matrix"])
    assert make(spark, rows).schema == make(spark, rows[:1]).schema and SCHEMA
