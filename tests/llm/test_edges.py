"""Empty tables, clashing columns, very long texts and awkward rows for every operator and stage."""

import pytest

import corpus_pipeline
from recordloom.llm import chat, chroma, decontam, langid, near_copies, quality, simhash, suffix_dedup, tokens, toxicity
from tests.llm.test_operators import CLASH, CLASH_VALUES, SCHEMA, awkward, benchmark_items, by, clashing, labels, make, small  # noqa: F401


def test_empty_tables(spark, small, benchmark_items):  # noqa: F811
    none, docs = make(spark, []), make(spark, small)
    items = spark.createDataFrame(benchmark_items, "item_id long, text string")
    assert decontam.contamination(none, items).count() == 0
    clean = decontam.contamination(docs, items.where("false")).collect()
    assert len(clean) == len(small) and not any(r.contaminated or r.items or r.spans for r in clean)
    assert by(decontam.decontaminated(docs, items.where("false")).drop("n_chars").collect()) == by(docs.drop("n_chars").collect())
    assert tokens.token_counts(none).count() == simhash.simhash_components(none).count() == near_copies.similar_components(none).count() == 0
    audio = chroma.recordings(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert chroma.align(audio).count() == chroma.align_with_members(audio).count() == 0


def test_columns_with_clashing_names(spark, small, labels, benchmark_items):  # noqa: F811
    docs, plain = clashing(spark, small), make(spark, small)
    items = spark.createDataFrame(benchmark_items, "item_id long, text string")
    for f in (tokens.token_counts, lambda d: quality.classify(d, labels), lambda d: toxicity.classify(d, labels), langid.detect, suffix_dedup.substring_dedup, simhash.simhash_components, near_copies.similar_components, lambda d: decontam.contamination(d, items)):
        assert by(map(str, f(docs).collect())) == by(map(str, f(plain).collect()))
    turns = [(c, t, ("user", "assistant")[t], f"text {c} {t}") for c in range(3) for t in (0, 1)]
    more = spark.createDataFrame([(*r, *CLASH_VALUES) for r in turns], "conv_id long, turn long, role string, text string" + CLASH)
    assert by(chat.chat_digests(more).collect()) == by(chat.chat_digests(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect())
    vectors = [(i * 100, [float(i * j % 7) for j in range(40)]) for i in range(4)]
    more = spark.createDataFrame([(*r, *CLASH_VALUES, "c", b"d") for r in vectors], "vec_id long, embedding array<double>" + CLASH + ", class_id string, code binary")
    one = chroma.align_with_members(chroma.recordings(more)).collect()
    assert by(one) == by(chroma.align_with_members(chroma.recordings(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))).collect())


def test_texts_longer_than_a_batch(spark, labels, benchmark_items):  # noqa: F811
    words = " ".join(f"w{i % 99_991}x{i // 99_991}" for i in range(1_150_000))
    assert len(words) > 9_000_000
    rows = [(1, words, "en", "a", 0), (2, "a short one " * 9, "en", "a", 0), (3, words[-500:], "en", "b", 0), (4, "a line of good text.\n" * 3, "fr", "b", 0)]
    docs = make(spark, rows)
    items = spark.createDataFrame([(1, " ".join(words.split()[-12:]))], "item_id long, text string")
    found = {r.doc_id: r for r in decontam.contamination(docs, items).collect()}
    assert (found[1].n_words, found[1].n_hit, found[3].n_hit, found[2].n_hit) == (1_150_000, 12, 12, 0)
    cut = {r.doc_id: r for r in suffix_dedup.substring_dedup(docs).collect()}
    assert cut[1].n_removed == 0 and cut[3].n_removed == 500 and cut[1].n_bytes == len(words)
    assert {r.doc_id: r.fingerprint for r in simhash.simhash_components(docs).collect()}[1] == f"{simhash.fingerprint(words.encode()):016x}"
    for out in (quality.classify(docs, labels), toxicity.classify(docs, labels), langid.detect(docs)):
        assert len(out.collect()) == 4


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows, marks, items):
        make(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
        marks.write.parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return write


def test_pipeline_on_awkward_rows(spark, awkward, labels, benchmark_items, folder):  # noqa: F811
    sf_dir = folder(awkward, labels.where("false"), benchmark_items)
    docs = corpus_pipeline.table(spark, sf_dir, "documents")
    kept = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    assert by(kept.collect()) == by(docs.collect())
    once = corpus_pipeline.near_copies_stage(spark, kept, sf_dir).collect()
    assert sorted(str(r.doc_id) for r in once) == sorted(["1", "None", "4", "4", "5", "6", "7"])
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [*docs.columns, "copy"] and out.count() > 0


def test_pipeline_on_an_empty_table(spark, labels, benchmark_items, folder):  # noqa: F811
    assert corpus_pipeline.run(spark, folder([], labels, benchmark_items)).count() == 0
    assert SCHEMA
