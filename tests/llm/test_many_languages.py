"""Many languages: all are learned, by an equal part of the rows."""

from recordloom.llm import langid


def test_every_language_is_learned_and_predicted(spark):
    rows = [(70 * k + c, f"{chr(0x4E00 + 9 * c)}{chr(0x4E03 + 9 * c)} " * (3 + k), f"l{c:02}") for k in range(5) for c in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names = [f"l{c:02}" for c in range(70)]
    assert langid.fit(docs, landmarks=2)["langs"] == names
    assert langid.fit(docs, most_rows=140, most_landmarks=70)["langs"] == names
    assert {r.lang_pred for r in langid.detect(docs).collect()} == set(names)
