"""Survivors of SimHash components whose ids are null or repeat."""

from recordloom.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_keep_one_whatever_the_ids(spark):
    texts = ["the first of many texts here", "a second one that differs", "some third text with other words"]
    rows = [(None, t, "en", "a", 0) for t in texts] + [(None, texts[0], "fr", "b", 0), (1, "one more under this id", "en", "a", 0), (1, "quite another under this id", "en", "b", 0)]
    left = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.text for r in left) == sorted({r[1] for r in rows})
