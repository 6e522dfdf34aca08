"""The near-copies stage goes through op 10's SimHash balls first; what they propose is compared exactly."""

import random

from pyspark.sql import functions as F

from recordloom.llm import near_copies


def test_balls_propose_and_sets_decide(spark):
    rng = random.Random(2)
    word = lambda: "w" + str(rng.randrange(100_000))
    base = [word() for _ in range(20_000)]
    rows = [(0, " ".join(base)), (1, " ".join([*base[:-1], "other"])), (2, " ".join(word() for _ in range(900))), (3, ""), (4, None), (5, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = near_copies.marks(docs).groupBy("node").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"))
    first = {r.node: r.first for r in nodes.collect()}
    found = near_copies.ball_links(nodes, docs)
    assert {frozenset((first[r.a], first[r.b])) for r in found.collect()} == {frozenset((0, 1))}
    # one fingerprint for all: every pair is proposed, and the same one stays
    found = near_copies.ball_links(nodes.withColumn("fp", F.lit(7).cast("long")), docs)
    assert {frozenset((first[r.a], first[r.b])) for r in found.collect()} <= {frozenset((0, 1))}
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == [0, 2, 3, 5]


def test_texts_move_once_for_balls_and_bands(spark, monkeypatch):
    rng, asked, own = random.Random(4), [], near_copies.sets_of
    monkeypatch.setattr(near_copies, "sets_of", lambda docs, ids: asked.append(ids.count()) or own(docs, ids))
    base, other = (["w" + str(rng.randrange(100_000)) for _ in range(n)] for n in (9000, 100))
    rows = [(0, " ".join(base)), (1, " ".join([*base[:-1], "x"])), (2, " ".join(other)), (3, " ".join([*other[:-3], "x", "y", "z"])), (4, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == [0, 2, 4]
    assert asked == [4]  # balls have two of them, bands all four: each set is made once
