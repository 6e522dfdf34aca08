"""Components keep small tables in few files, so that a round is few tasks however many partitions a shuffle has."""

import random

from recordloom.llm import graph


def test_rounds_are_written_in_few_files(spark, monkeypatch):
    written, own = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: written.append(df := own(df)) or df)
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100)] + [(1000 + k, 1040) for k in range(60) if k != 40] + [(5000, 5000), (-7, 2**62), (2**62, -7)]
    rng.shuffle(edges)
    shuffles = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in shuffles}
    try:
        for k, v in shuffles.items():
            spark.conf.set(k, v)
        got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {k: 0 for k in range(101)} | {k: 1000 for k in range(1000, 1060)} | {-7: -7, 2**62: -7}
    assert all(df.rdd.getNumPartitions() <= graph.LEAST_FILES for df in written[1:])
