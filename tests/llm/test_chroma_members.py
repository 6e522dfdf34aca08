"""Which recordings a class of equal fingerprints has."""

import numpy as np

from recordloom.llm import chroma


def test_audio_membership(spark):
    rng = np.random.default_rng(5)
    v = [rng.normal(size=64).tolist() for _ in range(4)]
    rows = [(0, v[0]), (7, v[0]), (137, v[0]), (3, v[1]), (5, v[1]), (100, v[2]), (None, [*v[2][16:], *v[3][:16]])]
    got = chroma.align_with_members(chroma.recordings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).collect()
    of = {}
    for r in got:
        if r.kind == "member":
            of.setdefault(r.class_id, []).append(r.vec_id)
    assert sorted(map(str, (sorted(x, key=str) for x in of.values()))) == sorted(map(str, [[0, 137, 7], [3, 5], [100], [None]]))
    links = {(r.query_id, m) for r in got if r.kind == "match" for m in of[r.class_id]}
    assert {(0, 0), (0, 7), (0, 137), (100, 100), (100, None)} <= links
