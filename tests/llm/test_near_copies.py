"""The near-copies stage against brute force."""

import random
import re

import corpus_pipeline
from recordloom.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_near(rows, percent=80):
    """The smallest id of each component of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").lower().encode())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    label = list(range(len(rows)))
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    for i in order:
        for j in order:
            c = len(sets[i] & sets[j])
            if label[i] != label[j] and (sets[i] == sets[j] or 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c)):
                old, new = label[j], label[i]
                label = [new if x == old else x for x in label]
    return {min(rows[k][0] for k in range(len(rows)) if label[k] == x) for x in set(label)}


def test_near_copies_stage_takes_shingle_similarity(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    edited = [*base[:60], "other", *base[61:140], "words", *base[141:]]  # 10 of 196 shingles differ: 186 / 206
    far = [f"x{k}" if k % 25 == 0 else w for k, w in enumerate(base)]
    texts = [" ".join(base), " ".join(edited), " ".join(far), "short one", "Short  ONE", "", None]
    docs = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in enumerate(texts)], SCHEMA)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_copies_stage(spark, docs, "").collect())
    assert (simhash.fingerprint(texts[0].encode()) ^ simhash.fingerprint(texts[1].encode())).bit_count() > 2
    assert kept == [0, 2, 3, 5]


def test_large_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    monkeypatch.setattr(near_copies, "CHUNK", 5)
    monkeypatch.setattr(near_copies, "EACH", 1)
    rng = random.Random(3)
    base, rows = [f"w{k}" for k in range(100)], []
    for k in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(100)] = f"e{rng.randrange(1000)}"
        rows.append((k, " ".join(w)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(96)} for _, t in rows]
    label = list(range(120))
    for i in range(120):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    got = near_copies.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(label)) and 1 < len(set(label)) < 100


def test_near_copies_keep_one_whatever_the_ids(spark):
    texts = ["the first of many texts here", "a second one that differs", "some third text with other words"]
    rows = [(None, t, "en", "a", 0) for t in texts] + [(None, texts[0], "fr", "b", 0), (1, "one more under this id", "en", "a", 0), (1, "quite another under this id", "en", "b", 0)]
    left = near_copies.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.text for r in left) == sorted({r[1] for r in rows})
