"""Texts matched and assigned within their group, by one shuffle."""

import random

from pyspark.sql import functions as F

from recordloom.functions import fuzzy
from recordloom.operators import matching
from recordloom.plans import extract, receipts


def test_a_cover_is_read_by_one_shuffle(spark):
    rows = [(1, 0, "* Vendor Name", "Ann"), (1, 1, "vendor name", "Bob"), (1, 2, "PO Number :", "4500 A"), (2, 0, "nothing known", "x"), (2, 1, None, "y"), (3, 0, "Invoice Amount", None)]
    found = extract.cover_records(spark.createDataFrame(rows, "doc_id long, idx int, label string, value string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = {r.doc_id: (r.vendor_name, r.po_number, r.barcode_number) for r in found.collect()}
    assert got == {1: ("Ann", "4500", None), 2: (None, None, None), 3: (None, None, None)}


def test_synonyms_lose_no_match_and_score_texts_alike_once(monkeypatch):
    rng, calls = random.Random(5), []
    texts = ["".join(rng.choice("lr no truckzy7.") for _ in range(rng.randint(0, 14))) for _ in range(300)] + ["lr no", "truck no", "lorry  tare wt", "stamp"]
    plain = fuzzy.score
    monkeypatch.setattr(fuzzy, "score", lambda a, b: calls.append((a, b)) or plain(a, b))
    for threshold in (60.0, 82.0):
        s = fuzzy.Synonyms(receipts.ANCHORS, threshold)
        best = lambda t: [(k, x) for k, ss in enumerate(receipts.ANCHORS.values()) if (x := max(plain(t, y) for y in ss)) >= threshold]
        assert [sorted(m) for m in s.matches(texts)] == [best(t) for t in texts]
    calls.clear()
    s.matches(texts * 50)
    assert not calls


def test_guards_are_those_of_the_columns(spark):
    texts = ["lr no", "lr no 12345678901234567890", "l r n o", "xx lr no yy zz qq", "no", "lr-no.", "١٢ lr"]
    for guard in ("solid", "alnum"):
        s = fuzzy.Synonyms({"f": ["lr no", "lorry receipt"]}, 0.0, guard)
        want = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(matching.guarded(F.col("t"), F.lit("f"), {"f": ["lr no", "lorry receipt"]}, guard)).collect()]
        assert [s.guards(t, 0) for t in texts] == want
