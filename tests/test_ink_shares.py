import random

from pyspark.sql import functions as F

from recordloom.operators import bands, zones


def test_shares_of_a_batch_are_those_of_each_row(spark):
    rng = random.Random(2)
    rows = [([rng.choice((0, 0, rng.randint(0, 90))) for _ in range(256)],) for _ in range(40)] + [([0] * 256,), ([],), (None,), ([5],), ([3, 0, 4],), ([1, None, 2],)]
    t = spark.createDataFrame(rows, "levels array<bigint>").withColumn("share", bands.ink_shares()(F.col("levels")))
    got = t.select("share", zones.ink_share(F.col("levels")).alias("plain")).collect()
    assert [round(r.share, 9) for r in got] == [round(r.plain, 9) for r in got]


def test_the_query_shares_its_work_among_tasks(spark):
    from recordloom.catalog import library_queries

    plan = library_queries()["ink_share"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and "aggregate(" not in plan


def test_ink_of_a_page_is_added_in_batches(spark):
    from recordloom.operators import pages
    from recordloom.plans import derive_pages, receipts

    rng, tile = random.Random(3), lambda x, levels: (float(x), 0.0, float(x) + 10, 10.0, levels)
    some = lambda n: [rng.choice((0, 0, rng.randint(0, 90), None)) for _ in range(n)]
    rows = [(i, [tile(x, some(256)) for x in range(0, 40, 10)]) for i in range(20)] + [(30, []), (31, [tile(0, [])]), (32, [tile(0, some(9)), tile(90, some(256))]), (33, [tile(0, None), tile(10, some(256))]), (34, [tile(0, some(300))])]
    p = spark.createDataFrame(rows, f"doc_id int, tiles array<{pages.TILE}>")
    area = pages.zone(F.lit(0), F.lit(0), F.lit(29), F.lit(20))
    inside = F.filter("tiles", lambda t: t["x1"] < 25)
    added = F.aggregate(F.transform(inside, lambda t: t["levels"]), F.array_repeat(F.lit(0).cast("long"), 256), lambda a, x: F.zip_with(a, x, lambda m, n: m + F.coalesce(n, F.lit(0))))
    got = pages.with_ink(p.withColumn("none", F.lit(None).cast("struct<x1: double, y1: double, x2: double, y2: double>")), a=area, b=F.col("none")).select("a", "b", zones.ink_share(added).alias("plain")).collect()
    assert [round(r.a, 9) for r in got] == [round(r.plain, 9) for r in got] and {r.b for r in got} == {0.0} and len({r.a for r in got}) > 15
    plan = receipts.zoned(pages.gathered(**derive_pages.receipt_pages(spark, "/root/testdata/sf0.001")))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(transform(filter(tiles" not in plan and plan.count("ArrowEvalPython") >= 3
