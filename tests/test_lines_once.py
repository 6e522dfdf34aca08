"""Points move twice at most on their way to lines: to their segment, and as lines."""

import random
import time

from pyspark.sql import functions as F

from recordloom.operators import tables


def test_lines_are_numbered_over_segments_without_moving_points_again(spark):
    rng = random.Random(3)
    rows = [(k, x) for k in (1, 2, None) for x in rng.sample(range(400), 60)] + [(7, 5), (8, None)]
    points = spark.createDataFrame(rows, "k long, x long")
    for span in (7, 50, 100_000):
        got = {(r.k, r.line_no, r.first, r.last) for r in tables.group_lines(points.where("x is not null"), ["k"], 6, span).collect()}
        want = set()
        for k in (1, 2, None, 7):
            lines = []
            for x in sorted(x for j, x in rows if j == k and x is not None):
                if lines and x - lines[-1][1] <= 6:
                    lines[-1][1] = x
                else:
                    lines.append([x, x])
            want |= {(k, i, a, b) for i, (a, b) in enumerate(lines)}
        assert got == want
    plan = tables.group_lines(points, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(k" in line and "_segment" in line and "_nth" not in line for line in plan.splitlines()) <= 3 and plan.count("Join") == 1


def test_trimming_many_lines_is_not_their_square(spark):
    lines = [*range(0, 60_000, 10), 70_000]
    began = time.time()
    got = spark.createDataFrame([(lines,), ([],), ([5],), ([5, 90],), ([5, 5, 5, 9],), ([0, 10, 20, 100, 110],)], "x array<long>").select(tables.trim_outliers(F.col("x"), 1.5).alias("t")).collect()
    assert [r.t for r in got] == [lines[:-1], [], [5], [5, 90], [5, 5, 5, 9], [0, 10, 20, 100, 110]] and time.time() - began < 30
