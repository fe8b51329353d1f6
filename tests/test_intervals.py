"""Ranges and boxes against all pairs in plain Python, on hot pages too."""

import random

from pyspark.sql import functions as F

from veilspark.operators import intervals, proposals, recognition

RANGES = "doc_id long, page int, start int, stop int, k int"


def test_touched_against_all_pairs(spark):
    random.seed(1)
    place = lambda: (lambda a: (a, a + random.choice((0, 1, 3, 50, 5000))))(random.choice((0, 5, 4095, 4096, 4097, 9000, random.randint(0, 20_000))))
    row = lambda k: (random.choice((1, 1, 1, 2, None)), random.choice((1, 1, 2)), *place(), k)
    asked, rules = [row(k) for k in range(500)], [row(k) for k in range(60)]
    want = {k: any((d, p) == (x, y) and d is not None and s < b and a < e for x, y, a, b, _ in rules) for d, p, s, e, k in asked}
    for block in (intervals.BLOCK, 7):
        got = intervals.touched(spark.createDataFrame(asked, RANGES), spark.createDataFrame(rules, RANGES), block=block).collect()
        assert {r["k"]: r["touched"] for r in got} == want and len(got) == 500
    assert 50 < sum(want.values()) < 450
    none = spark.createDataFrame([], RANGES)
    assert proposals.not_covered(none, spark.createDataFrame(rules, RANGES)).count() == 0 and proposals.not_covered(spark.createDataFrame(asked, RANGES), none).count() == 500


def test_a_page_that_holds_all_ranges(spark):
    """A hundred thousand ranges of one page, a third of them at one place."""
    n = 100_000
    every = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 10).alias("start"), "id")
    rules = every.withColumn("stop", F.col("start") + 5)
    asked = every.withColumn("start", F.col("start") + F.when(F.col("id") % 2 == 0, 5).otherwise(0)).withColumn("stop", F.col("start") + 2)
    got = {r["id"] for r in proposals.not_covered(asked, rules).select("id").collect()}
    starts = [7 if i % 3 == 0 else 10 * i for i in range(n)]
    held = set(starts)
    want = {i for i in range(n) if not any(s in held for s in range(starts[i] + (5 if i % 2 == 0 else 0) - 4, starts[i] + (5 if i % 2 == 0 else 0) + 2))}
    assert got == want and len(want) > 1000


def test_boxes_against_all_pairs(spark):
    random.seed(6)
    def box():
        size = random.choice((0.0, 1.0, 9.0, 16.0, 17.0, 300.0, 40_000.0))
        return (random.choice((0.0, 16.0, 32.0, -16.0, random.uniform(-100, 400))), random.uniform(-100, 400), size, random.choice((size, 4.0)))

    schema = "doc_id long, page int, {0} struct<k:int,box:struct<x:double,y:double,w:double,h:double>>"
    a, b = ([(1 if k % 4 else 2, 1, (k, box() if k != 5 else None)) for k in range(220)] for _ in range(2))
    met = intervals.met_boxes(spark.createDataFrame(a, schema.format("a")), spark.createDataFrame(b, schema.format("b"))).select("a", "b", intervals.agrees(F.col("a.box"), F.col("b.box")).alias("agrees"), intervals.contains(F.col("a.box"), F.col("b.box")).alias("holds")).collect()
    got = sorted((r["a"]["k"], r["b"]["k"]) for r in met)
    touch = lambda x, y: x[0] < y[0] + y[2] and y[0] < x[0] + x[2] and x[1] < y[1] + y[3] and y[1] < x[1] + x[3]
    want = sorted((i[2][0], j[2][0]) for i in a for j in b if i[0] == j[0] and i[2][1] and j[2][1] and (touch(i[2][1], j[2][1]) or recognition.contains(i[2][1], j[2][1]) or recognition.contains(j[2][1], i[2][1])))
    assert got == want and len(want) > 300
    for r in met:
        x, y = (tuple(r[n]["box"]) for n in "ab")
        assert r["agrees"] == recognition.agrees(x, y) and r["holds"] == recognition.contains(x, y)


def test_boxes_of_tokens(spark):
    tokens = [(1, 1, 0, 0, 4, (0.0, 0.0, 40.0, 10.0)), (1, 1, 0, 5, 60, (50.0, 1.0, 500.0, 8.0)), (1, 1, 0, 61, 64, (600.0, 0.0, 30.0, 10.0)), (1, 1, 1, 0, 4, (0.0, 20.0, 40.0, 10.0))]
    hits = [(1, 1, 0, 1, 2, 5), (1, 1, 0, 2, 3, 62), (1, 1, 0, 3, 4, 5), (1, 1, 1, 1, 0, 1), (2, 1, 0, 1, 0, 4)]
    got = {(r["doc_id"], r["line"], r["hit"]): r["box"] and tuple(r["box"]) for r in intervals.boxes_covering(spark.createDataFrame(hits, "doc_id long, page int, line int, hit int, start int, stop int"), spark.createDataFrame(tokens, "doc_id long, page int, line int, start int, stop int, box struct<x:double,y:double,w:double,h:double>")).collect()}
    assert got == {(1, 0, 1): (0.0, 0.0, 40.0, 10.0), (1, 0, 2): (0.0, 0.0, 630.0, 10.0), (1, 0, 3): None, (1, 1, 1): (0.0, 20.0, 40.0, 10.0), (2, 0, 1): None}
