import random

from pyspark.sql import functions as F

from pagewright.functions import geometry
from pagewright.operators.documents import scale_of

BOX = "struct<l: double, t: double, r: double, b: double>"


def test_iou(spark):
    boxes = [(0.0, 0.0, 10.0, 10.0), (10.0, 0.0, 20.0, 10.0), (2.0, 2.0, 4.0, 4.0), (5.0, 5.0, 5.0, 5.0), (9.0, 9.0, 1.0, 1.0), (5.0, 0.0, 15.0, 10.0)]
    df = spark.createDataFrame([(a, b) for a in boxes for b in boxes], f"a {BOX}, b {BOX}")
    for r in df.select("a", "b", geometry.iou(F.col("a"), F.col("b")).alias("x"), geometry.iou(F.col("b"), F.col("a")).alias("y")).collect():
        assert abs(r.x - geometry.py_iou(tuple(r.a), tuple(r.b))) < 1e-12 and r.x == r.y and 0 <= r.x <= 1


def brute(pred, base, threshold):
    scored = sorted(((geometry.py_iou(p, b), i, j) for i, p in enumerate(pred) for j, b in enumerate(base)), reverse=True)
    out, left, right = [], set(), set()
    for x, i, j in scored:
        if x >= threshold and i not in left and j not in right:
            out.append((i, j))
            left.add(i)
            right.add(j)
    return out


def test_greedy_matching(spark):
    pick = random.Random(8)
    box = lambda: (lambda l, t: (l, t, l + pick.choice([2.0, 4.0]), t + 4.0))(float(pick.randint(0, 6)), float(pick.randint(0, 3)))
    cases = [([box() for _ in range(pick.randint(0, 7))], [box() for _ in range(pick.randint(0, 7))]) for _ in range(60)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, p array<{BOX}>, b array<{BOX}>")
    got = {r.i: [(m.p, m.q) for m in r.m] for r in df.select("i", geometry.greedy_matches(F.col("p"), F.col("b"), 0.25).alias("m")).collect()}
    for i, (p, b) in enumerate(cases):
        assert got[i] == brute(p, b, 0.25)


REGION = f"array<struct<n: int, bbox: {BOX}, reading_order: bigint, score: double>>"


def order(spark, regions):
    df = spark.createDataFrame([([(i, (float(l), float(t), l + 9.0, t + 9.0), o, 1.0) for i, (l, t, o) in enumerate(regions)],)], f"r {REGION}")
    return [x.n for x in df.select(geometry.in_reading_order(F.col("r")).alias("r")).first().r]


def test_reading_order(spark):
    assert order(spark, [(0, 0, 2), (0, 0, 1)]) == [1, 0]
    assert order(spark, [(0, 300, 1), (5, 0, None)]) == [1, 0]  # one lacks an order: all by place
    assert order(spark, [(9, 24, None), (5, 25, None), (1, 26, None), (0, 75, None)]) == [1, 0, 2, 3]  # 25 goes to band 0, 75 to 100
    assert order(spark, [(3, 0, 1), (3, 0, 1)]) == [0, 1]


def test_region_filters(spark):
    df = spark.createDataFrame([([(0, (0.0, 0.0, 64.0, 64.0), None, 0.5), (1, (0.0, 0.0, 63.0, 65.0), None, 0.49), (2, (9.0, 0.0, 0.0, 900.0), None, 0.9), (3, (0.0, 0.0, 4097.0, 1.0), None, 0.1)],)], f"r {REGION}")
    row = df.select(geometry.large_enough(F.col("r")).alias("a"), geometry.certain(F.col("r")).alias("b")).first()
    assert [x.n for x in row.a] == [0, 3] and [x.n for x in row.b] == [0, 2]


def test_resizing(spark):
    sizes = [(1000, 800), (5000, 7000), (30, 20), (14, 14), (42, 70), (0, 10), (28, 28), (3360, 3360), (2240, 1680)]
    box = F.struct(*[F.lit(float(k)).alias(c) for k, c in enumerate("ltrb", 1)])
    df = spark.createDataFrame(sizes, "h long, w long")
    for r in df.select("h", "w", geometry.rescaled(box, F.col("h"), F.col("w")).alias("x")).collect():
        scale = scale_of(r.h, r.w)
        sx, sy = scale or (1, 1)
        assert all(abs(a - b) < 1e-9 for a, b in zip(r.x, (1 * sx, 2 * sy, 3 * sx, 4 * sy), strict=True)), r
