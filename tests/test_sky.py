import math

from pyspark.sql import functions as F

from almagest.operators import sky

SRC = "id bigint, ra_deg double, dec_deg double, ra double, code string"
BOX = "id bigint, ra_min double, ra_max double, dec_min double, dec_max double"


def sep(a, b):
    (r1, d1), (r2, d2) = [(math.radians(x), math.radians(y)) for x, y in (a, b)]
    h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((r2 - r1) / 2) ** 2
    return math.degrees(2 * math.asin(math.sqrt(h))) * 3600


def test_near_against_all_pairs(spark):
    import random

    rnd = random.Random(3)
    pts = [(i, rnd.uniform(0, 0.05), rnd.uniform(-0.03, 0.03)) for i in range(150)]
    pts += [(200 + i, rnd.uniform(0, 360), 90 - rnd.uniform(0, 0.01)) for i in range(60)]
    pts += [(300, 359.9999, 10.0), (301, 0.0001, 10.0), (302, 360.0, 10.0), (303, -359.9999, 10.0)]
    rows = [(i, r, d, 1.0, "x") for i, r, d in pts] + [(900, None, 1.0, None, None), (901, float("nan"), 1.0, None, None), (902, 1.0, 99.0, None, None), (903, 1.0, float("inf"), None, None)]
    got = {(r.id_a, r.id_b) for r in sky.near_pairs(sky.positions(spark.createDataFrame(rows, SRC), "id"), 30.0).collect()}
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and sep(a[1:], b[1:]) <= 30.0}
    assert got == want and (300, 301) in got


def test_repeated_points_and_boxes_count(spark):
    p = sky.positions(spark.createDataFrame([(1, 5.0, 5.0, None, None), (2, 5.0, 5.0, None, None), (3, 5.0, -90.0, None, None), (4, 100.0, 90.0, None, None)], SRC), "id")
    b = sky.boxes(spark.createDataFrame([(7, 5.0, 5.0, 5.0, 5.0), (8, 5.0, 5.0, 5.0, 5.0), (9, 350.0, 10.0, -90.0, 90.0), (10, 4.0, 6.0, 6.0, 4.0), (11, None, 1.0, 1.0, 2.0), (12, 0.0, 359.999, 80.0, 90.0)], BOX), "id")
    assert sorted(map(tuple, sky.near_pairs(p, 30).select("id_a", "id_b").collect())) == [(1, 2)]
    assert sorted(map(tuple, sky.inside_boxes(p, b).collect())) == [(1, 7), (1, 8), (1, 9), (2, 7), (2, 8), (2, 9), (3, 9), (4, 12)]


def test_boxes_against_plain_test(spark):
    import random

    rnd = random.Random(5)
    pts = [(i, rnd.uniform(-360, 720), rnd.uniform(-90, 90)) for i in range(300)]
    bx = [(i, a := rnd.uniform(-10, 370), a + rnd.choice([0.01, 3, 90, 300]), d := rnd.uniform(-90, 89), min(90.0, d + rnd.choice([0.01, 2, 60, 180]))) for i in range(80)]
    got = sorted(map(tuple, sky.inside_boxes(sky.positions(spark.createDataFrame([(*p, None, None) for p in pts], SRC), "id"), sky.boxes(spark.createDataFrame(bx, BOX), "id")).collect()))
    inside = lambda r, a, z: a <= r <= z if a <= z else r >= a or r <= z
    assert got == sorted((p, b) for p, r, d in pts for b, a, z, lo, hi in bx if lo <= d <= hi and inside(r % 360, a % 360, z % 360))


def test_empty(spark):
    s, r = spark.createDataFrame([], SRC), spark.createDataFrame([], BOX)
    assert sky.found(s, r).count() == 0
    assert sky.cone(sky.positions(s, "id"), 1, 2, 3).count() == 0
    assert sky.found(s, r).select(F.count("*")).first()[0] == 0
