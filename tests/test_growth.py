"""Operators on what larger tables bring: other letters, many rows at one place, dense shapes, clusters."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions import scalar


@pytest.mark.parametrize("text,want", [("èles", True), ("leséelle", True), ("x DER.", True), ("les_", False), ("tales", False), ("9les", False), (None, False)])
def test_code_mask_has_ascii_words(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(scalar.code_mask(F.col("t"), ["the", "der", "les"])).first()[0]
    assert got is want


def test_code_mask_is_that_of_sql(spark, duck):
    texts = ["les", "le\u017f x", "le\u017fx", "the\u00e9", "the\u0301", "\u0130the", "THE", "a\nthe\nb", "a-the", "a.b the"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(scalar.code_mask(F.col("t"), ["the", "der", "les"])).collect()]
    assert got == [duck.execute(r"SELECT regexp_matches(?, '(?i)\b(?:the|der|les)\b')", [t]).fetchone()[0] for t in texts]


def test_nearest_compares_places(spark, monkeypatch):
    """Many points at few places form no more pairs than one point each would."""
    from lodestar.operators import spatial

    formed = []
    real = spatial.within_radius

    def counted(*args, **kw):
        pairs = real(*args, **kw)
        formed.append(pairs.count())
        return pairs

    monkeypatch.setattr(spatial, "within_radius", counted)
    left = spark.range(4000).selectExpr("id", "cast(id % 8 as double) x", "cast(id % 5 as double) y")
    right = spark.range(2000).selectExpr("id k", "cast(id % 10 as double) x", "cast(id % 4 as double) y", "id % 3 c")
    brute = left.crossJoin(right.toDF("k", "rx", "ry", "c")).withColumn("d", F.expr("sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry))"))
    want = {r.id: (r.b.k, r.b.d) for r in brute.groupBy("id").agg(F.min(F.struct("d", "k")).alias("b")).collect()}
    for got in (spatial.nearest_within(left, right, 3.0, "id", "k"), spatial.nearest(left, right, "id", "k", 0.5)):
        assert {r.id: (r.near_id, r.near_d) for r in got.collect()} == want
    far = spatial.nearest_within(left.withColumn("x", F.col("x") + 50), right, 3.0, "id", "k", ["c"])
    assert far.count() == 4000 and far.where("near_id is not null or near_d is not null or c is not null").isEmpty()
    assert sum(formed) < 10_000
    by = {(r.id, r.c): r.d for r in brute.where("d <= 2").groupBy("id", "c").agg(F.min("d").alias("d")).collect()}
    near = spatial.nearest_by_class(left, right.withColumn("c", F.col("c").cast("string")), "id", "c", ["0", "1", "7"], 2.0)
    for r in near.collect():
        assert (r["0"], r["1"], r["7"]) == (by.get((r.id, 0)), by.get((r.id, 1)), None)


def test_nearest_legs_compare_few_pairs(spark, monkeypatch):
    """Directions and distances among dense lines and boxes are those of brute force, from a small part of the pairs in reach."""
    from lodestar.model import Grid
    from lodestar.operators import spatial

    formed = []
    real = spatial.within_radius

    def counted(*args, **kw):
        pairs = real(*args, **kw)
        formed.append(pairs.count())
        return pairs

    monkeypatch.setattr(spatial, "within_radius", counted)
    lines = spark.range(300).selectExpr("id as line_id", "cast(id * 37 % 251 as double) a", "cast(id * 53 % 199 as double) b")
    point = lambda u, v: F.struct((F.col("a") + u).alias("x"), (F.col("b") + v).alias("y"))
    rings = lines.select(F.col("line_id").alias("poly_id"), F.array(point(0, 0), point(9, 0), point(9, 6), point(0, 6), point(0, 0)).alias("ring"))
    lines = lines.select("line_id", F.array(point(0, 0), point(9, 0), point(9, 6)).alias("pts"))
    points = spark.range(2000).selectExpr("id", "cast(id * 7 % 401 as double) x", "cast(id * 11 % 5 * 40 as double) y")
    legs = [(r.line_id, i, *p, *q) for r in lines.collect() for i, (p, q) in enumerate(zip(r.pts, r.pts[1:], strict=False))]

    def away(x, y, x1, y1, x2, y2):
        vx, vy = x2 - x1, y2 - y1
        t = max(0.0, min(1.0, ((x - x1) * vx + (y - y1) * vy) / (vx * vx + vy * vy)))
        dx, dy = x - (x1 + t * vx), y - (y1 + t * vy)
        return (dx * dx + dy * dy) ** 0.5

    known = {}
    for r in spatial.tangents(points, lines, "id", 40.0).collect():
        if (r.x, r.y) not in known:
            d, _, _, x1, y1, x2, y2 = min((away(r.x, r.y, *leg[2:]), *leg) for leg in legs)
            known[r.x, r.y] = (1.0, 0.0) if d > 40 else ((x2 - x1) / max(abs(x2 - x1), abs(y2 - y1)), (y2 - y1) / max(abs(x2 - x1), abs(y2 - y1)))
        assert (r.ux, r.uy) == known[r.x, r.y]
    assert sum(formed) < 40_000
    formed.clear()
    grid = Grid(0.0, 0.0, 5.0, 50, 70)
    cells = spark.range(3500).selectExpr("id div 70 as row", "id % 70 as col")
    boxes = [(r.ring[0].x, r.ring[0].y) for r in rings.collect()]
    for boundary in (False, True):
        for r in spatial.polygon_distance(cells, rings, grid, 60.0, boundary=boundary).collect():
            x, y = r.col * 5 + 2.5, r.row * 5 + 2.5
            want = 60.0
            for a, b in boxes:
                dx, dy = max(a - x, x - a - 9, 0), max(b - y, y - b - 6, 0)
                edge = (dx * dx + dy * dy) ** 0.5 or (min(x - a, a + 9 - x, y - b, b + 6 - y) if boundary else 0.0)
                want = min(want, edge)
            assert r.d == pytest.approx(want, abs=1e-9)
