"""Overlay of shapes: the boxes around suppliers as polygons with holes, united, clipped and buffered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import overlay
from .registry import POLYGONS_SQL, polygons, query, rounded

#: Side of a cell that shapes are cut along.
SIZE = 250.0


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes; those over 200 wide and high have a hole of 20 metres all around its edge."""
    p = polygons(spark, d)
    at = lambda i, k: F.get("ring", i)[k]
    x0, y0, x1, y1 = at(0, "x"), at(0, "y"), at(2, "x"), at(2, "y")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    hole = F.array(corner(x0 + 20, y0 + 20), corner(x1 - 20, y0 + 20), corner(x1 - 20, y1 - 20), corner(x0 + 20, y1 - 20), corner(x0 + 20, y0 + 20))
    rings = F.when((x1 - x0 > 200) & (y1 - y0 > 200), F.array(F.col("ring"), hole)).otherwise(F.array("ring"))
    return p.select(F.col("poly_id").alias("id"), rings.alias("rings"), "alluvium")


SHAPES_SQL = f"""{POLYGONS_SQL}, s AS (SELECT *, x1 - x0 > 200 AND y1 - y0 > 200 AS hollow FROM boxes),
xs AS (SELECT DISTINCT x FROM (SELECT unnest([x0, x1, x0 + 20, x1 - 20]) AS x FROM s UNION SELECT 250.0 * unnest(range(0, (SELECT max(x1) FROM s)::BIGINT // 250 + 2)))),
ys AS (SELECT DISTINCT y FROM (SELECT unnest([y0, y1, y0 + 20, y1 - 20]) AS y FROM s UNION SELECT 250.0 * unnest(range(0, (SELECT max(y1) FROM s)::BIGINT // 250 + 2)))),
xi AS (SELECT x AS xa, lead(x) OVER (ORDER BY x) AS xb FROM xs), yi AS (SELECT y AS ya, lead(y) OVER (ORDER BY y) AS yb FROM ys),
hit AS (SELECT s.poly_id, s.alluvium, xa, xb, ya, yb FROM s JOIN xi ON xa >= x0 AND xb <= x1 JOIN yi ON ya >= y0 AND yb <= y1 WHERE NOT (hollow AND xa >= x0 + 20 AND xb <= x1 - 20 AND ya >= y0 + 20 AND yb <= y1 - 20))"""


@query(f"WITH {SHAPES_SQL}, u AS (SELECT DISTINCT xa, xb, ya, yb FROM hit) SELECT floor(ya / 250)::BIGINT AS row, floor(xa / 250)::BIGINT AS col, round(sum((xb - xa) * (yb - ya)), 4) AS area FROM u GROUP BY 1, 2")
def united_area(spark: SparkSession, d: str) -> DataFrame:
    """Area of each cell that any shape covers."""
    mask = overlay.union(overlay.cut(_shapes(spark, d), SIZE), SIZE)
    return rounded(mask.select("row", "col", overlay.piece_area(SIZE).alias("area")), 4)


def _clipped(spark: SparkSession, d: str, inside: bool) -> DataFrame:
    shapes = _shapes(spark, d)
    mask = overlay.union(overlay.cut(shapes.where("alluvium"), SIZE), SIZE)
    pieces = overlay.clip(overlay.cut(shapes.where("not alluvium"), SIZE), mask, SIZE, inside=inside)
    return rounded(pieces.groupBy("id").agg(F.sum(overlay.piece_area(SIZE)).alias("area")), 4)


_PARTS = f"{SHAPES_SQL}, m AS (SELECT DISTINCT xa, ya, true AS m FROM hit WHERE alluvium) SELECT poly_id AS id, round(sum((xb - xa) * (yb - ya)), 4) AS area FROM hit LEFT JOIN m USING (xa, ya) WHERE NOT alluvium AND"


@query(f"WITH {_PARTS} m GROUP BY poly_id")
def clipped_area(spark: SparkSession, d: str) -> DataFrame:
    """Area of each other shape inside of the alluvial ones; those with none are dropped."""
    return _clipped(spark, d, True)


@query(f"WITH {_PARTS} m IS NULL GROUP BY poly_id")
def remaining_area(spark: SparkSession, d: str) -> DataFrame:
    """Area of each other shape outside of the alluvial ones."""
    return _clipped(spark, d, False)


@query(f"WITH {POLYGONS_SQL} SELECT poly_id AS id, round((x1 - x0) * (y1 - y0) + 2 * (x1 - x0 + y1 - y0) * 30 + 16 * 900 * sin(pi() / 16), 4) AS area FROM boxes")
def buffered_area(spark: SparkSession, d: str) -> DataFrame:
    """Area of each box with 30 metres around it (arcs of 16 corners a half circle)."""
    boxes = polygons(spark, d).select(F.col("poly_id").alias("id"), F.array("ring").alias("rings"))
    pieces = overlay.union(overlay.cut(overlay.buffer(boxes, 30.0), SIZE), SIZE, by=("id",))
    return rounded(pieces.groupBy("id").agg(F.sum(overlay.piece_area(SIZE)).alias("area")), 4)


@query(f"WITH {POLYGONS_SQL} SELECT poly_id AS id, (CASE WHEN x1 - x0 > 200 AND y1 - y0 > 200 THEN 2 ELSE 1 END)::INT AS rings, (CASE WHEN x1 - x0 > 200 AND y1 - y0 > 200 THEN 10 ELSE 5 END)::BIGINT AS points FROM boxes")
def dissolved_rings(spark: SparkSession, d: str) -> DataFrame:
    """Rings and points of each shape after it was cut along cells and put together again."""
    whole = overlay.dissolve(overlay.cut(_shapes(spark, d), SIZE), SIZE)
    return whole.select("id", F.size("rings").alias("rings"), F.aggregate("rings", F.lit(0).cast("long"), lambda a, r: a + F.size(r)).alias("points"))
