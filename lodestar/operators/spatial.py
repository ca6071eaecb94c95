"""Spatial joins between points, lines, polygons and the cells of a regular grid.

A grid is regular, so a point, leg or polygon knows by arithmetic which cells it can touch: those
are generated and tested exactly, and no pair of far-apart things is ever formed. Points are
joined with points through buckets of the search radius (each point of one side is copied to the
3 x 3 buckets around it). Nearest neighbours without a radius are found by rings of growing
radius: only points that have found nothing yet go on to the next ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import bounds, centroid, contains, densify, distance, line_distance, segment_distance, segments
from ..model import Grid


def assign_cells(points: DataFrame, grid: Grid) -> DataFrame:
    """Append ``row`` and ``col``; points outside the half-open extent are dropped."""
    col, row = F.floor((F.col("x") - grid.x0) / grid.cell), F.floor((F.col("y") - grid.y0) / grid.cell)
    return points.withColumns({"row": row, "col": col}).where(F.col("row").between(0, grid.n_rows - 1) & F.col("col").between(0, grid.n_cols - 1))


def _window(low: Column, high: Column, start: float, cell: float, n: int) -> Column:
    """The cells whose centres lie between two coordinates, as an array (empty where none does)."""
    first = F.greatest(F.ceil((low - start) / cell - 0.5), F.lit(0)).cast("int")
    last = F.least(F.floor((high - start) / cell - 0.5), F.lit(n - 1)).cast("int")
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def cells_in_box(df: DataFrame, grid: Grid, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> DataFrame:
    """A row per row of ``df`` and cell whose centre is in its box: ``row``, ``col``, ``cx``, ``cy``."""
    out = df.withColumn("row", F.explode(_window(ymin, ymax, grid.y0, grid.cell, grid.n_rows))).withColumn("col", F.explode(_window(xmin, xmax, grid.x0, grid.cell, grid.n_cols)))
    half = grid.cell / 2
    return out.withColumns({"cx": grid.x0 + F.col("col") * grid.cell + half, "cy": grid.y0 + F.col("row") * grid.cell + half})


def cells_within(points: DataFrame, grid: Grid, radius: float) -> DataFrame:
    """A row per point and cell centre at most ``radius`` away, with distance ``d``. Costs the cells of the circle per point, whatever the grid."""
    x, y = F.col("x"), F.col("y")
    return cells_in_box(points, grid, x - radius, y - radius, x + radius, y + radius).withColumn("d", distance(F.col("cx"), F.col("cy"), x, y)).where(F.col("d") <= radius)


def radius_aggregate(points: DataFrame, grid: Grid, radius: float, values: list[str]) -> DataFrame:
    """Per cell with a sample in reach: ``<v>_mean``, ``<v>_max``, ``<v>_count``, ``<v>_has_data`` over non-null values.

    Partial aggregation happens before the only shuffle, by cell.
    """
    near = cells_within(points, grid, radius)
    aggs = [f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("max", F.max), ("count", F.count))]
    out = near.groupBy("row", "col").agg(*aggs)
    return out.withColumns({f"{v}_has_data": (F.col(f"{v}_count") > 0).cast("int") for v in values})


def polygon_cells(polygons: DataFrame, grid: Grid, ring: str = "ring") -> DataFrame:
    """A row per polygon and cell centre inside it."""
    boxed = polygons.withColumn("_b", bounds(F.col(ring)))
    b = F.col("_b")
    hits = cells_in_box(boxed, grid, b["xmin"], b["ymin"], b["xmax"], b["ymax"])
    return hits.where(contains(F.col(ring), F.col("cx"), F.col("cy"))).drop("_b")


def assign_polygon(cells: DataFrame, polygons: DataFrame, grid: Grid, value: str, poly_id: str = "poly_id", default: int = -1) -> DataFrame:
    """Left join of cells with the polygon that holds their centre; the smallest id wins; ``default`` outside."""
    hits = polygon_cells(polygons, grid).groupBy("row", "col").agg(F.min_by(value, poly_id).alias(value))
    return cells.join(hits, ["row", "col"], "left").withColumn(value, F.coalesce(value, F.lit(default)))


def any_polygon(cells: DataFrame, polygons: DataFrame, grid: Grid, flag: str) -> DataFrame:
    """Left join of cells with whether any polygon that holds their centre has ``flag``."""
    hits = polygon_cells(polygons, grid).groupBy("row", "col").agg(F.bool_or(flag).alias(flag))
    return cells.join(hits, ["row", "col"], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def polygon_weights(polygons: DataFrame, grid: Grid, ring: int = 1, edge: float = 0.5, poly_id: str = "poly_id") -> DataFrame:
    """``row``, ``col``, ``weight``: 1 inside, ``edge`` within ``ring`` cells around; a polygon that holds no centre takes the cell of its centroid."""
    inside = polygon_cells(polygons, grid).select(poly_id, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    lost = polygons.join(inside.select(poly_id).distinct(), poly_id, "left_anti").withColumn("c", centroid(F.col("ring"))).select(poly_id, F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    inside = inside.unionByName(assign_cells(lost, grid).select(poly_id, "row", "col")).select("row", "col").distinct()
    step = F.sequence(F.lit(-ring), F.lit(ring))
    around = inside.withColumn("dr", F.explode(step)).withColumn("dc", F.explode(step))
    w = F.when((F.col("dr") == 0) & (F.col("dc") == 0), 1.0).otherwise(edge)
    around = around.select((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), w.alias("weight"))
    around = around.where(F.col("row").between(0, grid.n_rows - 1) & F.col("col").between(0, grid.n_cols - 1))
    return around.groupBy("row", "col").agg(F.max("weight").alias("weight"))


def stamp_kernel(points: DataFrame, grid: Grid, along: float, across: float, reach: float) -> DataFrame:
    """``row``, ``col``, ``weight``: the largest anisotropic Gaussian over the points; ``ux``, ``uy`` is a point's unit direction."""
    near = cells_within(points, grid, reach)
    dx, dy = F.col("cx") - F.col("x"), F.col("cy") - F.col("y")
    u, v = dx * F.col("ux") + dy * F.col("uy"), -dx * F.col("uy") + dy * F.col("ux")
    w = F.exp(-0.5 * ((u / along) * (u / along) + (v / across) * (v / across)))
    return near.groupBy("row", "col").agg(F.max(w).alias("weight"))


def within_radius(left: DataFrame, right: DataFrame, radius: float, strict: bool = False, by: list[str] | None = None) -> DataFrame:
    """Pairs of points at most (``strict``: less than) ``radius`` apart and equal in ``by``, with ``d``; the right columns but ``by`` are prefixed ``r_``."""
    by = by or []
    bucket = lambda c: F.floor(F.col(c) / radius)
    step = F.sequence(F.lit(-1), F.lit(1))
    near = right.select(*[F.col(c).alias(c if c in by else f"r_{c}") for c in right.columns])
    near = near.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step)).withColumns({"_bx": F.floor(F.col("r_x") / radius) + F.col("_dx"), "_by": F.floor(F.col("r_y") / radius) + F.col("_dy")})
    pairs = left.withColumns({"_bx": bucket("x"), "_by": bucket("y")}).join(near, ["_bx", "_by", *by])
    d = distance(F.col("x"), F.col("y"), F.col("r_x"), F.col("r_y"))
    return pairs.withColumn("d", d).where(F.col("d") < radius if strict else F.col("d") <= radius).drop("_bx", "_by", "_dx", "_dy")


def _placed(df: DataFrame) -> DataFrame:
    """Rows with a whole place: no null or NaN coordinate."""
    return df.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan(F.col("x").cast("double")) & ~F.isnan(F.col("y").cast("double")))


#: The densest square of a first round's radius holds at most so many marks.
CROWD = 64


def _first_radius(marks: DataFrame, by: list[str]) -> float:
    """A radius at which no square of that side holds more than ``CROWD`` marks (of one value of ``by``)."""
    n, x0, x1, y0, y1 = marks.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    wide, high = float(x1 - x0), float(y1 - y0)
    side = max((wide * high / n) ** 0.5, max(wide, high) / n)
    if not 0 < side < float("inf"):
        return 1.0
    for _ in range(20):
        if marks.groupBy(F.floor(F.col("x") / side), F.floor(F.col("y") / side), *by).count().where(F.col("count") > CROWD).isEmpty():
            break
        side /= 4
    return side


def _nearest_places(left: DataFrame, right: DataFrame, own: list[str], cap: float | None, start: float | None = None, by: list[str] | None = None) -> DataFrame | None:
    """``x``, ``y`` (of left points, different ones), ``by``, ``b``: distance ``d`` and columns ``own`` of the nearest right point at most ``cap`` away, ties by ``own``; none where there is none. None for an empty right side.

    Different places are compared, however many points they have; of the right ones at a place the smallest ``own`` stands for all. The radius
    starts where few marks are in reach (``start``: at most there) and doubles up to ``cap`` for the places that have found nothing yet. Each round is written to the shared folder.
    """
    from ..plans.storage import materialize

    by = by or []
    marks = materialize(_placed(right.select("x", "y", *by, *own)).groupBy("x", "y", *by).agg(F.min(F.struct(*own)).alias("o")))
    if marks.isEmpty():
        return None
    here = _placed(left.select("x", "y")).distinct()
    if by:
        here = here.crossJoin(F.broadcast(marks.select(*by).distinct()))  # a row per class
    todo, found = materialize(here), None
    radius = min(r for r in (_first_radius(marks, by), cap, start) if r is not None)
    while True:
        pairs = within_radius(todo, marks, radius, by=by)
        got = materialize(pairs.groupBy("x", "y", *by).agg(F.min(F.struct("d", *[F.col(f"r_o.{c}").alias(c) for c in own])).alias("b")))
        found = got if found is None else found.unionByName(got)
        if cap is not None and radius >= cap:
            return found
        todo = materialize(todo.join(got, ["x", "y", *by], "left_anti"))
        if todo.isEmpty():
            return found
        radius = radius * 2 if cap is None else min(radius * 2, cap)


def _places_near(left: DataFrame, right: DataFrame, radius: float, strict: bool) -> DataFrame:
    """``x``, ``y``: the different places of left points that have a right point in reach, written and hinted by ``small``.

    Different places are compared, however many points they have. In a cell whose diagonal is the radius all places are in
    reach of each other, so those that share one with a right place are decided without a pair; only the others look around.
    """
    from ..plans.storage import materialize, small

    side = radius / 2**0.5 * (1 - 1e-12)
    cell = [F.floor(F.col(c) / side).alias(f"_{c}") for c in ("x", "y")]
    there = _placed(right.select("x", "y")).distinct()
    here = _placed(left.select("x", "y")).distinct().select("x", "y", *cell)
    held = there.select(*cell).distinct()
    far = within_radius(here.join(held, ["_x", "_y"], "left_anti").select("x", "y"), there, radius, strict).select("x", "y").distinct()
    return small(materialize(here.join(held, ["_x", "_y"], "left_semi").select("x", "y").unionAll(far)))


def near_any(left: DataFrame, right: DataFrame, radius: float, key: str, strict: bool = False) -> DataFrame:
    """Keys of the left points that have a right point in reach."""
    return left.select(key, "x", "y").join(_places_near(left, right, radius, strict), ["x", "y"], "left_semi").select(key).distinct()


def outside(left: DataFrame, right: DataFrame, radius: float, key: str, strict: bool = False) -> DataFrame:
    """Left points without a right point in reach (points of one ``key`` share a place). They are told by their place, so keys are neither gathered nor joined."""
    return left.join(_places_near(left, right, radius, strict), ["x", "y"], "left_anti").select(key, *[c for c in left.columns if c != key])


def outside_all(left: DataFrame, known: list[tuple[DataFrame, float]], key: str) -> DataFrame:
    """Left points away from every one of several sets of points, each with its own radius: what is left is a blind set."""
    for points, radius in known:
        left = outside(left, points, radius, key)
    return left


def inside(left: DataFrame, right: DataFrame, radius: float, key: str, strict: bool = False) -> DataFrame:
    """Left points with a right point in reach, told by their place as in ``outside``."""
    return left.join(_places_near(left, right, radius, strict), ["x", "y"], "left_semi").select(key, *[c for c in left.columns if c != key])


def reclassify(points: DataFrame, pits: DataFrame, radius: float, key: str, on_old_unit: Column, old: str, young: str) -> DataFrame:
    """Append ``class``: ``old`` for points at most ``radius`` from a pit or on an old unit, else ``young``."""
    near = near_any(points, pits, radius, key).withColumn("_near", F.lit(True))
    rows = points.join(near, key, "left")
    return rows.withColumn("class", F.when(F.coalesce(F.col("_near"), F.lit(False)) | F.coalesce(on_old_unit, F.lit(False)), old).otherwise(young)).drop("_near")


def nearest_within(left: DataFrame, right: DataFrame, radius: float, key: str, right_key: str, payload: list[str] | None = None) -> DataFrame:
    """Left join with the nearest right point at most ``radius`` away: ``near_id``, ``near_d`` and ``payload``; ties go to the smallest id. Places are compared, not points (``_nearest_places``)."""
    return _with_nearest(left, right, right_key, payload or [], radius)


def _with_nearest(left: DataFrame, right: DataFrame, right_key: str, payload: list[str], cap: float | None, start: float | None = None) -> DataFrame:
    from ..plans.storage import materialize, small

    own = [right_key, *payload]
    best = _nearest_places(left, right, own, cap, start)
    if best is None:
        kinds = dict(right.dtypes)
        return left.select("*", F.lit(None).cast(kinds[right_key]).alias("near_id"), F.lit(None).cast("double").alias("near_d"), *[F.lit(None).cast(kinds[p]).alias(p) for p in payload])
    best = small(materialize(best.select("x", "y", F.col(f"b.{right_key}").alias("near_id"), F.col("b.d").alias("near_d"), *[F.col(f"b.{p}").alias(p) for p in payload])))
    return left.join(best, ["x", "y"], "left").select(*[left[c] for c in left.columns], "near_id", "near_d", *payload)


def nearest(left: DataFrame, right: DataFrame, key: str, right_key: str, start: float) -> DataFrame:
    """``key``, ``near_id``, ``near_d`` for every left point, however far. The search radius (at most ``start`` at first) doubles for the places that have found nothing yet.

    Points without a whole place (a null or NaN coordinate) are near nothing and come out with nulls; so do all for an empty
    right side. Each round is written to the shared folder, so that later rounds don't repeat earlier ones.
    """
    return _with_nearest(left.select(key, "x", "y"), right, right_key, [], None, start).select(key, "near_id", "near_d")


def nearest_by_class(left: DataFrame, right: DataFrame, key: str, category: str, classes: list[str], radius: float) -> DataFrame:
    """A column per class with the distance to its nearest point, null beyond ``radius``. Places are compared, not points (``_nearest_places``)."""
    from ..plans.storage import materialize, small

    of = right.select("x", "y", F.col(category).alias("_class")).where(F.col("_class").isin(classes))
    best = _nearest_places(left, of, ["x"], radius, by=["_class"])
    if best is None:
        return left.withColumns({c: F.lit(None).cast("double") for c in classes})
    near = small(materialize(best.groupBy("x", "y").agg(*[F.min(F.when(F.col("_class") == c, F.col("b.d"))).alias(c) for c in classes])))
    return left.join(near, ["x", "y"], "left").select(*[left[c] for c in left.columns], *classes)


def snap_to_cell(points: DataFrame, grid: Grid) -> DataFrame:
    """Append ``row`` and ``col`` of the nearest cell centre; points outside go to the edge."""
    half = grid.cell / 2
    at = lambda c, start, n: F.least(F.greatest(F.ceil((F.col(c) - start - half) / grid.cell - 0.5), F.lit(0)), F.lit(n - 1)).cast("long")  # noqa: E731  a tie goes to the smaller cell
    return points.withColumns({"row": at("y", grid.y0, grid.n_rows), "col": at("x", grid.x0, grid.n_cols)})


#: Up to so many cells within the cap on either side, cells look for legs in a growing radius (points send themselves to the cells around); beyond that, blocks of cells look for the shapes near them.
DIRECT = 64
#: Cells along a side of a block.
BLOCK = 16


def _near_blocks(cells: DataFrame, marks: DataFrame, grid: Grid, cap: float, slack: float) -> DataFrame:
    """``_br``, ``_bc``, ``shape``: for each block of cells, every shape that can be the nearest to one of its cells, among those in ``cap``.

    ``marks``: points (``x``, ``y``) of shapes (``shape``), such that any point of a shape is at most ``slack`` from one. The nearest mark
    of a block's centre bounds how far the nearest shape of its cells can be; shapes with a mark within that bound stay. The bounds are
    rounded up to powers of two, and each power is one join by buckets of that size, so the work follows the blocks and what is near them.
    """
    from ..plans.storage import materialize

    side = BLOCK * grid.cell
    half = side * 2**0.5 / 2
    centre = lambda c, start: (F.col(c) + 0.5) * side + start
    blocks = cells.select(F.floor(F.col("row") / BLOCK).alias("_br"), F.floor(F.col("col") / BLOCK).alias("_bc")).distinct()
    blocks = blocks.select(F.struct("_br", "_bc").alias("block"), centre("_bc", grid.x0).alias("x"), centre("_br", grid.y0).alias("y"))
    near = nearest(blocks, marks, "block", "shape", side).where(F.col("near_d") <= cap + half + slack).select("block", (F.col("near_d") + 2 * half + slack).alias("reach"))
    sized = materialize(blocks.join(near, "block").withColumn("power", F.greatest(F.ceil(F.log2(F.col("reach") / side)), F.lit(0)).cast("int")))
    found = None
    for (power,) in sorted(sized.select("power").distinct().collect()):  # as many as there are doublings of a block up to the cap
        own = within_radius(sized.where(F.col("power") == power).select("block", "reach", "x", "y"), marks, side * 2.0**power).where(F.col("d") <= F.col("reach")).select("block", F.col("r_shape").alias("shape"))
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = blocks.select("block", F.lit(None).cast(dict(marks.dtypes)["shape"]).alias("shape")).limit(0)
    return materialize(found.distinct().select("block._br", "block._bc", "shape"))


def _with_shapes(cells: DataFrame, shapes: DataFrame, near: DataFrame, grid: Grid) -> DataFrame:
    """Cells (``row``, ``col``, ``cx``, ``cy``) with each shape that can be their nearest."""
    at = cells.select("row", "col", F.floor(F.col("row") / BLOCK).alias("_br"), F.floor(F.col("col") / BLOCK).alias("_bc"))
    at = at.withColumns({"cx": (F.col("col") + 0.5) * grid.cell + grid.x0, "cy": (F.col("row") + 0.5) * grid.cell + grid.y0})
    return at.join(near.join(shapes, "shape"), ["_br", "_bc"])


def polygon_distance(cells: DataFrame, polygons: DataFrame, grid: Grid, cap: float, boundary: bool = False, buffer: float | None = None, direct: int = DIRECT) -> DataFrame:
    """Append ``d``: distance of each cell to the nearest polygon (0 inside) or ``boundary``, capped; with ``buffer``, null where it is closer."""
    boxed = polygons.select("ring").distinct().withColumn("_b", bounds(F.col("ring")))
    b = F.col("_b")
    edge = line_distance(F.col("cx"), F.col("cy"), F.col("ring"))
    if cap <= direct * grid.cell:
        half = grid.cell / 2
        at = cells.select("row", "col", (F.col("col") * grid.cell + grid.x0 + half).alias("x"), (F.col("row") * grid.cell + grid.y0 + half).alias("y"))
        legs = polygons.select("ring").distinct().select(F.explode(segments(F.col("ring"))).alias("s")).distinct()
        near = _nearest_legs(at, legs, [], cap)
        near = at.join(near.select("x", "y", F.col("b.d").alias("d")), ["x", "y"]).select("row", "col", "d")
        best = near.groupBy("row", "col").agg(F.min("d").alias("d"))
    else:
        side = BLOCK * grid.cell
        shapes = polygons.select(F.xxhash64("ring").alias("shape"), "ring").dropDuplicates(["shape"])
        marks = shapes.select("shape", F.explode(densify(F.col("ring"), side)).alias("p")).select("shape", "p.x", "p.y")
        best = _with_shapes(cells, shapes, _near_blocks(cells, marks, grid, cap, side / 2), grid).groupBy("row", "col").agg(F.min(edge).alias("d"))
    if not boundary:  # deep inside of a polygon its edge may be far
        held = cells_in_box(boxed, grid, b["xmin"], b["ymin"], b["xmax"], b["ymax"]).where(contains(F.col("ring"), F.col("cx"), F.col("cy")))
        best = best.unionByName(held.select("row", "col", F.lit(0.0).alias("d"))).groupBy("row", "col").agg(F.min("d").alias("d"))
    out = cells.join(best, ["row", "col"], "left").withColumn("d", F.least(F.coalesce("d", F.lit(float(cap))), F.lit(float(cap))))
    return out.withColumn("d", F.when(F.col("d") >= buffer, F.col("d"))) if buffer is not None else out


def line_point_distance(cells: DataFrame, lines: DataFrame, grid: Grid, spacing: float, cap: float, direct: int = DIRECT) -> DataFrame:
    """Append ``d``: distance to the nearest point of lines that carry a point each ``spacing``, from 0 to ``cap``."""
    points = lines.select(F.explode(densify(F.col("pts"), spacing)).alias("p")).select("p.x", "p.y")
    if cap <= direct * grid.cell:
        best = cells_within(points, grid, cap).groupBy("row", "col").agg(F.min("d").alias("d"))
    else:
        shapes = points.distinct().select(F.struct("x", "y").alias("shape"), F.col("x").alias("px"), F.col("y").alias("py"))
        near = _near_blocks(cells, shapes.select("shape", F.col("px").alias("x"), F.col("py").alias("y")), grid, cap, 0.0)
        best = _with_shapes(cells, shapes, near, grid).groupBy("row", "col").agg(F.min(distance(F.col("cx"), F.col("cy"), F.col("px"), F.col("py"))).alias("d"))
    return cells.join(best, ["row", "col"], "left").withColumn("d", F.least(F.coalesce("d", F.lit(float(cap))), F.lit(float(cap))))


def _nearest_legs(points: DataFrame, legs: DataFrame, own: list[str], cap: float) -> DataFrame:
    """``x``, ``y`` (different ones), ``b``: distance ``d`` and, with ``own``, those and leg ``s`` of the nearest of ``legs`` at most ``cap`` away, ties by ``own``; none where there is none.

    Legs are found by marks along them. The radius starts at the gap between legs (unless that takes far more marks than there are legs and
    places) and grows fourfold up to ``cap`` for the places that have found nothing yet; only places near a leg look at all.
    """
    from ..plans.storage import materialize, small

    legs, places = materialize(legs), _placed(points.select("x", "y")).distinct()
    length = distance(F.col("s.x1"), F.col("s.y1"), F.col("s.x2"), F.col("s.y2"))
    ends = [f(g(F.col(f"s.{c}1"), F.col(f"s.{c}2"))) for c in "xy" for f, g in ((F.min, F.least), (F.max, F.greatest))]
    n, total, x0, x1, y0, y1 = legs.agg(F.count("*"), F.coalesce(F.sum(length), F.lit(0.0)), *ends).first()

    def marked(radius: float) -> DataFrame:
        line = F.array(*(F.struct(F.col(f"s.x{i}").alias("x"), F.col(f"s.y{i}").alias("y")) for i in (1, 2)))
        spread = legs.repartition(int(legs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a few small files would be a task or two for all pairs
        return spread.withColumn("p", F.explode(densify(line, radius))).select("s", *own, F.col("p.x").alias("x"), F.col("p.y").alias("y"))

    square, step = [F.floor(F.col(c) / (1.5 * cap)).alias(f"_{c}") for c in "xy"], F.sequence(F.lit(-1), F.lit(1))
    held = marked(cap).select(*square).distinct().withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step)).select((F.col("_x") + F.col("_dx")).alias("_x"), (F.col("_y") + F.col("_dy")).alias("_y")).distinct()
    todo = materialize(places.select("x", "y", *square).join(held, ["_x", "_y"], "left_semi").select("x", "y"))
    gap = (x1 - x0) * (y1 - y0) / total if total else cap
    radius, found = min(cap, max(gap, total / (16 * (n + todo.count()) or 1), cap / 4**5)), None
    while True:
        pairs = within_radius(marked(radius), todo, 1.5 * radius).select(F.col("r_x").alias("x"), F.col("r_y").alias("y"), "s", *own)
        pairs = pairs.withColumn("d", segment_distance(F.col("x"), F.col("y"), F.col("s"))).where(F.col("d") <= radius)
        got = pairs.groupBy("x", "y").agg(F.min("d").alias("least"))  # hashed: the least struct would sort all pairs
        if own:
            tied = pairs.join(small(materialize(got)), ["x", "y"]).where(F.col("d") == F.col("least"))
            got = tied.groupBy("x", "y").agg(F.min(F.struct("d", *own, "s")).alias("b"))
        else:
            got = got.select("x", "y", F.struct(F.col("least").alias("d")).alias("b"))
        got = materialize(got)
        found = got if found is None else found.unionByName(got)
        if radius >= cap:
            return found
        todo = materialize(todo.join(got, ["x", "y"], "left_anti"))
        if todo.isEmpty():
            return found
        radius = min(4 * radius, cap)


def tangents(points: DataFrame, lines: DataFrame, key: str, reach: float) -> DataFrame:
    """Append ``ux``, ``uy``: the direction of the nearest leg among lines in ``reach``, ties by ``line_id`` and leg; (1, 0) without one. Different places and lines are compared (``_nearest_legs``)."""
    from ..plans.storage import materialize, small

    legs = lines.groupBy("pts").agg(F.min("line_id").alias("line_id")).select("line_id", F.posexplode(segments(F.col("pts"))).alias("leg", "s"))
    dx, dy = F.col("b.s.x2") - F.col("b.s.x1"), F.col("b.s.y2") - F.col("b.s.y1")
    size = F.sqrt(dx * dx + dy * dy)
    best = _nearest_legs(points, legs, ["line_id", "leg"], reach)
    best = small(materialize(best.select("x", "y", F.when(size > 0, dx / size).alias("ux"), F.when(size > 0, dy / size).alias("uy"))))
    out = points.join(best, ["x", "y"], "left").select(*[points[c] for c in points.columns], "ux", "uy")
    return out.withColumns({"ux": F.coalesce("ux", F.lit(1.0)), "uy": F.coalesce("uy", F.lit(0.0))})


def shared_vertices(shapes: DataFrame, key: str, vertices: str, flag: str) -> DataFrame:
    """``key``, ``neighbour``: whether a shape shares a vertex with a flagged one (itself included).

    Vertices are exploded once, to the shared folder; a vertex that many shapes have is one row of the flagged ones, so
    the way back is a semi-join, broadcast where they are few.
    """
    from ..plans.storage import materialize, small

    exploded = materialize(shapes.select(key, flag, F.explode(vertices).alias("v")))
    marked = materialize(exploded.where(flag).select("v").distinct())
    hit = exploded.join(small(marked), "v", "left_semi").select(key).distinct().withColumn("neighbour", F.lit(True))
    return shapes.select(key).join(hit, key, "left").withColumn("neighbour", F.coalesce("neighbour", F.lit(False)))


def hex_bins(points: DataFrame, size: float) -> DataFrame:
    """Append ``q``, ``r``: axial coordinates of the hexagon of edge ``size`` that holds a point."""
    q = (F.sqrt(F.lit(3.0)) / 3 * F.col("x") - F.col("y") / 3) / size
    r = 2 * F.col("y") / 3 / size
    rq, rr, rs = F.round(q), F.round(r), F.round(-q - r)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs + q + r)
    return points.withColumns({
        "q": F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq).cast("long"), "r": F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr).cast("long"),
    })


def blocks(points: DataFrame, size: float) -> DataFrame:
    """Append ``bx``, ``by``: absolute block numbers, the same for any frame."""
    return points.withColumns({"bx": F.floor(F.col("x") / size), "by": F.floor(F.col("y") / size)})


def block_neighbours(counts: DataFrame, value: str) -> DataFrame:
    """Append ``around``: the sum of ``value`` over the eight blocks around each block."""
    step = F.sequence(F.lit(-1), F.lit(1))
    moved = counts.select("bx", "by", value).withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).where("dx <> 0 or dy <> 0")
    sums = moved.select((F.col("bx") + F.col("dx")).alias("bx"), (F.col("by") + F.col("dy")).alias("by"), value).groupBy("bx", "by").agg(F.sum(value).alias("around"))
    return counts.join(sums, ["bx", "by"], "left").withColumn("around", F.coalesce("around", F.lit(0)))


