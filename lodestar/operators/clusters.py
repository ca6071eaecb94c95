"""Density clusters of points by the cells of a grid, and names for them.

A cell's diagonal is the radius, so all points of a cell are in reach of each other: a cell with enough
points is all core and needs no pair. What is left to compare are points of thin cells (each has
fewer than ``least``) with the 5 x 5 cells around, so the work is linear in the points for a given
``least``, and neighbouring cells with core points, which are asked only whether any of their points
are in reach. Components are those of cells, not of points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import distance
from ..plans.storage import materialize

#: Two cells whose places make at most so many pairs are compared directly; larger ones are halved first.
PAIRS = 1024
#: Halvings after which cells are compared whatever they hold.
DEPTH = 24


def _around(df: DataFrame, half: bool = False) -> DataFrame:
    """A row per cell (``cx``, ``cy``) around, as ``nx``, ``ny``; ``half``: one direction of each pair."""
    step = F.sequence(F.lit(-2), F.lit(2))
    moved = df.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step))
    if half:
        moved = moved.where("_dx > 0 or (_dx = 0 and _dy > 0)")
    return moved.withColumns({"nx": F.col("cx") + F.col("_dx"), "ny": F.col("cy") + F.col("_dy")}).drop("_dx", "_dy")


def _gap(a: str, b: str, level: int, far: bool) -> Column:
    """Least (``far``: greatest) distance, in cell sides, between two parts along an axis."""
    away = F.abs(F.col(a) - F.col(b))
    return (F.greatest(away - 1, F.lit(0)) if not far else away + 1) / float(2**level)


def _linked(core: DataFrame, side: float, eps: float, pairs: int) -> DataFrame:
    """``cx``, ``cy``, ``nx``, ``ny``: neighbouring cells some of whose core places are in reach.

    Cells are halved until two parts are surely in reach, surely not, or hold few places; a pair of cells that is decided goes.
    """
    own = ["cx", "cy", "nx", "ny"]
    part = lambda level: [F.floor(F.col(q) * float(2**level)) for q in ("qx", "qy")]  # noqa: E731  halving is exact
    held = core.groupBy("cx", "cy").agg(F.count("*").alias("m"))
    there = held.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("m").alias("bm"))
    todo = _around(held, half=True).join(there, ["nx", "ny"])
    todo = materialize(todo.select(*own, F.col("cx").alias("ai"), F.col("cy").alias("aj"), F.col("m").alias("am"), F.col("nx").alias("bi"), F.col("ny").alias("bj"), "bm"))
    found, level = [], 0
    while not todo.isEmpty():
        few = (F.col("am") * F.col("bm") <= pairs) if level < DEPTH else F.lit(True)
        i, j = part(level)
        a = core.select(i.alias("ai"), j.alias("aj"), F.col("x").alias("ax"), F.col("y").alias("ay"))
        b = core.select(i.alias("bi"), j.alias("bj"), F.col("x").alias("bx"), F.col("y").alias("by"))
        met = todo.where(few).join(a, ["ai", "aj"]).join(b, ["bi", "bj"]).where(distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= eps)
        found.append(materialize(met.select(*own).distinct()))
        rest = todo.where(~few).join(found[-1], own, "left_anti")
        level += 1
        i, j = part(level)
        small = core.groupBy(i.alias("i"), j.alias("j")).agg(F.count("*").alias("m"))
        child = lambda s: small.select(F.shiftright("i", 1).alias(f"{s}i"), F.shiftright("j", 1).alias(f"{s}j"), F.col("i").alias(f"{s}_i"), F.col("j").alias(f"{s}_j"), F.col("m").alias(f"{s}_m"))  # noqa: E731, B023
        split = rest.drop("am", "bm").join(child("a"), ["ai", "aj"]).join(child("b"), ["bi", "bj"])
        least, most = (F.hypot(_gap("a_i", "b_i", level, far), _gap("a_j", "b_j", level, far)) * side for far in (False, True))
        split = materialize(split.where(least <= eps * (1 + 1e-9)).select(*own, *[F.col(f"{s}_{c}").alias(f"{s}{c}") for s in "ab" for c in "ijm"], (most <= eps * (1 - 1e-9)).alias("sure")))
        found.append(materialize(split.where("sure").select(*own).distinct()))
        todo = materialize(split.drop("sure").join(found[-1], own, "left_anti"))
    out = found[0] if found else todo.select(*own)
    for f in found[1:]:
        out = out.unionAll(f)
    return out


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``a``, ``label`` of ``nodes`` (the same columns): the smallest label that edges (``a``, ``b``, both ways) reach. Each round is written."""
    labels = materialize(nodes)
    while True:
        seen = edges.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("new"))
        step = labels.join(seen, "a", "left").select("a", F.least("label", F.coalesce("new", "label")).alias("label"), (F.col("new") < F.col("label")).alias("moved"))
        home = nodes.select("a", F.col("label").alias("own"))  # a label is the own label of one cell: jump to that cell's label
        far = step.join(home, "a").select(F.col("own").alias("label"), F.col("label").alias("next"))
        moved = materialize(step.join(far, "label", "left").select("a", F.least("label", F.coalesce("next", "label")).alias("label"), "moved"))
        labels = moved.select("a", "label")
        if moved.where("moved").isEmpty():
            return labels


def dbscan(points: DataFrame, key: str, eps: float, least: int, pairs: int = PAIRS) -> DataFrame:
    """``key``, ``cluster``: density clusters, named by their smallest core key; noise is null.

    A point is core with at least ``least`` points (itself included) at most ``eps`` away; a point that isn't, but has core ones in reach,
    goes to the smallest of their clusters. Points alike in place count each and are one place; points without a place are noise.
    """
    side = eps / 2**0.5 * (1 - 1e-12)
    here = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    places = here.groupBy("x", "y").agg(F.count("*").alias("n"), F.min(key).alias("first"))
    places = places.withColumns({"qx": F.col("x") / side, "qy": F.col("y") / side})
    places = materialize(places.withColumns({"cx": F.floor("qx"), "cy": F.floor("qy")}))
    cells = materialize(places.groupBy("cx", "cy").agg(F.sum("n").alias("held")))
    lone = places.join(cells.where(F.col("held") < least), ["cx", "cy"], "left_semi")
    looking = materialize(_around(lone.select("cx", "cy", F.col("x").alias("ax"), F.col("y").alias("ay"))).select("nx", "ny", "ax", "ay"))

    def reached(marks: DataFrame, *more: str) -> DataFrame:
        met = looking.join(marks.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), "x", "y", *more), ["nx", "ny"])
        return met.where(distance(F.col("ax"), F.col("ay"), F.col("x"), F.col("y")) <= eps).groupBy(F.col("ax").alias("x"), F.col("ay").alias("y"))

    thick = reached(places, "n").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("x", "y")
    full = places.join(cells.where(F.col("held") >= least), ["cx", "cy"], "left_semi")
    core = materialize(full.unionByName(lone.join(thick, ["x", "y"], "left_semi")))
    nodes = materialize(core.groupBy(F.struct("cx", "cy").alias("a")).agg(F.min("first").alias("label")))
    one = _linked(core, side, eps, pairs).select(F.struct("cx", "cy").alias("a"), F.struct(F.col("nx").alias("cx"), F.col("ny").alias("cy")).alias("b"))
    labels = _components(nodes, materialize(one.unionAll(one.select(F.col("b").alias("a"), F.col("a").alias("b")))))
    named = materialize(core.select("cx", "cy", "x", "y").join(labels.select("a.cx", "a.cy", "label"), ["cx", "cy"]))
    border = reached(named, "label").agg(F.min("label").alias("label")).join(named, ["x", "y"], "left_anti")
    both = named.select("x", "y", "label").unionByName(border)
    return points.select(key, "x", "y").join(both, ["x", "y"], "left").select(key, F.col("label").alias("cluster"))


def cluster_names(members: DataFrame, named: DataFrame, tolerance: float = 0.3, cluster: str = "cluster") -> DataFrame:
    """``cluster``, ``n``, ``lat``, ``lon``, ``name``, ``d``: each cluster's centre and the named place nearest to it.

    ``members``: points with ``lat``, ``lon`` (degrees); noise is left out. ``named``: ``name``, ``lat``, ``lon``. Distances are flat, with the length of a degree
    of longitude at the centre; of places equally near the smaller name wins. A centre with none in ``tolerance`` is named by its position, and ``d`` is null.
    Centres look into buckets of the tolerance, so neither side is broadcast.
    """
    centres = members.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    bucket = lambda c: F.floor(c / tolerance)
    squeeze = F.greatest(F.cos(F.radians("lat")), F.lit(0.01))
    span = lambda c, reach: F.explode(F.sequence(bucket(c - reach), bucket(c + reach)))
    looking = centres.withColumn("_by", span(F.col("lat"), F.lit(tolerance))).withColumn("_bx", span(F.col("lon"), tolerance / squeeze))
    marks = named.select("name", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), bucket(F.col("lat")).alias("_by"), bucket(F.col("lon")).alias("_bx"))
    dy, dx = F.col("lat") - F.col("_lat"), (F.col("lon") - F.col("_lon")) * F.cos(F.radians("lat"))
    met = looking.join(marks, ["_by", "_bx"]).withColumn("d", F.sqrt(dy * dy + dx * dx)).where(F.col("d") <= tolerance)
    best = met.groupBy(cluster).agg(F.min(F.struct("d", "name")).alias("b"))
    place = F.concat(F.lit("cluster_lat"), F.format_string("%.1f", "lat"), F.lit("_lon"), F.format_string("%.1f", "lon"))
    return centres.join(best, cluster, "left").select(cluster, "n", "lat", "lon", F.coalesce("b.name", F.replace(F.replace(place, F.lit("."), F.lit("p")), F.lit("-"), F.lit("neg"))).alias("name"), F.col("b.d").alias("d"))
