"""Planar geometry on plain columns: points are ``x``, ``y``; lines and rings are arrays of ``struct<x, y>``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def segments(points: Column) -> Column:
    """The legs of a line as ``struct<x1, y1, x2, y2>``."""
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1))),
        lambda i: F.struct(
            F.get(points, i - 1)["x"].alias("x1"), F.get(points, i - 1)["y"].alias("y1"),
            F.coalesce(F.get(points, i)["x"], F.get(points, i - 1)["x"]).alias("x2"), F.coalesce(F.get(points, i)["y"], F.get(points, i - 1)["y"]).alias("y2"),
        ),
    )


def segment_distance(x: Column, y: Column, s: Column) -> Column:
    """Distance of a point to a leg."""
    vx, vy = s["x2"] - s["x1"], s["y2"] - s["y1"]
    length = vx * vx + vy * vy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - s["x1"]) * vx + (y - s["y1"]) * vy) / length))).otherwise(0.0)
    return distance(x, y, s["x1"] + t * vx, s["y1"] + t * vy)


def line_distance(x: Column, y: Column, points: Column) -> Column:
    """Distance of a point to the nearest leg of a line."""
    return F.array_min(F.transform(segments(points), lambda s: segment_distance(x, y, s)))


def contains(points: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: whether a closed ring holds a point (points on the lower and left edge count as inside)."""
    crossings = F.filter(
        segments(points),
        lambda s: ((s["y1"] > y) != (s["y2"] > y)) & (x < (s["x2"] - s["x1"]) * (y - s["y1"]) / (s["y2"] - s["y1"]) + s["x1"]),
    )
    return F.size(crossings) % 2 == 1


def bounds(points: Column) -> Column:
    """``struct<xmin, ymin, xmax, ymax>`` of a line or ring."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def centroid(points: Column) -> Column:
    """Centroid of a closed ring (shoelace); the mean of the vertices where the area is 0."""
    cross = lambda s: s["x1"] * s["y2"] - s["x2"] * s["y1"]
    legs = segments(points)
    total = lambda f: F.aggregate(F.transform(legs, f), F.lit(0.0), lambda a, v: a + v)
    area = total(cross) / 2
    cx, cy = total(lambda s: (s["x1"] + s["x2"]) * cross(s)), total(lambda s: (s["y1"] + s["y2"]) * cross(s))
    mean = lambda k: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[k]) / F.size(points)
    return F.struct(F.when(area != 0, cx / (6 * area)).otherwise(mean("x")).alias("x"), F.when(area != 0, cy / (6 * area)).otherwise(mean("y")).alias("y"))


def densify(points: Column, spacing: float) -> Column:
    """Points along each leg no more than ``spacing`` apart, at least its two ends."""

    def leg(s: Column) -> Column:
        n = F.greatest(F.lit(2), F.ceil(distance(s["x1"], s["y1"], s["x2"], s["y2"]) / spacing).cast("int"))
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct((s["x1"] + (s["x2"] - s["x1"]) * i / (n - 1)).alias("x"), (s["y1"] + (s["y2"] - s["y1"]) * i / (n - 1)).alias("y")),
        )

    return F.flatten(F.transform(segments(points), leg))


def clip_ring(points: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """A closed ring cut to a box, edge by edge; empty where nothing is left. Arrow batches: as a column expression it would double with every edge."""
    sides = ((0, xmin, 1), (0, xmax, -1), (1, ymin, 1), (1, ymax, -1))

    def cut(ring) -> list[dict]:
        out = [(p["x"], p["y"]) for p in ring]
        for axis, bound, sign in sides:
            legs, out = list(zip(out, out[1:])), []
            for a, b in legs:
                ins = [(p[axis] - bound) * sign >= 0 for p in (a, b)]
                if ins[0] != ins[1]:
                    t = (bound - a[axis]) / (b[axis] - a[axis])
                    meet = [a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])]
                    meet[axis] = bound
                    out.append(tuple(meet))
                if ins[1]:
                    out.append(b)
            out = out + out[:1]
        return [{"x": float(x), "y": float(y)} for x, y in out]

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def clipped(rings: pd.Series) -> pd.Series:
        return rings.map(lambda r: None if r is None else cut(r))

    return clipped(points)
