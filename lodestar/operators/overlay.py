"""Overlay of shapes with holes and parts: clip, union and buffer by cutting rings along the cells of a grid.

A shape is a row with ``rings``: closed rings of ``struct<x, y>``, read by the even-odd rule, so holes and
the parts of a multipolygon are just more rings. Rings are halved and halved again down to the cells they
touch; a cell that a shape covers whole is a flag without rings. What overlaps is then decided inside cells,
each by a sweep over its few edges, and cells meet by an equi-join or an aggregation: no pair of
far-apart shapes is ever formed. Results are disjoint trapezoids by cell; ``dissolve`` puts those of one
shape together to rings again.

Defined cases: null or empty rings, and rings of fewer than three different points, cover nothing; rings are closed where
they aren't; a shape with a null or non-finite coordinate is an error; equal shapes are united once.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import contains

RINGS = "array<array<struct<x:double,y:double>>>"
_RINGS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

#: Shapes that are united at a time in a cell; more are united in several tasks first.
TOGETHER = 64


def holds(rings: Column, x: Column, y: Column) -> Column:
    """Whether a shape holds a point (holes and parts by the even-odd rule)."""
    return F.size(F.filter(rings, lambda r: contains(r, x, y))) % 2 == 1


def area(rings: Column) -> Column:
    """Area of disjoint rings, such as the pieces of this module have (holes are not taken off)."""
    cross = lambda r: F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1))), F.lit(0.0), lambda a, i: a + F.coalesce(F.get(r, i - 1)["x"] * F.get(r, i)["y"] - F.get(r, i)["x"] * F.get(r, i - 1)["y"], F.lit(0.0)))
    return F.aggregate(F.transform(rings, lambda r: F.abs(cross(r)) / 2), F.lit(0.0), lambda a, v: a + v)


def _halves(ring: list, axis: int, at: float) -> tuple[list, list]:
    """The parts of a closed ring (without its last point) below and above a line."""
    below, above = [], []
    for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
        if p[axis] <= at:
            below.append(p)
        if p[axis] >= at:
            above.append(p)
        if (p[axis] - at) * (q[axis] - at) < 0:
            t = (at - p[axis]) / (q[axis] - p[axis])
            other = p[1 - axis] + t * (q[1 - axis] - p[1 - axis])
            meet = (at, other) if axis == 0 else (other, at)
            below.append(meet)
            above.append(meet)
    return below, above


def _spans(ring: list, axis: int) -> bool:
    return len(ring) > 2 and min(p[axis] for p in ring) < max(p[axis] for p in ring)


def _cut(rings: list[list], size: float) -> Iterator[tuple[int, int, list[list]]]:
    """``row``, ``col`` and rings of every cell that the rings touch with some area."""
    rings = [r for r in rings if _spans(r, 0) and _spans(r, 1)]
    if not rings:
        return
    low = [math.floor(min(p[a] for r in rings for p in r) / size) for a in (0, 1)]
    high = [math.ceil(max(p[a] for r in rings for p in r) / size) for a in (0, 1)]
    todo = [(low[0], high[0], low[1], high[1], rings)]
    while todo:
        c0, c1, r0, r1, rings = todo.pop()
        if c1 - c0 <= 1 and r1 - r0 <= 1:
            yield r0, c0, rings
            continue
        axis = 0 if c1 - c0 >= r1 - r0 else 1
        mid = (c0 + c1) // 2 if axis == 0 else (r0 + r1) // 2
        sides = [[], []]
        for ring in rings:
            for side, part in zip(sides, _halves(ring, axis, mid * size), strict=True):
                if _spans(part, 0) and _spans(part, 1):
                    side.append(part)
        for side, box in zip(sides, ((c0, mid, r0, r1), (mid, c1, r0, r1)) if axis == 0 else ((c0, c1, r0, mid), (c0, c1, mid, r1)), strict=True):
            if side:
                todo.append((*box, side))


def _open(ring) -> list:
    points = [(p["x"], p["y"]) for p in ring]
    if any(x is None or y is None or not math.isfinite(x + y) for x, y in points):
        raise ValueError("a ring has a null or non-finite coordinate")
    return points[:-1] if len(points) > 1 and points[0] == points[-1] else points


def _close(ring: list) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in [*ring, ring[0]]]


def _box(row: int, col: int, size: float) -> list:
    return [(col * size, row * size), ((col + 1) * size, row * size), ((col + 1) * size, (row + 1) * size), (col * size, (row + 1) * size)]


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows spread over all tasks: shapes are few bytes each and much work, so their files or joins make few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Few rows at a time: rings as Python objects take many times their bytes, and a cell's rings come with every piece in it."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def cut(shapes: DataFrame, size: float, key: str = "id", rings: str = "rings") -> DataFrame:
    """``key``, ``row``, ``col``, ``full``, ``rings``: a row per shape and cell that it has some area in; ``rings`` is null where the cell is ``full``."""
    kind = dict(shapes.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, own in enumerate(batch.column("rings").to_pylist()):
                out: list[tuple] = []
                for row, col, parts in _cut([_open(r) for r in own or [] if r], size):
                    traps = _sweep([parts], any)
                    covered = sum(_trapezoid_area(t) for t in traps)
                    if covered > 0:
                        full = covered >= size * size * (1 - 1e-12)
                        out.append((row, col, full, None if full else [_close(t) for t in traps]))
                    if len(out) >= 4096:
                        yield _pieces(batch.column("key").slice(i, 1), out)
                        out = []
                if out:
                    yield _pieces(batch.column("key").slice(i, 1), out)

    rows = _dealt(shapes.select(F.col(key).alias("key"), F.col(rings).alias("rings")), "key")
    done = rows.mapInArrow(run, f"key {kind}, row long, col long, full boolean, rings {RINGS}")
    return done.withColumnRenamed("key", key)


def _pieces(key: pa.Array, out: list[tuple]) -> pa.RecordBatch:
    row, col, full, rings = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([key.take(pa.array([0] * len(out))), pa.array(row, pa.int64()), pa.array(col, pa.int64()), pa.array(full, pa.bool_()), pa.array(rings, _RINGS)], ["key", "row", "col", "full", "rings"])


def _sweep(shapes: list[list[list]], wanted: Callable[[list[bool]], bool]) -> list[list]:
    """Disjoint trapezoids (open rings) that cover the points where ``wanted`` (of which shapes hold the point) is true.

    Edges are cut into slabs at every end and crossing, so inside a slab they only lie side by side; trapezoids that go on between the same edges in the next slab are one.
    """
    if len(shapes) == 1 and len(shapes[0]) == 1 and len(shapes[0][0]) == 4 and wanted([True]) and not wanted([False]):
        (a, b), (c, d), (e, f), (g, h) = shapes[0][0]
        if (b == d and c == e and f == h and a == g) or (a == c and d == f and e == g and b == h):  # a rectangle
            x0, x1, y0, y1 = (float(v) for v in (min(a, e), max(a, e), min(b, f), max(b, f)))
            return [[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]] if x1 > x0 and y1 > y0 else []
    edges = []
    for s, rings in enumerate(shapes):
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
                if y1 != y2:
                    edges.append((x1, y1, x2, y2, s) if y1 < y2 else (x2, y2, x1, y1, s))
    if not edges:
        return []
    e = np.array(edges)
    x1, y1, x2, y2, of = e.T
    slope = (x2 - x1) / (y2 - y1)
    ys = np.unique(np.concatenate([y1, y2, _crossings(x1, y1, y2, slope)]))
    out: list[list] = []
    last: dict[tuple[int, int], int] = {}  # trapezoids that end at the slab's lower side, by their edges
    span = ys[-1] - ys[0]
    for lo, hi in zip(ys[:-1], ys[1:], strict=True):
        if hi - lo <= 1e-13 * span:
            continue
        on = np.flatnonzero((y1 <= lo) & (y2 >= hi))
        middle = x1[on] + slope[on] * ((lo + hi) / 2 - y1[on])
        on = on[np.argsort(middle, kind="stable")]
        inside = [False] * len(shapes)
        begun, now = -1, {}
        for k in on.tolist():
            was = wanted(inside)
            s = int(of[k])
            inside[s] = not inside[s]
            if wanted(inside) and not was:
                begun = k
            elif was and not wanted(inside):
                at = lambda i, y: float(x2[i] if y == y2[i] else x1[i] + slope[i] * (y - y1[i]))
                low, high = (at(begun, lo), at(k, lo)), (at(begun, hi), at(k, hi))
                if low[1] > low[0] or high[1] > high[0]:
                    before = last.get((begun, k))
                    if before is not None:
                        out[before][2:] = [(high[1], float(hi)), (high[0], float(hi))]
                    else:
                        before = len(out)
                        out.append([(low[0], float(lo)), (low[1], float(lo)), (high[1], float(hi)), (high[0], float(hi))])
                    now[begun, k] = before
        last = now
    return out


def _crossings(x1: np.ndarray, y1: np.ndarray, y2: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """The heights at which edges cross."""
    if len(x1) <= 128:  # all pairs at once
        i, j = np.triu_indices(len(x1), 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            turn = slope[i] - slope[j]
            y = (x1[j] - slope[j] * y1[j] - x1[i] + slope[i] * y1[i]) / turn
        return y[(turn != 0) & (y > np.maximum(y1[i], y1[j])) & (y < np.minimum(y2[i], y2[j]))]
    found = []
    for i in range(len(x1) - 1):
        j = slice(i + 1, None)
        turn = slope[i] - slope[j]
        with np.errstate(divide="ignore", invalid="ignore"):
            y = (x1[j] - slope[j] * y1[j] - x1[i] + slope[i] * y1[i]) / turn
        hit = (turn != 0) & (y > np.maximum(y1[i], y1[j])) & (y < np.minimum(y2[i], y2[j]))
        found.append(y[hit])
    return np.concatenate(found) if found else np.zeros(0)


def _trapezoid_area(t: list) -> float:
    return ((t[1][0] - t[0][0]) + (t[2][0] - t[3][0])) / 2 * (t[2][1] - t[1][1])


def _swept(shapes: list[list], wanted: Callable, row: int, col: int, size: float) -> tuple[bool, list | None]:
    traps = [t for t in _sweep(shapes, wanted) if _trapezoid_area(t) > 0]
    full = sum(map(_trapezoid_area, traps)) >= size * size * (1 - 1e-12)
    return full, None if full else [_close(t) for t in traps]


def union(pieces: DataFrame, size: float, together: int = TOGETHER, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, ``row``, ``col``, ``full``, ``rings``: what any of the shapes (with equal ``by``) covers, from the pieces of ``cut``; a row per cell.

    A cell that some shape covers is full, and equal pieces count once, before anything is brought together. A
    cell of many pieces is united in parts of ``together``, those again, until there is one.
    """
    from ..plans.storage import materialize

    cell = [*by, "row", "col"]
    told = materialize(pieces.select(*cell, "full", "rings").distinct())
    full = told.where("full").select(*cell).distinct()
    left = materialize(told.where("not full").join(full, cell, "left_anti").select(*cell, "rings"))
    kinds = ", ".join(f"{c} {k}" for c, k in left.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            found = [_swept([[_open(r) for r in rings] for rings in shapes], any, row, col, size) for row, col, shapes in zip(*(part.column(c).to_pylist() for c in ("row", "col", "shapes")), strict=True)]
            rings = [[_close(_box(row, col, size))] if whole else rings for row, col, (whole, rings) in zip(part.column("row").to_pylist(), part.column("col").to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in cell), pa.array(rings, _RINGS), pa.array([whole for whole, _ in found], pa.bool_())], [*cell, "rings", "whole"])

    done = None
    while True:
        counts = left.groupBy(*cell).agg(F.count("*").alias("n"))
        some = counts.agg(F.max("n")).first()[0] or 0
        if done is not None and some <= 1:
            break
        parts = left.join(counts, cell).withColumn("part", F.pmod(F.xxhash64("rings"), F.ceil(F.col("n") / together)))
        lists = parts.groupBy(*cell, "part").agg(F.collect_list("rings").alias("shapes"))  # about ``together`` at most
        alone = lists.where(F.size("shapes") == 1).select(*cell, F.get("shapes", F.lit(0)).alias("rings"), F.lit(False).alias("whole"))  # pieces are disjoint as they are
        several = _dealt(lists.where(F.size("shapes") > 1).select(*cell, "shapes"), *cell).mapInArrow(run, f"{kinds}, whole boolean")
        done = materialize(alone.unionByName(several))
        left = done.select(*cell, "rings")
    closed = done.select(*cell, F.col("whole").alias("full"), F.when(~F.col("whole"), F.col("rings")).alias("rings"))
    return closed.unionByName(full.select(*cell, F.lit(True).alias("full"), F.lit(None).cast(RINGS).alias("rings")))


def clip(pieces: DataFrame, mask: DataFrame, size: float, key: str = "id", inside: bool = True) -> DataFrame:
    """``key``, ``row``, ``col``, ``full``, ``rings``: the pieces of shapes inside (else outside) of a ``union``; empty ones are dropped."""
    m = mask.select("row", "col", F.col("full").alias("_full"), F.col("rings").alias("_rings"))
    rows = pieces.select(key, "row", "col", "full", "rings").join(m, ["row", "col"], "inner" if inside else "left")
    easy = F.col("_full") if inside else F.col("_full").isNull()
    kept = rows.where(easy).select(key, "row", "col", "full", "rings")
    # a full cell against a part of it needs no sweep on the way in; all others do
    kept = kept.unionByName(rows.where(~easy & F.col("full")).select(key, "row", "col", F.lit(False).alias("full"), F.col("_rings").alias("rings"))) if inside else kept
    rest = rows.where(~easy & ~F.col("full")) if inside else rows.where(~easy & ~F.col("_full"))
    kind = dict(pieces.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            row, col, full, own, other = (batch.column(c).to_pylist() for c in ("row", "col", "full", "rings", "_rings"))
            out = []
            for r, c, f, a, b in zip(row, col, full, own, other, strict=True):
                a = [_box(r, c, size)] if f else [_open(x) for x in a]
                wanted = (lambda x: x[0] and x[1]) if inside else (lambda x: x[0] and not x[1])
                out.append(_swept([a, [_open(x) for x in b]], wanted, r, c, size))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("row"), batch.column("col"), pa.array([f for f, _ in out], pa.bool_()), pa.array([x for _, x in out], _RINGS)], [key, "row", "col", "full", "rings"])

    cutout = _dealt(rest, key, "row", "col").mapInArrow(run, f"{key} {kind}, row long, col long, full boolean, rings {RINGS}")
    return kept.unionByName(cutout.where(F.col("full") | (F.size("rings") > 0)))


def piece_area(size: float) -> Column:
    """The area of a piece."""
    return F.when(F.col("full"), float(size) ** 2).otherwise(F.coalesce(area(F.col("rings")), F.lit(0.0)))


def covered(points: DataFrame, mask: DataFrame, size: float) -> DataFrame:
    """Append ``covered``: whether a point (``x``, ``y``) is in a ``union``: it meets the one cell it is in."""
    at = points.withColumns({"row": F.floor(F.col("y") / size), "col": F.floor(F.col("x") / size)})
    met = at.join(mask.select("row", "col", "full", "rings"), ["row", "col"], "left")
    hit = F.coalesce(F.col("full") | holds(F.col("rings"), F.col("x"), F.col("y")), F.lit(False))
    return met.withColumn("covered", hit).drop("row", "col", "full", "rings")


def buffer(shapes: DataFrame, distance: float, key: str = "id", rings: str = "rings", corners: int = 32) -> DataFrame:
    """``key``, ``rings``: the shapes whose ``union`` is everything within ``distance`` of a shape: the shape itself, and for every edge a box with half circles (polygons of ``corners`` corners) at its ends."""
    r = F.lit(float(distance))
    own = shapes.select(key, F.col(rings).alias("rings"))
    legs = own.select(key, F.explode("rings").alias("ring")).select(key, "ring", F.posexplode("ring").alias("i", "p")).select(key, F.col("p").alias("a"), F.get("ring", F.col("i") + 1).alias("b")).where("b is not null").distinct()
    turn = F.atan2(F.col("b.y") - F.col("a.y"), F.col("b.x") - F.col("a.x"))
    half = corners // 2

    def arc(end: str, start: float) -> Column:
        angle = lambda k: turn + start + k * (math.pi / half)
        return F.transform(F.sequence(F.lit(0), F.lit(half)), lambda k: F.struct((F.col(f"{end}.x") + r * F.cos(angle(k))).alias("x"), (F.col(f"{end}.y") + r * F.sin(angle(k))).alias("y")))

    capsule = F.concat(arc("b", -math.pi / 2), arc("a", math.pi / 2))
    capsule = F.concat(capsule, F.slice(capsule, 1, 1))
    return own.unionByName(legs.select(key, F.array(capsule).alias("rings")))


def _left_over(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The parts of a line that an odd number of spans covers."""
    count: dict[float, int] = defaultdict(int)
    for a, b in spans:
        count[a] += 1
        count[b] += 1
    ends = [x for x in sorted(count) if count[x] % 2]
    return list(zip(ends[::2], ends[1::2], strict=True))


def _outline(parts: list[list]) -> list[list]:
    """The rings around disjoint trapezoids: borders that two of them share cancel out."""
    flat: dict[tuple[int, float], list] = defaultdict(list)
    legs: list[tuple] = []
    for ring in parts:
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            if p == q:
                continue
            axis = 1 if p[1] == q[1] else 0 if p[0] == q[0] else None
            if axis is None:
                legs.append((p, q))
            else:
                flat[axis, p[axis]].append((min(p[1 - axis], q[1 - axis]), max(p[1 - axis], q[1 - axis])))
    for (axis, at), spans in flat.items():
        for a, b in _left_over(spans):
            legs.append(((a, at), (b, at)) if axis else ((at, a), (at, b)))
    seen: dict[tuple, int] = defaultdict(int)
    for p, q in legs:
        seen[min(p, q), max(p, q)] += 1
    ends: dict[tuple, list] = defaultdict(list)
    for (p, q), n in seen.items():
        if n % 2:
            ends[p].append(q)
            ends[q].append(p)
    rings = []
    for start in sorted(ends):
        while ends[start]:
            ring, at = [start], start
            while True:
                to = ends[at].pop()
                ends[to].remove(at)
                if to == start:
                    break
                ring.append(to)
                at = to
                if not ends[at]:  # ends differ in their last digits: the ring is closed as it is
                    break
            ring = [p for i, p in enumerate(ring) if _turns(ring[i - 1], p, ring[(i + 1) % len(ring)])]
            if len(ring) > 2:
                rings.append(ring)
    return rings


def _turns(a: tuple, b: tuple, c: tuple) -> bool:
    """Whether a corner is one, beyond the last digits."""
    u, v = (b[0] - a[0], b[1] - a[1]), (c[0] - b[0], c[1] - b[1])
    return abs(u[0] * v[1] - u[1] * v[0]) > 1e-12 * (math.hypot(*u) * math.hypot(*v))


def dissolve(pieces: DataFrame, size: float, key: str = "id") -> DataFrame:
    """``key``, ``rings``: the pieces of each shape as rings (even-odd) without the borders of cells. A shape's pieces are one group, as they came from one row; a ``union`` is left in cells."""
    kind = dict(pieces.dtypes)[key]

    def run(group: pa.Table) -> pa.Table:
        parts = []
        for row, col, full, rings in zip(*(group.column(c).to_pylist() for c in ("row", "col", "full", "rings")), strict=True):
            parts += [_box(row, col, size)] if full else [_open(r) for r in rings]
        return pa.table({key: group.column(key).slice(0, 1), "rings": pa.array([[_close(r) for r in _outline(parts)]], _RINGS)})

    return pieces.select(key, "row", "col", "full", "rings").groupBy(key).applyInArrow(run, f"{key} {kind}, rings {RINGS}")
