"""Terrain that a neighbourhood doesn't tell: flow in shares, nearest sources, horizons, Fourier filters, long kernels.

All work on long tables (``row``, ``col``, ``value``; a null value is a missing cell). What goes far over a raster is
cut so that no task holds more than a tile, a row, or a bounded block of columns:

* flow is accumulated tile by tile, and between tiles over a condensed graph of their edges;
* the nearest source is found column by column (windows), then row by row (lower envelopes);
* horizons look along rows, columns and diagonals, each a window with its own key;
* the Fourier transform goes over blocks of rows, is transposed by one shuffle, and goes over blocks of columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import segments
from ..model import FeatureWeight, Grid
from .raster import elevation_percentile, haloed, local_relief, running_mean, top_hat

#: Cells along a side of a tile of the flow.
TILE = 64

# The eight facets around a cell, counter-clockwise from east: (row, col) steps to the straight and to the diagonal neighbour.
FACETS = (((0, 1), (-1, 1)), ((-1, 0), (-1, 1)), ((-1, 0), (-1, -1)), ((0, -1), (-1, -1)), ((0, -1), (1, -1)), ((1, 0), (1, -1)), ((1, 0), (1, 1)), ((0, 1), (1, 1)))


def _shares(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each cell but the outermost: the places (in ``z``, flat) of the straight and the diagonal receiver, and their shares.

    The direction is that of the steepest facet (of equal ones the first). Where a facet lacks a neighbour it is the other one alone.
    """
    h, w = z.shape
    mid = z[1:-1, 1:-1]
    here = np.arange(h * w).reshape(h, w)[1:-1, 1:-1]
    at = lambda step: z[1 + step[0] : h - 1 + step[0], 1 + step[1] : w - 1 + step[1]]
    best, share = np.zeros(mid.shape), np.zeros(mid.shape)
    to = [np.zeros(mid.shape, np.int64), np.zeros(mid.shape, np.int64)]
    for straight, diagonal in FACETS:
        a, b = at(straight), at(diagonal)
        s1, s2, across = mid - a, a - b, (mid - b) / math.sqrt(2)
        angle = np.arctan2(s2, s1)
        fall = np.where(angle <= 0, s1, np.where(angle >= math.pi / 4, across, np.hypot(s1, s2)))
        part = np.clip(angle / (math.pi / 4), 0, 1)
        fall, part = np.where(np.isnan(b), s1, fall), np.where(np.isnan(b), 0.0, part)
        fall, part = np.where(np.isnan(a), across, fall), np.where(np.isnan(a), 1.0, part)
        steeper = fall > best  # false where both are missing
        best, share = np.where(steeper, fall, best), np.where(steeper, part, share)
        for k, step in enumerate((straight, diagonal)):
            to[k] = np.where(steeper, here + step[0] * w + step[1], to[k])
    runs = best > 0
    return to[0], to[1], np.where(runs, 1 - share, 0.0), np.where(runs, share, 0.0)


class _Tile:
    """A tile with two cells around, and how its water runs."""

    def __init__(self, pdf: pd.DataFrame, size: int):
        self.r0, self.c0 = int(pdf["tr"].iloc[0]) * size - 2, int(pdf["tc"].iloc[0]) * size - 2
        self.width = size + 4
        self.place = ((pdf["row"].to_numpy() - self.r0) * self.width + pdf["col"].to_numpy() - self.c0).astype(np.int64)
        z = np.full(self.width * self.width, np.nan)
        z[self.place] = pdf["value"].to_numpy(np.float64, na_value=np.nan)
        self.z = z
        grid = z.reshape(self.width, self.width)
        shares = _shares(grid)
        self.to = [np.zeros(len(z), np.int64), np.zeros(len(z), np.int64)]
        self.share = [np.zeros(len(z)), np.zeros(len(z))]
        inner = np.arange(len(z)).reshape(grid.shape)[1:-1, 1:-1].ravel()
        for k in (0, 1):
            self.to[k][inner], self.share[k][inner] = shares[k].ravel(), shares[2 + k].ravel()
        own = np.zeros(grid.shape, bool)
        own[2:-2, 2:-2] = True
        self.own = own.ravel() & ~np.isnan(z)
        self.order = np.flatnonzero(self.own)[np.argsort(-z[self.own], kind="stable")]  # water only falls

    def entries(self) -> np.ndarray:
        """Own cells that get water from outside the tile."""
        ring = ~self.own & ~np.isnan(self.z)
        got = np.concatenate([self.to[k][ring & (self.share[k] > 0)] for k in (0, 1)])
        got = np.unique(got)
        return got[self.own[got]]

    def run(self, water: np.ndarray) -> np.ndarray:
        """``water`` (a row per place) after it has run down the own cells; what has left lies on the cells around."""
        for i in self.order.tolist():
            for to, share in zip(self.to, self.share, strict=True):
                if share[i] > 0:
                    water[to[i]] += share[i] * water[i]
        return water

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return places // self.width + self.r0, places % self.width + self.c0


def dinf_accumulation(df: DataFrame, size: int = TILE) -> DataFrame:
    """``row``, ``col``, ``flow``: the area in cells that drains through each cell, itself included, along D-infinity directions (two receivers in shares).

    A tile tells what leaves it, of its own and for a unit of water that enters at each cell of its edge:
    a condensed graph whose nodes are the cells where water enters a tile. Water is sent along that graph, round by
    round, until none is left; the rounds are the tiles that the longest path enters, not its cells. Then each tile is
    run once more with what enters. Pits and flats keep their water; missing cells have no flow.
    """
    from ..plans.storage import materialize

    near = haloed(df.select("row", "col", "value"), size, 2)

    def condense(pdf: pd.DataFrame) -> pd.DataFrame:
        tile = _Tile(pdf, size)
        enter = tile.entries()
        water = np.zeros((len(tile.z), 1 + len(enter)))
        water[tile.own, 0] = 1.0
        water[enter, 1 + np.arange(len(enter))] = 1.0
        water = tile.run(water)
        water[tile.own] = 0.0
        left, e = np.nonzero(water)
        r, c = tile.at(left)
        er, ec = tile.at(np.append(0, enter)[e])
        local = e == 0
        return pd.DataFrame({"own": local, "er": np.where(local, 0, er), "ec": np.where(local, 0, ec), "row": r, "col": c, "amount": water[left, e]})

    links = materialize(near.groupBy("tr", "tc").applyInPandas(condense, "own boolean, er long, ec long, row long, col long, amount double"))
    sent = materialize(links.where("own").groupBy("row", "col").agg(F.sum("amount").alias("water")))
    step = links.where("not own").select(F.col("er").alias("row"), F.col("ec").alias("col"), F.col("row").alias("to_row"), F.col("col").alias("to_col"), "amount")
    entered = sent
    while not sent.isEmpty():
        moved = sent.join(step, ["row", "col"]).groupBy(F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.sum(F.col("water") * F.col("amount")).alias("water"))
        sent = materialize(moved)
        entered = entered.unionAll(sent)
    entered = entered.groupBy("row", "col").agg(F.sum("water").alias("water"))
    wet = df.select("row", "col", "value").join(entered, ["row", "col"], "left")

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        tile = _Tile(pdf, size)
        water = np.zeros((len(tile.z), 1))
        water[tile.place, 0] = pdf["water"].fillna(0.0)
        water = np.where(tile.own[:, None], 1.0 + water, 0.0)
        places = tile.place[tile.own[tile.place]]
        r, c = tile.at(places)
        return pd.DataFrame({"row": r, "col": c, "flow": tile.run(water)[places, 0]})

    return haloed(wet, size, 2).groupBy("tr", "tc").applyInPandas(finish, "row long, col long, flow double")


def _nearest_in_row(at: np.ndarray, site: np.ndarray, away: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each place ``at`` (ascending) the site with the least ``(at - site)**2 + away**2``, of equal ones the lower ``rank``.

    The best site moves only forward with the place, so the middle place halves the sites for those on either side: all halvings of a level in one step.
    """
    best = np.zeros(len(at), np.int64)
    a, b = np.array([0]), np.array([len(at)])
    low, high = np.array([0]), np.array([len(site) - 1])
    while len(a):
        mid = (a + b) // 2
        n = high - low + 1
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        s = np.arange(n.sum()) - np.repeat(start - low, n)
        d = (np.repeat(at[mid], n) - site[s]) ** 2 + away[s] ** 2
        least = np.minimum.reduceat(d, start)
        r = np.where(d == np.repeat(least, n), rank[s], len(rank))
        first = np.minimum.reduceat(r, start)
        hit = s[np.flatnonzero(r == np.repeat(first, n))]
        best[mid] = hit
        a, b, low, high = np.concatenate([a, mid + 1]), np.concatenate([mid, b]), np.concatenate([low, hit]), np.concatenate([hit, high])
        left = a < b
        a, b, low, high = a[left], b[left], low[left], high[left]
    return best


def nearest_source(df: DataFrame, source: Column) -> DataFrame:
    """``row``, ``col``, ``value`` with ``src_row``, ``src_col``, ``src_value``, ``d2``: the nearest cell where ``source`` holds (straight-line distance over cells, squared), of equal ones the first by row and column.

    Exact, and without a pair of cell and source: windows along columns carry the next source from
    above and below, and each row then takes the lower envelope over its columns. The box around the raster is filled for that, so
    a missing cell hides no source. Without a source all four are null.
    """
    ends = df.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col"), F.count("*")).first()
    cells = df.select("row", "col", "value", F.coalesce(source, F.lit(False)).alias("_s"), F.lit(True).alias("_own"))
    if ends[4] and (ends[1] - ends[0] + 1) * (ends[3] - ends[2] + 1) > ends[4]:
        rows = df.select("row").distinct().withColumn("col", F.explode(F.sequence(F.lit(ends[2]), F.lit(ends[3]))))
        holes = rows.join(df.select("row", "col"), ["row", "col"], "left_anti")
        cells = cells.unionByName(holes.select("row", "col", F.lit(None).cast("double").alias("value"), F.lit(False).alias("_s"), F.lit(False).alias("_own")))
    mark = F.when(F.col("_s"), F.struct("row", "value"))
    before = F.last(mark, ignorenulls=True).over(Window.partitionBy("col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(mark, ignorenulls=True).over(Window.partitionBy("col").orderBy(F.desc("row")).rowsBetween(Window.unboundedPreceding, 0))
    seen = cells.withColumns({"_a": before, "_b": after})
    up, down = F.col("row") - F.col("_a.row"), F.col("_b.row") - F.col("row")
    seen = seen.withColumn("_n", F.when(down.isNull() | (up <= down), F.col("_a")).otherwise(F.col("_b"))).select("row", "col", "value", "_own", F.col("_n.row").alias("_sr"), F.col("_n.value").alias("_sv"))

    def envelope(group: pa.Table) -> pa.Table:
        group = group.sort_by("col")
        row = group.column("row")[0].as_py()
        own = group.filter(group.column("_own"))
        sites = group.filter(pa.compute.is_valid(group.column("_sr")))
        out = own.select(["row", "col", "value"])
        if not sites.num_rows:
            none = [pa.nulls(own.num_rows, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int64())]
        else:
            site, at_row = sites.column("col").to_numpy(), sites.column("_sr").to_numpy()
            rank = np.empty(len(site), np.int64)
            rank[np.lexsort((site, at_row))] = np.arange(len(site))
            at = own.column("col").to_numpy()
            best = _nearest_in_row(at, site, at_row - row, rank)
            none = [pa.array(at_row[best]), pa.array(site[best]), sites.column("_sv").take(pa.array(best)).combine_chunks(), pa.array((at - site[best]) ** 2 + (row - at_row[best]) ** 2)]
        for name, x in zip(("src_row", "src_col", "src_value", "d2"), none, strict=True):
            out = out.append_column(name, x)
        return out

    types = dict(df.dtypes)
    return seen.groupBy("row").applyInArrow(envelope, f"row {types['row']}, col {types['col']}, value double, src_row long, src_col long, src_value double, d2 long")


def line_cells(lines: DataFrame, grid: Grid, pts: str = "pts") -> DataFrame:
    """``row``, ``col`` of every cell that a line touches: each leg goes through its columns, and in each through the rows it spans there."""
    leg = lines.select(F.explode(segments(F.col(pts))).alias("s")).select("s.*")
    at = lambda v, start: F.floor((v - start) / grid.cell)
    xlo, xhi = F.least("x1", "x2"), F.greatest("x1", "x2")
    leg = leg.where((xhi >= grid.x0) & (xlo <= grid.x0 + grid.n_cols * grid.cell))
    inside = lambda c, n: F.greatest(F.least(c, F.lit(n - 1)), F.lit(0))
    leg = leg.withColumn("col", F.explode(F.sequence(inside(at(xlo, grid.x0), grid.n_cols), inside(at(xhi, grid.x0), grid.n_cols))))
    left = grid.x0 + F.col("col") * grid.cell
    y = lambda x: F.when(F.col("x1") == F.col("x2"), F.col("y1")).otherwise(F.col("y1") + (F.col("y2") - F.col("y1")) * (x - F.col("x1")) / (F.col("x2") - F.col("x1")))
    ya, yb = y(F.greatest(left, xlo)), y(F.least(left + grid.cell, xhi))
    level = F.col("x1") == F.col("x2")  # a leg along a column spans all its rows there
    ylo, yhi = F.when(level, F.least("y1", "y2")).otherwise(F.least(ya, yb)), F.when(level, F.greatest("y1", "y2")).otherwise(F.greatest(ya, yb))
    leg = leg.withColumns({"ylo": ylo, "yhi": yhi}).where((F.col("yhi") >= grid.y0) & (F.col("ylo") <= grid.y0 + grid.n_rows * grid.cell))
    leg = leg.withColumn("row", F.explode(F.sequence(inside(at(F.col("ylo"), grid.y0), grid.n_rows), inside(at(F.col("yhi"), grid.y0), grid.n_rows))))
    return leg.select("row", "col").distinct()


def flow_channels(flow: DataFrame, percentile: float = 95.0) -> DataFrame:
    """``row``, ``col`` of the cells whose flow is at or above a percentile."""
    from .ranking import percentiles

    (least,) = percentiles(flow.where("flow is not null").withColumn("flow", F.log1p("flow")), "flow", [percentile / 100])
    return flow.where(F.log1p("flow") >= F.lit(least)).select("row", "col")


def relative_elevation(dem: DataFrame, sources: Iterable[DataFrame | None]) -> DataFrame:
    """``row``, ``col``, ``value``, ``rem``: elevation of the nearest channel cell less the cell's own, so cells at channel level are high.

    ``sources``: channel cells (``row``, ``col``) from the most to the least trusted: mapped flowlines, other centre lines,
    the raster's own flow. The first one with a cell on the raster is used; without any all are null.
    """
    filled = dem.where("value is not null")
    for channel in sources:
        if channel is not None and not (on := filled.select("row", "col").join(channel.select("row", "col").distinct(), ["row", "col"], "left_semi")).isEmpty():
            marked = dem.join(on.withColumn("_c", F.lit(True)), ["row", "col"], "left")
            near = nearest_source(marked, F.col("_c"))
            return near.select("row", "col", "value", (F.col("src_value") - F.col("value")).alias("rem"))
    return dem.select("row", "col", "value", F.lit(None).cast("double").alias("rem"))


# The published table of landforms by how many of eight directions look up to lower (first index) and to higher (second) ground;
# 1 flat, 2 peak, 3 ridge, 4 shoulder, 5 spur, 6 slope, 7 hollow, 8 footslope, 9 valley, 10 pit; 0 can't be.
FORMS = (
    (1, 1, 1, 8, 8, 9, 9, 9, 10),
    (1, 1, 8, 8, 8, 9, 9, 9, 0),
    (1, 4, 6, 6, 7, 7, 9, 0, 0),
    (4, 4, 6, 6, 6, 7, 0, 0, 0),
    (4, 4, 5, 6, 6, 0, 0, 0, 0),
    (3, 3, 5, 5, 0, 0, 0, 0, 0),
    (3, 3, 3, 0, 0, 0, 0, 0, 0),
    (3, 3, 0, 0, 0, 0, 0, 0, 0),
    (2, 0, 0, 0, 0, 0, 0, 0, 0),
)
#: The landforms that make a terrace: flat, hollow, footslope.
TERRACES = (1, 7, 8)


def landforms(df: DataFrame, radius: int, cell: float, flat: float = 1.0) -> DataFrame:
    """Append ``form`` (1 to 10, see ``FORMS``) and ``terrace`` (1.0 or 0.0); null where the value is.

    In each of eight directions the highest elevation angle over ``radius`` cells and the deepest depression angle
    are compared: higher ground where the first is more than ``flat`` degrees the larger, lower ground where the
    second is. A direction without cells is level. Rows, columns and both diagonals are windows with their own keys.
    """
    lines = {"row": ("row", "col", 1.0), "col": ("col", "row", 1.0), "falling": ("_f", "row", math.sqrt(2)), "rising": ("_r", "row", math.sqrt(2))}
    out = df.withColumns({"_f": F.col("row") - F.col("col"), "_r": F.col("row") + F.col("col")})
    found = []
    for name, (key, along, length) in lines.items():
        for side, ends in (("b", (-radius, -1)), ("a", (1, radius))):
            near = F.collect_list(F.when(F.col("value").isNotNull(), F.struct(F.col(along).alias("p"), F.col("value").alias("v")))).over(Window.partitionBy(key).orderBy(along).rangeBetween(*ends))
            found.append(f"_{name}_{side}")
            here, unit = F.col(along), length * cell
            fall = F.transform(near, lambda x: (x["v"] - F.col("value")) / (F.abs(x["p"] - here) * unit))  # noqa: B023 (built at once)
            # higher minus lower angle, in degrees; angles below the level count as level
            up, down = F.greatest(F.array_max(fall), F.lit(0.0)), F.greatest(-F.array_min(fall), F.lit(0.0))
            out = out.withColumn(found[-1], F.coalesce(F.degrees(F.atan(up)) - F.degrees(F.atan(down)), F.lit(0.0)))
    higher = sum((F.when(F.col(c) > flat, 1).otherwise(0) for c in found), F.lit(0))
    lower = sum((F.when(F.col(c) < -flat, 1).otherwise(0) for c in found), F.lit(0))
    form = F.element_at(F.element_at(F.lit([list(r) for r in FORMS]), lower + 1), higher + 1)
    out = out.withColumn("form", F.when(F.col("value").isNotNull(), form)).drop("_f", "_r", *found)
    return out.withColumn("terrace", F.when(F.col("form").isNotNull(), F.col("form").isin(*TERRACES).cast("double")))


#: Numbers (complex) of a block of rows or columns that a task transforms at a time.
SPECTRUM = 1 << 21


def vertical_derivative(df: DataFrame, cell: float, taper: bool = True, block: int = SPECTRUM) -> DataFrame:
    """Append ``vd``: the first vertical derivative by the Fourier transform, i.e. every wave times its wavenumber.

    Missing cells count as the mean (and stay null), the mean is taken off, and with ``taper`` a Hann window goes to 0 at the
    edges. Blocks of rows are transformed in tasks and cut into blocks of columns; one shuffle transposes them, columns
    are transformed, multiplied and transformed back, and the same way goes back. No task holds more than ``block`` numbers or one row or column.
    """
    r0, r1, c0, c1, mean, there = df.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col"), F.avg("value"), F.count("*")).first()
    if not there or mean is None:
        return df.withColumn("vd", F.lit(None).cast("double"))
    ny, nx = r1 - r0 + 1, c1 - c0 + 1
    tall, wide = max(1, block // nx), max(1, block // ny)
    # the mean of the filled raster is the mean of the cells there are, as holes are filled with it
    hy, hx = (np.hanning(ny), np.hanning(nx)) if taper else (np.ones(ny), np.ones(nx))

    def packed(x: np.ndarray, rows: np.ndarray) -> pa.Table:
        """A row per raster row and block of columns."""
        starts = np.arange(0, x.shape[1], wide)
        parts = [np.ascontiguousarray(x[:, s : s + wide]) for s in starts]
        data = [p[i].tobytes() for i in range(len(rows)) for p in parts]
        return pa.table({"y": np.repeat(rows, len(starts)), "b": np.tile(starts // wide, len(rows)), "x": pa.array(data, pa.binary())})

    def along_rows(group: pa.Table) -> pa.Table:
        y, x = group.column("row").to_numpy() - r0, group.column("col").to_numpy() - c0
        rows = np.unique(y)
        grid = np.zeros((len(rows), nx))
        grid[np.searchsorted(rows, y), x] = np.nan_to_num(group.column("value").to_numpy(zero_copy_only=False).astype(float) - mean)
        return packed(np.fft.fft(grid * hy[rows, None] * hx, axis=1), rows)

    def along_columns(group: pa.Table) -> pa.Table:
        y, b = group.column("y").to_numpy(), group.column("b")[0].as_py()
        x = np.stack([np.frombuffer(v, np.complex128) for v in group.column("x").to_pylist()])
        full = np.zeros((ny, x.shape[1]), np.complex128)  # a row without any cell is all mean
        full[y] = x
        ky, kx = np.fft.fftfreq(ny, d=cell) * 2 * np.pi, np.fft.fftfreq(nx, d=cell)[b * wide : b * wide + x.shape[1]] * 2 * np.pi
        back = np.fft.ifft(np.fft.fft(full, axis=0) * np.hypot(ky[:, None], kx), axis=0)
        return pa.table({"y": y, "b": np.full(len(y), b), "x": pa.array([v.tobytes() for v in back[y]], pa.binary())})

    def back_along_rows(group: pa.Table) -> pa.Table:
        group = group.sort_by([("y", "ascending"), ("b", "ascending")])
        rows = np.unique(group.column("y").to_numpy())
        grid = np.frombuffer(b"".join(group.column("x").to_pylist()), np.complex128).reshape(len(rows), nx)
        out = np.fft.ifft(grid, axis=1).real
        return pa.table({"row": np.repeat(rows + r0, nx), "col": np.tile(np.arange(nx) + c0, len(rows)), "vd": out.ravel()})

    kind = "y long, b long, x binary"
    rows = df.select("row", "col", "value", F.floor((F.col("row") - r0) / tall).alias("k")).groupBy("k").applyInArrow(along_rows, kind)
    back = rows.groupBy("b").applyInArrow(along_columns, kind)
    out = back.withColumn("k", F.floor(F.col("y") / tall)).groupBy("k").applyInArrow(back_along_rows, "row long, col long, vd double")
    return df.join(out, ["row", "col"], "left").withColumn("vd", F.when(F.col("value").isNotNull(), F.col("vd")))


def fourier_derivatives(df: DataFrame, cell: float, taper: bool = True) -> DataFrame:
    """Append ``vd`` (Fourier), ``hgm`` (Sobel, missing cells as 0, edges repeated), ``asa`` and ``tilt`` of a magnetic raster; null where the value is."""
    row, col = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    v = F.coalesce("value", F.lit(0.0))

    def smooth(c: Column, w) -> Column:
        return F.coalesce(F.lag(c).over(w), c) + 2 * c + F.coalesce(F.lead(c).over(w), c)

    def step(name: str, w) -> Column:
        c = F.col(name)
        return (F.coalesce(F.lead(c).over(w), c) - F.coalesce(F.lag(c).over(w), c)) / (8 * cell)

    out = vertical_derivative(df, cell, taper).withColumns({"_y": smooth(v, col), "_x": smooth(v, row)})
    out = out.withColumns({"_gx": step("_y", row), "_gy": step("_x", col)})
    hgm = F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))
    there = F.col("value").isNotNull()
    return out.withColumn("hgm", F.when(there, hgm)).withColumns({"asa": F.sqrt(F.col("hgm") * F.col("hgm") + F.col("vd") * F.col("vd")), "tilt": F.atan2(F.col("vd"), F.col("hgm") + 1e-12)}).drop("_x", "_y", "_gx", "_gy")


def smoothed(df: DataFrame, sigma: float, peak: float | None = None, out: str = "smooth") -> DataFrame:
    """Append ``out``: Gaussian smoothing by weighted windows along rows, then columns; edges are repeated, missing cells count as the mean.

    With ``peak`` the result is scaled so that its largest value is ``peak`` (left as it is where that isn't above 0). Rows need no gaps: a missing
    cell is a null value. A window holds the reach of the kernel, whatever the raster.
    """
    reach = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights = weights / weights.sum()
    tails = np.concatenate([[0.0], np.cumsum(weights)])  # sums of the first k weights
    mean = df.agg(F.avg("value").alias("_m"))
    rows = df.join(F.broadcast(mean), how="cross").withColumn(out, F.coalesce(F.col("value").cast("double"), "_m", F.lit(0.0))).drop("_m")  # one row
    kernel, tail = F.lit(weights.tolist()), F.lit(tails.tolist())
    for key, along in (("row", "col"), ("col", "row")):
        own = Window.partitionBy(key).orderBy(along)
        whole = Window.partitionBy(key)
        near = own.rangeBetween(-reach, reach)
        rows = rows.withColumns({
            "_n": F.collect_list(F.struct((F.col(along) + 0).alias("p"), F.col(out).alias("v"))).over(near), "_lo": F.min(along).over(whole), "_hi": F.max(along).over(whole),
            "_first": F.first(out).over(own.rowsBetween(Window.unboundedPreceding, 0)), "_last": F.first(out).over(Window.partitionBy(key).orderBy(F.desc(along)).rowsBetween(Window.unboundedPreceding, 0)),
        })
        place = F.col(along)
        inside = F.aggregate("_n", F.lit(0.0), lambda a, x: a + x["v"] * F.get(kernel, (x["p"] - place + reach).cast("int")))  # noqa: B023 (built at once)
        before = F.get(tail, F.greatest(reach - (place - F.col("_lo")), F.lit(0)).cast("int"))
        after = F.get(tail, F.greatest(reach - (F.col("_hi") - place), F.lit(0)).cast("int"))
        rows = rows.withColumn(out, inside + before * F.col("_first") + after * F.col("_last")).drop("_n", "_lo", "_hi", "_first", "_last")
    if peak is not None:
        top = rows.agg(F.max(out).alias("_t"))
        rows = rows.join(F.broadcast(top), how="cross").withColumn(out, F.when(F.col("_t") > 0, F.col(out) / F.col("_t") * peak).otherwise(F.col(out))).drop("_t")  # one row
    return rows


def robust(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` scaled to 0..1 between their percentiles 1 and 99, the percentiles of all in one pass; nulls stay."""
    from ..plans.index import normalized
    from .ranking import percentiles_of

    ends = percentiles_of(df, {c: F.col(c).cast("double") for c in columns}, [0.01, 0.99])
    return df.withColumns({c: normalized(df, c, FeatureWeight(1.0, "direct"), ends[c]) for c in columns})


def paleochannel(dem: DataFrame, flow: DataFrame, sources: Iterable[DataFrame | None], cell: float, radius: int = 3, relief: int = 2, hat: int = 2, low: int = 2, weights: tuple[float, float, float] = (0.45, 0.20, 0.35)) -> DataFrame:
    """``row``, ``col``, ``likelihood``: relative elevation, local relief and a geomorphic index, each scaled robustly, weighted, and scaled once more.

    The geomorphic index is the mean, over what isn't null, of terraces (landforms within ``radius``), the black top-hat, the height above
    the low percentile, and ``log1p`` of the flow. Rows of cells are dealt to all tasks first (a small file is one, and a cell is sent
    to 25), and each component is written, so later ones don't repeat it. A cell lacks a likelihood where it lacks one of the three parts.
    """
    from ..plans.storage import materialize

    base = materialize(dem.select("row", "col", "value").repartition(int(dem.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row"))
    rem = materialize(relative_elevation(base, sources).select("row", "col", "rem"))
    parts = materialize(top_hat(local_relief(base, 0, relief), hat).select("row", "col", "value", "lrm", "top_hat"))
    above = materialize(elevation_percentile(base, low).select("row", "col", (F.col("value") - F.col("low")).alias("above")))
    forms = materialize(landforms(base, radius, cell).select("row", "col", "terrace"))
    rows = parts.join(rem, ["row", "col"]).join(above, ["row", "col"]).join(forms, ["row", "col"]).join(flow.select("row", "col", F.log1p("flow").alias("wet")), ["row", "col"], "left")
    rows = robust(materialize(rows), ["rem", "lrm", "terrace", "top_hat", "above", "wet"])
    rows = rows.withColumn("gmi", running_mean(*(F.col(c) for c in ("terrace", "top_hat", "above", "wet"))))
    rows = robust(materialize(rows.select("row", "col", "rem", "lrm", "gmi")), ["gmi"])
    total = sum((F.col(c) * w for c, w in zip(("rem", "lrm", "gmi"), weights, strict=True)), F.lit(0.0)) / sum(weights)
    return robust(materialize(rows.select("row", "col", total.alias("likelihood"))), ["likelihood"])
