"""Raster algebra on long tables (``row``, ``col``, ``value``).

Box statistics are separable: one window along rows, one along columns, each partitioned by the
other coordinate, so a raster of any size spreads over tasks. Kernels that aren't separable go
over neighbourhoods: every cell sends its value to the cells around it (partial aggregation
first), or, for heavy kernels, over tiles with a halo in numpy.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.projection import Crs, reproject
from ..model import Grid


def _along(df: DataFrame, radius: int) -> tuple:
    return (
        Window.partitionBy("row").orderBy("col").rangeBetween(-radius, radius),
        Window.partitionBy("col").orderBy("row").rangeBetween(-radius, radius),
    )


def box(df: DataFrame, radius: int, how: str = "mean", value: str = "value", out: str = "box") -> DataFrame:
    """Append the mean, max or min over the (2 r + 1) squared cells around, missing cells left out."""
    across, down = _along(df, radius)
    if how == "mean":
        part = df.withColumns({"_s": F.sum(value).over(across), "_n": F.count(value).over(across)})
        s, n = F.sum("_s").over(down), F.sum("_n").over(down)
        return part.withColumn(out, F.when(n > 0, s / n)).drop("_s", "_n")
    f = {"max": F.max, "min": F.min}[how]
    return df.withColumn("_m", f(value).over(across)).withColumn(out, f("_m").over(down)).drop("_m")


def mirrored(df: DataFrame, radius: int, n_rows: int, n_cols: int) -> DataFrame:
    """The raster with ``radius`` mirrored cells at each edge (the edge cell itself comes first)."""

    def copies(axis: str, n: int) -> Column:
        c = F.col(axis)
        low, high = F.when(c < radius, F.array(-c - 1)), F.when(c >= n - radius, F.array(2 * n - 1 - c))
        empty = F.array().cast("array<bigint>")
        return F.explode(F.concat(F.array(c.cast("bigint")), F.coalesce(low.cast("array<bigint>"), empty), F.coalesce(high.cast("array<bigint>"), empty)))

    rest = [c for c in df.columns if c not in ("row", "col")]
    rows = df.select(copies("row", n_rows).alias("row"), "col", *rest)
    return rows.select("row", copies("col", n_cols).alias("col"), *rest)


def tpi(df: DataFrame, radius: int, n_rows: int, n_cols: int) -> DataFrame:
    """Append ``tpi``: value less the box mean with mirrored edges; missing values count as the global mean and stay null in the result."""
    mean = df.agg(F.avg("value").alias("_g"))
    filled = df.join(F.broadcast(mean), how="cross").withColumn("_v", F.coalesce("value", "_g")).drop("_g")  # one row
    out = box(mirrored(filled, radius, n_rows, n_cols), radius, "mean", "_v", "_box")
    inside = out.where(F.col("row").between(0, n_rows - 1) & F.col("col").between(0, n_cols - 1))
    return inside.withColumn("tpi", F.col("value") - F.col("_box")).drop("_v", "_box")


def top_hat(df: DataFrame, radius: int) -> DataFrame:
    """Append ``top_hat``: grey closing (maximum, then minimum) less the value."""
    closed = box(box(df, radius, "max", "value", "_d"), radius, "min", "_d", "_c")
    return closed.withColumn("top_hat", F.col("_c") - F.col("value")).drop("_d", "_c")


def local_relief(df: DataFrame, small: int, large: int) -> DataFrame:
    """Append ``lrm``: the small box mean less the large one."""
    return box(box(df, small, "mean", "value", "_a"), large, "mean", "value", "_b").withColumn("lrm", F.col("_a") - F.col("_b")).drop("_a", "_b")


def slope_tri(df: DataFrame, cell: float) -> DataFrame:
    """Append ``slope`` (degrees; central differences, one-sided at edges) and ``tri`` (mean absolute difference to the eight neighbours, edges repeated)."""
    row, col = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    v = F.col("value")
    rows = df.withColumns({"_w": F.lag("value").over(row), "_e": F.lead("value").over(row), "_n": F.lag("value").over(col), "_s": F.lead("value").over(col)})
    grad = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), (b - a) / (2 * cell)).when(b.isNotNull(), (b - v) / cell).when(a.isNotNull(), (v - a) / cell).otherwise(0.0)
    rows = rows.withColumns({"_gx": grad(F.col("_w"), F.col("_e")), "_gy": grad(F.col("_n"), F.col("_s"))})
    rows = rows.withColumns({"_w": F.coalesce("_w", "value"), "_e": F.coalesce("_e", "value")})
    # the corners are the west and east neighbours (edges repeated) of the rows above and below
    near = {f"_{n}{c}": f(f"_{c}").over(col) for n, f in (("n", F.lag), ("s", F.lead)) for c in ("w", "e")}
    rows = rows.withColumns(near)
    rows = rows.withColumns({**{f"_{n}{c}": F.coalesce(f"_{n}{c}", f"_{c}") for n in "ns" for c in "we"}, "_n": F.coalesce("_n", "value"), "_s": F.coalesce("_s", "value")})
    total = sum((F.abs(F.col(f"_{k}") - v) for k in ("n", "s", "w", "e", "nw", "ne", "sw", "se")), F.lit(0.0))
    slope = F.degrees(F.atan(F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))))
    return rows.withColumns({"slope": slope, "tri": total / 8.0, "gradient": F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))}).drop(*[c for c in rows.columns if c.startswith("_")])


def channel_steepness(df: DataFrame, flow: str = "flow", theta: float = 0.45) -> DataFrame:
    """Append ``ksn``: gradient times flow to the power theta, scaled to 0..1 over the raster (needs ``gradient``)."""
    rows = df.withColumn("_k", F.when(F.col(flow) > 0, F.col("gradient") * F.pow(flow, F.lit(theta))))
    ends = rows.agg(F.min("_k").alias("_lo"), F.max("_k").alias("_hi"))
    k = F.when(F.col("_hi") > F.col("_lo"), (F.col("_k") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.when(F.col("_k").isNotNull(), 0.0))
    return rows.join(F.broadcast(ends), how="cross").withColumn("ksn", k).drop("_k", "_lo", "_hi")  # one row


def two_bands(first: DataFrame, second: DataFrame) -> DataFrame:
    """``row``, ``col``, ``band1``, ``band2`` of two rasters of one shape; another extent of rows or columns is an error."""
    shape = lambda df: tuple(df.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first())
    if shape(first) != shape(second):
        raise ValueError("the rasters differ in shape")
    a, b = (df.select("row", "col", F.col("value").alias(n)) for df, n in ((first, "band1"), (second, "band2")))
    return a.join(b, ["row", "col"], "full")


def decimate(df: DataFrame, by: int) -> DataFrame:
    """Area mean over blocks of ``by`` cells: ``row``, ``col``, ``value``, ``n``."""
    return df.groupBy(F.floor(F.col("row") / by).alias("row"), F.floor(F.col("col") / by).alias("col")).agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def focal(df: DataFrame, radius: int, aggregate: Column, out: str) -> DataFrame:
    """Append any aggregate (of column ``v``) over the cells around: every cell sends its value to its neighbourhood."""
    step = F.sequence(F.lit(-radius), F.lit(radius))
    sent = df.select("row", "col", F.col("value").alias("v")).withColumn("dr", F.explode(step)).withColumn("dc", F.explode(step))
    got = sent.groupBy((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col")).agg(aggregate.alias(out))
    return df.join(got, ["row", "col"], "left")


def elevation_percentile(df: DataFrame, radius: int, p: float = 0.1) -> DataFrame:
    """Append ``low``: a percentile of the cells around, between two values in proportion.

    Values are sent along rows and listed, and the lists are sent along columns: 2 (2 r + 1) rows a cell, not (2 r + 1) squared.
    """
    step = F.sequence(F.lit(-radius), F.lit(radius))
    sent = df.where(F.col("value").isNotNull()).select("row", "col", F.col("value").alias("v")).withColumn("d", F.explode(step))
    lists = sent.groupBy("row", (F.col("col") + F.col("d")).alias("col")).agg(F.collect_list("v").alias("v")).withColumn("d", F.explode(step))
    near = lists.groupBy((F.col("row") + F.col("d")).alias("row"), "col").agg(F.array_sort(F.flatten(F.collect_list("v"))).alias("v"))
    at = (F.size("v") - 1) * F.lit(float(p))
    low, high = F.get("v", F.floor(at).cast("int")), F.get("v", F.ceil(at).cast("int"))
    value = F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).cast("double")
    return df.join(near.select("row", "col", value.alias("low")), ["row", "col"], "left")


def running_mean(*columns: Column) -> Column:
    """Mean of the columns that aren't null; null where all are."""
    n = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0)) / n)


def bilinear(raster: DataFrame, points: DataFrame, x0: float, y0: float, cell: float) -> DataFrame:
    """Append ``sampled``: bilinear value of a raster at points, by an equi-join with the four cells around (missing ones left out, weights renewed)."""
    fx, fy = (F.col("x") - x0) / cell - 0.5, (F.col("y") - y0) / cell - 0.5
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    spread = points.withColumns({"_c": F.floor(fx), "_r": F.floor(fy), "_key": F.struct("x", "y")}).withColumn("_k", F.explode(corners))
    wx, wy = fx - F.col("_c"), fy - F.col("_r")
    w = F.when(F.col("_k.i") == 1, wy).otherwise(1 - wy) * F.when(F.col("_k.j") == 1, wx).otherwise(1 - wx)
    spread = spread.select("x", "y", (F.col("_r") + F.col("_k.i")).alias("row"), (F.col("_c") + F.col("_k.j")).alias("col"), w.alias("w"))
    met = spread.distinct().join(raster.select("row", "col", "value").where("value is not null"), ["row", "col"])
    best = met.groupBy("x", "y").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("sampled"))
    return points.join(best, ["x", "y"], "left")


def nearest_pixel(raster: DataFrame, points: DataFrame, x0: float, y0: float, cell: float) -> DataFrame:
    """Append ``sampled``: the value of the cell that holds each point."""
    at = points.withColumns({"col": F.floor((F.col("x") - x0) / cell), "row": F.floor((F.col("y") - y0) / cell)})
    return at.join(raster.select("row", "col", F.col("value").alias("sampled")), ["row", "col"], "left").drop("row", "col")


def haloed(df: DataFrame, size: int, halo: int) -> DataFrame:
    """A row per cell and tile that it is in or at most ``halo`` cells outside of (``halo`` up to ``size``): ``tr``, ``tc`` in front."""
    r, c = F.floor(F.col("row") / size), F.floor(F.col("col") / size)
    step = F.sequence(F.lit(-1), F.lit(1))
    near = df.withColumn("dr", F.explode(step)).withColumn("dc", F.explode(step)).withColumns({"tr": r + F.col("dr"), "tc": c + F.col("dc")})
    edge = lambda x, t: F.col(x).between(F.col(t) * size - halo, F.col(t) * size + size - 1 + halo)
    return near.where(edge("row", "tr") & edge("col", "tc")).select("tr", "tc", *df.columns)


def tiles(df: DataFrame, size: int, halo: int, kernel: Callable[[np.ndarray], np.ndarray], out: str = "out") -> DataFrame:
    """Append ``kernel`` of the raster, tile by tile: each tile gets ``halo`` cells of its neighbours, so memory is bounded by ``size``.

    ``kernel`` maps a 2-D array (missing cells NaN) to one of the same shape.
    """
    near = haloed(df.select("row", "col", "value"), size, halo)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf["tr"].iloc[0]), int(pdf["tc"].iloc[0])
        r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
        grid = np.full((int(pdf["row"].max()) - r0 + 1, int(pdf["col"].max()) - c0 + 1), np.nan)
        i, j = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
        grid[i, j] = pdf["value"]
        own = ((pdf["row"] // size == tr) & (pdf["col"] // size == tc)).to_numpy()
        got = kernel(grid)[i, j][own]
        return pd.DataFrame({"row": pdf["row"][own], "col": pdf["col"][own], out: got})

    made = near.groupBy("tr", "tc").applyInPandas(run, f"row long, col long, {out} double")
    return df.join(made.withColumn(out, F.nanvl(out, F.lit(None))), ["row", "col"], "left")


def gaussian(grid: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian smoothing, edges repeated, missing cells as the mean of the rest."""
    reach = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    k /= k.sum()
    g = np.where(np.isnan(grid), np.nanmean(grid) if not np.isnan(grid).all() else 0.0, grid)
    for axis in (0, 1):
        g = np.apply_along_axis(lambda v: np.convolve(np.pad(v, reach, mode="edge"), k, "valid"), axis, g)
    return g


def curvature(kind: str, sigma: float, cell: float) -> Callable[[np.ndarray], np.ndarray]:
    """Kernel for ``tiles``: plan or profile curvature of the smoothed surface."""

    def kernel(grid: np.ndarray) -> np.ndarray:
        if min(grid.shape) < 2:
            return np.zeros_like(grid)
        z = gaussian(grid, sigma)
        zy, zx = np.gradient(z, cell)
        zyy, _ = np.gradient(zy, cell)
        zxy, zxx = np.gradient(zx, cell)
        p = zx**2 + zy**2
        with np.errstate(divide="ignore", invalid="ignore"):
            if kind == "plan":
                c = (zxx * zy**2 - 2 * zxy * zx * zy + zyy * zx**2) / p**1.5
            else:
                c = (zxx * zx**2 + 2 * zxy * zx * zy + zyy * zy**2) / (p * (1 + p) ** 1.5)
        return np.where(p > 1e-12, c, 0.0)

    return kernel


def glcm_contrast(levels: int = 16, window: int = 5) -> Callable[[np.ndarray], np.ndarray]:
    """Kernel for ``tiles``: texture contrast of horizontal neighbours in a window. Values must be scaled to 0..1."""

    def kernel(grid: np.ndarray) -> np.ndarray:
        q = np.clip(np.nan_to_num(grid) * levels, 0, levels - 1).astype(int)
        half = window // 2
        diff = np.pad((q[:, 1:] - q[:, :-1]) ** 2, ((half, half), (half, half)), mode="edge").astype(float)
        view = np.lib.stride_tricks.sliding_window_view(diff, (window, window - 1)).mean((2, 3))
        return view[: grid.shape[0], : grid.shape[1]]

    return kernel


def texture(df: DataFrame, levels: int = 16, window: int = 5) -> DataFrame:
    """Append ``contrast``, ``dissimilarity``, ``homogeneity``, ``correlation`` of the co-occurrence of horizontal neighbours around each cell.

    Values are put in ``levels`` steps between their 5th and 95th percentile (nulls in the lowest). The symmetric co-occurrence matrix of a window
    is never built: its four properties are sums over the window's pairs, so windows along rows and then columns give them. Cells without a whole window
    get nulls; a window of one level has correlation 1.
    """
    from .ranking import percentiles

    lo, hi = percentiles(df, "value", [0.05, 0.95])
    lo, span = (0.0, 1.0) if lo is None else (lo, max(hi - lo, 1e-9))
    level = F.when(F.col("value").isNull(), 0.0).otherwise(F.floor(F.greatest(F.least((F.col("value") - lo) / span, F.lit(1.0)), F.lit(0.0)) * (levels - 1)).cast("double"))
    order, half, pairs = Window.partitionBy("row").orderBy("col"), window // 2, window * (window - 1)
    i, j = F.col("_q"), F.when(F.lead("col").over(order) == F.col("col") + 1, F.lead("_q").over(order))
    terms = {"_d2": (i - j) * (i - j), "_d1": F.abs(i - j), "_h": 1 / (1 + (i - j) * (i - j)), "_s": i + j, "_ss": i * i + j * j, "_ij": i * j}
    rows = df.withColumn("_q", level).withColumns(terms)
    along = order.rangeBetween(-half, half - 1)
    rows = rows.withColumns({t: F.sum(t).over(along) for t in terms} | {"_n": F.count("_d1").over(along)})
    down = Window.partitionBy("col").orderBy("row").rangeBetween(-half, half)
    rows = rows.withColumns({t: F.sum(t).over(down) / pairs for t in terms} | {"_n": F.sum("_n").over(down)})
    mean = F.col("_s") / 2
    spread = F.col("_ss") / 2 - mean * mean
    whole = lambda c: F.when(F.col("_n") == pairs, c)
    return rows.withColumns({
        "contrast": whole(F.col("_d2")), "dissimilarity": whole(F.col("_d1")), "homogeneity": whole(F.col("_h")), "correlation": whole(F.when(spread > 1e-12, (F.col("_ij") - mean * mean) / spread).otherwise(1.0)),
    }).drop("_q", "_n", *terms)


def flow_accumulation(df: DataFrame) -> DataFrame:
    """``row``, ``col``, ``flow``: cells that drain through each cell, itself included, along the steepest of eight descents.

    Every cell points at its receiver. Pointers are doubled: after k rounds a cell knows how many
    cells drain to it over fewer than 2^k steps and where its water is after 2^k steps, so the
    rounds are the logarithm of the longest path. Each round is written to the shared folder. Both sides of a
    round's joins are cells, so they meet by shuffle: a broadcast a round would send them through the driver.
    """
    from ..plans.storage import materialize

    step = F.sequence(F.lit(-1), F.lit(1))
    near = df.select("row", "col", "value").withColumn("dr", F.explode(step)).withColumn("dc", F.explode(step)).where("dr <> 0 or dc <> 0")
    near = near.select((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("value").alias("v2"), F.sqrt((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).cast("double")).alias("len"))
    drop = df.join(near.hint("merge"), ["row", "col"]).withColumn("fall", (F.col("value") - F.col("v2")) / F.col("len")).where("fall > 0")
    receiver = drop.groupBy("row", "col").agg(F.max(F.struct("fall", -F.col("r2"), -F.col("c2"), F.struct(F.col("r2").alias("row"), F.col("c2").alias("col")).alias("to"))).alias("b")).select("row", "col", F.col("b.to").alias("to"))
    state = df.select("row", "col").join(receiver.hint("merge"), ["row", "col"], "left").select(F.struct("row", "col").alias("cell"), "to", F.lit(1).cast("long").alias("flow"))
    state = materialize(state)
    while not state.where("to is not null").isEmpty():
        more = state.where("to is not null").groupBy(F.col("to").alias("cell")).agg(F.sum("flow").alias("more"))
        further = state.where("to is not null").select(F.col("cell").alias("to"), F.col("to").alias("next"))
        state = materialize(state.join(more.hint("merge"), "cell", "left").join(further.hint("merge"), "to", "left").select("cell", F.col("next").alias("to"), (F.col("flow") + F.coalesce("more", F.lit(0))).alias("flow")))
    return state.select("cell.row", "cell.col", "flow")


def magnetic_derivatives(df: DataFrame, cell: float) -> DataFrame:
    """Append ``hgm``, ``asa``, ``tilt`` from the horizontal gradient and the vertical one, here the negative Laplacian upward-continued one cell.

    A Fourier vertical derivative needs the whole raster in one place; this local one doesn't.
    """
    row, col = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    pick = lambda f, w: F.coalesce(f("value").over(w), F.col("value"))
    rows = df.withColumns({"_w": pick(F.lag, row), "_e": pick(F.lead, row), "_n": pick(F.lag, col), "_s": pick(F.lead, col)})
    gx, gy = (F.col("_e") - F.col("_w")) / (2 * cell), (F.col("_s") - F.col("_n")) / (2 * cell)
    gz = (4 * F.col("value") - F.col("_w") - F.col("_e") - F.col("_n") - F.col("_s")) / (4 * cell)
    hgm = F.sqrt(gx * gx + gy * gy)
    return rows.withColumns({"hgm": hgm, "asa": F.sqrt(gx * gx + gy * gy + gz * gz), "tilt": F.atan2(gz, hgm)}).drop("_w", "_e", "_n", "_s")


def warp(df: DataFrame, source: Grid, source_crs: Crs, target: Grid, target_crs: Crs, how: str = "bilinear") -> DataFrame:
    """``row``, ``col``, ``value`` on another grid in another coordinate system: every target cell looks back at where its centre lies in the source.

    ``how``: ``bilinear`` (missing neighbours left out) or ``nearest``; a cell whose centre falls outside of the source is null. One equi-join of target cells with source cells.
    """
    at = reproject(target.cells(df.sparkSession).select(F.col("row").alias("_tr"), F.col("col").alias("_tc"), "x", "y"), target_crs, source_crs)
    look = bilinear if how == "bilinear" else nearest_pixel
    inside = F.col("x").between(source.x0, source.x0 + source.n_cols * source.cell) & F.col("y").between(source.y0, source.y0 + source.n_rows * source.cell)
    got = look(df.select("row", "col", "value"), at.where(inside), source.x0, source.y0, source.cell)
    cells = at.select("_tr", "_tc").join(got.select("_tr", "_tc", "sampled"), ["_tr", "_tc"], "left")
    return cells.select(F.col("_tr").alias("row"), F.col("_tc").alias("col"), F.col("sampled").alias("value"))
