"""River networks: a table of reaches with a linear order (``hydroseq``, larger is upstream) and a running length (``arbolate``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import ordered


def upstream_max(reaches: DataFrame, seeds: DataFrame) -> DataFrame:
    """Append ``seed_max``: the largest ``arbolate`` of the seeds whose ``hydroseq`` is at or above the reach's; null without one.

    A running maximum over the union of both, kept by ranges: no inequality join.
    """
    marks = seeds.groupBy("hydroseq").agg(F.max("arbolate").alias("seed"))
    both = reaches.select("comid", "hydroseq", F.lit(None).cast("double").alias("seed")).unionByName(marks.select(F.lit(None).cast("bigint").alias("comid"), "hydroseq", "seed"))
    return reaches.join(running_max(both, "hydroseq", "seed").where("comid is not null").select("comid", F.col("best").alias("seed_max")), "comid")


def running_max(df: DataFrame, order: str, value: str) -> DataFrame:
    """Append ``best``: the largest ``value`` among rows with ``order`` at or above the row's (ties count)."""
    from pyspark.sql import Window

    n = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(order).cast("double")
    bounds = sorted(set(df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 50 * n)).first()[0] or []))
    edges = F.array(*map(F.lit, bounds)).cast("array<double>")
    rows = df.withColumn("_r", F.size(F.filter(edges, lambda b: b > key)))
    own = Window.partitionBy("_r").orderBy(F.col(order).desc())
    tops = rows.groupBy("_r").agg(F.max(value).alias("_m"))
    earlier = F.broadcast(tops.withColumn("_before", F.max("_m").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))).select("_r", "_before"))  # a row per range
    run = rows.withColumn("_own", F.max(value).over(own.rangeBetween(Window.unboundedPreceding, 0)))
    return run.join(earlier, "_r").withColumn("best", F.greatest("_own", "_before")).drop("_r", "_own", "_before")


def distance_downstream(reaches: DataFrame, seeds: DataFrame, longest: float) -> DataFrame:
    """Append ``downstream``: running length from the nearest seed upstream, null outside 0 to ``longest``."""
    guard_lode(seeds)
    d = F.col("arbolate") - F.col("seed_max")
    return upstream_max(reaches, seeds).withColumn("downstream", F.when(d.between(0, longest), d))


def snapped_downstream(points: DataFrame, reaches: DataFrame, seeds: DataFrame, key: str, radius: float, longest: float) -> DataFrame:
    """``key``, ``comid``, ``downstream`` for each point: seeds and points go to their nearest reach in ``radius`` (ties: smaller ``comid``), and the running length from the nearest seed upstream is read there.

    ``reaches``: ``comid``, ``hydroseq``, ``arbolate``, ``x``, ``y``. Null without a reach or a seed upstream, and outside 0 to ``longest``.
    """
    from .spatial import nearest_within

    guard_lode(seeds)
    marks = nearest_within(seeds.select("x", "y").distinct().withColumn("seed", F.struct("x", "y")), reaches, radius, "seed", "comid", ["hydroseq", "arbolate"])
    marks = marks.where("near_id is not null").select("hydroseq", "arbolate").distinct()
    along = distance_downstream(reaches.select("comid", "hydroseq", "arbolate"), marks.withColumn("dep_type", F.lit("snapped")), longest)
    at = nearest_within(points.select(key, "x", "y"), reaches, radius, key, "comid").select(key, F.col("near_id").alias("comid"))
    return at.join(along.select("comid", "downstream"), "comid", "left").select(key, "comid", "downstream")


def guard_lode(seeds: DataFrame) -> None:
    """Raise if seeds are placers (they are what is predicted) or can't tell."""
    if "dep_type" not in seeds.columns:
        raise KeyError("seeds need dep_type to show that none is a placer")
    if not seeds.where(F.col("dep_type").rlike("(?i)placer")).isEmpty():
        raise ValueError("placer seeds would leak labels")


#: Rows that one task sums exactly, the most ranges (of order and of length) that a larger group is dealt to at a time, and rows that a range gets where that is enough of them.
RANGE_ROWS, RANGES, DEALT = 600_000, 512, 100_000
#: Up to so many pairs of reach and sample are simply joined.
PAIRS = 4_000_000
#: The span of a group's lengths, in decays, up to which one factor for each row is a double.
SPAN = 600.0


def dual_decay(cells: DataFrame, samples: DataFrame, near: float = 5.0, far: float = 25.0, alpha: float = 0.3, sign: int = 1, ranges: int | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    """``comid``, ``n_samples``, ``catchment``: the mean of the samples at or above each reach, weighed by a near and a far decay of running length (see ``decay_sums``)."""
    sums = decay_sums(cells, samples, near, far, alpha, sign, ranges, rows)
    return sums.select("comid", F.col("n").cast("long").alias("n_samples"), F.when(F.col("w") > 0, F.col("wv") / F.col("w")).alias("catchment"))


def decay_sums(cells: DataFrame, samples: DataFrame, near: float = 5.0, far: float = 25.0, alpha: float = 0.3, sign: int = 1, ranges: int | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    """``comid``, ``n``, ``w``, ``wv`` for each reach with a sample at or above it: samples, the sum of their weights, and of weights times values (see ``decay_parts``)."""
    parts = decay_parts(cells, samples.withColumn("f", F.lit(0)), [0], near, far, alpha, sign, ranges, rows)
    return parts.groupBy("comid").agg(*(F.sum(c).alias(c) for c in ("m", "n", "w", "wv"))).where("m > 0").select("comid", "n", "w", "wv")


def decay_parts(cells: DataFrame, samples: DataFrame, kinds: list[int], near: float = 5.0, far: float = 25.0, alpha: float = 0.3, sign: int = 1, ranges: int | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    """``f``, ``comid``, ``m``, ``n``, ``w``, ``wv``: addends of the sums for each reach over the samples of each of ``kinds`` (their column ``f``) at or above it.

    Both sides are first reduced to reaches (samples with one reach and value count together). A group
    of more than ``rows`` rows is dealt to ranges of ``hydroseq`` and bins of running length, ``ranges`` or as many as its rows ask for. A table of sums for each range and
    bin, decayed to the bin's edge, tells what other bins of ranges above give; the rows of the own range and those of
    the own bin are groups of their own, dealt again while they are large: tables and tasks keep a bounded size, and a
    level does for ``RANGES * rows`` rows. Groups of up to ``rows`` are summed exactly in a task each, by halves in order of ``hydroseq``. Pairs are
    formed only where ``PAIRS`` bounds them. ``sign``: 1 if the running length shrinks downstream, -1 if it grows.
    Distances below 0, and those to or from a null running length, count as 0. ``ranges`` given: no pairs are formed.
    """
    from ..plans.storage import materialize, small

    at = samples.where("hydroseq is not null").groupBy("f", "hydroseq", "arbolate").agg(F.count("value").cast("double").alias("n"), F.coalesce(F.sum(F.col("value").cast("double")), F.lit(0.0)).alias("v")).withColumn("m", F.lit(1.0))
    reach = cells.select("comid", "hydroseq", "arbolate").where("hydroseq is not null").distinct()
    comid = dict(reach.dtypes)["comid"]
    each = reach.select(F.explode(F.array(*map(F.lit, kinds))).alias("f"), "*")
    both = at.select("f", F.lit(None).cast(comid).alias("comid"), "hydroseq", "arbolate", "m", "n", "v").unionByName(each.select("*", *(F.lit(0.0).alias(c) for c in "mnv")))
    both = materialize(both)
    given, reaches, lo, hi = both.withColumn("len", sign * F.col("arbolate").cast("double")).agg(F.count_if(F.col("m") > 0), F.count_if(F.col("m") == 0), F.min("len"), F.max("len")).first()
    if ranges is None and reaches // max(len(kinds), 1) * given <= PAIRS:
        return _paired(both.where("m = 0").select("f", "comid", "hydroseq", "arbolate"), both.where("m > 0").select("f", "hydroseq", "arbolate", "m", "n", "v"), near, far, alpha, sign)
    k = ranges or min(RANGES, max(2, -(-(given + reaches) // (max(len(kinds), 1) * DEALT))))
    both = both.withColumn("len", F.coalesce(sign * F.col("arbolate").cast("double"), F.when(F.col("m") > 0, F.lit(lo or 0.0)).otherwise(F.lit(hi or 0.0))))
    keys = ["f", "comid", "p", "len", "m", "n", "v"]
    kind = f"f int, comid {comid}, m double, n double, w double, wv double"
    level = both.select(F.col("f").cast("long").alias("g"), F.col("f").cast("int").alias("f"), "comid", F.col("hydroseq").cast("double").alias("p"), "len", "m", "n", "v")

    def exact(group: pa.Table) -> pa.Table:
        return _own(group, near, far, alpha)

    def shrunk(d: Column, tau: float) -> Column:
        return F.exp(-d / tau) if tau > 0 else F.lit(0.0)

    flat = (1.0 if near > 0 else 0.0) + (alpha if far > 0 else 0.0)
    masses = ["all_m", "all_n", "flat_n", "flat_v", "near_n", "near_v", "far_n", "far_v"]
    parts, first = [], True
    while True:
        sizes = level.groupBy("g").agg(F.count("*").alias("size"), F.sum("m").alias("given")).where("given > 0 and size > given")  # both sides are there
        sizes = materialize(sizes.select("g", (F.col("size") > (0 if first and ranges else rows)).alias("large")))
        first = False
        parts.append(level.join(small(sizes.where("not large").select("g")), "g", "left_semi").select("g", *keys).groupBy("g").applyInArrow(exact, kind))
        large = small(sizes.where("large").select("g"))
        if sizes.where("large").isEmpty():
            break
        rows_ = level.join(large, "g", "left_semi")
        points = [i / k for i in range(1, k)] or [0.5]
        bounds = rows_.groupBy("g").agg(*(F.array_sort(F.array_distinct(F.percentile_approx(c, points, 50 * k))).alias(f"e{c}") for c in ("p", "len")))
        bounds = small(materialize(bounds), 1000)
        edges = rows_.sparkSession.sparkContext.broadcast({r.g: (np.array(r.ep), np.array(r.elen)) for r in bounds.collect()})  # of groups of over ``rows`` rows each

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _placed(batch, edges.value)  # noqa: B023 (a broadcast of this level)

        placed = materialize(rows_.select("g", *keys).mapInArrow(place, f"g long, f int, comid {comid}, p double, len double, m double, n double, v double, r int, b int, low double, gap double"))
        sums = [F.sum("m"), F.sum("n"), *(F.sum(flat * F.col(c)) for c in "nv")] + [F.sum(F.when(F.col("b") > 0, shrunk(F.col("low"), tau) * F.col(c)).otherwise(0.0)) for tau in (near, far) for c in "nv"]
        told = placed.where("m > 0").groupBy("g", "r", "b").agg(*(x.alias(f"s{i}") for i, x in enumerate(sums)))

        def above(group: pa.Table) -> pa.Table:
            g = group.column("g")[0].as_py()
            lows = np.concatenate([[0.0], np.repeat(edges.value[g][1], 2)])  # noqa: B023
            r, b, got = _above(*(group.column(c).to_numpy() for c in "rb"), np.stack([group.column(f"s{i}").to_numpy() for i in range(8)], 1), lows, near, far)
            return pa.table({"g": pa.array(np.full(len(r), g)), "r": pa.array(r.astype(np.int32)), "b": pa.array(b.astype(np.int32)), **{n: pa.array(got[:, i]) for i, n in enumerate(masses)}})

        table = told.groupBy("g").applyInArrow(above, "g long, r int, b int, " + ", ".join(f"{c} double" for c in masses))
        fn, ff = (F.when(F.col("gap").isNotNull(), shrunk(F.col("gap"), tau)).otherwise(1.0 if tau > 0 else 0.0) for tau in (near, far))
        mass = lambda c: F.col(f"flat_{c}") + fn * F.col(f"near_{c}") + alpha * ff * F.col(f"far_{c}")  # noqa: E731, B023 (used at once)
        others = placed.where("m = 0").join(small(materialize(table)), ["g", "r", "b"])
        parts.append(others.select("f", "comid", F.col("all_m").alias("m"), F.col("all_n").alias("n"), mass("n").alias("w"), mass("v").alias("wv")))
        # within a range by hydroseq; within a bin by the ranges above (of a range that is one value: also that)
        ahead = F.when(F.col("m") > 0, F.col("r")).otherwise(F.col("r") + 1 - F.col("r") % 2).cast("double")
        child = lambda which, at: ((F.col("g") * 2 + which) * (2 * k + 2) + 1 + F.col(at)).alias("g")  # noqa: E731, B023 (used at once)
        own_range = placed.where("r % 2 = 0").select(child(0, "r"), *keys)
        own_bin = placed.where("b % 2 = 0").select(child(1, "b"), "f", "comid", ahead.alias("p"), "len", "m", "n", "v")
        level = own_range.unionByName(own_bin)
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every


def _paired(reach: DataFrame, at: DataFrame, near: float, far: float, alpha: float, sign: int) -> DataFrame:
    pairs = reach.join(at.select("f", F.col("hydroseq").alias("s_seq"), F.col("arbolate").alias("s_len"), "m", "n", "v"), ["f"]).where(F.col("s_seq") >= F.col("hydroseq"))
    d = F.greatest(sign * (F.col("s_len") - F.col("arbolate")), F.lit(0.0))
    w = (F.exp(-d / near) if near > 0 else F.lit(0.0)) + (alpha * F.exp(-d / far) if far > 0 else F.lit(0.0))
    return pairs.groupBy("f", "comid").agg(F.sum("m").alias("m"), F.sum("n").alias("n"), F.sum(w * F.col("n")).alias("w"), F.sum(w * F.col("v")).alias("wv"))


def _placed(batch: pa.RecordBatch, edges: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Append the range ``r``, the bin ``b`` and the lengths from its lower (``low``) and to its upper edge (``gap``, null in the last bin).

    Even: between two edges; odd: an edge itself, so that no value, however frequent, fills a range that has to be ordered.
    """
    g, p, length = (batch.column(c).to_numpy() for c in ("g", "p", "len"))
    r, b, low, gap = (np.zeros(len(g), t) for t in (np.int32, np.int32, float, float))
    for one in np.unique(g):
        own = np.flatnonzero(g == one)
        for at, x, e in ((r, p[own], edges[one][0]), (b, length[own], edges[one][1])):
            i = np.searchsorted(e, x)
            at[own] = 2 * i + (e[np.minimum(i, len(e) - 1)] == x)
        e, x, own_b = edges[one][1], length[own], b[own]
        low[own] = np.where(own_b > 0, x - e[np.maximum(own_b - 1, 0) // 2], np.nan)
        gap[own] = np.where(own_b // 2 < len(e), e[np.minimum(own_b // 2, len(e) - 1)] - x, np.nan)
    made = {"r": pa.array(r), "b": pa.array(b), "low": pa.array(low, from_pandas=True), "gap": pa.array(gap, from_pandas=True)}
    return pa.RecordBatch.from_arrays([*batch.columns, *made.values()], [*batch.schema.names, *made])


def _above(r: np.ndarray, b: np.ndarray, sums: np.ndarray, lows: np.ndarray, near: float, far: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges, bins and, for each, what samples of the ranges above give: sums of lower bins and, decayed to the bin's upper edge, of higher ones. The own bin counts where it is one value, the own range likewise."""
    bins, last = len(lows), int(r.max()) + 1  # ranges above the last sample get nothing
    s = np.zeros((last + 1, bins, 8))
    s[r, b] = sums
    s = s[::-1].cumsum(0)[::-1]  # at or above each range
    t = s[np.arange(last) + 1 - np.arange(last) % 2]
    run = t[:, :, :4].cumsum(1)
    odd = np.arange(bins) % 2 == 1
    below = np.concatenate([np.zeros((last, 1, 4)), run[:, :-1]], 1)
    below[:, odd] = run[:, odd]
    own = np.where(odd[:, None], 0.0, t[:, :, :4])
    high = np.zeros((last, bins, 4))
    for i in range(bins - 2, -1, -1):
        step = lows[i + 2] - lows[i + 1] if i + 2 < bins else np.inf
        keep = np.repeat([np.exp(-step / x) if x > 0 else 0.0 for x in (near, far)], 2)
        high[:, i] = t[:, i + 1, 4:] + keep * high[:, i + 1]
    rest = run[:, -1:, :2] - own[:, :, :2]
    at = np.nonzero(rest[:, :, 0] > 0)
    return *at, np.concatenate([rest[at], below[at][:, 2:], high[at]], 1)


def _own(group: pa.Table, near: float, far: float, alpha: float) -> pa.Table:
    """Sums over the samples of a group whose ``p`` is at or above each reach's, in about n log(n) steps.

    In order of ``p``, every sample above a reach is in the left half of just one block of 2, 4, 8,
    ... rows that has the reach in its right half; each such block is ordered by length, from the largest on: a block's halves
    keep its order. Lengths are factors from the group's smallest on, so sums of decayed values are running sums of positive terms from a block's far end.
    """
    f = group.column("f")[0].as_py()
    p, length, m, n, v = (group.column(c).to_numpy(zero_copy_only=False) for c in ("p", "len", "m", "n", "v"))
    given = m > 0
    order = np.lexsort((~given, -p))  # of equal p the samples come first
    given, length, m, n, v = given[order], length[order], m[order], n[order], v[order]
    taus = [(share, tau) for share, tau in ((1.0, near), (alpha, far)) if tau > 0]
    span = length - length.min()
    flat = sum(share for share, _ in taus)
    if taus and span.max() > SPAN * min(tau for _, tau in taus):
        w = _own_far(given, length, n, v, near, far, alpha, flat)
    else:
        shrunk = [np.exp(-span / tau) for _, tau in taus]
        got = _halved(length, given, [n, v], [x * e for e in shrunk for x in (n, v)])
        w = np.stack([flat * got[i] + sum(share * got[2 + 2 * j + i] / e for j, ((share, _), e) in enumerate(zip(taus, shrunk, strict=True))) for i in (0, 1)], 1)
    above, counted = m.cumsum(), n.cumsum()
    rows = np.flatnonzero(~given & (above > 0))
    comid = group.column("comid").take(pa.array(order[rows]))
    return pa.table({"f": pa.array(np.full(len(rows), f, np.int32)), "comid": comid, "m": above[rows], "n": counted[rows], "w": w[rows, 0], "wv": w[rows, 1]})


def _halved(length: np.ndarray, given: np.ndarray, low: list[np.ndarray], high: list[np.ndarray]) -> np.ndarray:
    """For each row, the sums of ``low`` over earlier rows that aren't longer, and of ``high`` over earlier ones that are; all are 0 but for samples."""
    count = len(length)
    size = 1 << max(count - 1, 1).bit_length()
    pad = size - count
    values = np.stack([np.concatenate([x, np.zeros(pad)]) for x in (*low, *high)])
    by = np.concatenate([np.lexsort((~given, length)), np.arange(count, size)])  # of equal lengths the samples come first
    got = np.zeros_like(values)
    while size > 1:
        half = size // 2
        left = by & half == 0
        to = by[~left]
        for i in range(len(values)):
            x = np.where(left, values[i, by], 0.0).reshape(-1, size)
            x = _running(x if i < len(low) else x[:, ::-1])
            got[i, to] += (x if i < len(low) else x[:, ::-1]).ravel()[~left]
        by = np.concatenate([by[left].reshape(-1, half), to.reshape(-1, half)], 1).ravel()
        size = half
    return got[:, :count]


def _running(x: np.ndarray) -> np.ndarray:
    """Running sums along rows; many short ones are added column by column."""
    if x.shape[1] > 64:
        return x.cumsum(1)
    out = np.ascontiguousarray(x.T)
    for i in range(1, len(out)):
        out[i] += out[i - 1]
    return out.T


def _own_far(given: np.ndarray, length: np.ndarray, n: np.ndarray, v: np.ndarray, near: float, far: float, alpha: float, flat: float) -> np.ndarray:
    """The weighted sums of ``_own`` where lengths span more decays than a double holds: neighbours' sums are doubled instead."""
    x = np.stack([flat * n, flat * v, n, v], 1)
    place, size = np.arange(len(n)), 1
    got = np.zeros((len(n), 2))
    while size < len(n):
        right = (place // size) % 2 == 1
        at = np.flatnonzero(given ^ right)  # samples of left halves, reaches of right ones
        block = place[at] // (2 * size)
        by = np.lexsort((~given[at], length[at], block))  # of equal lengths the samples come first
        at, block = at[by], block[by]
        values, here = np.where(given[at, None], x[at], 0.0), length[at]
        w = values[:, :2].cumsum(0)
        w -= np.concatenate([np.zeros((1, 2)), w])[np.searchsorted(block, block)]
        for share, tau in ((1.0, near), (alpha, far)):
            if tau > 0:
                w = w + share * _decayed(values[:, 2:], here, block, tau, 2 * size)
        reach = ~given[at]
        got[at[reach]] += w[reach]
        size *= 2
    return got


def _decayed(x: np.ndarray, at: np.ndarray, block: np.ndarray, tau: float, most: int) -> np.ndarray:
    """For each row of ``x``, the sum of it and the later ones of its block (of ``most`` rows at most), decayed by how far ahead they are. All factors are at most 1."""
    y, step = x.copy(), 1
    while step < min(most, len(x)):
        f = np.where(block[step:] == block[:-step], np.exp(-np.maximum(at[step:] - at[:-step], 0) / tau), 0.0)
        y[:-step] += f[:, None] * y[step:]
        step *= 2
    return y


def clean_attributes(vaa: DataFrame) -> DataFrame:
    """Sentinels of a network attribute table: slope at or below -9000 is null, missing order keys are 0."""
    return vaa.withColumns({"slope": F.when(F.col("slope") > -9000, F.col("slope")), "hydroseq": F.coalesce("hydroseq", F.lit(0)), "stream_order": F.coalesce("stream_order", F.lit(0))})
