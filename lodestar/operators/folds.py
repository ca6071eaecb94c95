"""Features and fits that leave something out: a fold's own samples, or one positive at a time.

Partial sums are made once per place and fold of the samples; what a place gets without a fold is the sum over the
folds before it and those after it, so nothing is subtracted and no digits are lost. Models that lack one row each
are fitted together: a matrix of weights, whose gradients are added up in one aggregate per step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Grid
from .network import decay_parts
from .ranking import ordered
from .spatial import cells_within


def without_own(parts: DataFrame, place: list[str], folds: list[int], sums: list[str], maxima: list[str] = (), fold: str = "fold") -> DataFrame:
    """``place``, ``fold`` and the totals of ``sums`` and ``maxima`` over all other folds, for each place and each of ``folds``.

    ``parts``: a row per place and fold of the samples. Samples without a fold count for all. Sums over nothing are 0, maxima null.
    """
    columns = [*sums, *maxima]
    every = parts.select(*place).distinct().withColumn(fold, F.explode(F.lit(folds)))
    kind = dict(parts.dtypes)[fold]
    every = every.withColumn(fold, F.col(fold).cast(kind))
    missing = every.join(parts.select(*place, fold), [*place, fold], "left_anti")
    rows = parts.select(*place, fold, *columns).unionByName(missing, allowMissingColumns=True)
    # a window holds the folds of one place
    before = Window.partitionBy(*place).orderBy(F.asc_nulls_first(fold)).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*place).orderBy(F.desc_nulls_last(fold)).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_{c}_{n}": f(c).over(w) for n, w in (("b", before), ("a", after)) for f, some in ((F.sum, sums), (F.max, maxima)) for c in some})
    zero = F.lit(0.0)
    totals = [(F.coalesce(F.col(f"_{c}_b"), zero) + F.coalesce(F.col(f"_{c}_a"), zero)).alias(c) for c in sums] + [F.greatest(f"_{c}_b", f"_{c}_a").alias(c) for c in maxima]
    return rows.where(F.col(fold).isin(folds)).select(*place, fold, *totals)


def radius_without_fold(points: DataFrame, grid: Grid, radius: float, values: list[str], folds: list[int], fold: str = "fold") -> DataFrame:
    """Per cell in reach of any sample and each fold: ``<v>_mean``, ``<v>_max``, ``<v>_count``, ``<v>_has_data`` over the samples of the other folds."""
    near = cells_within(points, grid, radius)
    aggs = [f.alias(f"{v}_{n}") for v in values for n, f in (("sum", F.sum(F.col(v).cast("double"))), ("max", F.max(v)), ("count", F.count(v).cast("double")))]
    parts = near.groupBy("row", "col", fold).agg(*aggs)
    out = without_own(parts, ["row", "col"], folds, [f"{v}_{n}" for v in values for n in ("sum", "count")], [f"{v}_max" for v in values], fold)
    made = {}
    for v in values:
        n = F.col(f"{v}_count")
        made |= {f"{v}_mean": F.when(n > 0, F.col(f"{v}_sum") / n), f"{v}_has_data": (n > 0).cast("int"), f"{v}_count": n.cast("long")}
    return out.withColumns(made).drop(*(f"{v}_sum" for v in values))


def decay_without_fold(cells: DataFrame, samples: DataFrame, folds: list[int], fold: str = "fold", **how) -> DataFrame:
    """``comid``, ``fold``, ``n_samples``, ``catchment``: the decayed mean of upstream samples (``dual_decay``) over the samples of the other folds.

    Every sample is summed for the reaches once, with those of its fold, all folds in one job. Reaches without any sample upstream have no row.
    """
    own = samples.withColumn("f", F.coalesce(*(F.when(F.col(fold) == x, F.lit(i)) for i, x in enumerate(folds)), F.lit(len(folds)))).drop(fold)
    kinds = [r[0] for r in own.where("hydroseq is not null").select("f").distinct().orderBy("f").collect()]  # one for each fold at most
    if not kinds:
        kinds = [0]
    parts = decay_parts(cells, own, kinds, **how)
    sums = parts.groupBy("comid").agg(F.sum("m").alias("m"), *(F.coalesce(F.sum(F.when(F.col("f") == k, F.col(c))), F.lit(0.0)).alias(f"{c}_{k}") for c in ("n", "w", "wv") for k in kinds))
    zero = F.lit(0.0)
    each = [F.struct(F.lit(x).cast("int").alias(fold), *(sum((F.col(f"{c}_{k}") for k in kinds if k != i), zero).alias(c) for c in ("n", "w", "wv"))) for i, x in enumerate(folds)]
    out = sums.where("m > 0").select("comid", F.inline(F.array(*each)))
    return out.select("comid", fold, F.col("n").cast("long").alias("n_samples"), F.when(F.col("w") > 0, F.col("wv") / F.col("w")).alias("catchment"))


#: Positives that can be left out in one job: their weights (one vector each) are sent to all tasks.
POSITIVES = 4096


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    columns = [np.nan_to_num(batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64)) for c in names]
    return np.stack([*columns, np.ones(batch.num_rows)], 1)


def _gradients(rows: DataFrame, names: list[str], weights: np.ndarray, weigh: tuple[float, float], curved: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The gradients of the logistic loss for all models (a row of ``weights`` each) and, if ``curved``, the Hessian of the first, in one aggregate."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    models, width = weights.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        g, h = np.zeros((models, width)), np.zeros((width, width))
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                x, y = _matrix(part, names), part.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
                c = np.where(y > 0, weigh[1], weigh[0])[:, None]
                p = 1 / (1 + np.exp(-np.clip(x @ w.T, -500, 500)))
                g += (c * (p - y[:, None])).T @ x
                if curved:
                    h += (x * (c * p * (1 - p))[:, :1]).T @ x
        flat = np.concatenate([g.ravel(), h.ravel()]) if curved else g.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["k", "s"])

    got = rows.mapInArrow(add, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).toPandas().sort_values("k")["s"].to_numpy()
    g = got[: models * width].reshape(models, width)
    return g, got[models * width :].reshape(width, width) if curved else np.zeros((width, width))


def leave_one_out(df: DataFrame, names: list[str], key: str, label: str = "label", penalty: float = 1e-3, steps: int = 50, tolerance: float = 1e-11, most: int = POSITIVES) -> DataFrame:
    """``key``, ``score``, ``higher``, ``pct``: each positive's probability from the model that lacks it, how many rows that model scores higher, and their share in percent.

    The models are balanced logistic regressions with a ridge penalty; they differ by one row, so all start at the fit on all rows and use its curvature less that of their row:
    a step is one pass over the rows for all of them, and a few steps do, however many positives there are. Features should be filled and scaled; a null counts as 0. More than ``most``
    positives are an error. Without a second positive or any negative there is no model, and no row.
    """
    from ..plans.storage import materialize

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # every pass weighs each row by all models, so a small file is dealt to all tasks
    rows = materialize(df.select(key, F.col(label).cast("int").alias("label"), *(F.col(n).cast("double").alias(n) for n in names)).where("label is not null").repartition(tasks, key))
    n, positives = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    kind = dict(rows.dtypes)[key]
    out = f"{key} {kind}, score double, higher long, pct double"
    if positives > most:
        raise ValueError(f"{positives} positives are more than {most}")
    if positives < 2 or n == positives:
        return df.sparkSession.createDataFrame([], out)
    own = rows.where("label = 1").orderBy(key, *names).toArrow()  # at most ``most``
    x = np.stack([*(np.nan_to_num(own.column(c).to_numpy().astype(float)) for c in names), np.ones(own.num_rows)], 1)
    ridge = np.append(np.full(len(names), penalty), 0.0) * (n - 1)
    weigh = ((n - 1) / (2 * (n - positives)), (n - 1) / (2 * (positives - 1)))
    w = np.zeros((1, x.shape[1]))
    for _ in range(steps):
        g, h = _gradients(rows, names, w, weigh, curved=True)
        step = np.linalg.solve(h + np.diag(ridge + 1e-12), (g + ridge * w)[0])
        w = w - step
        if np.abs(step).max() < tolerance:
            break
    p = 1 / (1 + np.exp(-(x @ w[0])))
    own_part = (weigh[1] * p * (1 - p))[:, None, None] * x[:, :, None] * x[:, None, :]
    curves = np.linalg.inv(h + np.diag(ridge + 1e-12) - own_part)  # of each model, without its row
    w = np.repeat(w, len(x), 0)
    for _ in range(steps):
        g, _ = _gradients(rows, names, w, weigh)
        p = 1 / (1 + np.exp(-(x * w).sum(1)))
        step = np.einsum("kij,kj->ki", curves, g - weigh[1] * (p - 1)[:, None] * x + ridge * w)
        w = w - step
        if np.abs(step).max() < tolerance:
            break
    margin = (x * w).sum(1)
    shared = rows.sparkSession.sparkContext.broadcast((w, margin))

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, own = shared.value
        count = np.zeros(len(own), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                count += (_matrix(batch.slice(start, 2048), names) @ w.T > own + 1e-12).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own))), pa.array(count)], ["i", "higher"])

    higher = rows.mapInArrow(above, "i long, higher long").groupBy("i").agg(F.sum("higher").alias("higher"))
    p = 1 / (1 + np.exp(-margin))
    scored = rows.sparkSession.createDataFrame(list(zip(range(len(p)), own.column(key).to_pylist(), p.tolist(), strict=True)), f"i long, {key} {kind}, score double")
    return scored.join(F.broadcast(higher), "i").select(key, "score", "higher", (F.col("higher") * 100.0 / n).alias("pct"))  # a row per positive


def fold_metrics(scored: DataFrame, names: list[str], folds: list[int], label: str = "label", fold: str = "fold") -> DataFrame:
    """``model``, ``fold``, ``n``, ``n_positive``, ``auc``, ``ap`` of out-of-fold scores; folds without both classes have null measures.

    Scores and models are unpivoted once; equal scores of a model and fold are counted together and ordered range by range. Null scores are left out.
    """
    long = scored.select(F.col(fold).alias("fold"), F.col(label).cast("long").alias("label"), F.explode(F.array(*(F.struct(F.lit(n).alias("model"), F.col(n).cast("double").alias("s")) for n in names))).alias("x"))
    levels = long.where(F.col("fold").isin(folds) & F.col("x.s").isNotNull()).groupBy("x.model", "fold", "x.s").agg(F.count("*").alias("each"), F.sum("label").alias("pos"))
    run = ordered(levels, "s", [], sums={"each": F.col("each"), "pos": F.col("pos")}, over=["model", "fold"])
    # a positive loses against the negatives above its score and half of those at it
    above = F.col("each_upto") - F.col("pos_upto") - (F.col("each") - F.col("pos")) / 2.0
    out = run.groupBy("model", "fold").agg(F.sum("each").alias("n"), F.sum("pos").alias("n_positive"), F.sum(F.col("pos") * above).alias("lost"), F.sum(F.col("pos") * F.col("pos_upto") / F.col("each_upto")).alias("gain"))
    pairs = F.col("n_positive") * (F.col("n") - F.col("n_positive"))
    return out.select("model", "fold", "n", "n_positive", F.when(pairs > 0, 1 - F.col("lost") / pairs).alias("auc"), F.when(pairs > 0, F.col("gain") / F.col("n_positive")).alias("ap"))
