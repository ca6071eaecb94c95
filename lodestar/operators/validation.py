"""Checks of a map against places it was not made from, fusion of calibrated scores with context, priors of parts of a map."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Grid
from .learning import fitted, forest, probability
from .ranking import ordered, percentiles_of
from .sampling import unit_hash
from .spatial import polygon_cells, snap_to_cell


def region_validation(df: DataFrame, inside: Column, barren: Column, scores: list[str], label: str, context: str) -> DataFrame:
    """A row per score: its medians in a belt, outside and in a region known to be barren, and its correlation with a context column.

    ``n_inside``, ``positives_inside``, ``n_barren``, ``positives_barren`` count cells; ``lift`` is the median inside against the one outside; ``n_corr`` cells have both
    score and context. A predicate that is null is false. Medians are exact and come from one pass over (column, value).
    """
    belt, dry = F.coalesce(inside, F.lit(False)), F.coalesce(barren, F.lit(False))
    parts = {"inside": belt, "outside": ~belt, "barren": dry}
    middle = percentiles_of(df, {f"{s}/{p}": F.when(own, F.col(s)) for s in scores for p, own in parts.items()}, [0.5])
    y = F.coalesce(F.col(label).cast("long"), F.lit(0))
    both = [F.col(s).isNotNull() & F.col(context).isNotNull() for s in scores]
    one = df.agg(
        F.count_if(belt).alias("n_inside"), F.coalesce(F.sum(F.when(belt, y)), F.lit(0)).alias("positives_inside"), F.count_if(dry).alias("n_barren"), F.coalesce(F.sum(F.when(dry, y)), F.lit(0)).alias("positives_barren"),
        *[F.corr(F.when(b, F.col(s)), F.when(b, F.col(context))).alias(f"_r{i}") for i, (s, b) in enumerate(zip(scores, both, strict=True))], *[F.count_if(b).alias(f"_n{i}") for i, b in enumerate(both)],
    )
    rows = []
    for i, s in enumerate(scores):
        m = {p: middle[f"{s}/{p}"][0] for p in parts}
        lift = None if m["inside"] is None or m["outside"] is None else m["inside"] / max(m["outside"], 1e-6)
        value = lambda v: F.lit(v).cast("double")
        rows.append(F.struct(F.lit(s).alias("score"), *[value(m[p]).alias(f"median_{p}") for p in parts], value(lift).alias("lift"), F.col(f"_r{i}").alias("corr"), F.col(f"_n{i}").alias("n_corr")))
    return one.select("n_inside", "positives_inside", "n_barren", "positives_barren", F.inline(F.array(*rows)))


def map_percentile(points: DataFrame, cells: DataFrame, grid: Grid, score: str) -> DataFrame:
    """Append ``row``, ``col``, the score of the nearest cell, ``n_higher``, ``percentile`` and ``top_pct`` to external points.

    ``n_higher``: cells that score strictly higher; ``percentile``: share of scored cells that don't; nulls where the cell has no score. Scores are counted by value,
    and values are put in order range by range.
    """
    counts = cells.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("_v")).agg(F.count("*").alias("c"))
    above = ordered(counts, "_v", [], sums={"c": F.col("c")}).select("_v", (F.col("c_upto") - F.col("c")).cast("long").alias("n_higher"), F.col("c_total").alias("_n"))
    at = snap_to_cell(points, grid).join(cells.select("row", "col", score), ["row", "col"], "left")
    out = at.join(above, F.col(score) == F.col("_v"), "left")
    return out.withColumns({"percentile": 100.0 * (F.col("_n") - F.col("n_higher")) / F.col("_n"), "top_pct": 100.0 * F.col("n_higher") / F.col("_n")}).drop("_v", "_n")


def context_fusion(df: DataFrame, scores: list[str], context: list[str], label: str, least: int = 10) -> tuple[DataFrame, dict]:
    """Append ``p_combined``: a balanced logistic regression on calibrated scores and context; and what it learned.

    A score that is missing is 0 (that population doesn't claim the cell), a context value that is missing or not finite is the column's median. Cells that
    no score covers teach nothing and get null. The penalty is half the squared weights against the sum of the losses. Fewer than ``least`` positives are an error.
    """
    finite = {c: F.when(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), None).otherwise(F.col(c).cast("double")) for c in context}
    middle = percentiles_of(df, finite, [0.5])
    filled = {f"_x{i}": F.coalesce(F.col(s).cast("double"), F.lit(0.0)) for i, s in enumerate(scores)}
    filled |= {f"_c{i}": F.coalesce(finite[c], F.lit(middle[c][0] or 0.0)) for i, c in enumerate(context)}
    covered = F.coalesce(*[F.col(s).cast("double") for s in scores]).isNotNull()
    rows = df.withColumns(filled | {"_y": F.coalesce(F.col(label).cast("int"), F.lit(0)), "_covered": covered})
    train = rows.where("_covered").select(*filled, "_y")
    n, positives = train.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    if positives < least or positives == n:
        raise ValueError(f"{positives} positives among {n} cells: at least {least}, and some others, are needed")
    fit = LogisticRegression(labelCol="_y", weightCol="weight", regParam=1.0 / n, standardization=False, maxIter=2000, tol=1e-10)
    (model,) = fitted([Pipeline(stages=[VectorAssembler(inputCols=list(filled), outputCol="features"), fit])], train, "_y")
    out = probability(model, rows, "p_combined").withColumn("p_combined", F.when(F.col("_covered"), F.col("p_combined"))).select(*df.columns, "p_combined")
    last = model.stages[-1]
    return out, {"weights": dict(zip([*scores, *context], map(float, last.coefficients), strict=True)), "intercept": float(last.intercept), "n": n, "positives": int(positives)}


def subarea(df: DataFrame, label: str, side: float, centre: tuple[float, float] | None = None) -> DataFrame:
    """Cells in a square of ``side`` around ``centre`` (the mean place of the positives), edges included. No positive and no centre: an error."""
    x, y = centre or df.where(F.col(label) > 0).agg(F.avg("x"), F.avg("y")).first()
    if x is None:
        raise ValueError("no positive cell to take for the centre")
    return df.where(F.col("x").between(x - side / 2, x + side / 2) & F.col("y").between(y - side / 2, y + side / 2))


def subarea_prior(df: DataFrame, names: list[str], label: str, side: float, centre: tuple[float, float] | None = None, trees: int = 200, seed: int = 0) -> DataFrame:
    """``x``, ``y``, ``p_prior``, ``label`` of the cells of a subarea; the forest is fitted on the whole map, which is written first, so that the joins it comes from run once."""
    from ..plans.storage import materialize

    rows = materialize(df.select("x", "y", *names, F.coalesce((F.col(label) > 0).cast("int"), F.lit(0)).alias("label")))
    (model,) = fitted([forest(names, trees=trees, seed=seed)], rows.select(*names, "label"), "label")
    return probability(model, subarea(rows, "label", side, centre), "p_prior").select("x", "y", "p_prior", "label")


def strips(df: DataFrame, key: str, area: tuple[float, float, float, float], width: tuple[int, int], length: tuple[int, int], unit: float, seed: int, margin: float = 0.0) -> DataFrame:
    """Append ``ring``: a strip for each row, its place, direction, width and length (whole ``unit``s, ends included) drawn from hashes of the key."""
    u = lambda k: unit_hash(seed + k, key)
    x0, y0, x1, y1 = area
    whole = lambda k, ends: (ends[0] + F.floor(u(k) * (ends[1] - ends[0] + 1))) * unit / 2
    df = df.withColumns({"_x": x0 + margin + u(0) * (x1 - x0 - 2 * margin), "_y": y0 + margin + u(1) * (y1 - y0 - 2 * margin), "_t": u(2) * math.pi, "_w": whole(3, width), "_l": whole(4, length)})
    corner = lambda a, b: F.struct((F.col("_x") + a * F.col("_l") * F.cos("_t") - b * F.col("_w") * F.sin("_t")).alias("x"), (F.col("_y") + a * F.col("_l") * F.sin("_t") + b * F.col("_w") * F.cos("_t")).alias("y"))
    return df.withColumn("ring", F.array(*[corner(a, b) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])).drop("_x", "_y", "_t", "_w", "_l")


def domain_means(cells: DataFrame, grid: Grid, domains: list[tuple[DataFrame, float]], base: float) -> DataFrame:
    """Append ``mean``: ``base`` and, for each set of polygons that covers the cell's centre, its boost once, however many of them overlap."""
    hits = None
    for i, (polygons, boost) in enumerate(domains):
        own = polygon_cells(polygons.select("ring"), grid).select("row", "col", F.lit(i).alias("_i"), F.lit(float(boost)).alias("_b")).distinct()
        hits = own if hits is None else hits.unionByName(own)
    if hits is None:
        return cells.withColumn("mean", F.lit(float(base)))
    total = hits.groupBy("row", "col").agg(F.sum("_b").alias("_b"))
    return cells.join(total, ["row", "col"], "left").withColumn("mean", base + F.coalesce("_b", F.lit(0.0))).drop("_b")
