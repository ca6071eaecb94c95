"""Calibration: reliability by equal-width and equal-frequency bins, confusion measures, fusion of two scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bin_by_edges
from .ranking import percentiles


def width_edges(bins: int = 10) -> list[float]:
    """The doubles i * (1 / bins), as linear spacing gives them (0.30000000000000004 is the third of ten)."""
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def frequency_edges(df: DataFrame, score: str, bins: int = 10) -> list[float]:
    """Quantile edges without repeats."""
    return sorted({e for e in percentiles(df, score, [i / bins for i in range(bins + 1)]) if e is not None})


def reliability(df: DataFrame, score: str, label: str, edges: list[float]) -> DataFrame:
    """``bin``, ``bin_left``, ``bin_right``, ``count``, ``mean_pred``, ``pos_rate`` of the bins that hold rows."""
    e = F.array(*[F.lit(float(x)) for x in edges])
    b = bin_by_edges(F.col(score), edges)
    rows = df.where(F.col(score).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("count"), F.avg(score).alias("mean_pred"), F.avg(F.col(label).cast("double")).alias("pos_rate"))
    return rows.select("bin", F.get(e, F.col("bin")).alias("bin_left"), F.get(e, F.col("bin") + 1).alias("bin_right"), "count", "mean_pred", "pos_rate")


def calibration_error(table: DataFrame) -> DataFrame:
    """``ece`` of a reliability table: gaps weighed by counts; 0 without rows."""
    gap = F.sum(F.col("count") * F.abs(F.col("pos_rate") - F.col("mean_pred"))) / F.sum("count")
    return table.agg(F.coalesce(gap, F.lit(0.0)).alias("ece"))


def confusion(df: DataFrame, predicted, label: str) -> DataFrame:
    """``tp``, ``fp``, ``fn``, ``tn``, ``f1``, ``kappa``, ``recall`` of a predicate."""
    y = F.col(label).cast("boolean")
    c = df.agg(*[F.count_if(a & b).alias(n) for n, a, b in (("tp", predicted, y), ("fp", predicted, ~y), ("fn", ~predicted, y), ("tn", ~predicted, ~y))])
    tp, fp, fn, tn = (F.col(n).cast("double") for n in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    chance = F.try_divide((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    seen = F.try_divide(tp + tn, n)
    return c.select(
        "tp", "fp", "fn", "tn", F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias("f1"),
        F.when(chance < 1, (seen - chance) / (1 - chance)).otherwise(0.0).alias("kappa"), F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0).alias("recall"),
    )


def brier(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(score) - F.col(label).cast("double"), 2)).alias("brier"))


def fuse(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Full outer join of two score tables with ``fused``, the larger score (null only where both are)."""
    both = left.select(*keys, F.col(a).alias("score_a")).join(right.select(*keys, F.col(b).alias("score_b")), keys, "full")
    return both.withColumn("fused", F.greatest("score_a", "score_b"))


def fusion_summary(fused: DataFrame) -> DataFrame:
    """How many cells have one score, both or none, and which one wins."""
    a, b = F.col("score_a"), F.col("score_b")
    return fused.agg(
        F.count_if(a.isNotNull() & b.isNull()).alias("a_only"), F.count_if(a.isNull() & b.isNotNull()).alias("b_only"), F.count_if(a.isNotNull() & b.isNotNull()).alias("both"),
        F.count_if(a.isNull() & b.isNull()).alias("neither"), F.count_if(a > b).alias("a_wins"), F.count_if(b > a).alias("b_wins"), F.count_if(a == b).alias("ties"),
    )
