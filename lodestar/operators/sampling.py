"""Folds, pseudo-negatives, bags and bootstraps. Randomness is a hash of a key and a seed, so reruns and lost executors give the same draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import ordered, percentiles


def unit_hash(seed: int, *keys: str) -> Column:
    """A uniform number in [0, 1) for a key and seed, the same in any engine (md5)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def spatial_folds(df: DataFrame, size: float, folds: int | None = None) -> DataFrame:
    """Append ``fold``: a hash of the absolute block (``folds`` of them), or the block's own number in order where ``folds`` is None."""
    rows = df.withColumns({"bx": F.floor(F.col("x") / size), "by": F.floor(F.col("y") / size)})
    if folds:
        return rows.withColumn("fold", F.pmod(F.xxhash64("bx", "by"), F.lit(folds)).cast("int"))
    ends = rows.agg(F.min("bx").alias("_x"), F.min("by").alias("_y"), F.max("by").alias("_z"))
    rows = rows.join(F.broadcast(ends), how="cross")  # one row
    return rows.withColumn("fold", (F.col("bx") - F.col("_x")) * (F.col("_z") - F.col("_y") + 1) + F.col("by") - F.col("_y")).drop("_x", "_y", "_z")


def quantile_folds(df: DataFrame, column: str, positive: str, bins: int, folds: int) -> DataFrame:
    """Append ``fold``: bin between quantiles of the positives' values (open ends), modulo ``folds``."""
    edges = percentiles(df.where(F.col(positive).cast("boolean")), column, [i / bins for i in range(1, bins)])
    inner = sorted({e for e in edges if e is not None})
    b = sum((F.when(F.col(column) > F.lit(e), 1).otherwise(0) for e in inner), F.lit(0))
    return df.withColumn("fold", (b % folds).cast("int"))


def quantile_folds_2d(df: DataFrame, x: str, y: str, positive: str, bins: int, folds: int) -> DataFrame:
    """Append ``fold``: bins of two columns, numbered row by row, modulo ``folds``."""
    a = quantile_folds(df, x, positive, bins, bins).withColumnRenamed("fold", "_a")
    b = quantile_folds(a, y, positive, bins, bins).withColumnRenamed("fold", "_b")
    return b.withColumn("fold", ((F.col("_a") * bins + F.col("_b")) % folds).cast("int")).drop("_a", "_b")


def pseudo_negatives(df: DataFrame, key: str, label: str, stratum: str, per_positive: int, seed: int) -> DataFrame:
    """Unlabelled rows in the class shares of the positives: ``max(1, round-half-even(n * share))`` of each class, by hash.

    The quota is applied by rank within the class; ranks come from value ranges, so a class that
    holds most rows is no single task.
    """
    from ..plans.storage import materialize, small

    positives = df.where(F.col(label) == 1)
    shares = positives.groupBy(stratum).agg(F.count("*").alias("_p"))
    total = positives.count()
    quotas = shares.select(F.col(stratum), F.greatest(F.lit(1), F.bround(F.col("_p") * float(per_positive))).cast("long").alias("quota")) if total else shares.select(stratum, F.lit(0).alias("quota"))
    free = df.where(F.col(label) == 0).withColumn("_h", unit_hash(seed, key))
    ranked = ordered(free, "_h", [key], descending=False, over=[stratum])
    return ranked.join(small(materialize(quotas)), stratum).where(F.col("rank") <= F.col("quota")).drop("_h", "rank", "n", "quota")


def bags(df: DataFrame, key: str, label: str, n_bags: int, seed: int) -> DataFrame:
    """``bag``, the row, ``in_bag``: all positives and about as many unlabelled rows, by hash, in each bag."""
    counts = df.agg(F.sum(F.col(label).cast("long")).alias("_p"), F.count("*").alias("_n"))
    rows = df.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(n_bags - 1)))).join(F.broadcast(counts), how="cross")  # one row
    share = F.col("_p") / F.greatest(F.col("_n") - F.col("_p"), F.lit(1))
    return rows.withColumn("in_bag", (F.col(label) == 1) | (unit_hash(seed, "bag", key) < share)).drop("_p", "_n")


def out_of_bag_mean(scored: DataFrame, key: str, label: str, p: str) -> DataFrame:
    """Mean score over the bags that didn't train on a row; positives over all bags."""
    return scored.where(~F.col("in_bag") | (F.col(label) == 1)).groupBy(key).agg(F.avg(p).alias("p_pu"), F.count("*").alias("n_bags"))


#: The share of Poisson(1) draws that are 0.
NONE = 0.36787944117144233


def poisson_weight(u: Column) -> Column:
    """A Poisson(1) draw from a uniform one (8 at most): how often a replicate holds a row."""
    cuts, total, term = [], 0.0, NONE
    for k in range(1, 9):
        total += term
        term /= k
        cuts.append(total)
    return sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))


def replicated(df: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """A row per row and replicate that holds it, with ``rep`` and ``w``: how often. Draws are hashes, so nothing is gathered.

    Rows are few bytes and many draws, so they are dealt to all tasks first. A draw is hashed once: the generator keeps the optimizer from copying it into the filter and each cut of the weight.
    """
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    drawn = dealt.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = drawn.select("*", F.inline(F.array(F.struct(unit_hash(seed, "rep", key).alias("_u")))))
    return drawn.where(F.col("_u") >= NONE).withColumn("w", poisson_weight(F.col("_u"))).drop("_u")


def _interval(point: DataFrame, name: str, reps: DataFrame) -> DataFrame:
    ends = reps.agg(F.percentile("c", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return point.join(ends, how="cross").select(name, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))  # one row each


def bootstrap_capture(df: DataFrame, score: str, positive: str, key: str, percent: float, replicates: int, seed: int) -> DataFrame:
    """``capture``, ``lo``, ``hi``: capture of the best ``percent`` and its bootstrap interval; replicates resample positives only."""
    rows = ordered(df, score, [key], sums={"pos": F.col(positive).cast("long")})
    hits = rows.where(F.col(positive).cast("boolean")).select(key, (F.col("rank") <= F.ceil(F.col("n") * percent / 100.0)).cast("int").alias("hit"))
    reps = replicated(hits, key, replicates, seed).groupBy("rep").agg((F.sum(F.col("w") * F.col("hit")) / F.sum("w")).alias("c"))
    return _interval(hits.agg(F.coalesce(F.avg("hit"), F.lit(0.0)).alias("capture")), "capture", reps)


def bootstrap_area(df: DataFrame, score: str, positive: str, key: str, replicates: int, seed: int) -> DataFrame:
    """``auc_pa``, ``lo``, ``hi``: the area under the curve of positives by area and its bootstrap interval; replicates resample positives only.

    The area is the mean over the positives of the share of rows behind them (half of their own strip included), so a replicate is a weighted mean.
    """
    rows = ordered(df, score, [key])
    own = rows.where(F.col(positive).cast("boolean")).select(key, ((F.col("n") - F.col("rank") + 0.5) / F.col("n")).alias("v"))
    reps = replicated(own, key, replicates, seed).groupBy("rep").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("c"))
    return _interval(own.agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("auc_pa")), "auc_pa", reps)


def bootstrap_auc(df: DataFrame, score: str, positive: str, key: str, replicates: int, seed: int) -> DataFrame:
    """``roc_auc``, ``lo``, ``hi``: the area under the ROC curve and its interval over resampled rows (ties count half)."""
    y = F.col(positive).cast("long")
    rows = df.where(F.col(score).isNotNull()).select(key, F.col(score).alias("s"), y.alias("y"))
    counted = replicated(rows, key, replicates, seed).unionByName(rows.withColumns({"rep": F.lit(-1), "w": F.lit(1)}))
    by = counted.groupBy("rep", "s").agg(F.sum(F.col("w") * F.col("y")).alias("p"), F.sum(F.col("w") * (1 - F.col("y"))).alias("q"))
    run = ordered(by, "s", [], descending=False, sums={"q": F.col("q")}, over=["rep"])
    auc = F.try_divide(F.sum(F.col("p") * (F.col("q_upto") - F.col("q") / 2.0)), F.sum("p") * F.sum("q")).alias("c")
    reps = run.groupBy("rep").agg(auc)
    return _interval(reps.where("rep = -1").select(F.col("c").alias("roc_auc")), "roc_auc", reps.where("rep >= 0"))


def bootstrap_mean(df: DataFrame, value: str, key: str, replicates: int, seed: int) -> DataFrame:
    """``mean``, ``lo``, ``hi``: the mean of a metric over folds that have it (not null, not NaN), and its interval over resampled folds."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(key, F.col(value).alias("v"))
    reps = replicated(rows, key, replicates, seed).groupBy("rep").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("c"))
    return _interval(rows.agg(F.avg("v").alias("mean")), "mean", reps)


def training_set(features: DataFrame, positives: DataFrame, key: str, stratum: str, per_positive: int, seed: int, drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows to train on: the positives (``key``) with label 1 and stratified pseudo-negatives with label 0; ``drop``: columns that would give the label away."""
    rows = features.join(positives.select(key).distinct().withColumn("label", F.lit(1)), key, "left").withColumn("label", F.coalesce("label", F.lit(0)))
    negatives = pseudo_negatives(rows, key, "label", stratum, per_positive, seed)
    return rows.where("label = 1").unionByName(negatives.select(rows.columns)).drop(*drop)


def keep_positives(df: DataFrame, key: str, label: str, share: float, seed: int) -> DataFrame:
    """All positives and a hashed share of the rest."""
    return df.where((F.col(label) == 1) | (unit_hash(seed, key) < share))


