"""Learning queries: no SQL says the same; tests check bounds and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds, learning
from .registry import CELLS_SQL, SAMPLES_SQL, grid, query, rounded, samples, table


def _frame(spark: SparkSession, d: str) -> DataFrame:
    """Cells with three features, a noisy label that depends on them, and a spatial fold."""
    p = table(spark, d, "part")
    noise = F.col("p_partkey") * 7919 % 101 / 100.0
    rows = p.select("p_partkey", ((F.col("p_retailprice") - 900) / 100).alias("f1"), F.when(F.col("p_partkey") % 11 > 0, F.col("p_size").cast("double") / 50).alias("f2"), (F.col("p_partkey") * 31 % 97 / 97.0).alias("f3"), noise.alias("noise"))
    return rows.select("p_partkey", "f1", "f2", "f3", (F.col("f1") + F.coalesce("f2", F.lit(0.5)) + F.col("noise") > 2.0).cast("int").alias("label"), (F.col("p_partkey") / 50 / 4).cast("int").alias("block")).withColumn("fold", (F.col("block") % 3).cast("int"))


NAMES = ["f1", "f2", "f3"]


@query()
def oof_stack(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold probabilities of a linear and a forest model and their stack."""
    f = _frame(spark, d)
    oof = learning.out_of_fold(f, {"p_lr": learning.baseline(NAMES), "p_rf": learning.forest(NAMES, trees=20)}, 3, ["p_partkey", "label"])
    return learning.probability(learning.stack(oof, ["p_lr", "p_rf"]), oof, "p_stack").select("p_partkey", "label", "fold", "p_lr", "p_rf", "p_stack")


@query()
def isotonic(spark: SparkSession, d: str) -> DataFrame:
    """Calibrated probabilities of a feature used as a score."""
    return learning.calibrate(_frame(spark, d).select("p_partkey", "f1", "label"), "f1", "label", "p_cal")


@query()
def pu_bagging(spark: SparkSession, d: str) -> DataFrame:
    f = _frame(spark, d).withColumn("label", ((F.col("label") == 1) & (F.col("p_partkey") % 3 == 0)).cast("int"))
    return learning.pu_bagging(f, NAMES, "p_partkey", "label", 3, 5)


@query()
def transfer(spark: SparkSession, d: str) -> DataFrame:
    """Train on one half of the map, score the other."""
    f = _frame(spark, d)
    (model,) = learning.fitted([learning.boosted(NAMES, rounds=10)], f.where("block % 2 = 0"), "label")
    return learning.probability(model, f.where("block % 2 = 1")).select("p_partkey", "label", "p")


@query()
def feature_pca(spark: SparkSession, d: str) -> DataFrame:
    return learning.group_pca(_frame(spark, d).na.fill(0.5), {"g": NAMES}, 2).select("p_partkey", "g_pc1", "g_pc2")


@query("""WITH f AS (SELECT p_partkey, p_retailprice / 1000 AS a, p_size / 50.0::DOUBLE AS b, (p_partkey % 7 + 1) / 7.0::DOUBLE AS c FROM part)
SELECT p_partkey, round(sqrt(1.0 / 2) * (ln(a) - ln(b)), 6) AS ilr_1, round(sqrt(2.0 / 3) * ((ln(a) + ln(b)) / 2 - ln(c)), 6) AS ilr_2 FROM f""")
def ilr_transform(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / 1000).alias("a"), (F.col("p_size") / 50.0).alias("b"), ((F.col("p_partkey") % 7 + 1) / 7.0).alias("c"))
    return p.select("p_partkey", *[F.round(c, 6).alias(f"ilr_{i + 1}") for i, c in enumerate(learning.ilr(["a", "b", "c"]))])


FRAME_SQL = "f AS (SELECT p_partkey, (p_retailprice - 900) / 100 AS a, coalesce(CASE WHEN p_partkey % 11 > 0 THEN p_size / 50.0::DOUBLE END, 0.5) AS b, (p_partkey * 31 % 97) / 97.0::DOUBLE AS c FROM part)"


@query(f"""WITH {FRAME_SQL}, m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, var_samp(a) AS aa, var_samp(b) AS bb, var_samp(c) AS cc, covar_samp(a, b) AS ab, covar_samp(a, c) AS ac, covar_samp(b, c) AS bc FROM f),
i AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM m), d AS (SELECT p_partkey, a - ma AS u, b - mb AS v, c - mc AS w, i.* FROM f, i)
SELECT p_partkey, round((u * u * (bb * cc - bc * bc) + v * v * (aa * cc - ac * ac) + w * w * (aa * bb - ab * ab) + 2 * u * v * (ac * bc - ab * cc) + 2 * u * w * (ab * bc - ac * bb) + 2 * v * w * (ab * ac - aa * bc)) / det, 6) AS anomaly FROM d""")
def anomaly(spark: SparkSession, d: str) -> DataFrame:
    """Squared Mahalanobis distance, a Gaussian stand-in for density models."""
    return rounded(learning.mahalanobis(_frame(spark, d).na.fill(0.5), NAMES).select("p_partkey", "anomaly"))


FOLDS = [0, 1, 2, 3]


@query(f"""WITH {CELLS_SQL}, {SAMPLES_SQL}, k AS (SELECT unnest([0, 1, 2, 3]) AS fold), s AS (SELECT *, floor(x / 3125)::INT AS own FROM samples), p AS (SELECT c.row, c.col, s.own, s.price FROM cells c JOIN s ON abs(c.x - s.x) <= 500 AND abs(c.y - s.y) <= 500 AND (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) <= 250000)
SELECT row, col, fold, round(avg(price) FILTER (own <> fold), 6) AS price_mean, max(price) FILTER (own <> fold) AS price_max, count(price) FILTER (own <> fold) AS price_count, (count(price) FILTER (own <> fold) > 0)::INT AS price_has_data FROM p CROSS JOIN k GROUP BY row, col, fold""")
def radius_without_fold(spark: SparkSession, d: str) -> DataFrame:
    """Samples within 500 m of each cell, for each of four strips without the samples of that strip."""
    s = samples(spark, d).withColumn("fold", F.floor(F.col("x") / 3125).cast("int"))
    return rounded(folds.radius_without_fold(s, grid(spark, d), 500.0, ["price"], FOLDS)).select("row", "col", "fold", "price_mean", "price_max", "price_count", "price_has_data")


@query("""WITH c AS (SELECT o_orderkey AS comid, o_orderkey AS hydroseq, o_totalprice / 1000 AS arbolate FROM orders),
s AS (SELECT l_orderkey AS hydroseq, l_extendedprice / 500 AS arbolate, l_quantity AS value, (l_orderkey // 64 % 4)::INT AS own FROM lineitem),
w AS (SELECT comid, own, count(*) AS n, sum(exp(-greatest(s.arbolate - c.arbolate, 0) / 5) + 0.3 * exp(-greatest(s.arbolate - c.arbolate, 0) / 25)) AS w,
  sum((exp(-greatest(s.arbolate - c.arbolate, 0) / 5) + 0.3 * exp(-greatest(s.arbolate - c.arbolate, 0) / 25)) * value) AS wv FROM c JOIN s ON s.hydroseq >= c.hydroseq GROUP BY comid, own)
SELECT comid, fold, coalesce(sum(n) FILTER (own <> fold), 0)::BIGINT AS n_samples, round(sum(wv) FILTER (own <> fold) / sum(w) FILTER (own <> fold) * 65536) / 65536 AS catchment FROM w CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS fold) GROUP BY comid, fold""")
def hawkes_without_fold(spark: SparkSession, d: str) -> DataFrame:
    """Upstream samples averaged with both decays, for each of four folds of blocks without the samples of that fold."""
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("comid"), F.col("o_orderkey").alias("hydroseq"), (F.col("o_totalprice") / 1000).alias("arbolate"))
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hydroseq"), (F.col("l_extendedprice") / 500).alias("arbolate"), F.col("l_quantity").cast("double").alias("value"), F.expr("cast(l_orderkey div 64 % 4 as int)").alias("fold"))
    return folds.decay_without_fold(c, s, FOLDS).withColumn("catchment", F.round(F.col("catchment") * 65536) / 65536)


@query()
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    """Each rare positive scored by a model that lacks it (tests hold it against separate fits)."""
    f = _frame(spark, d).na.fill(0.5).withColumn("label", ((F.col("label") == 1) & (F.col("p_partkey") % 53 == 7)).cast("int"))
    return folds.leave_one_out(f, NAMES, "p_partkey")


@query("""WITH f AS (SELECT p_partkey, (p_partkey // 200 % 3)::INT AS fold, round((p_retailprice - 900) / 100, 1) AS f1, p_partkey * 31 % 97 / 97.0 AS f3,
  ((p_retailprice - 900) / 100 + coalesce(CASE WHEN p_partkey % 11 > 0 THEN p_size / 50.0 END, 0.5) + p_partkey * 7919 % 101 / 100.0 > 2.0)::INT AS label FROM part),
s AS (SELECT 'f1' AS model, fold, label, f1 AS s FROM f UNION ALL SELECT 'f3', fold, label, f3 FROM f),
l AS (SELECT model, fold, s, count(*) AS n, sum(label) AS pos FROM s GROUP BY ALL), r AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM l WINDOW w AS (PARTITION BY model, fold ORDER BY s DESC)),
a AS (SELECT model, fold, sum(n) AS n, sum(pos) AS p, sum(pos * (seen - tp - (n - pos) / 2)) AS lost, sum(pos * tp / seen) AS gain FROM r GROUP BY ALL)
SELECT model, fold, n::BIGINT AS n, p::BIGINT AS n_positive, CASE WHEN p > 0 AND p < n THEN round(1 - lost / (p * (n - p)), 6) END AS auc, CASE WHEN p > 0 AND p < n THEN round(gain / p, 6) END AS ap FROM a""")
def fold_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Area under the curve and average precision of two scores (one with ties) in each fold."""
    f = _frame(spark, d).withColumn("f1", F.round("f1", 1))
    return rounded(folds.fold_metrics(f, ["f1", "f3"], [0, 1, 2]))
