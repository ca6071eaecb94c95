"""Ranking, capture, calibration, correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration, ranking, sampling
from .registry import SCORED_SQL, anchors, cells, query, rounded, scored, table

S = f"WITH {SCORED_SQL}"
RANKED = f"{S}, k AS (SELECT *, row_number() OVER (ORDER BY score DESC, cell_id) AS r, count(*) OVER () AS n, sum(positive) OVER () AS np, sum(positive) OVER (ORDER BY score DESC, cell_id ROWS UNBOUNDED PRECEDING) AS cp FROM scored)"


@query(f"""{RANKED} SELECT p AS k_pct, CAST(ceil(n * p / 100) AS BIGINT) AS top_n, CAST(sum(CASE WHEN r <= ceil(n * p / 100) THEN positive ELSE 0 END) AS BIGINT) AS hits, round(sum(CASE WHEN r <= ceil(n * p / 100) THEN positive ELSE 0 END) / np::DOUBLE, 6) AS capture,
  round(sum(CASE WHEN r <= ceil(n * p / 100) THEN positive ELSE 0 END) / np::DOUBLE * n / ceil(n * p / 100), 6) AS lift FROM k, (VALUES (1.0::DOUBLE), (5.0), (10.0)) t(p) GROUP BY p, n, np""")
def capture_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Share of positives among the best k percent, and lift."""
    return rounded(ranking.capture_at(scored(spark, d), "score", "positive", ["cell_id"], [1.0, 5.0, 10.0]))


@query(f"{RANKED} SELECT cell_id, r AS rank, round(r / n::DOUBLE, 9) AS frac_area, round(cp / np::DOUBLE, 9) AS frac_pos FROM k")
def success_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.area_curve(scored(spark, d), "score", "positive", ["cell_id"]).select("cell_id", "rank", "frac_area", "frac_pos"), 9)


@query(f"{RANKED} SELECT round(sum((2 * cp - positive) / 2.0::DOUBLE) / max(np) / max(n), 8) AS auc_pa FROM k")
def auc_pa(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.area_under_curve(scored(spark, d), "score", "positive", ["cell_id"]), 8)


@query(f"{S} SELECT round(sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 8) AS roc_auc, sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END)::DOUBLE AS u FROM (SELECT score FROM scored WHERE positive = 1) a, (SELECT score FROM scored WHERE positive = 0) b")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    """ROC-AUC and Mann-Whitney U."""
    return rounded(ranking.roc_auc(scored(spark, d), "score", "positive"), 8)


@query(f"{S}, g AS (SELECT score, sum(positive) AS p, count(*) AS c FROM scored GROUP BY score), c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(c) OVER (ORDER BY score DESC) AS n FROM g) SELECT round(sum(p * (tp / n::DOUBLE)) / sum(p), 8) AS avg_precision FROM c")
def avg_precision(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.average_precision(scored(spark, d), "score", "positive"), 8)


@query(f"{S}, g AS (SELECT score, sum(positive) AS p, sum(1 - positive) AS q FROM scored GROUP BY score), c AS (SELECT sum(p) OVER (ORDER BY score) / (SELECT sum(p) FROM g)::DOUBLE - sum(q) OVER (ORDER BY score) / (SELECT sum(q) FROM g)::DOUBLE AS gap FROM g) SELECT round(max(abs(gap)), 8) AS ks FROM c")
def ks_stat(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.ks_distance(scored(spark, d), "score", "positive"), 8)


@query(f"{RANKED} SELECT cell_id, CAST(greatest(ceil((r - 1) * 10 / (n - 1)::DOUBLE - 1e-12), 1) - 1 AS INT) AS decile FROM k")
def decile_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranking.decile(scored(spark, d), "score", ["cell_id"]).select("cell_id", "decile")


@query("""SELECT a.s_suppkey AS anchor_id, (SELECT count(*) FROM part WHERE p_retailprice < a.s_acctbal / 10)::BIGINT AS less, (SELECT count(*) FROM part WHERE p_retailprice <= a.s_acctbal / 10)::BIGINT AS at_most FROM supplier a""")
def percentile_less(spark: SparkSession, d: str) -> DataFrame:
    """How many cells score less than, and at most as much as, each anchor: ranks in the union instead of a range join."""
    c = cells(spark, d).groupBy(F.col("elevation").alias("v")).agg(F.count("*").alias("c"))
    a = anchors(spark, d).select("anchor_id", (F.col("value") / 10).alias("v"))
    values = c.select("v", "c").unionAll(a.select("v", F.lit(0))).groupBy("v").agg(F.sum("c").cast("bigint").alias("c"))
    run = ranking.ordered(values, "v", [], descending=False, sums={"c": F.col("c")}).select(F.col("v").alias("w"), F.col("c_upto").cast("bigint").alias("at_most"), (F.col("c_upto") - F.col("c")).cast("bigint").alias("less"))
    return a.join(run, F.col("v") == F.col("w")).select("anchor_id", "less", "at_most")


@query("WITH a AS (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100), b AS (SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 100) SELECT count(*) AS n, count(*) / 100.0::DOUBLE AS overlap FROM a JOIN b USING (p_partkey)")
def ranking_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How many of the best 100 cells two rankings share."""
    c = cells(spark, d)
    a, b = (ranking.top_k(c, s, ["cell_id"], 100).select("cell_id") for s in ("elevation", "slope"))
    return a.join(b, "cell_id").agg(F.count("*").alias("n")).select("n", (F.col("n") / 100.0).alias("overlap"))


@query(f"{S}, a AS (SELECT quantile_cont(score, [0.99, 0.95, 0.8]) AS t FROM scored), q AS (SELECT p, t[i] AS t FROM a, (VALUES (1, 0.01::DOUBLE), (2, 0.05), (3, 0.2)) v(i, p)) SELECT p, round(avg(CAST(score >= t AS INT)) FILTER (positive = 1), 6) AS capture FROM scored, q GROUP BY p")
def capture_by_quantile(spark: SparkSession, d: str) -> DataFrame:
    """Capture at a score threshold, ties all counted."""
    s = scored(spark, d)
    cuts = dict(zip((0.01, 0.05, 0.2), ranking.percentiles(s, "score", [0.99, 0.95, 0.8]), strict=True))
    one = s.where("positive = 1").agg(*[F.avg((F.col("score") >= t).cast("int")).alias(f"c{i}") for i, t in enumerate(cuts.values())])
    return rounded(one.select(F.inline(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"c{i}").alias("capture")) for i, p in enumerate(cuts)]))))


@query("""WITH b AS (SELECT (p_partkey * 53 % 101) / 100.0::DOUBLE AS s, (p_partkey * 31 % 17 < 4)::INT AS y FROM part), e AS (SELECT s, y, len(list_filter([i * (1.0::DOUBLE / 10) FOR i IN range(1, 10)], lambda v: s >= v)) AS bin FROM b), g AS (SELECT bin, count(*) AS count, avg(s) AS mean_pred, avg(y) AS pos_rate FROM e GROUP BY bin)
SELECT CAST(bin AS INT) AS bin, round(bin * (1.0::DOUBLE / 10), 6) AS bin_left, round(CASE WHEN bin = 9 THEN 1.0 ELSE (bin + 1) * (1.0::DOUBLE / 10) END, 6) AS bin_right, count, round(mean_pred, 6) AS mean_pred, round(pos_rate, 6) AS pos_rate FROM g""")
def reliability_width(spark: SparkSession, d: str) -> DataFrame:
    return rounded(calibration.reliability(_cal(spark, d), "s", "y", calibration.width_edges()))


def _cal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(((F.col("p_partkey") * 53 % 101) / 100.0).alias("s"), (F.col("p_partkey") * 31 % 17 < 4).cast("int").alias("y"))


@query("""WITH b AS (SELECT (p_partkey * 53 % 101) / 100.0::DOUBLE AS s, (p_partkey * 31 % 17 < 4)::INT AS y FROM part), g AS (SELECT len(list_filter([i * (1.0::DOUBLE / 10) FOR i IN range(1, 10)], lambda v: s >= v)) AS bin, count(*) AS c, avg(s) AS m, avg(y) AS p FROM b GROUP BY 1) SELECT round(sum(c * abs(p - m)) / sum(c), 8) AS ece FROM g""")
def ece_width(spark: SparkSession, d: str) -> DataFrame:
    return rounded(calibration.calibration_error(calibration.reliability(_cal(spark, d), "s", "y", calibration.width_edges())), 8)


@query("""WITH b AS (SELECT (p_partkey * 53 % 101) / 100.0::DOUBLE AS s, (p_partkey * 31 % 17 < 4)::INT AS y FROM part), q AS (SELECT list_sort(list_distinct(quantile_cont(s, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM b), g AS (SELECT len(list_filter(e[2:len(e) - 1], lambda v: s >= v)) AS bin, count(*) AS c, avg(s) AS m, avg(y) AS p FROM b, q GROUP BY 1) SELECT round(sum(c * abs(p - m)) / sum(c), 8) AS ece FROM g""")
def ece_freq(spark: SparkSession, d: str) -> DataFrame:
    c = _cal(spark, d)
    return rounded(calibration.calibration_error(calibration.reliability(c, "s", "y", calibration.frequency_edges(c, "s"))), 8)


@query(f"""{S}, t AS (SELECT quantile_cont(score, 0.9) AS t FROM scored), c AS (SELECT count(*) FILTER (score >= t AND positive = 1) AS tp, count(*) FILTER (score >= t AND positive = 0) AS fp, count(*) FILTER (score < t AND positive = 1) AS fn, count(*) FILTER (score < t AND positive = 0) AS tn FROM scored, t), n AS (SELECT *, (tp + fp + fn + tn)::DOUBLE AS n FROM c)
SELECT tp, fp, fn, tn, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round(((tp + tn) / n - ((tp + fp)::DOUBLE * (tp + fn) + (fn + tn)::DOUBLE * (fp + tn)) / (n * n)) / (1 - ((tp + fp)::DOUBLE * (tp + fn) + (fn + tn)::DOUBLE * (fp + tn)) / (n * n)), 6) AS kappa, round(tp / (tp + fn)::DOUBLE, 6) AS recall FROM n""")
def confusion_top_decile(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    cut = ranking.percentiles(s, "score", [0.9])[0]
    return rounded(calibration.confusion(s, F.col("score") >= cut, "positive"))


@query(f"{S} SELECT round(avg(pow(score - positive, 2)), 8) AS brier FROM scored")
def brier(spark: SparkSession, d: str) -> DataFrame:
    return rounded(calibration.brier(scored(spark, d), "score", "positive"), 8)


@query("""WITH f AS (SELECT p_retailprice AS a, p_size::DOUBLE AS b, (p_partkey % 7)::DOUBLE AS c FROM part), r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0::DOUBLE AS rc FROM f)
SELECT 'a' AS a, 'c' AS b, round(corr(a, c), 6) AS pearson, round(corr(ra, rc), 6) AS spearman FROM r UNION ALL SELECT 'b', 'c', round(corr(b, c), 6), round(corr(rb, rc), 6) FROM r""")
def leakage_audit(spark: SparkSession, d: str) -> DataFrame:
    """Pearson and Spearman correlation of features with a label."""
    f = table(spark, d, "part").select(F.col("p_retailprice").alias("a"), F.col("p_size").cast("double").alias("b"), (F.col("p_partkey") % 7).cast("double").alias("c"))
    return rounded(ranking.correlations(f, [("a", "c"), ("b", "c")]))


@query(f"{RANKED} SELECT avg(CAST(r <= 100 AS INT)) AS share, min(r) AS best FROM k WHERE positive = 1 AND cell_id % 5 = 0")
def held_out_rank(spark: SparkSession, d: str) -> DataFrame:
    """Rank of held-out positives in the full map."""
    rows = ranking.ordered(scored(spark, d), "score", ["cell_id"]).where("positive = 1 and cell_id % 5 = 0")
    return rows.agg(F.avg((F.col("rank") <= 100).cast("int")).alias("share"), F.min("rank").alias("best"))


@query("SELECT c_nationkey, count(*) FILTER (c_acctbal > 0) AS positive, count(*) FILTER (c_acctbal > 5000) AS rich, count(*) AS n FROM customer GROUP BY c_nationkey")
def bucket_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 0).alias("positive"), F.count_if(F.col("c_acctbal") > 5000).alias("rich"), F.count("*").alias("n"))


@query(f"{S}, q AS (SELECT quantile_cont(score, [0.8, 0.9, 0.95, 0.99]) AS t FROM scored) SELECT i AS cutoff, round(avg(positive) FILTER (score >= t[i]) / (SELECT avg(positive) FROM scored), 6) AS lift FROM scored, q, (VALUES (1), (2), (3), (4)) v(i) GROUP BY i")
def flag_rate_lift(spark: SparkSession, d: str) -> DataFrame:
    """Rate of positives above score percentiles against the rate overall."""
    s = scored(spark, d)
    cuts = ranking.percentiles(s, "score", [0.8, 0.9, 0.95, 0.99])
    one = s.agg(*[(F.avg(F.when(F.col("score") >= t, F.col("positive"))) / F.avg("positive")).alias(f"l{i}") for i, t in enumerate(cuts)])
    return rounded(one.select(F.inline(F.array(*[F.struct(F.lit(i + 1).alias("cutoff"), F.col(f"l{i}").alias("lift")) for i in range(4)]))))


_TOTAL, _TERM, _CUTS = 0.0, 0.36787944117144233, []
for _k in range(1, 9):
    _TOTAL += _TERM
    _TERM /= _k
    _CUTS.append(_TOTAL)
#: How often a replicate holds a row, in SQL.
WEIGHT_SQL = "(" + " + ".join(f"(u >= {c!r})::INT" for c in _CUTS) + ")"
UNIT_SQL = "CAST(('0x' || substr(md5('{seed}:' || rep::VARCHAR || ':' || {key}::VARCHAR), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u"


@query(f"""WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, cell_id) <= ceil(count(*) OVER () * 0.1) AS hit FROM scored), h AS (SELECT cell_id, hit::INT AS hit FROM r WHERE positive = 1),
w AS (SELECT rep, hit, {UNIT_SQL.format(seed=3, key='cell_id')} FROM h, range(0, 200) t(rep)), c AS (SELECT rep, sum({WEIGHT_SQL} * hit) / sum({WEIGHT_SQL})::DOUBLE AS c FROM w GROUP BY rep)
SELECT round((SELECT avg(hit) FROM h), 8) AS capture, round(quantile_cont(c, 0.025), 8) AS lo, round(quantile_cont(c, 0.975), 8) AS hi FROM c""")
def bootstrap_capture(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sampling.bootstrap_capture(scored(spark, d), "score", "positive", "cell_id", 10.0, 200, 3), 8)


@query(f"""WITH {SCORED_SQL}, w AS (SELECT rep, score, positive AS y, {UNIT_SQL.format(seed=5, key='cell_id')} FROM scored, range(0, 20) t(rep)), k AS (SELECT rep, score, y, {WEIGHT_SQL} AS w FROM w UNION ALL SELECT -1, score, positive, 1 FROM scored),
b AS (SELECT rep, score, sum(w * y) AS p, sum(w * (1 - y)) AS q FROM k WHERE w > 0 GROUP BY rep, score), a AS (SELECT rep, p, q, sum(q) OVER (PARTITION BY rep ORDER BY score) AS upto FROM b),
c AS (SELECT rep, sum(p * (upto - q / 2.0::DOUBLE)) / (sum(p) * sum(q)) AS c FROM a GROUP BY rep) SELECT round(max(c) FILTER (rep = -1), 8) AS roc_auc, round(quantile_cont(c, 0.025) FILTER (rep >= 0), 8) AS lo, round(quantile_cont(c, 0.975) FILTER (rep >= 0), 8) AS hi FROM c""")
def bootstrap_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sampling.bootstrap_auc(scored(spark, d), "score", "positive", "cell_id", 20, 5), 8)


@query(f"""WITH f AS (SELECT o_custkey AS fold, CASE WHEN o_custkey % 9 > 0 THEN avg(o_totalprice) / 1e5 END AS v FROM orders GROUP BY o_custkey), r AS (SELECT * FROM f WHERE v IS NOT NULL), w AS (SELECT rep, v, {UNIT_SQL.format(seed=4, key='fold')} FROM r, range(0, 50) t(rep)),
c AS (SELECT rep, sum({WEIGHT_SQL} * v) / sum({WEIGHT_SQL}) AS c FROM w GROUP BY rep) SELECT round((SELECT avg(v) FROM r), 8) AS mean, round(quantile_cont(c, 0.025), 8) AS lo, round(quantile_cont(c, 0.975), 8) AS hi FROM c""")
def bootstrap_fold_mean(spark: SparkSession, d: str) -> DataFrame:
    """The mean of a fold metric; folds without one are left out."""
    f = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("fold")).agg((F.avg("o_totalprice") / 1e5).alias("v"))
    return rounded(sampling.bootstrap_mean(f.withColumn("v", F.when(F.col("fold") % 9 > 0, F.col("v")).otherwise(float("nan"))), "v", "fold", 50, 4), 8)


@query(f"""WITH {SCORED_SQL}, r AS (SELECT cell_id, positive, row_number() OVER (ORDER BY score DESC, cell_id) AS rank, count(*) OVER () AS n FROM scored), v AS (SELECT cell_id, (n - rank + 0.5) / n AS v FROM r WHERE positive = 1),
w AS (SELECT rep, v, {UNIT_SQL.format(seed=6, key='cell_id')} FROM v, range(0, 40) t(rep)), c AS (SELECT rep, sum({WEIGHT_SQL} * v) / sum({WEIGHT_SQL}) AS c FROM w GROUP BY rep)
SELECT round((SELECT avg(v) FROM v), 8) AS auc_pa, round(quantile_cont(c, 0.025), 8) AS lo, round(quantile_cont(c, 0.975), 8) AS hi FROM c""")
def bootstrap_area(spark: SparkSession, d: str) -> DataFrame:
    """Area under the curve of positives by area, with its interval."""
    return rounded(sampling.bootstrap_area(scored(spark, d), "score", "positive", "cell_id", 40, 6), 8)
