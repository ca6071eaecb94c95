"""Beliefs and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import decision, spatial
from .registry import ANCHORS_SQL, CELLS_SQL, anchors, cells, grid, query, rounded, table

PRIORS_SQL = """c AS (SELECT p_partkey AS cell, (p_partkey % 50)::DOUBLE AS x, (p_partkey // 50)::DOUBLE AS y FROM part), priors AS (
  SELECT 'NW vein' AS hypothesis, cell, 0.02 + 0.38 * exp(-pow(abs(x + y - 50) / sqrt(2.0), 2) / 4) AS prior FROM c UNION ALL
  SELECT 'NE vein', cell, 0.02 + 0.38 * exp(-pow(abs(y - x) / sqrt(2.0), 2) / 4) FROM c UNION ALL
  SELECT 'disseminated', cell, 0.05 + 0.20 * exp(-(pow(x - 25, 2) + pow(y - 25, 2)) / 16) FROM c)"""


@query(f"WITH {PRIORS_SQL} SELECT hypothesis, cell, round(prior, 8) AS prior FROM priors")
def vein_priors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_priors(spark, d), 8)


def _priors(spark: SparkSession, d: str) -> DataFrame:
    """Priors of all parts' cells."""
    key = F.col("p_partkey")
    return decision.vein_priors(table(spark, d, "part").select(key.alias("cell"), (key % 50).cast("double").alias("x"), F.floor(key / 50).cast("double").alias("y")), 50)


def _observations(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier observes a cell; cells that are no part's have no prior and say nothing."""
    return table(spark, d, "supplier").select((F.col("s_suppkey") * 19).alias("cell"), (F.col("s_acctbal") > 3000).cast("int").alias("obs"))


OBS_SQL = "obs AS (SELECT s_suppkey * 19 AS cell, (s_acctbal > 3000)::INT AS obs FROM supplier)"
POST_SQL = f"{PRIORS_SQL}, {OBS_SQL}, ll AS (SELECT hypothesis, sum(ln(CASE WHEN obs = 1 THEN prior ELSE 1 - prior END)) AS ll FROM priors JOIN obs USING (cell) GROUP BY hypothesis), post AS (SELECT hypothesis, exp(ll - (SELECT max(ll) FROM ll)) / (SELECT sum(exp(ll - (SELECT max(ll) FROM ll))) FROM ll) AS p FROM ll)"


def _uniform(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(h, 1 / 3) for h in ("NW vein", "NE vein", "disseminated")], "hypothesis string, p double")


def _posterior(spark: SparkSession, d: str) -> DataFrame:
    return decision.bernoulli_update(_uniform(spark), _priors(spark, d), _observations(spark, d))


@query(f"WITH {POST_SQL} SELECT hypothesis, round(p, 8) AS p FROM post")
def bayes_update(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_posterior(spark, d), 8)


@query(f"WITH {POST_SQL} SELECT cell, round(sum(p * prior), 8) AS p FROM priors JOIN post USING (hypothesis) GROUP BY cell")
def marginal_prior(spark: SparkSession, d: str) -> DataFrame:
    return rounded(decision.marginal_prior(_posterior(spark, d), _priors(spark, d)), 8)


@query(f"WITH {POST_SQL} SELECT max(p) < 0.5 AS falsified FROM post")
def falsification(spark: SparkSession, d: str) -> DataFrame:
    return decision.falsified(_posterior(spark, d))


@query(f"""WITH {PRIORS_SQL}, {OBS_SQL}, ll AS (SELECT hypothesis, sum(-0.5 * ln(2 * pi() * 0.0225) - 0.5 * pow(obs * 0.3 - prior, 2) / 0.0225) AS ll FROM priors JOIN obs USING (cell) GROUP BY hypothesis)
SELECT hypothesis, round(exp(ll - (SELECT max(ll) FROM ll)) / (SELECT sum(exp(ll - (SELECT max(ll) FROM ll))) FROM ll), 8) AS p FROM ll""")
def gaussian_update(spark: SparkSession, d: str) -> DataFrame:
    means = _priors(spark, d).select("hypothesis", "cell", F.col("prior").alias("mean"), F.lit(0.12).alias("std"))
    obs = _observations(spark, d).select("cell", (F.col("obs") * 0.3).alias("obs"))
    return rounded(decision.gaussian_update(_uniform(spark), means, obs, 0.09), 8)


@query(f"WITH {POST_SQL}, m AS (SELECT cell, sum(p * prior) AS p FROM priors JOIN post USING (hypothesis) GROUP BY cell) SELECT cell, round(CASE WHEN cell IN (SELECT cell FROM obs) THEN 0 ELSE -(p * log2(p) + (1 - p) * log2(1 - p)) END, 8) AS eoi FROM m")
def entropy_eoi(spark: SparkSession, d: str) -> DataFrame:
    """Bits that drilling each cell yields under the updated belief."""
    m = decision.marginal_prior(_posterior(spark, d), _priors(spark, d))
    return rounded(decision.information(m, _observations(spark, d)).select("cell", "eoi"), 8)


@query(f"WITH {PRIORS_SQL}, {OBS_SQL} SELECT cell FROM priors WHERE hypothesis = 'disseminated' AND cell NOT IN (SELECT cell FROM obs) ORDER BY round(prior, 9) DESC, cell LIMIT 25")
def top_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = _priors(spark, d).where("hypothesis = 'disseminated'").withColumn("prior", F.round("prior", 9))
    return decision.candidates(p, _observations(spark, d), "prior", 25).select("cell")


STEPS_SQL = "steps AS (SELECT user_id AS episode, 'p' || user_id % 3 AS policy, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS step, value AS reward, value > 60 AS hit FROM events)"


def _steps(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("episode"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("policy"), (F.row_number().over(order) - 1).alias("step"), F.col("value").alias("reward"), (F.col("value") > 60).alias("hit"))


@query(f"WITH {STEPS_SQL} SELECT episode, policy, round(sum(pow(0.95, step) * reward), 5) AS total FROM steps GROUP BY ALL")
def discounted_reward(spark: SparkSession, d: str) -> DataFrame:
    return rounded(decision.discounted(_steps(spark, d), 0.95), 5)


@query(f"""WITH {STEPS_SQL}, f AS (SELECT policy, episode, min(step) FILTER (hit) AS first, max(step) AS last FROM steps GROUP BY ALL), n AS (SELECT policy, count(*) AS n, max(last) AS last FROM f GROUP BY policy)
SELECT policy, CAST(step AS INT) AS step, round((SELECT count(*) FROM f WHERE f.policy = n.policy AND first <= step) / n::DOUBLE, 8) AS found FROM n, (SELECT unnest(range((SELECT max(last) + 1 FROM n))) AS step) WHERE step <= last""")
def discovery_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(decision.discovery_curve(_steps(spark, d)), 8)


@query(f"WITH {STEPS_SQL}, e AS (SELECT episode, policy, sum(pow(0.95, step) * reward) AS total, bool_or(hit) AS found FROM steps GROUP BY ALL) SELECT policy, round(avg(total), 5) AS mean_reward, round(median(total), 5) AS median_reward, round(stddev_samp(total) / sqrt(count(*)), 5) AS sem_reward, round(avg(found::INT), 5) AS discovery_rate FROM e GROUP BY policy")
def policy_summary(spark: SparkSession, d: str) -> DataFrame:
    s = _steps(spark, d)
    e = s.groupBy("episode", "policy").agg(F.sum(F.pow(F.lit(0.95), "step") * F.col("reward")).alias("total"), F.bool_or("hit").alias("found"))
    return rounded(decision.policy_summary(e), 5)


@query(f"WITH {STEPS_SQL}, t AS (SELECT count(*) FILTER (hit) AS t FROM steps) SELECT policy, round(count(*) FILTER (hit) / max(t)::DOUBLE, 8) AS capture FROM steps, t WHERE step < 10 GROUP BY policy")
def capture_n_drills(spark: SparkSession, d: str) -> DataFrame:
    s = _steps(spark, d)
    return rounded(decision.capture_first(s, 10, F.lit(s.where("hit").count())), 8)


@query("SELECT policy, CAST(step AS INT) AS step, round(running, 4) AS running FROM (SELECT 'all' AS policy, step, sum(sum(pow(0.95, step) * reward)) OVER (ORDER BY step) AS running FROM (SELECT CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS step, value AS reward FROM events) GROUP BY step)")
def running_reward(spark: SparkSession, d: str) -> DataFrame:
    """Discounted reward accumulated over steps, summed over episodes."""
    by = _steps(spark, d).groupBy("step").agg(F.sum(F.pow(F.lit(0.95), "step") * F.col("reward")).alias("r"))
    run = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # a row per step
    return rounded(by.select(F.lit("all").alias("policy"), "step", F.sum("r").over(run).alias("running")), 4)


@query("WITH w AS (SELECT vec_id, exp(-pow(embedding[1]::DOUBLE - 0.1, 2) / 0.02) AS w FROM embeddings) SELECT round(pow(sum(w), 2) / sum(w * w), 4) AS ess FROM w")
def particle_ess(spark: SparkSession, d: str) -> DataFrame:
    """Effective sample size after a Gaussian observation."""
    return rounded(decision.effective_sample_size(_particles(spark, d)), 4)


def _particles(spark: SparkSession, d: str) -> DataFrame:
    f = F.get("embedding", F.lit(0)).cast("double")
    p = table(spark, d, "embeddings").select("vec_id", f.alias("value"), F.lit(1.0).alias("w"))
    return decision.reweigh(p, F.exp(-F.pow(F.col("value") - 0.1, 2) / 0.02))


@query("""WITH w AS (SELECT vec_id, exp(-pow(embedding[1]::DOUBLE - 0.1, 2) / 0.02) AS w FROM embeddings), u AS (SELECT vec_id, w, sum(w) OVER (ORDER BY vec_id) AS upto, sum(w) OVER () AS total, count(*) OVER () AS n FROM w),
k AS (SELECT vec_id, n, CAST(ceil(upto / total * n - 0.5 - 1e-12) - ceil((upto - w) / total * n - 0.5 - 1e-12) AS INT) AS copies FROM u)
SELECT vec_id, CAST(unnest(range(1, copies + 1)) AS INT) AS copy, 1.0::DOUBLE / n AS w FROM k WHERE copies > 0""")
def particle_filter(spark: SparkSession, d: str) -> DataFrame:
    """The particles that systematic resampling keeps, with the number of each copy."""
    return decision.resample(_particles(spark, d), "vec_id", 0.5).select("vec_id", "copy", "w")


TAIL_SQL = "exp(-a * a / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))"


@query(f"""WITH {POST_SQL}, z AS (SELECT hypothesis, cell, (0.1 - prior) / 0.1 AS z FROM priors), q AS (SELECT *, abs(z) AS a, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z)
SELECT cell, round(sum(p * CASE WHEN z >= 0 THEN {TAIL_SQL} ELSE 1 - {TAIL_SQL} END), 8) AS p FROM q JOIN post USING (hypothesis) GROUP BY cell""")
def expected_deposit(spark: SparkSession, d: str) -> DataFrame:
    means = _priors(spark, d).select("hypothesis", "cell", F.col("prior").alias("mean"), F.lit(0.1).alias("std"))
    return rounded(decision.expected_deposit(_posterior(spark, d), means), 8)


@query(f"""WITH {PRIORS_SQL}, {OBS_SQL}, r AS (SELECT p.cell, (p_size > 40)::INT AS positive, row_number() OVER (ORDER BY prior DESC, p.cell) AS rank, count(*) OVER () AS n FROM priors p JOIN part ON p_partkey = p.cell WHERE hypothesis = 'disseminated' AND p.cell NOT IN (SELECT cell FROM obs))
SELECT 10.0::DOUBLE AS percent, round(sum(positive) FILTER (rank <= greatest(round_even(n * 0.1, 0), 1)) / sum(positive)::DOUBLE, 8) AS capture FROM r""")
def retrospective(spark: SparkSession, d: str) -> DataFrame:
    """Positives among the best tenth of the cells that were not drilled."""
    p = _priors(spark, d).where("hypothesis = 'disseminated'").join(table(spark, d, "part").select(F.col("p_partkey").alias("cell"), (F.col("p_size") > 40).cast("int").alias("positive")), "cell")
    return rounded(decision.retrospective(p, _observations(spark, d), 10.0).select(F.col("k_pct").alias("percent"), "capture"), 8)


@query(f"""WITH {CELLS_SQL}, {ANCHORS_SQL}, p AS (SELECT c.cell_id, a.value, sqrt(5) * sqrt((c.x - a.x) * (c.x - a.x) + (c.y - a.y) * (c.y - a.y)) / 400 AS a FROM cells c JOIN anchors a ON sqrt((c.x - a.x) * (c.x - a.x) + (c.y - a.y) * (c.y - a.y)) <= 1000)
SELECT cell_id, round(sum(value * (1 + a + a * a / 3) * exp(-a)) / 1000, 6) AS field, round(max((1 + a + a * a / 3) * exp(-a)), 6) AS nearest FROM p GROUP BY cell_id""")
def covariance_field(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences spread over the cells around them by a Matern covariance."""
    near = spatial.cells_within(anchors(spark, d), grid(spark, d), 1000.0).withColumn("k", decision.matern52(F.col("d"), 400.0, 1.0))
    out = near.groupBy("row", "col").agg((F.sum(F.col("value") * F.col("k")) / 1000).alias("field"), F.max("k").alias("nearest"))
    return rounded(cells(spark, d).select("cell_id", "row", "col").join(out, ["row", "col"]).select("cell_id", "field", "nearest"))
