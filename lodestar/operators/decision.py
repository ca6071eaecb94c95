"""Sequential decisions under uncertainty: beliefs, particles, trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import binary_entropy, normal_tail

#: A cell counts as ore above this field value, unless a caller says otherwise.
CUTOFF = 0.1


# The fields of the default hypotheses on an n x n grid. Each falls off as a Gaussian from a line (a x + b y
# + c n = 0) or a point (in n): hypothesis, line or point, floor, height above it, width.
FIELDS = [("NW vein", (1.0, 1.0, -1.0), 0.02, 0.38, 2.0), ("NE vein", (-1.0, 1.0, 0.0), 0.02, 0.38, 2.0), ("disseminated", (0.5, 0.5), 0.05, 0.20, 4.0)]


def _away(shape: tuple[float, ...], n: float) -> Column:
    """Squared distance of a cell (``x``, ``y``) from a line or a point."""
    if len(shape) == 2:
        dx, dy = F.col("x") - shape[0] * n, F.col("y") - shape[1] * n
        return dx * dx + dy * dy
    a, b, c = shape
    off = a * F.col("x") + b * F.col("y") + c * n
    return off * off / (a * a + b * b)


def vein_priors(cells: DataFrame, n: float, fields: list[tuple] = FIELDS) -> DataFrame:
    """``hypothesis``, ``cell``, ``prior`` of Gaussian fields around lines and points, for a table of cells (``cell``, ``x``, ``y`` in cells); ``n`` is the side that lines and points are scaled to."""
    each = [F.struct(F.lit(name).alias("hypothesis"), (floor + height * F.exp(-_away(shape, n) / (width * width))).alias("prior")) for name, shape, floor, height, width in fields]
    return cells.select("cell", F.inline(F.array(*each))).withColumn("prior", F.least(F.greatest("prior", F.lit(0.001)), F.lit(0.999)))


def bernoulli_update(belief: DataFrame, priors: DataFrame, observations: DataFrame) -> DataFrame:
    """``hypothesis``, ``p`` after all observations (``cell``, ``obs``), in log space; unchanged where every likelihood is 0."""
    lik = F.when(F.col("obs") == 1, F.col("prior")).otherwise(1 - F.col("prior"))
    ll = priors.join(observations, "cell").groupBy("hypothesis").agg(F.sum(F.ln(lik)).alias("ll"), F.bool_or(lik <= 0).alias("dead"))
    return _normalise(belief.join(ll, "hypothesis", "left").withColumn("ll", F.when(F.col("dead"), F.lit(None)).otherwise(F.coalesce("ll", F.lit(0.0)))))


def gaussian_update(belief: DataFrame, means: DataFrame, observations: DataFrame, noise: float) -> DataFrame:
    """The same for Gaussian observations: ``means`` has ``hypothesis``, ``cell``, ``mean``, ``std``."""
    var = F.col("std") * F.col("std") + noise * noise
    diff = F.col("obs") - F.col("mean")
    ll = means.join(observations, "cell").groupBy("hypothesis").agg(F.sum(-0.5 * F.ln(2 * 3.141592653589793 * var) - 0.5 * diff * diff / var).alias("ll"))
    return _normalise(belief.join(ll, "hypothesis", "left").withColumn("ll", F.coalesce("ll", F.lit(0.0))))


def _normalise(rows: DataFrame) -> DataFrame:
    """Log-sum-exp over the (few) hypotheses."""
    whole = Window.partitionBy(F.lit(1))
    log_post = F.ln(F.greatest("p", F.lit(1e-300))) + F.col("ll")
    rows = rows.withColumn("_l", log_post).withColumn("_m", F.max("_l").over(whole))
    rows = rows.withColumn("_e", F.coalesce(F.exp(F.col("_l") - F.col("_m")), F.lit(0.0)))
    z = F.sum("_e").over(whole)
    return rows.withColumn("p", F.when(z > 0, F.col("_e") / z).otherwise(F.col("p"))).select("hypothesis", "p")


def marginal_prior(belief: DataFrame, priors: DataFrame) -> DataFrame:
    """``cell``, ``p``: the prior averaged over the belief."""
    return priors.join(belief, "hypothesis").groupBy("cell").agg(F.sum(F.col("p") * F.col("prior")).alias("p"))


def falsified(belief: DataFrame) -> DataFrame:
    """``falsified``: whether the best hypothesis is below one and a half times the uniform share."""
    return belief.agg((F.max("p") < 1.5 / F.count("*")).alias("falsified"))


def information(cells: DataFrame, drilled: DataFrame, p: str = "p") -> DataFrame:
    """Append ``eoi``: bits that drilling a cell yields; 0 where it was drilled."""
    done = drilled.select("cell").distinct().withColumn("_d", F.lit(True))
    return cells.join(done, "cell", "left").withColumn("eoi", F.when(F.col("_d"), 0.0).otherwise(binary_entropy(F.col(p)))).drop("_d")


def candidates(cells: DataFrame, drilled: DataFrame, score: str, k: int) -> DataFrame:
    """The k best cells that weren't drilled (ties: smaller cell)."""
    return cells.join(drilled.select("cell"), "cell", "left_anti").orderBy(F.desc(score), "cell").limit(k)


def expected_deposit(belief: DataFrame, means: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``cell``, ``p``: belief-weighted probability that a Gaussian field exceeds the cutoff."""
    tail = normal_tail((F.lit(cutoff) - F.col("mean")) / F.col("std"))
    return means.join(belief, "hypothesis").groupBy("cell").agg(F.sum(F.col("p") * tail).alias("p"))


def discounted(steps: DataFrame, gamma: float) -> DataFrame:
    """``episode``, ``policy``, ``total``: discounted reward."""
    return steps.groupBy("episode", "policy").agg(F.sum(F.pow(F.lit(gamma), F.col("step")) * F.col("reward")).alias("total"))


def discovery_curve(steps: DataFrame) -> DataFrame:
    """``policy``, ``step``, ``found``: the share of episodes that have found something by each step."""
    first = steps.groupBy("policy", "episode").agg(F.min(F.when(F.col("hit"), F.col("step"))).alias("first"), F.max("step").alias("last"))
    n = first.groupBy("policy").agg(F.count("*").alias("n"), F.max("last").alias("last"))
    at = first.where("first is not null").groupBy("policy", F.col("first").alias("step")).agg(F.count("*").alias("c"))
    every = n.select("policy", "n", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("step"))
    run = Window.partitionBy("policy").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # a row per policy and step
    return every.join(at, ["policy", "step"], "left").withColumn("found", F.coalesce(F.sum("c").over(run), F.lit(0)) / F.col("n")).select("policy", "step", "found")


def policy_summary(episodes: DataFrame) -> DataFrame:
    """Per policy: mean, median and standard error of ``total``, share of episodes that found something."""
    return episodes.groupBy("policy").agg(
        F.avg("total").alias("mean_reward"), F.percentile("total", 0.5).alias("median_reward"), (F.stddev_samp("total") / F.sqrt(F.count("*"))).alias("sem_reward"), F.avg(F.col("found").cast("int")).alias("discovery_rate"),
    )


def capture_first(steps: DataFrame, n: int, total: Column) -> DataFrame:
    """``policy``, ``capture``: the share of ``total`` positives among the first n steps of each trajectory."""
    return steps.where(F.col("step") < n).groupBy("policy").agg((F.sum(F.col("hit").cast("int")) / F.max(total)).alias("capture"))


def effective_sample_size(particles: DataFrame) -> DataFrame:
    """``ess`` = 1 / sum of squared normalised weights (``w``)."""
    return particles.agg(F.try_divide(F.sum("w") * F.sum("w"), F.sum(F.col("w") * F.col("w"))).alias("ess"))


def reweigh(particles: DataFrame, likelihood: Column) -> DataFrame:
    """Multiply weights by a likelihood and normalise (weights only pass through one-row aggregates)."""
    rows = particles.withColumn("w", F.col("w") * likelihood)
    return rows.join(F.broadcast(rows.agg(F.sum("w").alias("_z"))), how="cross").withColumn("w", F.try_divide("w", "_z")).drop("_z")


def resample(particles: DataFrame, key: str, u: float) -> DataFrame:
    """Systematic resampling with offset ``u``: a particle is copied once for each comb tooth inside its share of the running weight."""
    from .ranking import ordered

    rows = ordered(particles, key, [], descending=False, sums={"w": F.col("w")})
    n = F.col("n")
    low, high = (F.col("w_upto") - F.col("w")) / F.col("w_total") * n, F.col("w_upto") / F.col("w_total") * n
    copies = (F.ceil(high - u - 1e-12) - F.ceil(low - u - 1e-12)).cast("int")
    return rows.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("w", 1 / n).select(*particles.columns, "copy")


def matern52(d: Column, scale: float, std: float) -> Column:
    """Matern 5/2 covariance by distance."""
    a = F.sqrt(F.lit(5.0)) * d / scale
    return std * std * (1 + a + a * a / 3) * F.exp(-a)


def retrospective(prior: DataFrame, drilled: DataFrame, percent: float) -> DataFrame:
    """``capture``: positives among the best ``percent`` of undrilled cells (half-even rounding, one at least)."""
    from .ranking import capture_at

    left = prior.join(drilled.select("cell"), "cell", "left_anti")
    return capture_at(left, "prior", "positive", ["cell"], [percent], rule="round1")
