"""Relational patterns: unit pivots, star queries, overlays, reconciling unions, statistics documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import gate, to_ppm
from .ranking import percentiles


#: Boxes that every point is compared with at most.
MOST_REGIONS = 10_000


def semi_filter(assays: DataFrame, ids: DataFrame, key: str, species: list[str]) -> DataFrame:
    """Assays of wanted samples and species."""
    return assays.where(F.col("species").isin(species)).join(ids.select(key).distinct(), key, "left_semi")


def pivot_ppm(assays: DataFrame, key: str, species: list[str]) -> DataFrame:
    """A column ``<species>_ppm`` per species with the mean of its values in ppm; below detection is null."""
    rows = assays.withColumn("_ppm", to_ppm(F.col("value"), F.col("unit")))
    wide = rows.groupBy(key).pivot("species", species).agg(F.avg("_ppm"))
    return wide.select(key, *[F.col(s).alias(f"{s}_ppm") for s in species])


def pivot_first(rows: DataFrame, key: str, category: str, value: str, order: str, categories: list[str]) -> DataFrame:
    """A column per category with its first non-null value by ``order``."""
    wide = rows.where(F.col(value).isNotNull()).groupBy(key).pivot(category, categories).agg(F.min_by(value, order))
    return wide


def drill_star(collars: DataFrame, samples: DataFrame, results: DataFrame, elements: DataFrame, factors: dict[str, float], names: list[str]) -> DataFrame:
    """Per collar the largest value of each element: collars <- samples <- results, code tables joined, units scaled.

    Results are cut to the samples of wanted collars first; code tables are small dimensions and
    are left to the optimizer's size check.
    """
    own = samples.join(collars.select("hole_id"), "hole_id", "left_semi").select("sample_id", "hole_id")
    unit = F.element_at(F.create_map(*[x for k, v in factors.items() for x in (F.lit(k), F.lit(v))]), F.col("unit"))
    best = results.join(own, "sample_id").join(elements, "code", "left").withColumn("_v", F.col("value") * unit)
    best = best.groupBy("hole_id").pivot("element", names).agg(F.max("_v"))
    return collars.join(best, "hole_id", "left").select(*collars.columns, *[F.col(n).alias(f"max_{n}") for n in names])


def period_overlay(rows: DataFrame, keys: list[str], when: Column, periods: list[str], value: str, least: float) -> DataFrame:
    """Per key and period: count, count of large values and largest value, as columns; absent periods count 0."""
    wide = rows.withColumn("_p", when).groupBy(*keys).pivot("_p", periods).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) >= least).alias("n_hit"), F.max(value).alias("max"))
    return wide.select(*keys, *[x for p in periods for x in (F.coalesce(f"{p}_n", F.lit(0)).alias(f"{p}_n"), F.coalesce(f"{p}_n_hit", F.lit(0)).alias(f"{p}_n_hit"), F.col(f"{p}_max").alias(f"{p}_max"))])


def reconcile(*tables: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that a table lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def value_counts(df: DataFrame, column: str, n: int) -> DataFrame:
    """``value``, ``count``, ``share`` of the n most frequent values (ties: smaller value first)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("_t"))
    return counts.join(F.broadcast(total), how="cross").select("value", "count", (F.col("count") / F.col("_t")).alias("share")).orderBy(F.desc("count"), "value").limit(n)  # one row


def factorize(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Append ``code``: the place of the value among the distinct ones, sorted, or by first appearance in ``by``. Null: -1.

    Codes are numbered on the distinct values; the table comes back through a join.
    """
    from .ranking import ordered

    if by is None:
        from pyspark.sql import Window

        from ..plans.storage import materialize

        # distinct values, dealt to ranges; a range is ordered in its own task and the sizes of the ranges before it are added
        n = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = materialize(df.where(F.col(column).isNotNull()).select(column).distinct().repartitionByRange(n, column).withColumn("_p", F.spark_partition_id()))
        before = dealt.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))  # a row per range
        place = F.row_number().over(Window.partitionBy("_p").orderBy(column)) - 1
        codes = dealt.withColumn("_k", place).join(F.broadcast(before), "_p").select(column, (F.col("_k") + F.col("_o")).cast("int").alias("code"))
    else:
        first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(by).alias("_f"))
        codes = ordered(first, "_f", [column], descending=False).select(column, (F.col("rank") - 1).cast("int").alias("code"))
    return df.join(codes, column, "left").withColumn("code", F.coalesce("code", F.lit(-1)))


def statistics(df: DataFrame, p: str, cutoffs: list[float]) -> DataFrame:
    """One row: ``count``, ``min``, ``max``, ``mean``, percentiles 50 to 99.9 and the share above each cutoff."""
    points = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p99_9": 0.999}
    got = percentiles(df, p, list(points.values()))
    basics = df.where(F.col(p).isNotNull()).agg(
        F.count(p).alias("count"), F.min(p).alias("min"), F.max(p).alias("max"), F.avg(p).alias("mean"),
        *[(F.count_if(F.col(p) > c) * 100.0 / F.count(p)).alias(f"pct_gt_{str(c).replace('.', '_')}") for c in cutoffs],
    )
    return basics.withColumns({n: F.lit(v).cast("double") for n, v in zip(points, got, strict=True)})


def regional_statistics(df: DataFrame, regions: DataFrame, p: str) -> DataFrame:
    """``region``, ``count``, ``mean``, ``max`` of the points inside each box (boxes may overlap; up to ``MOST_REGIONS`` of them, else an error)."""
    if regions.count() > MOST_REGIONS:
        raise ValueError(f"more than {MOST_REGIONS} regions: assign points to regions by a grid instead")
    inside = df.join(F.broadcast(regions), F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax")))
    return inside.groupBy("region").agg(F.count(p).alias("count"), F.avg(p).alias("mean"), F.max(p).alias("max"))


def area_gates(df: DataFrame, area: str, listed: list[str], passes: int, marginal: int) -> DataFrame:
    """``area``, ``n``, ``gate`` of the listed areas, and one row ``outside`` (no gate) for records of other areas or of none."""
    named = F.when(F.col(area).isin(listed), F.col(area)).otherwise("outside")
    counts = df.groupBy(named.alias("area")).agg(F.count("*").alias("n"))
    return counts.withColumn("gate", F.when(F.col("area") != "outside", gate(F.col("n"), passes, marginal)))


def bag_quantiles(bags: DataFrame, key: str, p: str = "p") -> DataFrame:
    """Across bags, per cell: ``p05``, ``p50``, ``p95``, ``mean``, ``spread``."""
    out = bags.groupBy(key).agg(F.percentile(p, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("_q"), F.avg(p).alias("mean"))
    return out.select(key, F.col("_q")[0].alias("p05"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p95"), "mean", (F.col("_q")[2] - F.col("_q")[0]).alias("spread"))


def fold_summary(folds: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Over valid folds: ``n``, mean, sample deviation, 2.5 and 97.5 percentiles of a metric."""
    rows = folds.where("fold_id >= 0").groupBy(*keys).agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.percentile(metric, F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    return rows.select(*keys, "n", "mean", "std", F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))


def first_interval(litho: DataFrame, skip: str) -> DataFrame:
    """Per hole the top of the first interval that isn't overburden."""
    return litho.where(~F.coalesce(F.col("lithology"), F.lit("")).rlike(skip)).groupBy("hole_id").agg(F.min("from_depth").alias("bedrock_depth"))


def composite(scenes: DataFrame, keys: list[str], mode: str, order: list[Column] | None = None) -> DataFrame:
    """``value`` over time: ``mean``, ``median`` or ``first`` (by ``order``), nulls left out."""
    if mode == "first":
        return scenes.where("value is not null").groupBy(*keys).agg(F.min_by("value", F.struct(*order)).alias("value"))
    return scenes.groupBy(*keys).agg((F.avg("value") if mode == "mean" else F.percentile("value", 0.5)).alias("value"))


def top_features(df: DataFrame, names: list[str], k: int = 3) -> Column:
    """The k largest columns by magnitude, as ``name=value`` strings, ties by name."""
    pairs = F.array(*[F.struct((-F.abs(F.col(n))).alias("m"), F.lit(n).alias("n"), F.col(n).cast("double").alias("v")) for n in names])
    return F.transform(F.slice(F.array_sort(F.filter(pairs, lambda p: p["v"].isNotNull())), 1, k), lambda p: F.concat(p["n"], F.lit("="), F.format_number(p["v"], 3)))


def join_many(samples: DataFrame, tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Samples with one value column per element table, as one union and pivot instead of a join for each; negative is null."""
    long = reconcile(*[t.select(key, "value", F.lit(n).alias("_e")) for n, t in tables.items()])
    wide = long.groupBy(key).pivot("_e", list(tables)).agg(F.max(F.when(F.col("value") >= 0, F.col("value"))))
    return samples.join(wide, key, "left")


def recode(df: DataFrame, column: str, table: dict[str, str], default: str | None, out: str) -> DataFrame:
    """Append ``out``: the entry of a small dictionary, ``default`` for others."""
    if not table:
        return df.withColumn(out, F.lit(default))
    looked = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(column))
    return df.withColumn(out, F.coalesce(looked, F.lit(default)) if default is not None else looked)
