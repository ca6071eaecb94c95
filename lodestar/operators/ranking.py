"""Global order without a global sort: ranks, running sums, percentiles, capture and area curves.

A window without a partition would put all rows into one task. Here the rows are dealt to value
ranges found by an approximate quantile, each range is ordered in a task of its own, and the
counts and sums of the ranges before it (a bounded table) are added. Ties are ordered by ``by``; a
value (or null) that more than one range's share of the rows have is dealt to ranges of its first ``by``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranges(df: DataFrame, value: Column) -> int:
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _as_number(df: DataFrame, column: str) -> Column | None:
    """A number that is ordered like the column: itself, or the first six bytes of a string; ``None`` for other types."""
    kind = dict(df.dtypes)[column]
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return F.col(column).cast("double")
    if kind == "string":
        return F.conv(F.rpad(F.substring(F.hex(F.col(column)), 1, 12), 12, "0"), 16, 10).cast("double")
    return None


def _tie_range(df: DataFrame, v: Column, found: list[float], by: list[str], nulls: int = 0) -> Column:
    """The range of the first of ``by`` among rows of one frequent value, from 1 on; 0 for other rows, which come before it in its range. Null is a value as others are; ``nulls``: the ranges it would fill."""
    heavy = {x: found.count(x) for x in set(found) if found.count(x) > 1} | ({None: nulls} if nulls > 1 else {})
    tie = _as_number(df, by[0]) if by else None
    if not heavy or tie is None:
        return F.lit(0)
    most = max(heavy.values())
    of = v.isin(*(x for x in heavy if x is not None)) if set(heavy) - {None} else F.lit(False)
    rows = df.where(F.coalesce(of, F.lit(None in heavy)))
    cuts = {r[0]: r[1] for r in rows.groupBy(v.alias("v")).agg(F.percentile_approx(tie, [i / most for i in range(1, most)], 50 * most)).collect()}
    out = F
    for x, edges in cuts.items():
        e = F.array(*map(F.lit, sorted(set(edges or [])))).cast("array<double>")
        out = out.when(v.isNull() if x is None else v == F.lit(x), 1 + F.size(F.filter(e, lambda b: b < tie)))
    return out.otherwise(F.lit(0)) if out is not F else F.lit(0)


def ordered(df: DataFrame, value: str, by: list[str], descending: bool = True, sums: dict[str, Column] | None = None, over: list[str] | None = None) -> DataFrame:
    """Append ``rank`` (1 is first; nulls last), ``n`` and, for each of ``sums``, ``<name>_upto`` and ``<name>_total``.

    ``over``: columns that split the rows into separate orders. Values must be numeric.
    """
    sums, over = sums or {}, over or []
    n = _ranges(df, F.col(value))
    v = F.col(value).cast("double")
    found, nulls, rows_ = df.agg(F.percentile_approx(v, [i / n for i in range(1, n)], 50 * n), F.count_if(v.isNull()), F.count("*")).first()
    found, nulls = sorted(found or []), -(-nulls * n // max(rows_, 1))
    bounds = sorted(set(found))
    edges = F.array(*map(F.lit, bounds)).cast("array<double>") if bounds else F.array().cast("array<double>")
    before = F.size(F.filter(edges, (lambda b: b > v) if descending else (lambda b: b < v)))
    rows = df.withColumn("_r", F.when(v.isNull(), F.lit(len(bounds) + 1)).otherwise(before)).withColumn("_q", _tie_range(df, v, found, by, nulls))
    rows = rows.withColumns({f"_s_{k}": F.coalesce(c, F.lit(0)) for k, c in sums.items()})
    first = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    order = Window.partitionBy(*over, "_r", "_q").orderBy(first, *by)
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumns({"_rank": F.row_number().over(order), **{f"_u_{k}": F.sum(f"_s_{k}").over(run) for k in sums}})
    totals = rows.groupBy(*over, "_r", "_q").agg(F.count("*").alias("_n"), *[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums])
    earlier = Window.partitionBy(*over).orderBy("_r", "_q").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*over)
    offsets = totals.select(
        *over, "_r", "_q", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o"), F.sum("_n").over(whole).alias("n"),
        *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in sums], *[F.sum(f"_t_{k}").over(whole).alias(f"{k}_total") for k in sums],
    )
    if not over:
        offsets = F.broadcast(offsets)  # a row per range
    out = ranked.join(offsets, [*over, "_r", "_q"])
    return out.withColumns({"rank": (F.col("_rank") + F.col("_o")).cast("long"), **{f"{k}_upto": F.col(f"_u_{k}") + F.col(f"_b_{k}") for k in sums}}).drop(
        "_r", "_q", "_rank", "_o", *[f"_{p}_{k}" for p in "sub" for k in sums]
    )


def percentiles(df: DataFrame, value: str, points: list[float]) -> list[float | None]:
    """Exact percentiles (linear interpolation) of the non-null values, as numbers.

    The driver gets two values a point. Equal values are counted together before they are ordered.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    upto = ordered(counts, "v", [], descending=False, sums={"c": F.col("c")}).select("v", "c_upto", "c_total").persist()
    try:
        total = upto.agg(F.max("c_total")).first()[0]
        if not total:
            return [None] * len(points)
        places = sorted({k for p in points for k in (int(p * (total - 1)), min(int(p * (total - 1)) + 1, total - 1))})
        at = {r[0]: r[1] for r in upto.select(F.explode(F.array(*map(F.lit, places))).alias("k"), "v", "c_upto").where("c_upto > k").groupBy("k").agg(F.min("v")).collect()}
        out = []
        for p in points:
            k = int(p * (total - 1))
            lo, hi = at[k], at[min(k + 1, total - 1)]
            out.append(lo + (hi - lo) * (p * (total - 1) - k))
        return out
    finally:
        upto.unpersist()


def percentiles_of(df: DataFrame, columns: dict[str, Column], points: list[float]) -> dict[str, list[float | None]]:
    """``percentiles`` of several columns in one pass over (column, value): a list of numbers for each name.

    Values are scaled to the span of their column first, so that all columns spread over the same ranges.
    """
    if not columns:
        return {}
    ends = df.agg(*[f(c.cast("double")).alias(f"{k}_{n}") for n, c in columns.items() for k, f in (("lo", F.min), ("hi", F.max))]).first().asDict()
    pairs = [F.struct(F.lit(n).alias("name"), c.cast("double").alias("v"), F.lit(ends[f"lo_{n}"]).cast("double").alias("lo"), F.lit(ends[f"hi_{n}"]).cast("double").alias("hi")) for n, c in columns.items()]
    rows = df.select(F.explode(F.array(*pairs)).alias("s")).select("s.*").where("v is not null")
    counts = rows.groupBy("name", "v", "lo", "hi").agg(F.count("*").alias("c")).withColumn("u", F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0))
    upto = ordered(counts, "u", ["v"], descending=False, sums={"c": F.col("c")}, over=["name"]).select("name", "v", "c_upto", "c_total").persist()
    try:
        totals = {r[0]: r[1] for r in upto.groupBy("name").agg(F.max("c_total")).collect()}
        places = {n: sorted({k for p in points for k in (int(p * (t - 1)), min(int(p * (t - 1)) + 1, t - 1))}) for n, t in totals.items()}
        wanted = [F.struct(F.lit(n).alias("name"), F.lit(k).cast("long").alias("k")) for n, ks in places.items() for k in ks]
        out: dict[str, list[float | None]] = {n: [None] * len(points) for n in columns}
        if not wanted:
            return out
        own = F.filter(F.array(*wanted), lambda x: (x["name"] == F.col("name")) & (F.col("c_upto") > x["k"]))
        at = {(r[0], r[1]): r[2] for r in upto.select("name", "v", F.explode(own).alias("w")).groupBy("name", "w.k").agg(F.min("v")).collect()}
        for n, t in totals.items():
            for i, p in enumerate(points):
                k = int(p * (t - 1))
                lo, hi = at[n, k], at[n, min(k + 1, t - 1)]
                out[n][i] = lo + (hi - lo) * (p * (t - 1) - k)
        return out
    finally:
        upto.unpersist()


def capture_at(df: DataFrame, score: str, positive: str, by: list[str], percents: list[float], rule: str = "ceil") -> DataFrame:
    """``k_pct``, ``top_n``, ``hits``, ``capture``, ``lift`` of the best k percent by score.

    ``rule``: ``ceil``, ``ceil1`` (at least one) or ``round1`` (half to even, at least one).
    """
    rows = ordered(df, score, by, sums={"pos": F.col(positive).cast("long")})
    k = F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("k_pct")
    rows = rows.select("rank", "n", "pos_total", F.col(positive).cast("long").alias("p"), k)
    size = F.col("n") * F.col("k_pct") / 100.0
    top = {"ceil": F.ceil(size), "ceil1": F.greatest(F.lit(1), F.ceil(size)), "round1": F.greatest(F.lit(1), F.bround(size))}[rule].cast("long")
    out = rows.withColumn("top_n", top).groupBy("k_pct", "n", "pos_total", "top_n").agg(F.sum(F.when(F.col("rank") <= F.col("top_n"), F.col("p")).otherwise(0)).alias("hits"))
    capture = F.when(F.col("pos_total") > 0, F.col("hits") / F.col("pos_total")).otherwise(0.0)
    return out.select("k_pct", "top_n", "hits", capture.alias("capture"), F.coalesce(F.try_divide(capture * F.col("n"), F.col("top_n")), F.lit(0.0)).alias("lift"))


def area_curve(df: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """Append ``frac_area`` and ``frac_pos``: the share of rows and of positives down to each row, best first."""
    rows = ordered(df, score, by, sums={"pos": F.col(positive).cast("long")})
    return rows.withColumns({"frac_area": F.col("rank") / F.col("n"), "frac_pos": F.when(F.col("pos_total") > 0, F.col("pos_upto") / F.col("pos_total")).otherwise(0.0)})


def area_under_curve(df: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """``auc_pa``: trapezoid from (0, 0). The step up to a row is its own label, so no lag is needed."""
    rows = ordered(df, score, by, sums={"pos": F.col(positive).cast("long")})
    strip = (2 * F.col("pos_upto") - F.col(positive).cast("long")) / 2.0
    return rows.agg(F.try_divide(F.try_divide(F.sum(strip), F.max("pos_total")), F.max("n")).alias("auc_pa")).select(F.coalesce("auc_pa", F.lit(0.0)).alias("auc_pa"))


def _by_score(df: DataFrame, score: str, positive: str) -> DataFrame:
    y = F.col(positive).cast("long")
    return df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("q"))


def roc_auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """``roc_auc`` and Mann-Whitney ``u`` from counts by score (ties count half)."""
    rows = ordered(_by_score(df, score, positive), "s", [], descending=False, sums={"q": F.col("q")})
    u = F.sum(F.col("p") * (F.col("q_upto") - F.col("q") / 2.0))
    return rows.agg(u.alias("u"), F.sum("p").alias("np"), F.sum("q").alias("nq")).select(F.try_divide(F.col("u"), F.col("np") * F.col("nq")).alias("roc_auc"), "u")


def average_precision(df: DataFrame, score: str, positive: str) -> DataFrame:
    """``avg_precision``: precision at each score, weighed by the recall it adds."""
    rows = ordered(_by_score(df, score, positive), "s", [], sums={"p": F.col("p"), "q": F.col("q")})
    return rows.agg(F.try_divide(F.sum(F.col("p") * F.col("p_upto") / (F.col("p_upto") + F.col("q_upto"))), F.sum("p").cast("double")).alias("avg_precision"))


def ks_distance(df: DataFrame, score: str, positive: str) -> DataFrame:
    """``ks``: the widest gap between the two classes' distribution functions."""
    rows = ordered(_by_score(df, score, positive), "s", [], descending=False, sums={"p": F.col("p"), "q": F.col("q")})
    return rows.agg(F.max(F.abs(F.try_divide("p_upto", "p_total") - F.try_divide("q_upto", "q_total"))).alias("ks"))


def decile(df: DataFrame, score: str, by: list[str], q: int = 10) -> DataFrame:
    """Append ``decile`` (0 is best): equal-frequency bins by interpolated edges of the ranks, not ``ntile``."""
    rows = ordered(df, score, by)
    place = F.when(F.col("n") > 1, F.greatest(F.ceil((F.col("rank") - 1) * q / (F.col("n") - 1) - 1e-12), F.lit(1)) - 1).otherwise(0)
    return rows.withColumn("decile", place.cast("int")).drop("rank", "n")


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Append ``out``: the ascending rank of the value, ties sharing the mean rank."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("c"))
    ranks = ordered(counts, "_v", [], descending=False, sums={"c": F.col("c")}).select("_v", (F.col("c_upto") - (F.col("c") - 1) / 2.0).alias(out))
    return df.join(ranks, F.col(value) == F.col("_v"), "left").drop("_v")


def percent_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Append ``out``: the lowest ascending rank among equal values as a share of all rows that have one; null for those without."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("c"))
    low = ordered(counts, "_v", [], descending=False, sums={"c": F.col("c")}).select("_v", ((F.col("c_upto") - F.col("c") + 1) / F.col("c_total")).alias(out))
    return df.join(low, F.col(value) == F.col("_v"), "left").drop("_v")


def fold_capture(df: DataFrame, score: str, positive: str, fold: str, by: list[str], percent: float, least_rows: int = 50, least_positives: int = 3) -> DataFrame:
    """``fold``, ``n``, ``pos``, ``capture``, ``lift`` of the best ``percent`` of each fold; folds below the least counts are left out."""
    y = F.col(positive).cast("long")
    rows = ordered(df, score, by, sums={"pos": y}, over=[fold]).where((F.col("n") >= least_rows) & (F.col("pos_total") >= least_positives))
    top = F.ceil(F.col("n") * percent / 100.0)
    found = rows.groupBy(fold, F.col("n").cast("long").alias("n"), F.col("pos_total").cast("long").alias("pos")).agg(F.sum(F.when(F.col("rank") <= top, y).otherwise(0)).alias("hits"))
    capture = F.col("hits") / F.col("pos")
    return found.select(fold, "n", "pos", capture.alias("capture"), (capture * F.col("n") / F.ceil(F.col("n") * percent / 100.0)).alias("lift"))


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``a``, ``b``, ``pearson``, ``spearman`` for each pair of columns."""
    names = sorted({c for p in pairs for c in p})
    rows = df.select(*names)
    for c in names:
        rows = average_ranks(rows, c, f"_rank_{c}")
    aggs = [x for a, b in pairs for x in (F.corr(a, b).alias(f"p_{a}_{b}"), F.corr(f"_rank_{a}", f"_rank_{b}").alias(f"s_{a}_{b}"))]
    wide = rows.agg(*aggs)
    return wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p_{a}_{b}").alias("pearson"), F.col(f"s_{a}_{b}").alias("spearman")) for a, b in pairs])))


def top_k(df: DataFrame, score: str, by: list[str], k: int) -> DataFrame:
    """The best k rows, nulls last."""
    return df.orderBy(F.col(score).desc_nulls_last(), *by).limit(k)


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key (the limit is applied in each task before the shuffle)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
