"""Relational queries: codes, pivots, stars, overlays, unions, statistics, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import calibration, ranking, relational, sampling
from .registry import CELLS_SQL, SAMPLES_SQL, cells, query, rounded, samples, table


@query("SELECT p_partkey FROM part WHERE list_has_any([p_type, p_brand], ['SMALL', 'LARGE', 'Brand#11', 'Brand#12', 'Brand#21'])")
def deposit_code_overlap(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("codes", F.array("p_type", "p_brand"))
    return p.where(scalar.has_code(F.col("codes"), ["SMALL", "LARGE", "Brand#11", "Brand#12", "Brand#21"])).select("p_partkey")


@query(r"SELECT doc_id, regexp_matches(coalesce(text, ''), '(?i)\b(?:the|der|les)\b') AS hit FROM documents")
def code_regex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", scalar.code_mask(F.col("text"), ["the", "der", "les"]).alias("hit"))


@query(r"SELECT o_orderkey, array_to_string([('usgs:' || lower(x)) FOR x IN regexp_extract_all(lower(o_orderpriority || ' ' || (o_orderkey % 40)::VARCHAR || 'a 12'), '\b(\d{1,2}[a-z]?)\b')], ',') AS codes FROM orders")
def codes_from_text(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(" ", "o_orderpriority", F.concat((F.col("o_orderkey") % 40).cast("string"), F.lit("a")), F.lit("12"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(scalar.parse_codes(text), ",").alias("codes"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'a') THEN '36a' WHEN contains(lower(p_name), 'cu') THEN '21a' WHEN contains(lower(p_name), 'p') THEN '32a' ELSE 'none' END AS code FROM part")
def priority_code(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", scalar.first_match(F.col("p_name"), [("a", "36a"), ("cu", "21a"), ("p", "32a")], "none").alias("code"))


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_discount - 0.05 > 0 THEN l_discount - 0.05 END, CASE WHEN l_tax > 0 THEN l_tax * 0.001 END) AS best FROM lineitem")
def best_value_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalar.priority_value([(F.col("l_discount") - 0.05, 1.0), (F.col("l_tax"), 0.001)]).alias("best"))


UNIT_SQL = "CASE l_linestatus WHEN 'O' THEN 'ppb' ELSE CASE WHEN l_linenumber = 1 THEN '%' ELSE 'ppm' END END"


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity - 5 >= 0 THEN (l_quantity - 5) * CASE {UNIT_SQL} WHEN 'ppb' THEN 0.001 WHEN '%' THEN 10000.0 ELSE 1.0 END END AS ppm FROM lineitem""")
def unit_cascade(spark: SparkSession, d: str) -> DataFrame:
    unit = F.when(F.col("l_linestatus") == "O", "ppb").when(F.col("l_linenumber") == 1, "%").otherwise("ppm")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalar.to_ppm(F.col("l_quantity") - 5, unit).alias("ppm"))


def _assays(spark: SparkSession, d: str) -> DataFrame:
    unit = F.when(F.col("l_linestatus") == "O", "ppb").when(F.col("l_linenumber") == 1, "%").otherwise("ppm")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("lab_id"), F.col("l_returnflag").alias("species"), (F.col("l_quantity") - 5).alias("value"), unit.alias("unit"), "l_linenumber")


@query("SELECT l_orderkey AS lab_id, l_returnflag AS species, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%') GROUP BY ALL")
def assay_semi_filter(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("lab_id"))
    return relational.semi_filter(_assays(spark, d), ids, "lab_id", ["A", "R"]).groupBy("lab_id", "species").agg(F.count("*").alias("n"))


@query(f"""WITH a AS (SELECT l_orderkey AS lab_id, l_returnflag AS s, CASE WHEN l_quantity - 5 >= 0 THEN (l_quantity - 5) * CASE {UNIT_SQL} WHEN 'ppb' THEN 0.001 WHEN '%' THEN 10000.0 ELSE 1.0 END END AS v FROM lineitem)
SELECT lab_id, round(avg(v) FILTER (s = 'A'), 6) AS A_ppm, round(avg(v) FILTER (s = 'N'), 6) AS N_ppm, round(avg(v) FILTER (s = 'R'), 6) AS R_ppm FROM a GROUP BY lab_id""")
def assay_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Long assays to one column per species in ppm."""
    return rounded(relational.pivot_ppm(_assays(spark, d), "lab_id", ["A", "N", "R"]))


@query("""SELECT l_orderkey AS lab_id, arg_min(l_quantity, (l_linenumber, l_extendedprice)) FILTER (l_returnflag = 'A') AS A, arg_min(l_quantity, (l_linenumber, l_extendedprice)) FILTER (l_returnflag = 'N') AS N, arg_min(l_quantity, (l_linenumber, l_extendedprice)) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY l_orderkey""")
def pivot_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("lab_id"), "l_returnflag", "l_quantity", F.struct("l_linenumber", "l_extendedprice").alias("place"))
    return relational.pivot_first(rows, "lab_id", "l_returnflag", "l_quantity", "place", ["A", "N", "R"])


@query("""WITH b AS (SELECT o_custkey AS hole_id, p_type AS element, max(l_extendedprice * CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.001 WHEN 'R' THEN 10000.0 END) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT c_custkey AS hole_id, c_mktsegment, max(v) FILTER (element = 'SMALL') AS max_SMALL, max(v) FILTER (element = 'LARGE') AS max_LARGE, max(v) FILTER (element = 'PROMO') AS max_PROMO
FROM customer LEFT JOIN b ON hole_id = c_custkey WHERE c_acctbal > 0 GROUP BY ALL""")
def drill_star(spark: SparkSession, d: str) -> DataFrame:
    """The largest scaled result of each element per collar (customers, orders, line items, part types)."""
    collars = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("hole_id"), "c_mktsegment")
    taken = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("hole_id"))
    results = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_partkey").alias("code"), F.col("l_returnflag").alias("unit"), F.col("l_extendedprice").alias("value"))
    elements = table(spark, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_type").alias("element"))
    return relational.drill_star(collars, taken, results, elements, {"A": 1.0, "N": 0.001, "R": 10000.0}, ["SMALL", "LARGE", "PROMO"])


@query("""WITH o AS (SELECT o_custkey, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'pre' ELSE 'post' END AS p, o_totalprice AS v FROM orders)
SELECT o_custkey, count(*) FILTER (p = 'pre') AS pre_n, count(*) FILTER (p = 'pre' AND v >= 200000) AS pre_n_hit, max(v) FILTER (p = 'pre') AS pre_max,
  count(*) FILTER (p = 'post') AS post_n, count(*) FILTER (p = 'post' AND v >= 200000) AS post_n_hit, max(v) FILTER (p = 'post') AS post_max FROM o GROUP BY o_custkey""")
def period_overlay(spark: SparkSession, d: str) -> DataFrame:
    when = F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"), "pre").otherwise("post")
    return relational.period_overlay(table(spark, d, "orders"), ["o_custkey"], when, ["pre", "post"], "o_totalprice", 200000.0)


@query("SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value, event_id) <= 3")
def top_n_per_tile(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return ranking.first_per(e, ["user_id", "event_type"], [F.col("value"), F.col("event_id")], 3)


@query("SELECT user_id, arg_min(event_id, (value, event_id)) AS event_id, min(value) AS value FROM events GROUP BY user_id")
def best_per_tile(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("event_id"), F.min("value").alias("value"))


@query("SELECT user_id, round(median(value), 6) AS value FROM events GROUP BY user_id")
def temporal_composite(spark: SparkSession, d: str) -> DataFrame:
    return rounded(relational.composite(table(spark, d, "events").select("user_id", "value"), ["user_id"], "median"))


@query("SELECT user_id, round(avg(value), 6) AS value FROM events GROUP BY user_id")
def temporal_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(relational.composite(table(spark, d, "events").select("user_id", "value"), ["user_id"], "mean"))


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier")
def union_reconcile(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return relational.reconcile(c, s)


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def orphans_anti(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(big, "c_custkey", "left_anti")


FUSE_SQL = """a AS (SELECT p_partkey AS cell_id, (p_partkey * 37 % 101) / 100.0::DOUBLE AS score_a FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey AS cell_id, (p_partkey * 53 % 101) / 100.0::DOUBLE AS score_b FROM part WHERE p_partkey % 4 <> 0),
f AS (SELECT cell_id, score_a, score_b, CASE WHEN score_a IS NULL THEN score_b WHEN score_b IS NULL THEN score_a ELSE greatest(score_a, score_b) END AS fused FROM a FULL JOIN b USING (cell_id))"""


def _fused(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("cell_id"))
    a = p.where("cell_id % 3 <> 0").withColumn("s", (F.col("cell_id") * 37 % 101) / 100.0)
    b = p.where("cell_id % 4 <> 0").withColumn("t", (F.col("cell_id") * 53 % 101) / 100.0)
    return calibration.fuse(a, b, ["cell_id"], "s", "t")


@query(f"WITH {FUSE_SQL} SELECT * FROM f")
def outer_fuse(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d)


@query(f"""WITH {FUSE_SQL} SELECT count(*) FILTER (score_a IS NOT NULL AND score_b IS NULL) AS a_only, count(*) FILTER (score_a IS NULL AND score_b IS NOT NULL) AS b_only, count(*) FILTER (score_a IS NOT NULL AND score_b IS NOT NULL) AS both,
count(*) FILTER (score_a IS NULL AND score_b IS NULL) AS neither, count(*) FILTER (score_a > score_b) AS a_wins, count(*) FILTER (score_b > score_a) AS b_wins, count(*) FILTER (score_a = score_b) AS ties FROM f""")
def fusion_summary(spark: SparkSession, d: str) -> DataFrame:
    return calibration.fusion_summary(_fused(spark, d))


@query("SELECT p_partkey, CAST(p_type = 'SMALL' AS TINYINT) AS t_SMALL, CAST(p_type = 'LARGE' AS TINYINT) AS t_LARGE, CAST(p_type NOT IN ('SMALL', 'LARGE') AS TINYINT) AS t_other FROM part")
def onehot_topn(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", *scalar.one_hot(F.col("p_type"), ["SMALL", "LARGE"], "t"))


@query("SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INT) AS code FROM part")
def factorize_sorted(spark: SparkSession, d: str) -> DataFrame:
    return relational.factorize(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "code")


@query("WITH f AS (SELECT p_brand, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS code FROM part GROUP BY p_brand) SELECT p_partkey, CAST(code AS INT) AS code FROM part JOIN f USING (p_brand)")
def factorize_appearance(spark: SparkSession, d: str) -> DataFrame:
    return relational.factorize(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", by="p_partkey").select("p_partkey", "code")


@query("SELECT p_type AS value, count(*) AS count, round(count(*) / (SELECT count(*) FROM part)::DOUBLE, 6) AS share FROM part GROUP BY p_type ORDER BY count DESC, value LIMIT 4")
def value_counts_topn(spark: SparkSession, d: str) -> DataFrame:
    return rounded(relational.value_counts(table(spark, d, "part"), "p_type", 4))


@query(f"""WITH {CELLS_SQL} SELECT count(*) AS count, min(elevation) AS min, max(elevation) AS max, round(avg(elevation), 6) AS mean, round(100.0 * count(*) FILTER (elevation > 950) / count(*), 6) AS pct_gt_950_0,
round(quantile_cont(elevation, 0.5), 6) AS p50, round(quantile_cont(elevation, 0.75), 6) AS p75, round(quantile_cont(elevation, 0.9), 6) AS p90, round(quantile_cont(elevation, 0.95), 6) AS p95, round(quantile_cont(elevation, 0.99), 6) AS p99, round(quantile_cont(elevation, 0.999), 6) AS p99_9 FROM cells""")
def stats_document(spark: SparkSession, d: str) -> DataFrame:
    return rounded(relational.statistics(cells(spark, d), "elevation", [950.0]))


@query(f"WITH {CELLS_SQL} SELECT count(*) AS n, count(*) FILTER (elevation > 950) AS covered, round(count(*) FILTER (elevation > 950) * 100.0 / count(*), 6) AS pct FROM cells")
def coverage_mask(spark: SparkSession, d: str) -> DataFrame:
    from ..plans.storage import coverage

    return rounded(coverage(cells(spark, d), "elevation", 950.0))


@query(f"""WITH {CELLS_SQL}, r(region, xmin, ymin, xmax, ymax) AS (VALUES ('west', 0, 0, 4000, 9000), ('east', 3000, 0, 12000, 5000))
SELECT region, count(elevation) AS count, round(avg(elevation), 6) AS mean, max(elevation) AS max FROM cells JOIN r ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax GROUP BY region""")
def region_stats(spark: SparkSession, d: str) -> DataFrame:
    boxes = spark.createDataFrame([("west", 0, 0, 4000, 9000), ("east", 3000, 0, 12000, 5000)], "region string, xmin int, ymin int, xmax int, ymax int")
    return rounded(relational.regional_statistics(cells(spark, d), boxes, "elevation"))


@query("""SELECT label, n, round(mean, 6) AS mean, round(std, 6) AS std, round(lo, 6) AS lo, round(hi, 6) AS hi FROM (SELECT event_type AS label, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi
FROM events WHERE user_id % 10 - 1 >= 0 GROUP BY event_type)""")
def fold_metric_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("label"), (F.col("user_id") % 10 - 1).alias("fold_id"), "value")
    return rounded(relational.fold_summary(e, ["label"], "value"))


@query("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT label, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(avg(v), 6) AS mean,
round(quantile_cont(v, 0.95) - quantile_cont(v, 0.05), 6) AS spread FROM x GROUP BY label""")
def bag_quantiles(spark: SparkSession, d: str) -> DataFrame:
    bags = table(spark, d, "embeddings").select("label", F.explode("embedding").alias("p")).withColumn("p", F.col("p").cast("double"))
    return rounded(relational.bag_quantiles(bags, "label"))


@query("SELECT o_custkey AS hole_id, min(o_totalprice) AS bedrock_depth FROM orders WHERE NOT regexp_matches(o_orderpriority, '(?i)low|not') GROUP BY o_custkey")
def bedrock_depth(spark: SparkSession, d: str) -> DataFrame:
    litho = table(spark, d, "orders").select(F.col("o_custkey").alias("hole_id"), F.col("o_orderpriority").alias("lithology"), F.col("o_totalprice").alias("from_depth"))
    return relational.first_interval(litho, "(?i)low|not")


@query(r"SELECT doc_id, md5(lower(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\n\r\-/()]+', ' ', 'g'), '\s+', ' ', 'g')))) AS digest FROM documents")
def text_pre_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(scalar.pre_clean(F.coalesce("text", F.lit(""))).cast("binary")).alias("digest"))


@query("SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'fine' WHEN 'LARGE' THEN 'coarse' ELSE 'other' END AS grain FROM part")
def dictionary_decode(spark: SparkSession, d: str) -> DataFrame:
    return relational.recode(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", {"SMALL": "fine", "LARGE": "coarse"}, "other", "grain").drop("p_type")


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 5000 THEN 'PASS' WHEN c_acctbal >= 1000 THEN 'MARGINAL' ELSE 'FAIL' END AS gate FROM customer")
def threshold_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", scalar.gate(F.col("c_acctbal"), 5000, 1000).alias("gate"))


@query(f"WITH {SAMPLES_SQL}, e AS (SELECT min(CAST(floor(x / 3000) AS BIGINT)) AS x0, min(CAST(floor(y / 3000) AS BIGINT)) AS y0, max(CAST(floor(y / 3000) AS BIGINT)) AS y1 FROM samples) SELECT sample_id, (CAST(floor(x / 3000) AS BIGINT) - x0) * (y1 - y0 + 1) + CAST(floor(y / 3000) AS BIGINT) - y0 AS fold FROM samples, e")
def spatial_blocks(spark: SparkSession, d: str) -> DataFrame:
    return sampling.spatial_folds(samples(spark, d), 3000.0).select("sample_id", "fold")


@query(f"""WITH {SAMPLES_SQL}, q AS (SELECT list_distinct(quantile_cont(x, [0.2, 0.4, 0.6, 0.8])) AS e FROM samples WHERE grade > 40) SELECT sample_id, CAST(len(list_filter(e, lambda v: x > v)) % 3 AS INT) AS fold FROM samples, q""")
def quantile_folds_1d(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).withColumn("pos", F.col("grade") > 40)
    return sampling.quantile_folds(s, "x", "pos", 5, 3).select("sample_id", "fold")


@query(f"""WITH {SAMPLES_SQL}, q AS (SELECT list_distinct(quantile_cont(x, [0.25, 0.5, 0.75])) AS ex, list_distinct(quantile_cont(y, [0.25, 0.5, 0.75])) AS ey FROM samples WHERE grade > 40)
SELECT sample_id, CAST((len(list_filter(ex, lambda v: x > v)) * 4 + len(list_filter(ey, lambda v: y > v))) % 6 AS INT) AS fold FROM samples, q""")
def quantile_folds_2d(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).withColumn("pos", F.col("grade") > 40)
    return sampling.quantile_folds_2d(s, "x", "y", "pos", 4, 6).select("sample_id", "fold")


HASH_SQL = "CAST(('0x' || substr(md5('7:' || {k}::VARCHAR), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"


@query(f"""WITH s AS (SELECT p_partkey, p_type, CAST(p_partkey % 23 = 0 AS INT) AS label, {HASH_SQL.format(k='p_partkey')} AS h FROM part), q AS (SELECT p_type, greatest(1, count(*) * 3) AS quota FROM s WHERE label = 1 GROUP BY p_type),
r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY h, p_partkey) AS r FROM s WHERE label = 0) SELECT p_partkey FROM r JOIN q USING (p_type) WHERE r <= quota""")
def pseudo_negatives(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_type", (F.col("p_partkey") % 23 == 0).cast("int").alias("label"))
    return sampling.pseudo_negatives(p, "p_partkey", "label", "p_type", 3, 7).select("p_partkey")


@query(f"SELECT p_partkey FROM part WHERE p_partkey % 23 = 0 OR {HASH_SQL.format(k='p_partkey')} < 0.1")
def keep_positives(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 23 == 0).cast("int").alias("label"))
    return sampling.keep_positives(p, "p_partkey", "label", 0.1, 7).select("p_partkey")


@query(f"""WITH t AS (SELECT count(*) FILTER (p_partkey % 23 = 0)::DOUBLE AS p, count(*) AS n FROM part)
SELECT bag, count(*) AS n FROM part, t, range(0, 5) b(bag) WHERE p_partkey % 23 = 0 OR CAST(('0x' || substr(md5('7:' || bag::VARCHAR || ':' || p_partkey::VARCHAR), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < p / greatest(n - p, 1) GROUP BY bag""")
def pu_bags(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 23 == 0).cast("int").alias("label"))
    return sampling.bags(p, "p_partkey", "label", 5, 7).where("in_bag").groupBy(F.col("bag").cast("bigint").alias("bag")).agg(F.count("*").alias("n"))


@query()
def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    """Token-set similarity of distinct part names to a small thesaurus, mapped back."""
    from ..plans.thesaurus import match

    return match(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", ["part red small", "blue part", "green large thing"], 60.0)


