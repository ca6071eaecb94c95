"""Registry of queries and the roles that the test tables play."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Grid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as the query of its name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Cells are parts: 50 columns of 250 m, as many rows as there are parts.
CELL, COLUMNS = 250.0, 50
#: Extent that hashed coordinates fall into.
WIDTH, HEIGHT = 12500, 10000


def grid(spark: SparkSession, sf_dir: str) -> Grid:
    """The grid over all parts: 50 columns, and rows up to the largest part key (one bounded aggregate)."""
    top = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] or 0
    return Grid(0.0, 0.0, CELL, int(top) // COLUMNS + 1, COLUMNS)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cell_id``, ``row``, ``col``, ``x``, ``y`` and part attributes as features."""
    p = table(spark, sf_dir, "part")
    row, col = F.expr(f"p_partkey div {COLUMNS}"), F.col("p_partkey") % COLUMNS
    return p.select(
        F.col("p_partkey").alias("cell_id"), row.alias("row"), col.alias("col"), (col * CELL + CELL / 2).alias("x"), (row * CELL + CELL / 2).alias("y"),
        F.col("p_retailprice").alias("elevation"), F.col("p_size").cast("double").alias("slope"), F.col("p_type").alias("lithology"),
        (F.col("p_partkey") * 37 % 1000 + 1).cast("double").alias("flow"),
    )


CELLS_SQL = """cells AS (SELECT p_partkey AS cell_id, p_partkey // 50 AS row, p_partkey % 50 AS col, (p_partkey % 50) * 250.0::DOUBLE + 125 AS x, (p_partkey // 50) * 250.0::DOUBLE + 125 AS y,
  p_retailprice AS elevation, p_size::DOUBLE AS slope, p_type AS lithology, (p_partkey * 37 % 1000 + 1)::DOUBLE AS flow FROM part)"""


#: Line items that a task groups to samples, about.
SAMPLE_ROWS = 500_000


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as sample points with a grade and a price.

    Ids have few rows each, so a task that read a large part of a file would hold all its ids: rows are dealt by id first, to tasks of a bounded size.
    """
    li = table(spark, sf_dir, "lineitem")
    tasks = max(spark.sparkContext.defaultParallelism, -(-li.count() // SAMPLE_ROWS))
    one = li.withColumn("sample_id", F.col("l_orderkey") * 8 + F.col("l_linenumber")).repartition(tasks, "sample_id").groupBy("sample_id").agg(
        F.max("l_quantity").alias("grade"), F.max(F.when(F.col("l_discount") > 0, F.col("l_extendedprice"))).alias("price"), F.max("l_returnflag").alias("category"),
    )
    return one.withColumns({"x": ((F.col("sample_id") * 7919) % WIDTH).cast("double"), "y": ((F.col("sample_id") * 104729) % HEIGHT).cast("double")})


SAMPLES_SQL = """samples AS (SELECT l_orderkey * 8 + l_linenumber AS sample_id, (((l_orderkey * 8 + l_linenumber) * 7919) % 12500)::DOUBLE AS x, (((l_orderkey * 8 + l_linenumber) * 104729) % 10000)::DOUBLE AS y,
  max(l_quantity) AS grade, max(CASE WHEN l_discount > 0 THEN l_extendedprice END) AS price, max(l_returnflag) AS category FROM lineitem GROUP BY l_orderkey * 8 + l_linenumber)"""


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as occurrences."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("anchor_id"), ((F.col("s_suppkey") * 7907) % WIDTH).cast("double").alias("x"), ((F.col("s_suppkey") * 6421) % HEIGHT).cast("double").alias("y"), F.col("s_acctbal").alias("value"), (F.col("s_nationkey") % 3).alias("kind"))


ANCHORS_SQL = """anchors AS (SELECT s_suppkey AS anchor_id, ((s_suppkey * 7907) % 12500)::DOUBLE AS x, ((s_suppkey * 6421) % 10000)::DOUBLE AS y, s_acctbal AS value, s_nationkey % 3 AS kind FROM supplier)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with a score in 0..1 (many ties) and a positive flag."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("cell_id"), ((F.col("p_partkey") * 7919 % 997) / 997.0).alias("score"), ((F.col("p_partkey") * 31 % 17 < F.when(F.col("p_partkey") * 7919 % 997 > 600, 6).otherwise(2)).cast("int")).alias("positive"))


SCORED_SQL = """scored AS (SELECT p_partkey AS cell_id, (p_partkey * 7919 % 997) / 997.0::DOUBLE AS score, (p_partkey * 31 % 17 < CASE WHEN p_partkey * 7919 % 997 > 600 THEN 6 ELSE 2 END)::INT AS positive FROM part)"""


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes around suppliers as closed rings, with an id, a class and a flag."""
    s = table(spark, sf_dir, "supplier")
    x, y, w, h = (F.col("s_suppkey") * 7907) % WIDTH, (F.col("s_suppkey") * 6421) % HEIGHT, F.col("s_suppkey") % 7 * 100 + 40, F.col("s_suppkey") % 5 * 150 + 40
    corner = lambda a, b: F.struct((x + a).cast("double").alias("x"), (y + b).cast("double").alias("y"))
    zero = F.lit(0)
    ring = F.array(corner(zero, zero), corner(w, zero), corner(w, h), corner(zero, h), corner(zero, zero))
    return s.select(F.col("s_suppkey").alias("poly_id"), ring.alias("ring"), F.col("s_nationkey").alias("lith_class"), (F.col("s_acctbal") > 5000).alias("alluvium"))


POLYGONS_SQL = """boxes AS (SELECT s_suppkey AS poly_id, ((s_suppkey * 7907) % 12500)::DOUBLE AS x0, ((s_suppkey * 6421) % 10000)::DOUBLE AS y0, ((s_suppkey * 7907) % 12500 + s_suppkey % 7 * 100 + 40)::DOUBLE AS x1,
  ((s_suppkey * 6421) % 10000 + s_suppkey % 5 * 150 + 40)::DOUBLE AS y1, s_nationkey AS lith_class, s_acctbal > 5000 AS alluvium FROM supplier)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums of two engines differ in the last digits; -0.0 is 0.0."""
    return df.withColumns({n: F.when(F.round(n, digits) == 0, 0.0).otherwise(F.round(n, digits)) for n, t in df.dtypes if t == "double"})
