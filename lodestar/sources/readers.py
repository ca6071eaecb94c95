"""Typed readers of landed files (CSV, GeoJSON, parquet), clipping, alias resolution, sinks.

There is no download here: files are landed by whatever fetches them, and read in parallel.
Filters are plain comparisons, so they reach the scan where the format allows it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Area


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, **options: str) -> DataFrame:
    """CSV with a header and a fixed schema; never inferred."""
    return spark.read.options(header=True, **options).schema(schema).csv(path)


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """A row per point feature: ``x``, ``y`` and the properties (DDL)."""
    schema = f"features array<struct<geometry:struct<coordinates:array<double>>,properties:struct<{properties}>>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    return rows.select(F.get("f.geometry.coordinates", F.lit(0)).alias("x"), F.get("f.geometry.coordinates", F.lit(1)).alias("y"), "f.properties.*")


def clip(df: DataFrame, area: Area, x: str = "x", y: str = "y") -> DataFrame:
    """Rows inside a box, edges included."""
    return df.where(F.col(x).between(area.west, area.east) & F.col(y).between(area.south, area.north))


def overlaps(df: DataFrame, area: Area) -> DataFrame:
    """Rows whose own box (``xmin`` .. ``ymax``) meets the area."""
    return df.where((F.col("xmin") <= area.east) & (F.col("xmax") >= area.west) & (F.col("ymin") <= area.north) & (F.col("ymax") >= area.south))


def resolve(df: DataFrame, names: Sequence[str], default: Column | None = None) -> Column:
    """The first of several column names that the table has, in any case; ``default`` (null) where it has none."""
    have = {c.lower(): c for c in df.columns}
    for n in names:
        if n.lower() in have:
            return F.col(f"`{have[n.lower()]}`")
    return F.lit(None) if default is None else default


def trimmed(df: DataFrame) -> DataFrame:
    """Fixed-width text without its padding; blank is null."""
    return df.withColumns({n: F.nullif(F.trim(n), F.lit("")) for n, t in df.dtypes if t == "string"})


def to_date(text: Column) -> Column:
    """A timestamp, null where the text is none."""
    return F.try_to_timestamp(text)


def downcast(df: DataFrame, present: Sequence[str] = ()) -> DataFrame:
    """Doubles to floats, and columns that say ``Present`` (exactly) to booleans; anything else, null too, is false."""
    out = {n: F.col(n).cast("float") for n, t in df.dtypes if t == "double"}
    return df.withColumns(out | {n: F.coalesce(F.col(n) == "Present", F.lit(False)) for n in present})


def page_partitions(total: int, size: int) -> list[tuple[int, int]]:
    """Offsets and lengths of the pages of a paged service."""
    return [(at, min(size, total - at)) for at in range(0, total, size)]


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = (), files: int | None = None) -> None:
    """A parquet table; ``files`` spreads it evenly, ``by`` makes folders."""
    out = df.repartition(files) if files else df
    out.write.mode("overwrite").partitionBy(*by).parquet(path)


def dense_raster(cells: DataFrame, xmin: float, ymin: float, size: float, n_rows: int, n_cols: int, value: str) -> DataFrame:
    """Cells as a dense long raster: truncated positions clipped to the bounds, null outside (the last of several by key wins)."""
    at = lambda c, low, n: F.least(F.greatest(((F.col(c) - low) / size).cast("int"), F.lit(0)), F.lit(n - 1)).cast("long")
    filled = cells.groupBy(at("y", ymin, n_rows).alias("row"), at("x", xmin, n_cols).alias("col")).agg(F.max_by(value, "cell_id").alias(value))
    spark = cells.sparkSession
    grid = spark.range(n_rows * n_cols).select(F.floor(F.col("id") / n_cols).alias("row"), (F.col("id") % n_cols).alias("col"))
    return grid.join(filled, ["row", "col"], "left")
