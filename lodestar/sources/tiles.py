"""Tiles of an area: which are expected, which have landed, what is missing, and landing the missing ones."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Area

STATE = "tile string, run string, landed boolean, attempts int, error string"


def chunks(spark: SparkSession, area: Area, side: float) -> DataFrame:
    """``tile``, ``west``, ``south``, ``east``, ``north``: the area cut evenly into boxes with sides of at most ``side``, row by row from the south-west."""
    nx, ny = max(1, math.ceil((area.east - area.west) / side)), max(1, math.ceil((area.north - area.south) / side))
    dx, dy = (area.east - area.west) / nx, (area.north - area.south) / ny
    i, j = F.col("id") % nx, F.expr(f"id div {nx}")
    return spark.range(nx * ny).select(
        F.concat(F.lit("r"), j, F.lit("c"), i).alias("tile"), (area.west + i * dx).alias("west"), (area.south + j * dy).alias("south"), (area.west + (i + 1) * dx).alias("east"), (area.south + (j + 1) * dy).alias("north"),
    )


def degree_tiles(spark: SparkSession, area: Area) -> DataFrame:
    """``tile``, ``west``, ``south``, ``east``, ``north``: the one-degree tiles that overlap an area (north and west of zero), named by their north-west corner like ``n40w121``."""
    lats = F.sequence(F.lit(math.floor(area.south) + 1), F.lit(math.ceil(area.north)))
    lons = F.sequence(F.lit(math.floor(-area.east) + 1), F.lit(math.ceil(-area.west)))
    rows = spark.range(1).select(F.explode(lats).alias("n")).withColumn("w", F.explode(lons))
    return rows.select(F.format_string("n%02dw%03d", "n", "w").alias("tile"), (-F.col("w")).cast("double").alias("west"), (F.col("n") - 1).cast("double").alias("south"), (1 - F.col("w")).cast("double").alias("east"), F.col("n").cast("double").alias("north"))


def gaps(expected: DataFrame, landed: DataFrame) -> DataFrame:
    """The expected tiles that haven't landed."""
    return expected.join(landed.select("tile").distinct(), "tile", "left_anti")


def read_state(spark: SparkSession, folder: str) -> DataFrame:
    """What is known of each tile tried so far: ``tile``, ``landed``, ``attempts``, the last ``error``, and the ``run`` that landed it. Empty where nothing was tried."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "tile string, landed boolean, attempts long, error string, run string")
    rows = spark.read.schema(STATE).parquet(f"{folder}/state")
    run = F.max(F.when(F.col("landed"), F.col("run")))
    return rows.groupBy("tile").agg(F.bool_or("landed").alias("landed"), F.sum("attempts").alias("attempts"), F.max(F.when(~F.col("landed"), F.col("error"))).alias("error"), run.alias("run"))


def land(expected: DataFrame, folder: str, fetch: Callable[[dict], list[tuple[int, int, float | None]]], attempts: int = 3, partitions: int = 80) -> DataFrame:
    """Fetch the tiles of ``expected`` that haven't landed, and return the state afterwards.

    ``fetch`` gets a tile's row and returns its cells (row, col, value); it is tried ``attempts`` times, ``partitions`` tiles side by side, and a
    tile that fails still is a gap for the next call. Cells are written before the state that vouches for them: a run that dies in
    between leaves cells that nobody reads, and its tiles are fetched again.
    """
    spark = expected.sparkSession
    run = uuid.uuid4().hex
    todo = gaps(expected, read_state(spark, folder).where("landed"))
    if todo.isEmpty():
        return read_state(spark, folder)

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in batch.to_pylist():
                error, cells = None, []
                for k in range(1, attempts + 1):
                    try:
                        error, cells = None, fetch(tile)
                        break
                    except Exception as e:  # noqa: BLE001 (whatever a service answers makes a gap)
                        error = f"{type(e).__name__}: {e}"[:200]
                row, col, value = zip(*cells, strict=True) if cells else ((), (), ())
                n = len(row) + 1  # the first row tells how it went
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tile["tile"]] * n), pa.array([None, *row], pa.int64()), pa.array([None, *col], pa.int64()), pa.array([None, *value], pa.float64()), pa.array([k] + [None] * (n - 1), pa.int32()), pa.array([error] + [None] * (n - 1), pa.string())],
                    ["tile", "row", "col", "value", "attempts", "error"],
                )

    got = todo.repartition(partitions, "tile").mapInArrow(get, "tile string, row long, col long, value double, attempts int, error string")
    got.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{folder}/cells")
    told = spark.read.parquet(f"{folder}/cells/run={run}").where("attempts is not null")
    told.select("tile", F.lit(run).alias("run"), F.col("error").isNull().alias("landed"), F.col("attempts").cast("int").alias("attempts"), "error").coalesce(1).write.mode("append").parquet(f"{folder}/state")
    return read_state(spark, folder)


def landed_cells(spark: SparkSession, folder: str) -> DataFrame:
    """``tile``, ``row``, ``col``, ``value`` of all tiles that have landed, each from the run that landed it."""
    good = read_state(spark, folder).where("landed").select("tile", "run")
    cells = spark.read.option("mergeSchema", "false").parquet(f"{folder}/cells").where("attempts is null")
    return cells.join(good, ["tile", "run"]).select("tile", "row", "col", "value")


def mosaic(cells: DataFrame) -> DataFrame:
    """``row``, ``col``, ``value``: of tiles that overlap, the first by name that has a value."""
    return cells.where("value is not null").groupBy("row", "col").agg(F.min_by("value", "tile").alias("value"))


def coverage(expected: DataFrame, landed: DataFrame) -> DataFrame:
    """``expected``, ``landed``, ``missing``: counts of tiles."""
    missing = gaps(expected, landed).agg(F.count("*").alias("missing"))
    return expected.agg(F.count("*").alias("expected")).crossJoin(missing).select("expected", (F.col("expected") - F.col("missing")).alias("landed"), "missing")  # one row each
