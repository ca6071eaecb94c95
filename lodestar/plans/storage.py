"""Stage tables on the folder that driver and executors share."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode (one machine) a temporary folder where it is unset, on a cluster that is an error."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts lineage."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(table: DataFrame, rows: int = 100_000) -> DataFrame:
    """Hint a broadcast of a written ``table`` of numbers and short strings that has at most so many rows; beyond that it joins by shuffle."""
    return F.broadcast(table) if table.count() <= rows else table


def stage(spark: SparkSession, folder: str, name: str, version: str, build) -> DataFrame:
    """The table of a stage: read where this version was finished before, else built and written. A table without its success mark is built anew."""
    path = f"{folder}/{name}-{version}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_provenance(spark: SparkSession, path: str, **facts: str) -> None:
    """A JSON document (title, url, licence, notes) beside a data set."""
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.source")


def write_metrics(df: DataFrame, path: str) -> None:
    """A metric table (few rows) as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


#: Rows of a metric table that a model card shows at most.
CARD_ROWS = 200


def model_card(title: str, tables: dict[str, DataFrame], notes: str = "") -> str:
    """A Markdown document of metric tables (up to ``CARD_ROWS`` rows each, else an error)."""
    parts = [f"# {title}", *([notes] if notes else [])]
    for name, df in tables.items():
        rows = df.limit(CARD_ROWS + 1).collect()
        if len(rows) > CARD_ROWS:
            raise ValueError(f"{name} is no metric table: over {CARD_ROWS} rows")
        cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
        lines = [df.columns, ["-"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
        parts.append(f"## {name}\n\n" + "\n".join("| " + " | ".join(x) + " |" for x in lines))
    return "\n\n".join(parts) + "\n"


def coverage(df: DataFrame, p: str = "p", least: float = 0.01) -> DataFrame:
    """``n``, ``covered``, ``pct``: cells with a probability above ``least``."""
    hit = F.count_if(F.col(p) > least)
    return df.agg(F.count("*").alias("n"), hit.alias("covered"), (hit * 100.0 / F.count("*")).alias("pct"))
