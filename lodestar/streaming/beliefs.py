"""Sequential updates as Structured Streaming jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_parquet(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A folder of parquet files as a stream with a fixed schema."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed(events: DataFrame, when: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Event-time windows with a bound for late rows: count, sum and largest value."""
    rows = events.withWatermark(when, late).groupBy(F.window(when, width), *keys)
    return rows.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("largest")).select(F.col("window.start").alias("start"), *keys, "n", "total", "largest")


def running_belief(observations: DataFrame, key: str, priors: dict[str, float]) -> DataFrame:
    """``key``, ``n``, ``posterior``: log-odds belief per key, updated observation by observation (``obs`` 0 or 1).

    ``priors``: probability of an observation of 1 under each of two hypotheses.
    """
    import math

    (_, a), (_, b) = sorted(priors.items())

    def update(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, odds = state.get if state.exists else (0, 0.0)
        for pdf in frames:
            ones = int(pdf["obs"].sum())
            n += len(pdf)
            odds += ones * math.log(a / b) + (len(pdf) - ones) * math.log((1 - a) / (1 - b))
        state.update((n, odds))
        yield pd.DataFrame({key: [group[0]], "n": [n], "posterior": [1 / (1 + math.exp(-max(min(odds, 700), -700)))]})

    kind = dict(observations.dtypes)[key]
    return observations.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, posterior double", "n long, odds double", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """What a stream says once everything that is there has been read: all rows (``append``), or the newest row of each of ``keys`` (``update``).

    Each batch is a folder of its own, written anew if the batch is run again, so a restart repeats nothing.
    """
    from ..plans.storage import shared_dir

    spark = stream.sparkSession
    home = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/rows/batch={number}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    try:
        rows = spark.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in stream.dtypes)}, batch long").option("basePath", f"{home}/rows").parquet(f"{home}/rows")
    except AnalysisException:  # no batch at all
        return spark.createDataFrame([], stream.schema)
    if not keys:
        return rows.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, "_last.*").select(*stream.columns)


def ingest(spark: SparkSession, source: str, target: str, schema, state: str, columns: list) -> None:
    """Append all new CSV files of a folder to a parquet table, with casts; a rerun goes on where the last one ended."""
    rows = spark.readStream.schema(schema).option("header", True).csv(source).select(*columns)
    rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
