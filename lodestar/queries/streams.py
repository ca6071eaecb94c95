"""Streams over the test tables, run until everything that is there has been read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import shared_dir
from ..streaming import beliefs
from .registry import query, rounded, table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return beliefs.stream_parquet(spark, f"{d}/events.parque[t]", table(spark, d, "events").schema)  # a pattern may be one file as well as a folder


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS largest FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and type. Rows may be as late as the table is long, so none is dropped."""
    low, high = table(spark, d, "events").agg(F.min("ts").cast("timestamp").cast("long"), F.max("ts").cast("timestamp").cast("long")).first()
    days = ((high or 0) - (low or 0)) // 86400 + 2
    here = F.current_timezone()
    rows = _events(spark, d).where("ts is not null").withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), here))  # days are those of the clock on the wall
    out = beliefs.run_to_end(beliefs.windowed(rows, "ts", "1 day", f"{days} days", ["event_type"], "value"), "update", ["start", "event_type"])
    return rounded(out.withColumn("start", F.date_format(F.to_utc_timestamp("start", here), "yyyy-MM-dd")), 4)


@query("""WITH o AS (SELECT user_id, count(*) AS n, count(*) FILTER (value > 60) AS ones FROM events GROUP BY user_id)
SELECT user_id, n, round(1 / (1 + exp(-greatest(least(ones * ln(0.6 / 0.2) + (n - ones) * ln(0.4 / 0.8), 700), -700))), 8) AS posterior FROM o""")
def stream_beliefs(spark: SparkSession, d: str) -> DataFrame:
    """The belief that a user is an active one, kept as state and updated event by event."""
    seen = _events(spark, d).select("user_id", (F.coalesce(F.col("value"), F.lit(0.0)) > 60).cast("int").alias("obs"))
    return rounded(beliefs.run_to_end(beliefs.running_belief(seen, "user_id", {"active": 0.6, "quiet": 0.2}), "update", ["user_id"]), 8)


@query("SELECT o_orderkey AS id, CAST(o_totalprice AS FLOAT) AS price, o_orderstatus = 'F' AS present FROM orders")
def ingested_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders landed as text in two deliveries and ingested after each: the second run reads only what is new."""
    home = f"{shared_dir(spark)}/landing-{uuid.uuid4().hex}"
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") == "F", "Present").otherwise("Absent").alias("seen"))
    half = F.pmod(F.xxhash64("o_orderkey"), F.lit(2))
    for k in (0, 1):
        o.where(half == k).write.mode("append").option("header", True).csv(f"{home}/in")
        beliefs.ingest(spark, f"{home}/in", f"{home}/out", "o_orderkey long, o_totalprice double, seen string", f"{home}/state", [F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("float").alias("price"), (F.col("seen") == "Present").alias("present")])
    return spark.read.schema("id long, price float, present boolean").parquet(f"{home}/out")
