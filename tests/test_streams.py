"""Streams in several batches say what one batch says; restarts repeat nothing."""

from pyspark.sql import functions as F

from lodestar.streaming import beliefs


def test_run_to_end_in_batches(spark, tmp_path):
    df = spark.range(600).select((F.col("id") % 7).alias("k"), (F.col("id") % 3 == 0).cast("int").alias("obs"))
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("k long, obs int").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    got = {r.k: (r.n, round(r.posterior, 9)) for r in beliefs.run_to_end(beliefs.running_belief(rows, "k", {"a": 0.6, "b": 0.2}), "update", ["k"]).collect()}
    want = {}
    for r in df.groupBy("k").agg(F.count("*").alias("n"), F.sum("obs").alias("s")).collect():
        odds = 3.0**r.s * 0.5 ** (r.n - r.s)
        want[r.k] = (r.n, round(odds / (1 + odds), 9))
    assert got == want


def test_windows_keep_late_rows(spark, tmp_path):
    """A file with old rows comes last."""
    for i, day in enumerate(("2024-03-09", "2024-03-05", "2024-03-05")):
        spark.sql(f"select timestamp'{day} 10:00:00' as ts, 'a' as k, {i + 1}D as v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("ts timestamp, k string, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = beliefs.run_to_end(beliefs.windowed(rows, "ts", "1 day", "6 days", ["k"], "v"), "update", ["start", "k"])
    assert {(str(r.start)[:10], r.n, r.total) for r in got.collect()} == {("2024-03-09", 1, 1.0), ("2024-03-05", 2, 5.0)}


def test_stream_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "k long, obs int").write.parquet(str(tmp_path / "in"))
    rows = beliefs.stream_parquet(spark, str(tmp_path / "in"), "k long, obs int")
    assert beliefs.run_to_end(rows, "append").count() == 0
    assert beliefs.run_to_end(beliefs.running_belief(rows, "k", {"a": 0.6, "b": 0.2}), "update", ["k"]).count() == 0
