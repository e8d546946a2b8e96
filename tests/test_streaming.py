from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import activity, timeline
from tidemark.plans import catalogue as C
from tidemark.streaming import online

SF = "/root/testdata/sf0.001"


def test_stream_runs_match_batch(spark):
    """What a stream has emitted are the batch's runs; those still open may be missing."""
    got = {tuple(r) for r in C.stream_runs(spark, SF).collect()}
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    frames = events.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "value")))
    on = activity.hysteresis(frames, ["user_id"], "i", "value", 50, 20, initial=False)
    batch = {(r.user_id, int(r.start), int(r.end)) for r in timeline.runs(on, ["user_id"], "i", "on", "t").collect()}
    last = {r.user_id: r.t for r in events.groupBy("user_id").agg(F.max("t").alias("t")).collect()}
    assert got <= batch and all(e == last[u] for u, _, e in batch - got)


def test_tumbling_in_micro_batches(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value").orderBy("ts")
    rows.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = C._drained(online.tumbling(stream, [], "ts", "value", "1 day", "30 days"), "append" if False else "complete")
    want = rows.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    assert sorted((r.start, r.n) for r in got.collect()) == sorted((r.w.start, r.n) for r in want.collect())


def test_runs_whatever_the_batches(spark, tmp_path):
    """Rows within the watermark wait for earlier ones: one batch or several, in or out of order, give the same runs."""
    begin, schema = 10**9, "user_id int, ts timestamp, value double"
    rows = [(7, begin + t, x) for t, x in zip([0, 60, 120, 180, 240, 20_000, 40_000], [90.0, 60.0, 10.0, 95.0, 5.0, 30.0, 70.0])]
    last = [(8, begin + 200_000, 0.0)]
    for name, batches in (("one", [rows + last]), ("two", [rows[1::2], rows[0::2], last]), ("swapped", [rows[3:5], rows[:3], rows[5:], last])):
        for k, part in enumerate(batches):
            made = spark.createDataFrame(part, "user_id int, t bigint, value double").select("user_id", F.timestamp_seconds("t").alias("ts"), "value")
            made.coalesce(1).write.parquet(str(tmp_path / name / str(k)))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "*"))
        got = C._drained(online.active_runs(stream, "user_id", "ts", "value", 50, 20, "12 hours"), "append").select("user_id", F.unix_seconds("start"), F.unix_seconds("end"))
        assert sorted(tuple(r) for r in got.collect()) == [(7, begin, begin + 120), (7, begin + 180, begin + 240)], name
