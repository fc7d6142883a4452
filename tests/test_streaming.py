import datetime as dt

from pyspark.sql import functions as F

from strandline.operators import streams
from strandline.streaming import progress

SCHEMA = "user string, id bigint, ts timestamp, value double"


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def rows(spark):
    start = dt.datetime(2024, 1, 1)
    return [("ab"[k % 2], k, start + dt.timedelta(seconds=k * 0.4), float(k)) for k in range(60)]


def test_rate_limit_equals_batch_over_many_micro_batches(spark, tmp_path):
    path, all_rows = str(tmp_path / "in"), rows(spark)
    for k in range(0, 60, 20):
        write(spark, path, all_rows[k : k + 20])
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    got = progress.drain(progress.rate_limited_stream(source, "user", "ts", "id", 1.0), "kept")
    batch = spark.createDataFrame(all_rows, SCHEMA).withColumn("t", F.col("ts").cast("double"))
    expected = streams.rate_limited(batch, "user", "t", "id", 1.0)
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in expected.collect())


def test_latest_windows_and_sessions(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, rows(spark))
    source = spark.readStream.schema(SCHEMA).parquet(path)
    got = progress.drain(progress.latest_progress(source, "user", "ts", "value"), "latest", "complete")
    assert {r["user"]: r["value"] for r in got.collect()} == {"a": 58.0, "b": 59.0}
    windows = progress.drain(progress.tumbling(source, "ts", "user", "value", "10 seconds", "1 second"), "windows", "append")
    assert windows.count() >= 2
    static = spark.createDataFrame(rows(spark), SCHEMA)
    assert progress.sessions(static, "ts", "user", "5 seconds", "1 second").count() == 2
    beats = spark.createDataFrame([("j", 10.0), ("j", 50.0), ("k", 1000.0)], "job string, at double")
    assert [r["job"] for r in progress.stale(beats, "job", "at", 1000.0, 300.0).collect()] == ["j"]
