"""Streams give what tables give; resumption works by key."""

from pyspark.sql import functions as F

from candor.functions import text as T
from candor.sources import io
from candor.streaming import incremental


def test_row_local_operators_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(i, f"Text, {i}!") for i in range(20)], "id long, text string").write.parquet(src)
    stream = spark.readStream.schema("id long, text string").parquet(src)
    out = str(tmp_path / "out")
    q = incremental.append_batches(stream, out, str(tmp_path / "cp"), lambda d: d.select("id", T.normalize(F.col("text")).alias("n")), ["id"])
    q.awaitTermination(60)
    got = {r["id"]: r["n"] for r in spark.read.parquet(out).collect()}
    want = {r["id"]: r["n"] for r in spark.read.parquet(src).select("id", T.normalize(F.col("text")).alias("n")).collect()}
    assert got == want


def test_windowed_rate_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.range(120).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3).cast("double").alias("value"))
    rows.write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    q = incremental.windowed_rate(stream, "ts", F.col("value") > 0).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted((str(r["window_start"]), r["n"], round(r["rate"], 9)) for r in d.collect())
    assert key(spark.table("rates")) == key(incremental.windowed_rate(rows, "ts", F.col("value") > 0))


def test_resume_by_key(spark, tmp_path):
    path, seen = str(tmp_path / "t"), []

    def work(d):
        seen.append(d.count())
        return d

    incremental.resume(spark.range(5), path, ["id"], work)
    assert incremental.resume(spark.range(8), path, ["id"], work).count() == 8 and seen == [5, 3]


def test_formats_and_discovery(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a "q", b', ["x"]), (2, None, [])], "id long, t string, l array<string>")
    for kind in ("parquet", "jsonl", "csv"):
        io.write_table(d, f"{tmp_path}/t.{kind}")
        assert io.read_table(spark, f"{tmp_path}/t.{kind}", schema=d.schema if kind != "csv" else "id long, t string, l string").count() == 2
    d.write.parquet(f"{tmp_path}/train/a_with_answers.parquet")
    got = io.discover(spark, str(tmp_path / "train"), "part-*", schema=d.schema)
    assert got.select("path_split").distinct().first()[0] == "train"
    assert io.excluded_ids(spark, [f"{tmp_path}/none.parquet", f"{tmp_path}/t.parquet"]).count() == 2
