from pyspark.sql import functions as F

from nodeloom.sources.nodes import parse_markdown
from nodeloom.streaming import lines


def finish(stream, path, mode="append"):
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start(f"{path}/out").awaitTermination()


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", k) for m, k in ((1, "a"), (2, "a"), (3, "b"), (7, "a"), (40, "a"))]
    spark.createDataFrame(rows, "ts string, k string").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "k").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp_ntz, k string").parquet(f"{tmp_path}/in")
    finish(lines.windowed_counts(stream, "ts", "k").select(F.col("window.start").cast("string").alias("at"), "k", "n"), str(tmp_path))
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == [("2024-01-01 00:00:00", "a", 2), ("2024-01-01 00:00:00", "b", 1), ("2024-01-01 00:05:00", "a", 1)]


def test_documents_stream_through_the_parser(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.md").write_text(f"# T{i}\n\n- x\n")
    stream = lines.read_documents(spark, f"file://{tmp_path}/in").select(F.lit(0).alias("doc_id"), F.col("value").alias("text"))
    finish(parse_markdown(stream).where("kind = 'heading'").select("text"), str(tmp_path))
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["T0", "T1", "T2"]


def test_sessions_are_declared_on_events(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:00:00", "a")], "ts string, k string").select(F.col("ts").cast("timestamp").alias("ts"), "k").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, k string").parquet(f"{tmp_path}/in")
    assert lines.sessions(stream, "ts", "k").columns == ["session_window", "k", "n"]
