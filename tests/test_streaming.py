from pyspark.sql import functions as F

from archspark.streaming import editor


def test_latest_contents_are_published_whole(spark, tmp_path):
    source, seen = tmp_path / "in", []
    for n, rows in enumerate([[("/a", 1, "x"), ("/b", 2, "y")], [("/a", 3, "z")]]):
        spark.createDataFrame(rows, "path string, run long, content string").coalesce(1).write.mode("append").parquet(str(source))
        changes = spark.readStream.schema("path string, run long, content string").parquet(str(source))
        query = editor.publish(changes, lambda batch, number: seen.append(sorted(tuple(r) for r in batch.select("path", "content").collect())), str(tmp_path / "check"))
        query.awaitTermination(60)
    assert seen[0] == [("/a", "x"), ("/b", "y")] and seen[-1] == [("/a", "z"), ("/b", "y")]


def test_bursts(spark):
    df = spark.createDataFrame([("r", t) for t in (0.0, 0.5, 1.0, 3.0)], "root string, at double").select("root", F.timestamp_millis((F.col("at") * 1000).cast("long")).alias("ts"))
    assert sorted(r.n for r in editor.sessions(df, "root", "ts").collect()) == [1, 3]
