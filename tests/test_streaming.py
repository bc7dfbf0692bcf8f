"""A stream of frames gives the cuts that the batch rule gives."""

from framelake.streaming.scenes import streamed_cuts


def test_cuts(spark, tmp_path):
    schema = "video string, frame long, level double"
    source, kept = str(tmp_path / "in"), str(tmp_path / "state")
    first = [("a", 0, 10.0), ("a", 1, 12.0), ("a", 2, 90.0), ("b", 0, 5.0)]
    second = [("a", 3, 91.0), ("a", 4, 20.0), ("b", 1, 60.0), ("b", 0, 60.0)]
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(source)
    stream = streamed_cuts(spark.readStream.schema(schema).parquet(source), 40.0)
    query = stream.writeStream.format("memory").queryName("cuts").option("checkpointLocation", kept).start()
    query.processAllAvailable()
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(source)
    query.processAllAvailable()
    query.stop()
    assert sorted((r.video, r.frame) for r in spark.table("cuts").collect()) == [("a", 2), ("a", 4), ("b", 1)]
