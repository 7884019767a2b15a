"""Files that arrive later are processed once; a repeated run changes nothing."""

from pyspark.sql import functions as F

from outlyr.streaming.incremental import process_new, windowed_outliers


def test_incremental(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = lambda *tags: spark.createDataFrame([(t, i, float(i)) for t in tags for i in range(3)], "dtag string, event_idx int, score double")
    twice = lambda d: d.withColumn("score", F.col("score") * 2)
    schema = rows("a").schema
    rows("a").write.parquet(src)
    process_new(spark, src, schema, twice, out, state).awaitTermination()
    rows("a", "b").write.mode("append").parquet(src)
    process_new(spark, src, schema, twice, out, state).awaitTermination()
    process_new(spark, src, schema, twice, out, state).awaitTermination()
    got = spark.read.parquet(out).groupBy("dtag").agg(F.count("*").alias("n"), F.max("score").alias("m")).collect()
    assert {(r.dtag, r.n, r.m) for r in got} == {("a", 3, 4.0), ("b", 3, 4.0)}


def test_windows(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("at", F.col("ts").cast("timestamp")).select("at", "event_type", "value")
    e.write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = windowed_outliers(s, "at", "event_type", "value", "1 day").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == e.count()
