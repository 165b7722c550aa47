"""A stream of files counts like the same rows at rest."""

from pyspark.sql import functions as F

from locusloom.streaming import counts


def test_windowed_reasons(spark, tmp_path):
    rows = spark.range(300).select((F.timestamp_seconds(F.col("id") * 30)).alias("ts"), (F.col("id") % 3).alias("k"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    reason = F.when(F.col("k") == 0, "UNMAPPED").otherwise("PASS")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = counts.reasons_by_window(stream, reason).writeStream.outputMode("complete").format("memory").queryName("reasons").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from reasons").collect())) == sorted(map(tuple, counts.reasons_by_window(rows, reason).collect()))
