from pyspark.sql import functions as F

from almagest.streaming import streams


def test_stream_equals_table(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streams.windows(s).writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = streams.windows(events).agg(F.sum("n"), F.count("*")).first()
    assert spark.table("win").agg(F.sum("n"), F.count("*")).first() == want


def test_ingest_reads_each_file_once(spark, tmp_path):
    schema = "source string, chunk_index int, text string, ingested_at timestamp"
    src, dst, ck = (str(tmp_path / x) for x in ("src", "dst", "ck"))
    row = lambda t, at: spark.createDataFrame([("a", 0, t, at), ("b", 1, t, at)], "source string, chunk_index int, text string, ingested_at string").withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    for k in (1, 2):
        row(f"v{k}", f"2041-01-0{k} 00:00:00").write.mode("append").parquet(src)
        streams.ingest(streams.new_files(spark, src, schema), dst, ck, ["source", "chunk_index"], "ingested_at").awaitTermination(120)
    got = spark.read.parquet(dst)
    assert got.count() == 4 and got.groupBy("source").agg(F.max_by("text", "ingested_at").alias("t")).select("t").distinct().collect()[0].t == "v2"
