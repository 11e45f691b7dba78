import datetime as dt

from pyspark.sql import functions as F

from skeinflow.operators import identity
from skeinflow.streaming import ingest


def test_stream_and_batch_agree(spark, tmp_path):
    rows = [(i, f"k{i % 7}", i // 4) for i in range(40)]
    schema = "id long, key string, file int"
    for k in range(0, 10):
        spark.createDataFrame([r for r in rows if r[2] == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
        ingest.stream_into(stream, str(tmp_path / "out"), str(tmp_path / "check"), "key", "id").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.select("key").distinct().count() == 7
    batch = identity.insert_if_new(spark.createDataFrame(rows, schema), spark.createDataFrame([], "key string"), "key", "id")
    assert sorted(r["id"] for r in batch.collect()) == list(range(7))


def test_windows_on_a_stream(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(at + dt.timedelta(minutes=m), m % 2, 1.0) for m in (1, 2, 61, 62, 300, 301)]
    df = spark.createDataFrame(rows, "ts timestamp, user long, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ingest.tumbling(stream, "ts", "1 hour", "user", delay="1 minute").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, ingest.tumbling(df, "ts", "1 hour", "user").collect()))
    one = ingest.first_within(stream, "ts", "1 hour", "user").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    one.awaitTermination()
    assert spark.table("firsts").count() == 2
    assert ingest.sessions(df, "ts", "30 minutes").agg(F.sum("n")).first()[0] == 6
