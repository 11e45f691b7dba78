"""Ingest as a stream: the same identity rules as in batch, and windows over event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skeinflow.operators.identity import insert_if_new


def stream_into(source: DataFrame, path: str, checkpoint: str, key: str, *order: Column | str) -> StreamingQuery:
    """Appends what is new to the Parquet table at path, in micro-batches; the first row of each key stays.

    Each batch reads the keys written before it. A batch that runs again after a failure writes into the same
    folder batch=<number> and reads only the batches before it, so it does not count its own rows as known.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(path).where(F.col("batch") < number)
        except Exception as e:  # noqa: BLE001 - Spark has no narrower class for a table that is not there yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = batch.limit(0)
        insert_if_new(batch, known, key, *order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_within(source: DataFrame, time: str, delay: str, *keys: str) -> DataFrame:
    """The first row of each key within the watermark; state is dropped as the watermark passes."""
    return source.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def tumbling(events: DataFrame, time: str, width: str, *keys: str, delay: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums of value by window and keys; the same for a stream, where delay is needed."""
    df = events.withWatermark(time, delay) if delay else events
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, *keys: str, delay: str | None = None) -> DataFrame:
    """Sessions by keys: a gap as long as `gap` ends one."""
    df = events.withWatermark(time, delay) if delay else events
    return df.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
