"""Tables in the folder that all executors share, and connected components over them."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='skeinflow-')}"


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_folder()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is missing on a single machine (a local master, as
    in tests) a temporary folder of this process takes its place; on a cluster
    that is an error.
    """
    return f"{_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, with no lineage."""
    return written_at(df, shared_path(df.sparkSession, name))


def written_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS_OF_TASK = 250_000
ROWS_OF_FILE = 25_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df, of `rows` short rows or so, in as many partitions as these fill. A small table is then not written as a file for each
    shuffle partition, and its files grow in number, not in size, with the table; nothing is shuffled for it, and where there are
    no more partitions than that df is as it is."""
    return df.coalesce(max(1, -(-rows // ROWS_OF_FILE)))


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt out by keys over as many partitions as `rows` need, so that what a task holds doesn't grow with the table;
    where the session's number of shuffle partitions is enough, df as it is."""
    parts = -(-rows // ROWS_OF_TASK)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def delete(spark: SparkSession, *paths: str) -> None:
    """Removes tables that no DataFrame reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def components(edges: DataFrame, rounds: int = 60, rows: int | None = None) -> DataFrame:
    """(node, component) of the undirected edges (u, v): component is the smallest node reachable.

    Alternates large-star and small-star steps; each round is written to the
    shared folder, in files by its number of rows. Nodes without an edge are not
    in the result. rows: about how many different edges there are at most, if known.
    """
    spark = edges.sparkSession
    at = shared_path(spark, "links")
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = written_at(e if rows is None else gathered(e, rows), at)
    seen = None
    for _ in range(rounds):
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        if not seen[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A node with one smaller neighbour keeps its edge; its other smaller neighbours move to the smallest.
        large_at, small_at = shared_path(spark, "large"), shared_path(spark, "small")
        # Neither step makes more edges than there were.
        large = written_at(gathered(large.distinct(), seen[0]), large_at)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written_at(gathered(small.union(least.select("u", F.col("m").alias("v"))).distinct(), seen[0]), small_at)
        delete(spark, at, large_at)
        at = small_at
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(
        e.select("v", F.col("v").alias("component")).distinct()
    )
