"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "appointee_table"


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) under a name, with its SQL where there is one."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


@query("source_counts", "SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("source", "lang").agg(F.count("*").alias("n"))
