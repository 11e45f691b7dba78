"""Identity of records: who came first, and what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions.text import fingerprint, is_paywall


def first_of(df: DataFrame, key: str | list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in an ascending order that ends in a unique column; null is a key of its own.

    The least order value of each key combines before the shuffle, so a hot key
    costs one row a task and not a sort of all its rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    least = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    at = F.struct(*order)
    joined = df.withColumn("_at", at)
    cond = [F.col("a." + k).eqNullSafe(F.col("b." + k)) for k in keys] + [F.col("a._at") == F.col("b._first")]
    return joined.alias("a").join(least.alias("b"), cond, "left_semi").drop("_at")


def insert_if_new(batch: DataFrame, known: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """Rows of the batch whose key is not in known, the first of each key: later copies never update."""
    return first_of(batch, key, *order).join(known.select(key), key, "left_anti")


def update_by_key(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """df with the non-null values of changes (at most one row a key) in place of its own."""
    columns = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = df.join(new, key, "left")
    for c in columns:
        old = F.col(c) if c in df.columns else F.lit(None)
        out = out.withColumn(c, F.coalesce(F.col(f"_new_{c}"), old))
    return out.drop(*[f"_new_{c}" for c in columns])


LISTS = ("sectors", "claimants", "respondents", "states", "counsel", "arbitrators")
TEXTS = ("event_type", "institution", "treaty", "case_ref", "flag_reason", "country")


def items_from_raw(raw: DataFrame, name: str, tier: int = 2, fetched_at: Column | None = None) -> DataFrame:
    """A source's raw rows as items: rows without title or url go, texts are cut, empty strings become null,
    missing lists are empty. Columns that raw lacks are null."""
    has = lambda c, kind: F.col(c).cast(kind) if c in raw.columns else F.lit(None).cast(kind)
    blank = lambda c: F.when(c != "", c)
    summary = F.coalesce(has("summary", "string"), F.lit(""))
    rows = raw.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))
    return rows.select(
        fingerprint("url", "title").alias("fingerprint"), "url", F.coalesce(blank(has("source", "string")), F.lit(name)).alias("source"),
        F.lit(tier).alias("source_tier"), F.substring("title", 1, 500).alias("title"),
        F.when(is_paywall(summary), "").otherwise(F.substring(summary, 1, 4000)).alias("summary"), blank(F.substring(has("body", "string"), 1, 20000)).alias("body"),
        F.try_to_date(has("published_at", "string")).alias("published_at"), (fetched_at if fetched_at is not None else F.current_timestamp()).alias("fetched_at"),
        *[blank(has(c, "string")).alias(c) for c in TEXTS], *[F.coalesce(has(c, "array<string>"), F.array().cast("array<string>")).alias(c) for c in LISTS],
        has("amount_usd", "double").alias("amount_usd"), F.coalesce(blank(has("lang", "string")), F.lit("en")).alias("lang"),
    )


def effective_date(published: Column | str, fetched: Column | str) -> Column:
    """The published date, or where there is none the day of fetching."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.coalesce(c(published).cast("date"), c(fetched).cast("date"))


def same_outlet(a: Column, b: Column) -> Column:
    """Equal letters-only names, or one within the other where that has five letters or more."""
    clean = lambda x: F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z]", "")
    x, y = clean(a), clean(b)
    within = (F.length(x) >= 5) & F.contains(y, x) | (F.length(y) >= 5) & F.contains(x, y)
    return (x != "") & (y != "") & ((x == y) | within)


def numbered(df: DataFrame, partition: str | list[str], *order: Column | str, name: str = "rn") -> DataFrame:
    keys = [partition] if isinstance(partition, str) else list(partition)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
