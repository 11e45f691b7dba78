"""Selection of a day's items: what was shown before goes, groups have quotas, the best of the rest stay.

Days are parameters. Lists of earlier days come as a table with one row for
each record that a day carried (day, url, title), copies included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions.text import fingerprint, title_key
from skeinflow.operators.identity import first_of


def shown_keys(days: DataFrame, day: Column, band: int = 30) -> DataFrame:
    """(key): urls, title keys and fingerprints that other days of the band carried, earlier and later ones."""
    near = days.where((F.abs(F.datediff("day", day)) <= band) & (F.col("day") != day))
    return near.select(F.explode(F.array(F.col("url"), title_key("title"), fingerprint("url", "title"))).alias("key")).where("key IS NOT NULL").distinct()


def not_shown(items: DataFrame, shown: DataFrame) -> DataFrame:
    """items of which neither url nor title key nor fingerprint is among the keys. One exchange of items for
    each key would move them three times; the keys of an item are few, so they are matched once and items joined back by id."""
    keys = items.select("id", F.explode(F.array(F.col("url"), title_key("title"), fingerprint("url", "title"))).alias("key"))
    hit = keys.join(shown, "key", "left_semi").select("id").distinct()
    return items.join(hit, "id", "left_anti")


def taken_keys(taken: DataFrame) -> DataFrame:
    """The same keys of today's picks and of their copies (also: array of url, title)."""
    own = taken.select("url", "title")
    copies = taken.select(F.explode("also").alias("c")).select("c.url", "c.title")
    return own.union(copies).select(F.explode(F.array(F.col("url"), title_key("title"), fingerprint("url", "title"))).alias("key")).distinct()


def pool(items: DataFrame, as_of: Column, days: int, floor: float, most: int, but: Sequence[str] = ()) -> DataFrame:
    """Candidates: relevant, not assigned, not excluded; pinned, or scored `floor` or more with a date in the
    window of whole days up to as_of. Pinned first, then by score; at most `most`."""
    flag = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    day = F.coalesce(F.col("published_at").cast("date"), F.col("fetched_at").cast("date"))
    inside = (F.col("score") >= floor) & (day >= F.date_sub(as_of, days)) & (day <= as_of)
    rows = items.where(flag("relevant", True) & F.col("issue_id").isNull() & ~flag("excluded", False) & ~F.coalesce("source", F.lit("")).startswith("Court:"))
    if but:
        rows = rows.where(~F.coalesce("event_type", F.lit("")).isin(*but))
    return rows.where(flag("pinned", False) | F.coalesce(inside, F.lit(False))).orderBy(F.desc(flag("pinned", False)), F.desc_nulls_last("score"), "id").limit(most)


def quota(rows: DataFrame, group: Column, *order: Column, each: int = 2, most: int = 8) -> DataFrame:
    """At most `each` rows of a group and `most` in all: every group's first row comes before any second one."""
    w = Window.partitionBy("_g").orderBy(*order)
    ranked = rows.withColumn("_g", group).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= each)
    return ranked.orderBy("_rn", *order).limit(most).drop("_g", "_rn")


def top_each(rows: DataFrame, group: str, *order: Column, most: int = 6) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def unique_list(rows: DataFrame, key: Column, *order: Column | str, most: int) -> DataFrame:
    """The first row of each key, in an ascending order that ends in a unique column; at most `most` rows."""
    return first_of(rows.withColumn("_key", key), "_key", *order).drop("_key").orderBy(*order).limit(most)


def new_topics(rows: DataFrame, topics: str, seen: DataFrame, *order: Column | str) -> DataFrame:
    """Rows none of whose topics was seen, in `seen` (topic) or on a row before them that stays.

    The second part is a fold: a row that goes does not block later ones. It runs over the rows that
    survive the join with seen, ordered in one group; their number is that of a day's candidates.
    """
    blocked = rows.select("id", F.explode(topics).alias("topic")).join(seen, "topic", "left_semi").select("id").distinct()
    left = rows.join(blocked, "id", "left_anti")
    ordered = left.agg(F.array_sort(F.collect_list(F.struct(*order, F.col("id").alias("_id"), F.col(topics).alias("_t")))).alias("all"))
    fold = F.aggregate(
        "all", F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<bigint>").alias("keep")),
        lambda a, x: F.when(F.arrays_overlap(a["seen"], x["_t"]), a).otherwise(
            F.struct(F.array_union(a["seen"], x["_t"]).alias("seen"), F.concat(a["keep"], F.array(x["_id"].cast("bigint"))).alias("keep"))
        ),
    )
    return left.join(ordered.select(F.explode(fold["keep"]).alias("id")), "id", "left_semi")


def cap_stories(stories: DataFrame, trade: Column, most: int) -> DataFrame:
    """All trade rows, and of the others the best for the room that is left; by score."""
    w = Window.partitionBy("_t").orderBy(F.desc_nulls_last("score"), "id")
    n = stories.agg(F.count_if(trade).alias("n")).first()["n"]
    ranked = stories.withColumn("_t", trade).withColumn("_rn", F.row_number().over(w))
    return ranked.where(F.col("_t") | (F.col("_rn") <= max(0, most - n))).drop("_t", "_rn")


def tiers(stories: DataFrame, day: str, *order: Column, brief: Column | None = None) -> DataFrame:
    """lead, development or brief by place within the day: first, second to seventh, and the rest; brief rows are last."""
    brief = F.lit(False) if brief is None else brief
    w = Window.partitionBy(day).orderBy(F.col("_brief"), *order)
    ranked = stories.withColumn("_brief", brief).withColumn("place", F.row_number().over(w) - 1)
    tier = F.when(F.col("_brief"), "brief").when(F.col("place") == 0, "lead").when(F.col("place") <= 6, "development").otherwise("brief")
    return ranked.withColumn("tier", tier).drop("_brief")


def batches(rows: DataFrame, group: str, *order: Column | str, size: int = 8) -> DataFrame:
    """Number of the batch of `size` rows that a row falls into within its group."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def carried(rows: DataFrame, group: str, value: Column, *order: Column | str, name: str = "section") -> DataFrame:
    """The last value that is not null up to each row."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def issue_number(issues: DataFrame) -> DataFrame:
    return issues.agg((F.coalesce(F.max("number"), F.lit(0)) + 1).alias("number"))


def mark_issue(items: DataFrame, picks: DataFrame, issue: int) -> DataFrame:
    """items with issue_id set where their id or url is among the picks or their copies (also)."""
    urls = picks.select("url").union(picks.select(F.explode("also.url").alias("url"))).where("url IS NOT NULL").distinct().withColumn("_u", F.lit(True))
    ids = picks.select("id").distinct().withColumn("_i", F.lit(True))
    out = items.join(urls, "url", "left").join(ids, "id", "left")
    return out.withColumn("issue_id", F.when(F.col("_u") | F.col("_i"), F.lit(issue)).otherwise(F.col("issue_id"))).drop("_u", "_i")


def release_days(items: DataFrame, issues: DataFrame, first: Column, last: Column) -> tuple[DataFrame, DataFrame]:
    """items without the issues of a range of days, and the issues that remain. Sent issues are not released."""
    gone = issues.where((F.col("day") >= first) & (F.col("day") <= last) & ~F.coalesce("sent", F.lit(False))).select(F.col("issue_id").alias("_gone"))
    freed = items.join(gone, F.col("issue_id") == F.col("_gone"), "left")
    freed = freed.withColumn("issue_id", F.when(F.col("_gone").isNull(), F.col("issue_id"))).drop("_gone")
    return freed, issues.join(gone, F.col("issue_id") == F.col("_gone"), "left_anti")


def pin(items: DataFrame, ids: Sequence[int], what: str) -> DataFrame:
    """Toggles pinned or excluded of rows; setting one clears the other."""
    other = {"pinned": "excluded", "excluded": "pinned"}[what]
    chosen = F.col("id").isin(list(ids))
    now = ~F.coalesce(F.col(what), F.lit(False))
    return items.withColumns(
        {what: F.when(chosen, now).otherwise(F.col(what)), other: F.when(chosen & now, F.lit(False)).otherwise(F.col(other))}
    )


def pending(items: DataFrame, stage: str, most: int = 500) -> DataFrame:
    """The newest relevant items that wait at a stage of model reading: by date of publication, else of fetching; ties by id."""
    waiting = items.where((F.col("llm_stage") == stage) & F.coalesce("relevant", F.lit(False)))
    return waiting.orderBy(F.desc_nulls_last(F.coalesce(F.col("published_at").cast("string"), F.col("fetched_at").cast("string"))), "id").limit(most)
