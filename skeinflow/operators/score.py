"""The score of an item, with the record that explains it; a pure column expression for a given day.

Power and logarithm are the C library's: Spark's own differ from it in the last bit for some arguments, which
orders rows anew that score the same by other engines.
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from skeinflow.functions import fixed
from skeinflow.operators.classify import muted


@F.arrow_udf(DoubleType())
def halved(times: pa.Array) -> pa.Array:
    """0.5 to a power that is not negative."""
    return pa.array([None if t is None else math.pow(0.5, t) for t in times.to_pylist()], pa.float64())


@F.arrow_udf(DoubleType())
def log10(values: pa.Array) -> pa.Array:
    """Null for what has no logarithm."""
    return pa.array([math.log10(v) if v is not None and v > 0 else None for v in values.to_pylist()], pa.float64())


def age_days(published: Column, fetched: Column, as_of: Column) -> Column:
    """Whole days up to as_of, never negative; without a date three days."""
    day = F.coalesce(published.cast("date"), fetched.cast("date"))
    return F.coalesce(F.greatest(F.lit(0.0), F.datediff(as_of, day).cast("double")), F.lit(fixed.UNDATED_AGE))


def lookup(key: Column, table: dict, default) -> Column:
    return reduce(lambda rest, kv: F.when(key == kv[0], kv[1]).otherwise(rest), sorted(table.items(), reverse=True), F.lit(default))


def watchlist(haystack: Column, terms: dict[str, float]) -> tuple[Column, Column]:
    """(sum of weights, terms) of the watched terms that the lower-cased text holds."""
    if not terms:
        return F.lit(0.0), F.array().cast("array<string>")
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(float(w)).alias("w")) for t, w in terms.items()])
    hits = F.filter(table, lambda x: F.contains(haystack, F.lower(x["t"])))
    return F.aggregate(hits, F.lit(0.0), lambda a, x: a + x["w"]), F.transform(hits, lambda x: x["t"])


def score(
    items: DataFrame, as_of: Column, weights: dict[str, float], terms: dict[str, float] | None = None, mute: tuple[str, ...] = (),
    trade: Column | None = None,
) -> DataFrame:
    """items with score (not rounded) and score_detail.

    Columns read: event_type, published_at, fetched_at, source, source_tier, title, summary, states, claimants,
    respondents, sectors, treaty, counsel, amount_usd, lang, llm_stage. weights must have commentary. trade says
    whether a row is trade press.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    joined = lambda c: F.coalesce(F.array_join(c, " "), F.lit(""))
    trade = F.lit(False) if trade is None else trade
    event = F.when(text("event_type") == "", "commentary").otherwise(F.col("event_type"))
    base = lookup(event, weights, float(weights["commentary"]))
    base = F.when(trade & (event == "commentary"), F.greatest(base, F.lit(fixed.TRADE_BASE))).otherwise(base)
    age = age_days(F.col("published_at"), F.col("fetched_at"), as_of)
    recency = halved(age / fixed.HALF_LIFE)
    level = F.coalesce(F.when(F.col("source_tier") != 0, F.col("source_tier")), F.lit(2))
    tier = lookup(level, fixed.TIER_FACTOR, 1.0)
    tier = F.when(trade, F.greatest(tier, F.lit(fixed.TIER_FACTOR[1]))).otherwise(tier)
    parts = [text("title"), text("summary"), joined("states"), joined("claimants"), joined("respondents"), joined("sectors"), text("treaty"), joined("counsel")]
    haystack = F.lower(F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " "))
    boost, hits = watchlist(haystack, terms or {})
    named = (F.coalesce(F.size("claimants"), F.lit(0)) > 0) & F.col("event_type").isin(*fixed.MEASURE_EVENTS)
    boost = boost + F.when(named, fixed.CLAIMANT_BOOST).otherwise(0.0)
    hits = F.when(named, F.concat(hits, F.array(F.concat(F.lit("investor: "), F.get("claimants", F.lit(0)))))).otherwise(hits)
    amount = F.coalesce("amount_usd", F.lit(0.0))
    amount = F.when(amount > 1e6, F.least(F.lit(fixed.AMOUNT_CAP), 4.0 * log10(amount / 1e6))).otherwise(0.0)
    vacant = (F.coalesce(F.size("counsel"), F.lit(0)) <= 0) & (level == 1) & ~text("source").startswith("Court:") & event.isin(*fixed.VACANCY_EVENTS)
    vacancy = F.when(vacant, fixed.VACANCY).otherwise(0.0)
    foreign = (F.when(text("lang") == "", "en").otherwise(F.col("lang")) != "en") & F.coalesce("llm_stage", F.lit("none")).isin("none", "skipped")
    mutes = F.filter(F.array(*[F.when(muted("title", "summary", (m,)), m) for m in mute]).cast("array<string>"), lambda m: m.isNotNull())
    detail = F.struct(
        base.alias("base"), event.alias("event"), age.alias("age_days"), recency.alias("recency"), tier.alias("tier"), boost.alias("watchlist_boost"),
        hits.alias("watchlist_hits"), amount.alias("amount_bonus"), vacancy.alias("unrepresented_bonus"), foreign.alias("unverified_foreign"), mutes.alias("muted"),
    )
    d = lambda name: F.col(f"score_detail.{name}")
    total = d("base") * d("recency") * d("tier") * (1.0 + d("watchlist_boost")) + d("amount_bonus") + d("unrepresented_bonus")
    total = total * F.when(d("unverified_foreign"), fixed.FOREIGN).otherwise(1.0) * F.when(F.size(d("muted")) > 0, fixed.MUTED).otherwise(1.0)
    return items.withColumn("score_detail", detail).withColumn("score", total)


def top(items: DataFrame, k: int) -> DataFrame:
    return items.orderBy(F.desc_nulls_last("score"), "id").limit(k)
