"""Classification by ordered phrase tables, with tags for institution, sector and place.

Tables are parameters: a list of (type, phrases) in the order in which types
are tried, and gates that a type must pass besides a phrase; a type whose gate
fails leaves the row to the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.functions import fixed
from skeinflow.functions.text import places

Phrases = Sequence[tuple[str, Sequence[str]]]

# Patterns of the gates.
TREATY = r"icsid|investment treaty|bilateral investment|\bbit\b|investor-state|energy charter|expropriat|nationalis|nationaliz|uncitral"
PEOPLE = (
    r"partner|counsel\b|arbitrat|disputes|law firm|chambers|barrister|boutique|associate|\bkc\b|\bqc\b|practice|lawyer|attorney|solicitor|advocate|"
    r"tribunal|\bicc\b|lcia|icsid|siac|hkiac|\bscc\b|institution|secretary|litigat"
)
AWARD = r"arbitra|tribunal|icsid|\bicc\b|lcia|siac|hkiac|uncitral|\bpca\b|annul|enforce"
BUSINESS = (
    r"compan|investor|group|corp|plc|inc\b|ltd|\bag\b|\bsa\b|subsidiar|operator|miner|developer|contractor|bank|firm|venture|plant|project|"
    r"concession|licen[cs]e|mine\b|field|refiner|pipeline|terminal"
)
NOTICE = r"arbitra|treaty|icsid|dispute|claim|investor|\bbit\b|uncitral|cooling"


def padded(title: Column | str, summary: Column | str) -> Column:
    """Title and summary in lower case with a space around each: phrases may begin or end with one."""
    c = lambda x: F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))
    return F.concat(F.lit(" "), F.lower(F.concat_ws(" ", c(title), c(summary))), F.lit(" "))


def hit(text: Column, phrases: Sequence[str]) -> Column:
    """The first phrase, in the list's order, that the text holds; else null."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(p)), p) for p in phrases])


def holds(text: Column, phrases: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases], F.lit(False))


def gates(text: Column, place_text: Column, forms: dict[str, str]) -> dict[str, Column]:
    """Conditions by type. place_text: the text whose places count for a measure; its case is kept, as places
    are told by their capitals. (Given the lower-cased text, no measure ever passes: compat behaviour.)"""
    people = text.rlike(PEOPLE)
    out = {t: people for t in fixed.PEOPLE_EVENTS}
    out["commercial_dispute"] = ~text.rlike(TREATY)
    out["award_issued"] = text.rlike(AWARD)
    out["state_measure"] = (F.size(places(place_text, forms)) > 0) & text.rlike(BUSINESS)
    out["notice_of_intent"] = text.rlike(NOTICE)
    return out


def event_type(text: Column, table: Phrases, gate: dict[str, Column] | None = None, default: str = "commentary") -> tuple[Column, Column]:
    """(type, matched phrase) of the first type in order with a phrase in the text and its gate passed."""
    kind, phrase = F.lit(default), F.lit(None).cast("string")
    for name, phrases in reversed(table):
        ok = holds(text, phrases)
        if gate and name in gate:
            ok = ok & gate[name]
        kind, phrase = F.when(ok, name).otherwise(kind), F.when(ok, hit(text, phrases)).otherwise(phrase)
    return kind, phrase


def tags(text: Column, table: Phrases, most: int = 3) -> Column:
    """Names, in the table's order, of which a phrase stands in the text; at most `most`."""
    names = F.array(*[F.when(holds(text, phrases), name) for name, phrases in table])
    return F.slice(F.filter(names, lambda n: n.isNotNull()), 1, most)


def rule_classify(
    items: DataFrame, events: Phrases, institutions: Phrases, sectors: Phrases, forms: dict[str, str], compat: bool = False
) -> DataFrame:
    """Fills event_type, flag_reason, states, institution and sectors where they are not set."""
    text = padded("title", "summary")
    raw = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    kind, phrase = event_type(text, events, gates(text, F.lower(raw) if compat else raw, forms))
    unset = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    found = F.when(phrase.isNotNull(), F.concat(F.lit("matched ‘"), F.trim(phrase), F.lit("’ in the text")))
    return items.withColumns(
        {
            "flag_reason": F.when(unset("event_type"), F.coalesce(found, "flag_reason")).otherwise(F.col("flag_reason")),
            "event_type": F.when(unset("event_type"), kind).otherwise(F.col("event_type")),
            "states": F.when(none("states"), F.slice(places(raw, forms), 1, 3)).otherwise(F.col("states")),
            "institution": F.when(unset("institution"), F.get(tags(text, institutions, 1), F.lit(0))).otherwise(F.col("institution")),
            "sectors": F.when(none("sectors"), tags(text, sectors)).otherwise(F.col("sectors")),
        }
    )


def reclassify(
    items: DataFrame, as_of: Column, classify: Callable[[DataFrame], DataFrame], days: int = 21,
    keep: Sequence[str] = ("commercial-arbitration sweep", "State-measure sweep", "US federal docket", "SEC", "ICSID"),
) -> DataFrame:
    """Rows of the window that no model has read, with the type that the rules give now and whether it changed.
    A source's own type (flag_reason begins with one of keep) gives way only to a people type."""
    day = F.coalesce(F.col("published_at").cast("date"), F.col("fetched_at").cast("date"))
    rows = items.where((F.coalesce("llm_stage", F.lit("none")) == "none") & (day >= F.date_sub(as_of, days)))
    rows = rows.where(~F.col("source").startswith("Court:") & (F.col("source") != "ICSID docket"))
    old = rows.withColumns({"old_type": F.col("event_type"), "old_reason": F.col("flag_reason"), "event_type": F.lit(None).cast("string")})
    new = classify(old)
    own = reduce(lambda a, b: a | b, [F.coalesce("old_reason", F.lit("")).startswith(k) for k in keep])
    stays = own & ~F.col("event_type").isin("lateral_move", "appointment")
    return new.withColumn("event_type", F.when(stays, F.col("old_type")).otherwise(F.col("event_type"))).withColumn(
        "changed", ~F.col("event_type").eqNullSafe(F.col("old_type"))
    )


def muted(title: Column | str, summary: Column | str, terms: Sequence[str]) -> Column:
    """Whether a muted term stands in title and summary put together without a space."""
    c = lambda x: F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))
    return holds(F.lower(F.concat(c(title), c(summary))), [t.lower() for t in terms])


# What stories, leads and lists are tested for.
NOT_NEWS = (
    r"(?i)\b(report|survey|study|guide|webinar|conference|podcast|roundtable|symposium|summit|masterclass|awards? \d{4}|"
    r"awards (night|ceremony|shortlist)|shortlist|nominations?|rankings?|directory|publishes|launches its|annual review|year in review|in numbers|"
    r"statistics|celebrates|anniversary)\b"
)


def review_list(items: DataFrame, since: Column, like: str | None = None, event: str | None = None, source: str | None = None, most: int = 400) -> DataFrame:
    """Rows for review: newest window, optional text (in any case), type and source; pinned first, then by score."""
    df = items.where(F.coalesce(F.col("published_at").cast("date"), F.col("fetched_at").cast("date")) >= since)
    if like:
        df = df.where(F.contains(F.lower(F.concat_ws(" ", "title", "summary")), F.lit(like.lower())))
    if event:
        df = df.where(F.col("event_type") == event)
    if source:
        df = df.where(F.col("source") == source)
    return df.orderBy(F.desc(F.coalesce("pinned", F.lit(False))), F.desc_nulls_last("score"), "id").limit(most)
