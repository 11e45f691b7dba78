"""A day's issue from the table of items: stories, leads, enforcement and lists from primary records.

The pools are those of one day; selection bounds them before stories are told
apart. Nothing here writes: write_day() and the tables that rebuild() returns
are the only results, so a dry run is the same plan without them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions import editing, fixed
from skeinflow.functions.text import outlet_rank, places, topics, upper_share
from skeinflow.operators import classify, cluster
from skeinflow.operators import select as sel
from skeinflow.operators.graph import written

RECORDS = ("ICSID docket", "Court:", "US federal docket", "PCA", "SEC EDGAR")


@dataclass(frozen=True)
class Settings:
    """What a day is built with. Patterns are Java's, tested in any case; trade: sources read in full."""

    today_days: int = 2
    lookback_days: int = 7
    max_items: int = 12
    min_score: float = 20.0
    story_floor: float = 65.0
    leads: tuple[int, float] = (5, 45.0)
    enforcement: tuple[int, float] = (6, 40.0)
    track_pool: int = 120
    shown_band: int = 30
    anchor_days: int = 21
    record_days: int = 14
    mute: tuple[str, ...] = ()
    trade: str = "(?!)"
    on_topic: str = "arbitra|award|tribunal|treaty|expropriat|nationali[sz]|seiz|revok|licen[cs]e|concession|enforce|annul|windfall[- ]tax"
    dispute: str = r"arbitra|award|tribunal|\bclaims?\b|\bdispute|lawsuit|litigation|\bsue[sd]?\b|damages|breach of contract"
    arbitral: str = r"arbitra|\baward\b|exequatur|new york convention|seat of"
    business: str = fixed.BUSINESS
    tiers: dict[int, tuple[str, ...]] = field(default_factory=dict)
    lexicon: cluster.Lexicon = cluster.Lexicon()
    capitals: dict[str, str] = field(default_factory=dict)
    common: tuple[str, ...] = ()


def _like(c: Column, pattern: str) -> Column:
    return F.coalesce(c, F.lit("")).rlike(f"(?iu){pattern}")


def _head() -> Column:
    return F.coalesce(F.when(F.col("title_en") != "", F.col("title_en")), F.col("title"), F.lit(""))


def _body() -> Column:
    return F.concat_ws(" ", _head(), F.coalesce(F.when(F.col("summary_en") != "", F.col("summary_en")), F.col("summary")))


def _topics(s: Settings) -> Column:
    text = F.concat_ws(" ", _head(), F.substring(F.coalesce(F.when(F.col("summary_en") != "", F.col("summary_en")), F.col("summary"), F.lit("")), 1, 400))
    return topics(text, s.lexicon.forms, s.capitals)


def _pinned() -> Column:
    return F.coalesce("pinned", F.lit(False))


def anchors(items: DataFrame, issues: DataFrame, day: Column, days: int) -> DataFrame:
    """Items that an issue of an earlier day carries, published in the last days. issues: issue_id, day."""
    earlier = issues.where(F.col("day") < day).select("issue_id")
    return items.join(F.broadcast(earlier), "issue_id").where(F.col("published_at") >= F.date_sub(day, days))  # a row for each day


def _stories(pool: DataFrame, known: DataFrame, taken: DataFrame | None, s: Settings) -> DataFrame:
    """One row per story of the pool that neither an earlier day's item nor a pick of today is part of."""
    known_ids = known.select("id", "url")
    if taken is not None:
        known_ids = known_ids.union(taken.select("id", "url")).union(taken.select(F.lit(None).cast("bigint"), F.explode("also.url")))
    first = known if taken is None else known.unionByName(taken.select(*[c for c in taken.columns if c in known.columns]), allowMissingColumns=True)
    both = first.withColumn("_old", F.lit(0)).unionByName(pool.withColumn("_old", F.lit(1)), allowMissingColumns=True).dropDuplicates(["id"])
    both = written(both, "story-pool")
    # Earlier items first, then by score: a unique number, as ids are.
    place = F.struct("_old", -F.coalesce("score", F.lit(0.0)), "id")
    from pyspark.sql import Window

    numbered = both.withColumn("_place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(place)))
    told = cluster.fold(numbered, s.lexicon, F.col("_place"))
    urls = known_ids.select("url").where("url IS NOT NULL")
    new = cluster.not_anchored(written(told, "stories"), both, known_ids.where("id IS NOT NULL"), urls)
    reps = cluster.merged(both.drop("_old"), new)
    return cluster.cite_best(reps, lambda a, b: outlet_rank(a, b, s.tiers)) if s.tiers else reps


def stories(items: DataFrame, issues: DataFrame, shown: DataFrame, day: Column, s: Settings, extra_days: int = 0) -> DataFrame:
    """The day's stories, best first. shown: what days carried (day, url, title)."""
    pool = sel.pool(items, day, s.today_days + extra_days, s.min_score, s.max_items * 12, but=("lateral_move", "appointment"))
    pool = sel.not_shown(pool, sel.shown_keys(shown, day, s.shown_band))
    old = anchors(items, issues, day, s.anchor_days)
    reps = written(_stories(pool, old, None, s).withColumn("_topics", _topics(s)), "reps")
    seen = old.select(F.explode(_topics(s)).alias("topic")).distinct()
    repeat = reps.where(F.col("event_type").isin(*fixed.MEASURE_EVENTS) & ~_pinned()).select("id", F.explode("_topics").alias("topic")).join(seen, "topic", "left_semi")
    trade = _like(F.concat_ws(" ", "source", "url"), s.trade)
    record = reduce(lambda a, b: a | b, [F.col("source").startswith(r) for r in RECORDS])
    gates = (
        (F.coalesce("score", F.lit(0.0)) >= s.story_floor) & (~_head().rlike(classify.NOT_NEWS) | record)
        & ((F.col("event_type") != "commercial_dispute") | trade | _like(_body(), s.dispute))
        & (~F.col("event_type").isin(*fixed.MEASURE_EVENTS) | trade | (F.coalesce(F.size("claimants"), F.lit(0)) > 0) | F.col("amount_usd").isNotNull() | _body().rlike(s.business))
        & ((F.coalesce("source_tier", F.lit(2)) == 1) | trade | _like(_body(), s.on_topic))
    )
    scored = reps.join(repeat.select("id").distinct(), "id", "left_anti").where(_pinned() | gates)
    in_full = reps.where(trade & (F.col("published_at") >= F.date_sub(day, 1)) & ~_head().rlike(classify.NOT_NEWS))
    chosen = written(scored.unionByName(in_full.join(scored.select("id"), "id", "left_anti")), "chosen")
    n = chosen.limit(3).count()
    if n < 3:  # a quiet day: headlines on the topic a little below the floor
        more = reps.where((F.coalesce("score", F.lit(0.0)) >= s.story_floor - 12) & _like(_head(), s.on_topic)).join(chosen.select("id"), "id", "left_anti")
        chosen = chosen.unionByName(more.orderBy(F.desc_nulls_last("score"), "id").limit(6 - n))
    kept = sel.cap_stories(chosen, F.coalesce(trade & (F.col("published_at") >= F.date_sub(day, 1)), F.lit(False)), s.max_items)
    return kept.drop("_topics").orderBy(F.desc_nulls_last("score"), "id")


def foreign_docket(places: Column) -> Column:
    """Whether a federal docket's row has a foreign or sovereign side: by its list, its caption, its words, or a State in
    its title (places: those named in it)."""
    title, source = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("source", F.lit("")))
    listed = F.contains(source, F.lit("sovereign")) | F.contains(source, F.lit("execution")) | title.startswith("in re")
    return listed | F.concat_ws(" ", title, F.lower("summary")).rlike(fixed.FOREIGN_WORDS) | (F.size(places) > 0)


def track(
    items: DataFrame, issues: DataFrame, shown: DataFrame, taken: DataFrame, day: Column, s: Settings, events: tuple[str, ...], most: int, floor: float,
    trade_ok: bool, records_ok: bool, business_gate: bool, arbitral_gate: bool,
) -> DataFrame:
    """The best items of some types that are neither a story today nor were shown, one for each topic."""
    trade = _like(F.concat_ws(" ", "source", "url"), s.trade)
    rows = items.where(F.col("event_type").isin(*events))
    if not records_ok:
        rows = rows.where(~reduce(lambda a, b: a | b, [F.col("source").startswith(r) for r in ("ICSID docket", "SEC EDGAR", "PCA case list")]))
    if not trade_ok:
        rows = rows.where(~trade)
    # Of the federal dockets only those with a foreign side are the readers' matter.
    rows = rows.where(~F.col("source").startswith("US federal docket") | foreign_docket(places("title", s.lexicon.forms)))
    own = reduce(lambda a, b: a | b, [F.col("source").startswith(r) for r in ("Court:", "US federal docket")])
    measure = F.col("event_type").isin(*fixed.MEASURE_EVENTS)
    named = (F.coalesce(F.size("claimants"), F.lit(0)) > 0) | F.col("amount_usd").isNotNull() | _body().rlike(s.business)
    gates = (_like(_body(), s.on_topic) | own) & ~_head().rlike(classify.NOT_NEWS)
    if business_gate:
        gates = gates & (~measure | named) & ((F.col("event_type") != "commercial_dispute") | _like(_body(), s.dispute))
    if arbitral_gate:
        gates = gates & (reduce(lambda a, b: a | b, [F.col("source").startswith(r) for r in RECORDS[:4]]) | _like(_body(), s.arbitral))
    effective = F.coalesce(F.col("published_at"), F.col("fetched_at").cast("date"))
    rows = rows.where((F.coalesce("relevant", F.lit(True))) & F.col("issue_id").isNull() & ~F.coalesce("excluded", F.lit(False)) & (F.col("score") >= floor))
    rows = rows.where((effective >= F.date_sub(day, s.lookback_days)) & (effective <= day)).orderBy(F.desc("score"), "id").limit(s.track_pool)
    rows = sel.not_shown(rows, sel.shown_keys(shown, day, s.shown_band))
    rows = sel.not_shown(rows, sel.taken_keys(taken)).where(gates)
    old = anchors(items, issues, day, s.anchor_days)
    reps = _stories(rows, old, taken, s).withColumn("_topics", _topics(s))
    seen = old.select(F.explode(_topics(s)).alias("topic")).union(taken.select(F.explode(_topics(s)).alias("topic"))).distinct()
    fresh = sel.new_topics(written(reps, "track").withColumn("_back", -F.col("score")), "_topics", seen, "_back", "id")
    return fresh.orderBy(F.desc("score"), "id").limit(most).drop("_topics", "_back")


def record_lists(items: DataFrame, shown: DataFrame, featured: DataFrame, day: Column, s: Settings) -> DataFrame:
    """Lists from primary records, each newest first, with list and its columns: docket 8, disclosures 6 (one a
    filer), courts 8 (at most two a country), moves 6 and seats 6."""
    rows = items.where(F.coalesce("relevant", F.lit(True)) & (F.col("published_at") >= F.date_sub(day, s.record_days)) & (F.col("published_at") <= day))
    rows = rows.where(~classify.muted("title", F.concat(F.lit(" "), F.coalesce("summary", F.lit(""))), s.mute))
    rows = written(sel.not_shown(sel.not_shown(rows, sel.shown_keys(shown, day, s.shown_band)), sel.taken_keys(featured)), "records")
    title, source = F.coalesce("title", F.lit("")), F.col("source")
    newest = (F.desc("published_at"), F.col("id"))
    annul = (F.col("event_type") == "annulment_setaside") & title.rlike("(?i)application for annulment|decision on annulment|issues its decision|committee is constituted")
    docket = rows.where((source == "ICSID docket") & (F.col("event_type").isin("new_case_filed", "award_issued") | annul | title.rlike("(?i)resignation|disqualif")))
    filers = rows.where((source == "SEC EDGAR") & ~F.col("url").rlike("(?i)ex10|ex2-|ex4|ex3")).withColumn("_day", -F.datediff("published_at", F.lit("1970-01-01").cast("date")))
    foreign = F.contains(F.lower(source), F.lit("sovereign")) | title.rlike("^(?:In re|In Re|IN RE)") | _like(F.col("summary"), "foreign")
    courts = rows.where((F.coalesce("score", F.lit(0.0)) > 0) & (source.startswith("Court:") | (source.startswith("US federal docket") & foreign))).orderBy(*newest).limit(30)
    moved = rows.where(F.col("event_type").isin("lateral_move", "appointment") & (F.coalesce("score", F.lit(0.0)) > 0) & (source != "ICSID docket"))
    seats = rows.where((F.col("event_type") == "tribunal_constituted") & (source == "ICSID docket") & title.rlike("(?i)appoint|constituted|president"))
    parts = {
        "docket": docket.orderBy(*newest).limit(8),
        "disclosures": sel.unique_list(filers, F.substring_index(title, " discloses", 1), "_day", "id", most=6).drop("_day"),
        "courts": sel.quota(courts, F.coalesce("country", F.lit("United States")), *newest),
        "moves": moved.orderBy(*newest).limit(6),
        "seats": seats.orderBy(*newest).limit(6),
    }
    return reduce(DataFrame.unionByName, [p.withColumn("list", F.lit(n)) for n, p in parts.items()])


def edited(picks: DataFrame, s: Settings) -> DataFrame:
    """Picks with title_en and story in house form."""
    lists = [F.coalesce(c, F.array().cast("array<string>")) for c in ("claimants", "respondents", "counsel")]
    record = reduce(lambda a, b: a | b, [F.col("source").startswith(r) for r in RECORDS])
    text = F.coalesce(F.when(F.col("story") != "", F.col("story")), editing.clean(F.coalesce(F.when(F.col("summary_en") != "", F.col("summary_en")), F.col("summary"))))
    return picks.withColumn("title_en", editing.headline(_head(), s.common, F.concat(*lists), record)).withColumn("story", editing.explanation(editing.whole_sentences(text)))


def _told() -> Column:
    """What explains a headline: the summary without a feed's closing words; empty if it is a wall's text or the headline again."""
    from skeinflow.functions.text import html_text

    text = html_text(F.coalesce(F.when(F.col("summary_en") != "", F.col("summary_en")), F.col("summary"), F.lit("")))
    text = F.regexp_replace(F.trim(text), r"\s*The post .{0,200}? appeared first on .{0,80}?(?:\.|$)", "")
    text = F.trim(F.regexp_replace(F.trim(text), r"\s*(?:Read more|Continue reading|The article .{0,120} first appeared on .{0,60})\.?$", ""))
    return cluster.real_summary(text, F.col("title"))


def has_text() -> Column:
    """Whether a row's own summary is prose about its headline."""
    return F.coalesce(editing.relevant_summary(_head(), _told()), F.lit(False)) & (_told() != "")


def with_text(rows: DataFrame, s: Settings) -> DataFrame:
    """rows without those that are only a headline; primary sources (tier 1) and the trade press stay without text too."""
    return rows.where((F.coalesce("source_tier", F.lit(2)) == 1) | _like(F.concat_ws(" ", "source", "url"), s.trade) | has_text())


def today(items: DataFrame, issues: DataFrame, shown: DataFrame, day: Column, s: Settings) -> DataFrame:
    """The day's stories that can be explained, with brief_only. A thin day of fewer than three reaches a day further back
    for stories that were never printed, which say so in flag_reason and come after the others, up to max_items in all.
    Stories without text, or whose text is a docket entry in capitals, are brief and stand last."""
    own = written(with_text(stories(items, issues, shown, day, s), s), "day-stories")
    if "flag_reason" not in own.columns:
        own = own.withColumn("flag_reason", F.lit(None).cast("string"))
    out = own.withColumn("_held", F.lit(False))
    n = own.limit(3).count()
    if 0 < n < 3:  # a day without any story stays without
        more = with_text(stories(items, issues, shown, day, s, extra_days=1), s).join(own.select("id"), "id", "left_anti")
        if "flag_reason" not in more.columns:
            more = more.withColumn("flag_reason", F.lit(None).cast("string"))
        reason = F.concat_ws(" | ", F.when(F.col("flag_reason") != "", F.col("flag_reason")), F.lit("held over from the previous day"))
        more = more.withColumn("flag_reason", reason).withColumn("_held", F.lit(True))
        out = out.unionByName(more.select(*out.columns)).orderBy("_held", F.desc_nulls_last("score"), "id").limit(s.max_items)
    brief = ~has_text() | F.coalesce(upper_share(F.left(_told(), F.lit(200))) > 0.35, F.lit(False))
    return out.withColumn("brief_only", brief).orderBy("brief_only", "_held", F.desc_nulls_last("score"), "id").drop("_held")


def backed(leads: DataFrame) -> DataFrame:
    """Leads that have text of their own or that another source corroborates."""
    cites = F.coalesce(F.size("corroboration"), F.lit(0)) > 0 if "corroboration" in leads.columns else F.lit(False)
    return leads.where(has_text() | cites)


def lead_story(ordered: DataFrame, place: str = "place") -> DataFrame:
    """ordered (with brief_only and the place of each row) with lead: of the first five that are told, the first that
    starts a dispute, else the first told; where none is told all count as told. One row has it, none of no rows."""
    told = ordered.where("not brief_only")
    among = told if told.limit(1).count() else ordered
    first = among.orderBy(place).limit(5)  # a day's first five
    best = first.orderBy(~F.coalesce(F.col("event_type").isin(*fixed.STARTERS), F.lit(False)), place).limit(1).select(F.col("id").alias("_lead"))
    return ordered.join(F.broadcast(best), F.col("id") == F.col("_lead"), "left").withColumn("lead", F.col("_lead").isNotNull()).drop("_lead")


def build_explained(items: DataFrame, issues: DataFrame, shown: DataFrame, day: Column, s: Settings) -> dict[str, DataFrame]:
    """All parts of a day as build() gives them, where every printed headline carries an explanation: stories from today(),
    leads that are backed, the lead marked."""
    from pyspark.sql import Window

    first = written(today(items, issues, shown, day, s), "issue-stories")
    leads = written(backed(track(items, issues, shown, first, day, s, fixed.LEAD_EVENTS, *s.leads, False, False, True, False)), "issue-leads")
    both = first.select(*[c for c in first.columns if c in leads.columns]).unionByName(leads, allowMissingColumns=True)
    enforcement = written(track(items, issues, shown, both, day, s, fixed.ENFORCEMENT_EVENTS, *s.enforcement, True, True, False, True), "issue-enforcement")
    featured = both.unionByName(enforcement, allowMissingColumns=True)
    order = Window.partitionBy(F.lit(0)).orderBy("brief_only", F.coalesce(F.contains("flag_reason", F.lit("held over from the previous day")), F.lit(False)), F.desc_nulls_last("score"), "id")
    placed = edited(first, s).withColumn("place", F.row_number().over(order) - 1)  # a day's dozen
    tier = F.when(F.col("brief_only"), "brief").when(F.col("place") == 0, "lead").when(F.col("place") < 7, "development").otherwise("brief")
    placed = lead_story(placed.withColumn("tier", tier))
    return {"stories": placed, "leads": edited(leads, s), "enforcement": edited(enforcement, s), "records": record_lists(items, shown, featured, day, s)}


def build(items: DataFrame, issues: DataFrame, shown: DataFrame, day: Column, s: Settings) -> dict[str, DataFrame]:
    """All parts of a day, each written once: stories (with tier and place), leads, enforcement, records."""
    first = written(stories(items, issues, shown, day, s), "issue-stories")
    leads = written(track(items, issues, shown, first, day, s, fixed.LEAD_EVENTS, *s.leads, False, False, True, False), "issue-leads")
    both = first.select(*leads.columns).unionByName(leads)
    enforcement = written(track(items, issues, shown, both, day, s, fixed.ENFORCEMENT_EVENTS, *s.enforcement, True, True, False, True), "issue-enforcement")
    featured = both.unionByName(enforcement)
    placed = sel.tiers(edited(first, s).withColumn("_d", F.lit(0)), "_d", F.desc_nulls_last("score"), F.col("id"), brief=F.col("story") == "").drop("_d")
    return {"stories": placed, "leads": edited(leads, s), "enforcement": edited(enforcement, s), "records": record_lists(items, shown, featured, day, s)}


def carried(parts: dict[str, DataFrame], day: Column) -> DataFrame:
    """(day, url, title) of all that a day carries, copies included."""
    out = []
    for p in parts.values():
        out.append(p.select(day.alias("day"), "url", "title"))
        if "also" in p.columns:
            out.append(p.select(day.alias("day"), F.explode("also").alias("c")).select("day", "c.url", "c.title"))
    return reduce(DataFrame.union, out)


def write_day(parts: dict[str, DataFrame], day: str, path: str) -> None:
    """One JSON file of the day: date and each part as a list in order. A day is some dozens of rows, one row of the result."""
    spark = parts["stories"].sparkSession
    row = spark.range(1).select(F.lit(day).alias("date"))
    for name, p in parts.items():
        order = [c for c in ("list", "place") if c in p.columns]
        listed = p.agg(F.array_sort(F.collect_list(F.struct(*order, (-F.coalesce("score", F.lit(0.0))).alias("back"), *[c for c in p.columns if c not in order]))).alias(name))
        row = row.join(F.broadcast(listed))  # one row each
    row.coalesce(1).write.mode("overwrite").json(f"{path}/day={day}")


def day_rows(parts: dict[str, DataFrame], day: Column) -> DataFrame:
    """(day, part, place, record) of all that a day carries, for sources.daystore: a record is JSON with the fixed fields
    of a story, in their order and null where a part has none, and tier and place. What a part does not say of a tier:
    leads are signals, the enforcement track is enforcement."""
    told = {"leads": "signal", "enforcement": "enforcement"}
    out = []
    for name, p in parts.items():
        fields = [(F.col(c) if c in p.columns else F.lit(None).cast("string")).alias(c) for c in fixed.DAY_FIELDS]
        tier = F.col("tier") if "tier" in p.columns else F.lit(told.get(name, name))
        group = [F.col("list")] if "list" in p.columns else []
        part = F.concat_ws("/", F.lit(name), *group)
        at = F.col("place").cast("long") if "place" in p.columns else None
        if at is None:
            from pyspark.sql import Window

            # A part of a day is some dozens of rows.
            at = F.row_number().over(Window.partitionBy(part).orderBy(F.desc_nulls_last("score"), "id")).cast("long") - 1
        options = {"ignoreNullFields": "false"}
        out.append(p.select(day.cast("string").alias("day"), part.alias("part"), at.alias("place"), F.to_json(F.struct(*fields, tier.alias("tier")), options).alias("record")))
    return reduce(DataFrame.union, out)


def rebuild(spark: SparkSession, items: DataFrame, shown: DataFrame, days: list[str], s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Days in order, each seeing only what came before: items with their issue, issues, and what the days carry."""
    issues = spark.createDataFrame([], "issue_id long, number long, day date, sent boolean")
    for day in sorted(days):
        at = F.lit(day).cast("date")
        parts = build(items, issues, shown, at, s)
        number = sel.issue_number(issues).first()["number"]
        picks = parts["stories"].select("id", "url", "also")
        items = written(sel.mark_issue(items, picks, number), "items")
        issues = written(issues.union(spark.range(1).select(F.lit(number).cast("long"), F.lit(number).cast("long"), at, F.lit(False))), "issues")
        shown = written(shown.union(carried(parts, at)), "shown")
    return items, issues, shown
