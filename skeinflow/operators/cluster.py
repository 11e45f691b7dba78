"""Stories: which items tell the same matter.

Features are columns. Two forms use them: fold() goes through a bounded pool in
order, each item joining the first story that takes it, as an editor would;
graph() links items that meet under a rare phrase, a rare name, a party and a
State, or a pair of States at one stage, and items with similar words, with the
same vetoes, and takes connected components, which works on tables of any size.
They differ by construction: links are transitive, and the fold compares with
what a story has gathered so far. In graph() a rare name and a pair of States
count by themselves, where the fold asks for another word in common as well,
and the fold's likenesses that only a pair of items can show (two names of
which none is rare, or three words and a low share of words in common) have no
counterpart.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.functions import fixed
from skeinflow.functions import text as T
from skeinflow.operators.graph import components, written
from skeinflow.operators.link import jaccard_sets


@dataclass(frozen=True)
class Lexicon:
    """forms: places by surface form; common: ordinary lower-case words that are no names; cities: places that are no parties."""

    forms: dict[str, str] = field(default_factory=dict)
    common: tuple[str, ...] = ()
    cities: tuple[str, ...] = ()


UNIONS = ("eu", "uk", "us", "un")


def _low(c: Column) -> Column:
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(T.fold(x))), lambda x: x != "")


def stage(event: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, kinds in fixed.STAGES.items():
        out = F.when(event.isin(*kinds), name).otherwise(out)
    return out


def _lookup(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in sorted(set(words))]).cast("array<string>")


def features(items: DataFrame, lexicon: Lexicon, group: str | None = None, title: str = "title", common: DataFrame | None = None, once: bool = False) -> DataFrame:
    """items with _toks, _names, _ents, _phrases, _rare, _told (jurisdictions in the headline), _jur (with those of the
    record), _claimants, _respondents, _parties, _states, _stage.

    A phrase or name is rare if at most max(3, rows / 8) items of the pool have it; phrases with a word for a
    place, or of two words of the trade, and names of places don't count. The pool is the group's rows. Where `common`
    (k: a phrase as "b:...", a name as "n:...") is given, rare is what is not in it, whatever the pool. once: what headlines
    say is written to the shared folder, where it is read both for the pool's counts and for the rows.
    """
    head = F.coalesce(F.when(F.col("title_en") != "", F.col("title_en")), F.col(title)) if "title_en" in items.columns else F.col(title)
    has = lambda c: F.col(c) if c in items.columns else F.array().cast("array<string>")
    state_words = [*lexicon.forms, *fixed.ALIASES.values()]
    placing, trade = _stems_of(items, state_words), _stems_of(items, fixed.GENERIC)
    place_stems, generic = _lookup(placing), _lookup(trade)
    df = items.withColumn("_head", head).withColumn("_stems", T.stems("_head")).withColumns(
        {
            "_toks": F.array_distinct("_stems"), "_names": T.propers("_head"), "_bi": T.bigrams("_head", F.col("_stems")), "_states": _low(has("states")),
            "_claimants": _low(has("claimants")), "_respondents": _low(has("respondents")),
            "_stage": stage(F.col("event_type")) if "event_type" in items.columns else F.lit(None).cast("string"),
        }
    )
    shorts = F.transform(F.regexp_extract_all("_head", F.lit("(?<![A-Za-z])(?:EU|UK|US|UN)(?![A-Za-z])"), F.lit(0)), lambda w: F.lower(w))
    ents = F.array_except(F.col("_names"), F.array_union(F.array_union(place_stems, generic), _lookup([*lexicon.cities, *lexicon.common])))
    df = df.withColumns({"_told": F.array_distinct(F.concat(_low(T.places("_head", lexicon.forms)), shorts)), "_ents": ents})
    df = df.withColumns({"_jur": F.array_union("_told", "_states"), "_parties": F.array_union("_claimants", "_respondents")})
    df = df.withColumn("_k", F.concat(F.transform("_bi", lambda b: F.concat(F.lit("b:"), b)), F.transform("_names", lambda n: F.concat(F.lit("n:"), n)))).drop("_stems", "_bi", "_head")
    if once:
        df = written(df, "story-words")
    keys = [group] if group else []
    own = F.explode("_k").alias("k")
    if common is not None:
        sets = df.select("id", own).join(common.select("k").distinct(), "k", "left_anti").groupBy("id").agg(F.collect_set("k").alias("_k"))
        return _with_rare(df.drop("_k").join(sets, "id", "left"), placing, trade)
    pool = df.groupBy(*keys).agg(F.count("*").alias("_n")) if group else df.agg(F.count("*").alias("_n"))
    counted = df.select(*keys, own).groupBy(*keys, "k").agg(F.count("*").alias("c"))
    often = (counted.join(pool, keys) if group else counted.join(F.broadcast(pool))).where(F.col("c") > F.greatest(F.lit(3), F.floor(F.col("_n") / 8)))  # pool has one row
    # More than an eighth of the pool has each of these, so they are at most eight times as many as a row has on average.
    often = often.groupBy(*keys).agg(F.collect_list("k").alias("_often"))
    df = df.join(often, keys, "left") if group else df.join(F.broadcast(often))  # one row
    rare = F.array_except("_k", F.coalesce("_often", F.array().cast("array<string>")))
    return _with_rare(df.withColumn("_k", rare).drop("_often"), placing, trade)


def _with_rare(df: DataFrame, placing: Sequence[str], trade: Sequence[str]) -> DataFrame:
    place_stems = _lookup(placing)
    of = lambda mark: F.transform(F.filter(F.coalesce("_k", F.array().cast("array<string>")), lambda k: k.startswith(mark)), lambda k: F.substr(k, F.lit(3)))
    good = lambda b: T.bound(F.split(b, " "), lambda two: ~F.exists(two, lambda w: T.words_in(placing, w)) & F.exists(two, lambda w: ~T.words_in(trade, w)))
    return df.withColumns({"_phrases": F.filter(of("b:"), good), "_rare": F.array_except(of("n:"), place_stems), "_placed": F.array_intersect("_toks", place_stems)}).drop("_k")


def _stems_of(df: DataFrame, words: Sequence[str]) -> list[str]:
    """Stems of fixed words, computed by the same columns as everything else."""
    if not words:
        return []
    return df.sparkSession.createDataFrame([(" ".join(words),)], "w string").select(T.stems("w", stop=()).alias("s")).first()["s"]


# --- the fold ------------------------------------------------------------------------------------------------

WORDS = ("toks", "names", "ents", "phrases", "rare")  # what a story gathers from all its items
RECORD = ("claimants", "respondents", "states")  # what the telling item lacks comes from the others


class Story:
    """A story of the fold: its telling item, what its items have in common with others, and its copies in order."""

    def __init__(self, item: dict):
        self.items, self.said, self.copies = [], [], []
        self.words = {k: set() for k in WORDS}
        self.tell(item)

    def tell(self, item: dict) -> None:
        """item tells the story from now on. Its own record comes first, what was known before fills its gaps."""
        before = getattr(self, "record", {})
        self.teller, self.text = item, item
        self.record = {k: item[k] or before.get(k) or type(item[k])() for k in (*RECORD, "case")}
        self.take(item)

    def take(self, item: dict) -> None:
        self.items.append(item)
        self.said.append(item["toks"])
        for k in WORDS:
            self.words[k] |= item[k]

    def join(self, item: dict) -> None:
        if self.teller["lang"] != "en" and item["lang"] == "en":  # the version in English tells the story
            self.copies.append(self.teller["id"])
            self.tell(item)
            return
        self.take(item)
        self.copies.append(item["id"])
        for k in self.record:
            self.record[k] = self.record[k] or item[k]
        if item["real"] > self.text["real"]:
            self.text = item

    @property
    def jurisdictions(self) -> set:
        return self.teller["told"] | self.record["states"]

    def holds(self, item: dict) -> bool:
        """Whether an item belongs to the story."""
        mine, its = self.record, item
        if mine["case"] and its["case"] and mine["case"] != its["case"]:
            return False
        same_state = bool(mine["states"] & its["states"])
        if same_state and (mine["claimants"] | mine["respondents"]) & (its["claimants"] | its["respondents"]):
            return True
        shared = len(self.words["toks"] & its["toks"])
        if not shared or (self.words["ents"] and its["ents"] and not self.words["ents"] & its["ents"]):
            return False
        here, there = self.jurisdictions, its["told"] | its["states"]
        apart = bool(here and there and not here & there)
        closest = max(len(its["toks"] & t) / len(its["toks"] | t) for t in self.said)
        if closest >= fixed.JACCARD_ALONE:
            return True
        if apart:
            return False
        pair = here - set(UNIONS)
        return (
            bool(self.words["phrases"] & its["phrases"])
            or (bool(self.words["rare"] & its["rare"]) and (same_state or shared >= 2))
            or len(self.words["names"] & its["names"]) >= 2
            or (shared >= 3 and closest >= fixed.JACCARD_THREE)
            or (shared >= 3 and closest >= fixed.JACCARD_KIND and bool(its["placed"] & self.words["toks"]) and its["event"] == self.teller["event"] and its["event"] not in ("", "commentary"))
            or (shared >= 2 and len(pair) >= 2 and pair == there - set(UNIONS) and not (its["ents"] or self.words["ents"]) and its["stage"] == self.teller["stage"] is not None)
        )


_SETS = (*WORDS, *RECORD, "told", "placed")


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    stories: list[Story] = []
    for r in pdf.sort_values("place").to_dict("records"):
        item = r | {k: set(r[k] if r[k] is not None else ()) for k in _SETS}
        item["stage"] = r["stage"] if isinstance(r["stage"], str) else None
        home = next((s for s in stories if s.holds(item)), None)
        if home is None:
            stories.append(Story(item))
        else:
            home.join(item)
    seat = {i: n for s in stories for n, i in enumerate(s.copies)}
    out = [(i["id"], s.teller["id"], i["place"], seat.get(i["id"]) if i is not s.teller else None, s.text["id"]) for s in stories for i in s.items]
    return pd.DataFrame(out, columns=["id", "story", "place", "seat", "text_of"]).astype({"seat": "Int64"})


MOST_FOLDED = 5000


def fold(items: DataFrame, lexicon: Lexicon, place: Column, group: str | None = None, most: int = MOST_FOLDED) -> DataFrame:
    """One row per item: id, story (the id of the item that tells it), place, seat (the item's place among the
    story's copies; null for the one that tells it), text_of (the id of the item with the fullest summary).

    place: a unique number that orders the pool (anchors first, then by score). Each group's pool is one task's
    work; pools are the few hundred candidates of a day, which their selection bounds. A pool of more than `most`
    items is an error: graph() is the form for tables.
    """
    df = features(items, lexicon, group)
    keys = F.col(group) if group else F.lit(0)
    sized = df.groupBy(keys.alias("_g")).agg(F.count("*").alias("_rows"))
    large = sized.where(F.col("_rows") > most).limit(1).collect()
    if large:
        raise ValueError(f"a pool of {large[0]['_rows']} items is too large to fold (most: {most})")
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in items.columns else F.lit("")
    slim = df.select(
        "id", place.cast("long").alias("place"), *[F.col(f"_{k}").alias(k) for k in _SETS], F.col("_stage").alias("stage"), text("case_ref").alias("case"),
        text("event_type").alias("event"), (F.when(text("lang") == "", "en").otherwise(text("lang"))).alias("lang"),
        F.length(real_summary(text("summary"), text("title"))).alias("real"), keys.alias("group_"),
    )
    kind = dict(items.dtypes)["id"]
    return slim.groupBy("group_").applyInPandas(_fold, f"id {kind}, story {kind}, place long, seat long, text_of {kind}")


def real_summary(summary: Column, title: Column) -> Column:
    """A summary without white space around; empty if it is a wall's text or begins with the headline again."""
    s = F.trim(F.coalesce(summary, F.lit("")))
    return F.when(T.is_paywall(s) | F.lower(s).startswith(F.substring(F.lower(F.coalesce(title, F.lit(""))), 1, 40)), "").otherwise(s)


# --- the graph -----------------------------------------------------------------------------------------------


def _meetings(rows: DataFrame) -> DataFrame:
    """Edges (u, v) that connect what may link: rows (id, k, e, j, c) with the same k link unless they have names (e),
    jurisdictions (j) or case numbers (c) both and none in common.

    No pairs are made. A row that lacks one of the three goes with every row there, so rows are told by which they
    lack; under each key, for each two such kinds and each value that both must share, the rows of one kind link to
    the smallest of the other. Where rows have `by`, those are the names under which two that have names meet: the
    names that both may share and that don't link them elsewhere.
    """
    lists = _lists()
    df = written(rows.withColumn("p", _lacking(lists)), "meetings")
    if "by" in rows.columns:
        lists["e"] = F.when(F.size("e") > 0, F.col("by")).otherwise(lists["e"])
    kinds_there = sorted(r["p"] for r in df.select("p").distinct().collect())  # eight at most
    if not kinds_there:
        return rows.select(F.col("id").alias("u"), F.col("id").alias("v"))
    dealt = written(df.select("id", "k", F.inline(dealing(lists, kinds_there))), "dealt")
    least = dealt.groupBy("k", "g").agg(F.min(F.when(~F.col("side"), F.col("id"))).alias("a"), F.min(F.when(F.col("side"), F.col("id"))).alias("b"), F.count("*").alias("n"))
    # A row alone links to nothing.
    met = dealt.join(least.where("n > 1").drop("n"), ["k", "g"])
    return met.select("id", F.when(F.col("own") | F.col("side"), F.col("a")).otherwise(F.col("b")).alias("u")).where("u IS NOT NULL AND id <> u").select("u", F.col("id").alias("v")).distinct()


def _lists() -> dict[str, Column]:
    return {k: F.when(F.col(k).isNull() | (F.size(k) == 0), F.array(F.lit(""))).otherwise(F.col(k)) for k in ("e", "j")} | {"c": F.array(F.coalesce("c", F.lit("")))}


def _lacking(lists: dict[str, Column]) -> Column:
    """Which of the three a row lacks, as a number below eight."""
    lacks = lambda k: F.get(lists[k], F.lit(0)) == ""
    return reduce(lambda a, b: a + b, [F.when(lacks(k), 1 << n).otherwise(0) for n, k in enumerate("ejc")])


def dealing(lists: dict[str, Column], kinds: Sequence[int]) -> Column:
    """For a row of kind p: (g, side, own) of every group in which it meets rows of the given kinds. In a group of two
    kinds those of one side link to the other side; in one of a single kind (own) all link."""

    def with_kind(q: int) -> Column:
        e, j, c = (F.array(F.lit("")) if q >> n & 1 else lists[k] for n, k in enumerate("ejc"))
        must = F.flatten(F.transform(e, lambda x: F.flatten(F.transform(j, lambda y: F.transform(c, lambda z: F.concat_ws("\x01", x, y, z))))))
        kinds = F.concat_ws("\x01", F.least("p", F.lit(q)).cast("string"), F.greatest("p", F.lit(q)).cast("string"))
        return F.transform(F.array_distinct(must), lambda m: F.struct(F.concat_ws("\x01", kinds, m).alias("g"), (F.col("p") > q).alias("side"), (F.col("p") == q).alias("own")))

    return F.concat(*[with_kind(q) for q in kinds])


def meeting_keys() -> tuple[Column, Column]:
    """From features: the keys under which items meet unless their names, jurisdictions or case numbers keep them apart
    (rare phrases, rare names, States at one stage), and those where only case numbers do (a party and a State)."""
    mark = lambda m, c: F.transform(c, lambda x: F.concat(F.lit(f"{m}:"), x))
    both = lambda a, b: F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: y != x), lambda y: F.concat_ws(" ", x, y))))
    states = F.array_except("_jur", _lookup(UNIONS))
    pair = (F.size("_ents") == 0) & (F.size(states) >= 2) & F.col("_stage").isNotNull()
    keys = F.concat(
        mark("phrase", F.col("_phrases")), mark("name", F.col("_rare")),
        F.when(pair, F.array(F.concat_ws(" ", F.lit("pair:"), F.array_join(F.array_sort(states), ","), F.col("_stage")))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(keys), F.array_distinct(both(F.col("_parties"), F.col("_states")))


def graph(items: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(id, story) on tables of any size: connected components of linked items. Items without a case number go with
    one; a component of several case numbers is split by them."""
    used = [c for c in ("id", "title", "title_en", "states", "claimants", "respondents", "event_type", "case_ref") if c in items.columns]
    df = features(items.select(*used), lexicon, once=True).withColumn("_case", F.when(F.col("case_ref") != "", F.col("case_ref")) if "case_ref" in items.columns else F.lit(None).cast("string"))
    told = ("_toks", "_names", "_ents", "_rare", "_phrases", "_jur", "_parties", "_states", "_stage", "_case")
    # Items that are alike in all this are one, with the smallest id.
    rows = df.select("id", *[F.array_sort(c).alias(c) if c not in ("_stage", "_case") else F.col(c) for c in told])
    rows = written(rows, "story-features")
    first = written(rows.groupBy(*told).agg(F.min("id").alias("id")), "story-kinds")
    alike = rows.join(first.withColumnRenamed("id", "u"), reduce(lambda a, b: a & b, [rows[c].eqNullSafe(first[c]) for c in told])).where("id <> u").select("u", F.col("id").alias("v"))
    keys, sides = meeting_keys()
    none = F.array().cast("array<string>")
    # Items that share a rare name which counts as one are not kept apart by names, and all of them meet under it. So
    # under other keys two that have names need to meet under names that are not rare only.
    own = F.startswith("k", F.lit("name:")) & F.array_contains("_ents", F.substr("k", F.lit(6)))
    keyed = first.select("id", F.explode(keys).alias("k"), "_ents", F.array_except("_ents", "_rare").alias("by"), F.col("_jur").alias("j"), F.col("_case").alias("c"))
    met = _meetings(keyed.select("id", "k", F.when(own, none).otherwise(F.col("_ents")).alias("e"), "by", "j", "c"))
    # The same party and State: only case numbers keep those apart.
    parties = _meetings(first.select("id", F.explode(sides).alias("k"), none.alias("e"), none.alias("j"), F.col("_case").alias("c")))
    linked = written(components(alike.union(met).union(parties)), "story-links")
    # Similar words: sets of words are compared once, and the items of two similar sets (or of one) meet under them. Sets
    # all of whose items are linked already need not be compared.
    sets = first.select("id", "_toks", "_ents", "_case").where(F.size("_toks") > 0).join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("component", "id"))
    one = F.when(F.min("part") == F.max("part"), F.min("part"))
    leader = written(sets.groupBy("_toks").agg(F.min("id").alias("set"), one.alias("part")), "story-sets")
    near = jaccard_sets(leader.select(F.col("set").alias("id"), F.col("_toks").alias("t"), "part"))
    named = near.select(F.concat_ws(" ", "a", "b").alias("k"), F.explode(F.array("a", "b")).alias("set")).union(leader.where("part IS NULL").select(F.col("set").cast("string"), "set"))
    words = sets.drop("part").join(leader, "_toks").join(named, "set").select("id", "k", F.col("_ents").alias("e"), none.alias("j"), F.col("_case").alias("c"))
    comp = components(linked.select(F.col("node").alias("u"), F.col("component").alias("v")).union(_meetings(words)))
    labelled = rows.select("id", F.col("_case").alias("case")).join(comp, F.col("id") == F.col("node"), "left")
    return by_case(labelled.select("id", "case", F.coalesce("component", "id").alias("c")))


def by_case(labelled: DataFrame) -> DataFrame:
    """(id, story) of items (id, case, c): the least item of each component c, or where a component has several case
    numbers that of each number."""
    cases = labelled.groupBy("c").agg((F.min("case") != F.max("case")).alias("several"), F.min("id").alias("least"))
    split = labelled.groupBy("c", "case").agg(F.min("id").alias("own")).withColumnsRenamed({"c": "c_", "case": "case_"})
    out = labelled.join(cases, "c").join(split, (F.col("c") == F.col("c_")) & F.col("case").eqNullSafe(F.col("case_")))
    return out.select("id", F.when(F.coalesce("several", F.lit(False)), F.col("own")).otherwise(F.col("least")).alias("story"))


def merged(items: DataFrame, stories: DataFrame) -> DataFrame:
    """One row per story: the columns of the item that tells it, and also, the copies (source, url, title) in order,
    after those that the first item had already. Lists and values that it lacks come from the first item that has
    them, and the summary is the fullest of the story's. stories: (id, story) and, from fold(), place, seat, text_of;
    without those the order is that of ids and the first of the fullest summaries counts."""
    cols = [c for c in ("counsel", "claimants", "respondents", "states", "sectors", "arbitrators") if c in items.columns]
    single = [c for c in ("treaty", "amount_usd", "case_ref") if c in items.columns]
    ordered = {"place", "seat", "text_of"} <= set(stories.columns)
    at = stories.select("id", F.col("story").alias("_story"), *[F.col(c).alias(f"_{c}") for c in (("place", "seat", "text_of") if ordered else ())])
    df = items.join(at, "id")
    place, seat = (F.col("_place"), F.col("_seat")) if ordered else (F.col("id"), F.col("id"))
    copy = "array<struct<source string, url string, title string>>"
    had = F.coalesce("also", F.expr(f"cast(array() as {copy})")) if "also" in items.columns else F.expr(f"cast(array() as {copy})")
    other = F.col("id") != F.col("_story")
    own = F.array_sort(F.collect_list(F.when(other, F.struct(seat.alias("seat"), "source", "url", "title"))))
    fill = [F.min_by(c, F.when(F.size(c) > 0, place)).alias(f"_{c}") for c in cols]
    fill += [F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), place)).alias(f"_{c}") for c in single]
    if "summary" in items.columns:
        real = F.length(real_summary(F.col("summary"), F.col("title")))
        best = F.when(F.col("id") == F.col("_text_of"), F.lit(0)) if ordered else F.when(real > 0, F.struct(-real, F.col("id")))
        fill.append(F.min_by("summary", best).alias("_summary"))
        fill.append(F.max(F.when(~other, real)).alias("_real"))
        fill.append(F.max(real).alias("_most"))
    rest = df.groupBy("_story").agg(F.transform(own, lambda x: F.struct(x["source"], x["url"], x["title"])).alias("_also"), F.min_by(had, place).alias("_had"), *fill)
    out = items.join(rest, items["id"] == rest["_story"]).drop("_story")
    for c in cols:
        out = out.withColumn(c, F.when(F.size(c) > 0, F.col(c)).otherwise(F.coalesce(f"_{c}", c))).drop(f"_{c}")
    for c in single:
        out = out.withColumn(c, F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c)), f"_{c}", c)).drop(f"_{c}")
    if "summary" in items.columns:
        fuller = F.col("_summary") if ordered else F.when(F.col("_most") > F.col("_real"), F.col("_summary"))
        out = out.withColumn("summary", F.coalesce(fuller, "summary")).drop("_summary", "_real", "_most")
    return out.withColumn("also", F.concat("_had", "_also")).drop("_also", "_had")


def cite_best(stories: DataFrame, rank) -> DataFrame:
    """The copy with the best outlet rank in place of the citation, and the old citation first among the copies.
    rank(source, url) gives a column; a search engine's link counts half a rank more."""
    r = lambda s, u: rank(s, u) + F.when(F.contains(F.coalesce(u, F.lit("")), F.lit("news.google.")), 0.5).otherwise(0.0)
    scored = F.transform("also", lambda x, i: F.struct(r(x["source"], x["url"]).alias("r"), i.alias("i"), x.alias("x")))
    best = F.get(F.array_sort(F.filter(scored, lambda x: F.coalesce(x["x"]["url"], F.lit("")) != "")), F.lit(0))
    df = stories.withColumn("_best", best).withColumn("_swap", F.coalesce(F.col("_best.r") < r(F.col("source"), F.col("url")), F.lit(False)))
    old = F.struct(F.col("source"), F.col("url"), F.col("title"))
    rest = F.filter(F.col("also"), lambda x, i: i != F.col("_best.i"))
    english = F.coalesce("lang", F.lit("en")) == "en" if "lang" in stories.columns else F.lit(True)
    title = F.when(F.col("_swap") & english & (F.coalesce("_best.x.title", F.lit("")) != ""), F.col("_best.x.title")).otherwise(F.col("title"))
    return df.select(
        *[c for c in stories.columns if c not in ("also", "source", "url", "title")],
        F.when(F.col("_swap"), F.concat(F.array(old), rest)).otherwise(F.col("also")).alias("also"),
        F.when(F.col("_swap"), F.col("_best.x.source")).otherwise(F.col("source")).alias("source"),
        F.when(F.col("_swap"), F.col("_best.x.url")).otherwise(F.col("url")).alias("url"), title.alias("title"),
    )


def not_anchored(stories: DataFrame, items: DataFrame, anchors: DataFrame, anchor_urls: DataFrame) -> DataFrame:
    """Stories (id, story) none of whose items is an anchor (id) or has an anchor's url."""
    bad = stories.join(anchors.select("id"), "id", "left_semi").select("story")
    by_url = stories.join(items.select("id", "url").join(anchor_urls.select("url").distinct(), "url", "left_semi"), "id", "left_semi").select("story")
    return stories.join(bad.union(by_url).distinct(), "story", "left_anti")
