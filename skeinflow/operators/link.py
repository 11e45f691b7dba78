"""Linkage of records: interval joins on dates, copies of a story, and cascades of finders.

Interval joins bucket both sides by days, so they are equi-joins on (key,
bucket) with the interval as residual condition, and never nested loops.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions import fixed
from skeinflow.functions.text import is_paywall, stems, tokens
from skeinflow.operators.graph import written


def interval_join(left: DataFrame, right: DataFrame, key: str, left_day: str, right_day: str, before: int, after: int) -> DataFrame:
    """Pairs with equal keys (one key column on both sides) and right_day in [left_day - before, left_day + after]."""
    width = before + after + 1
    number = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    lows = F.floor((number(left_day) - before) / width)
    highs = F.floor((number(left_day) + after) / width)
    a = left.withColumn("_b", F.explode(F.sequence(lows, highs)))
    b = right.withColumn("_b", F.floor(number(right_day) / width))
    gap = F.datediff(F.col(right_day), F.col(left_day))
    return a.join(b, [key, "_b"]).where((gap >= -before) & (gap <= after)).drop("_b")


def unique_match(pairs: DataFrame, key: str) -> DataFrame:
    """Pairs of keys that have exactly one."""
    one = pairs.groupBy(key).count().where("count = 1").select(key)
    return pairs.join(one, key, "left_semi")


def first_match(pairs: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first pair of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return pairs.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def cascade(rows: DataFrame, key: str, *finders: DataFrame) -> DataFrame:
    """rows with found: that of the first finder (key, found), in order, that has one."""
    out = rows
    for i, f in enumerate(finders):
        out = out.join(f.select(key, F.col("found").alias(f"_f{i}")), key, "left")
    names = [f"_f{i}" for i in range(len(finders))]
    return out.withColumn("found", F.coalesce(*names)).drop(*names)


def fullest_summary(items: DataFrame, least: int = 200, gain: int = 20) -> DataFrame:
    """(id, summary): for items whose summary is short or cut off, the longest whole summary under the same url
    or title, if it is more than `gain` characters longer; ties go to the smallest id."""
    size = F.length(F.coalesce("summary", F.lit("")))
    cut = F.coalesce("summary", F.lit("")).rlike("(?:…|\\.\\.\\.)\\s*$")
    need = items.where((size < least) | cut).select(F.col("id").alias("_id"), "url", "title", size.alias("_own"))
    whole = ~cut & ~is_paywall("summary") & ~F.lower("summary").startswith(F.lower(F.substring("title", 1, 40)))
    best = {}
    for key in ("url", "title"):
        cands = items.where(whole & F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(size.alias("n"), (-F.col("id")).alias("back"), F.col("summary"))).alias("best"))
        best[key] = need.join(cands, key).select("_id", "_own", "best")
    found = best["url"].union(best["title"]).where(F.col("best.n") > F.col("_own") + gain)
    return found.groupBy("_id").agg(F.max("best").alias("best")).select(F.col("_id").alias("id"), F.col("best.summary").alias("summary"))


def other_copies(corroboration: Column, also: Column, trade) -> Column:
    """Distinct copies by url and by source, without search-engine links, trade press first (a stable order)."""
    all_ = F.filter(F.concat(F.coalesce(corroboration, F.array()), F.coalesce(also, F.array())), lambda x: (F.coalesce(x["url"], F.lit("")) != "") & ~F.contains(x["url"], F.lit("news.google.")))
    first = F.aggregate(
        all_, F.slice(all_, 1, 0),
        lambda acc, x: F.when(F.exists(acc, lambda y: (y["url"] == x["url"]) | (y["source"] == x["source"])), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return F.concat(F.filter(first, trade), F.filter(first, lambda x: ~trade(x)))


def attach(corroboration: Column, record: Column) -> Column:
    """A record first in the list, any entry of its url removed; a null record changes nothing."""
    rest = F.filter(F.coalesce(corroboration, F.array()), lambda x: ~x["url"].eqNullSafe(record["url"]))
    return F.when(record.isNotNull(), F.concat(F.array(record), rest)).otherwise(corroboration)


def party_match(names: Column, title: Column, states: tuple[str, ...] = (), sovereign: tuple[str, ...] = ("republic", "kingdom", "government", "state", "ministry")) -> Column:
    """Whether a title names the parties: one that is no State, or two States, or one State and a sovereign's word."""
    have = tokens(title)
    first = F.slice(names, 1, 4)
    held = F.filter(first, lambda n: F.size(F.array_except(tokens(n), have)) == 0)
    is_state = lambda n: n.isin(*states) if states else F.lit(False)
    company = F.exists(held, lambda n: ~is_state(n))
    n = F.size(F.filter(held, is_state))
    word = F.exists(F.array(*[F.lit(s) for s in sovereign]), lambda s: F.contains(F.lower(title), s))
    return company | (n >= 2) | ((n == 1) & word)


def jaccard_pairs(df: DataFrame, id: str, text: str, least: float = fixed.JACCARD_ALONE) -> DataFrame:
    """(a, b, jaccard) with a < b of distinct token sets whose Jaccard similarity is `least` or more. Rows with the
    same set are one representative (the smallest id), so copies don't multiply."""
    sets = df.select(F.col(id).alias("id"), F.array_sort(tokens(text)).alias("t")).where(F.size("t") > 0).groupBy("t").agg(F.min("id").alias("id"))
    return jaccard_sets(sets, least)


def jaccard_sets(sets: DataFrame, least: float = fixed.JACCARD_ALONE, hot: int = 1000) -> DataFrame:
    """(a, b, jaccard) with a < b of the similar ones among distinct, non-empty sets (id, t).

    A pair above the bound shares a word among the first of each set in order of rarity (prefix filtering), so rows
    meet only there; what travels is numbers: of a word the rank, of a set its size. The words themselves are
    compared at the end, once for each pair. Under a word that more than `hot` sets have, sets meet only those of a
    size that is still possible at that place, so that short sets don't all meet under a common word.

    Where sets have a part, pairs of the same part (not null) are not asked for. The largest part's sets then meet
    those of others only, so what is made grows with the sets outside of it.
    """
    parted = "part" in sets.columns
    sets = written(sets.select("id", "t", *(["part"] if parted else [])), "word-sets")
    counts = sets.select(F.explode("t").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    rows = written(prefixes(sets, counts, least, hot), "word-prefixes")
    if not parted:
        return alike(meetings(rows, rows, least, "a < b"), sets, sets, least)
    largest = sets.where("part IS NOT NULL").groupBy("part").count().orderBy(F.desc("count"), "part").first()
    within = F.col("part").eqNullSafe(F.lit(largest["part"])) if largest else F.lit(False)
    told = written(rows.join(sets.select("id", "part", within.alias("within")), "id"), "word-prefixes")
    met = meetings(told.where("NOT within"), told, least, "(a < b OR within) AND coalesce(pa <> pb, true)")
    return alike(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), sets, sets, least)


#: Numbers of 64 bits in a set's sketch.
SKETCH = 4


def prefixes(sets: DataFrame, counts: DataFrame, least: float, hot: int) -> DataFrame:
    """(id, n, at, w, hot, s0 ...) of sets (id, t): a set's size and its first words in order of rarity, as numbers, and
    its sketch. counts (w, n) orders the words, those of one count by their hash; words that it lacks come first."""
    word = sets.select("id", F.explode("t").alias("w"))
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.xxhash64("w").alias("h"))
    ordered = word.join(counts, "w", "left").groupBy("id").agg(F.array_sort(F.collect_list(rank)).alias("o"), *_sketch(F.xxhash64("w")))
    n = F.size("o")
    prefix = F.slice("o", 1, n - F.ceil(least * n).cast("int") + 1)
    sketch = [f"s{i}" for i in range(SKETCH)]
    rows = ordered.select("id", n.alias("n"), *sketch, F.posexplode(prefix).alias("at", "r"))
    return rows.select("id", "n", "at", F.col("r.h").alias("w"), (F.col("r.n") > hot).alias("hot"), *sketch)


def _sketch(h: Column) -> list[Column]:
    """The set's words by their hashes, each flipping one of the sketch's bits: what differs between two sketches is at most what differs
    between the sets, so sketches rule pairs out and never wrongly."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    place = F.pmod(F.shiftright(h, 6), F.lit(SKETCH))
    return [F.coalesce(F.bit_xor(F.when(place == i, bit)), F.lit(0).cast("long")).alias(f"s{i}") for i in range(SKETCH)]


def meetings(left: DataFrame, right: DataFrame, least: float, which: str = "a <> b") -> DataFrame:
    """(a, b) of rows of prefixes() that may be similar, for which `which` holds, each pair once. What two sets share
    from the first common word on is at most what is left of either, so sizes n and m can meet where
    left * (1 + least) >= least * (n + m). Sketches tell that more words differ than may, before a pair is made."""
    most = F.least(F.floor(F.col("n") / least), F.floor((F.col("n") - F.col("at")) * (1 + least) / least + 1e-9) - F.col("n"))
    sizes = F.filter(F.sequence(F.ceil(least * F.col("n") - 1e-9), F.greatest(most, F.ceil(least * F.col("n") - 1e-9))), lambda m: m <= most)
    other = F.explode(F.when(F.col("hot"), sizes).otherwise(F.array(F.lit(0).cast("long"))))
    own = F.when(F.col("hot"), F.col("n").cast("long")).otherwise(F.lit(0).cast("long"))
    sketch = lambda side: [F.col(f"s{i}").alias(f"{side}{i}") for i in range(SKETCH)]
    part = lambda name: [F.col("part").alias(name)] if "part" in right.columns else []
    within = ["within"] if "part" in right.columns else []
    a = left.withColumn("_m", other).select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), "w", "hot", own.alias("x"), F.col("_m").alias("y"), *sketch("u"), *part("pa"))
    b = right.withColumn("_m", other).select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), "w", "hot", F.col("_m").alias("x"), own.alias("y"), *sketch("v"), *part("pb"), *within)
    room = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    both = F.col("na") + F.col("nb")
    differ = reduce(lambda x, y: x + y, [F.coalesce(F.bit_count(F.col(f"u{i}").bitwiseXOR(F.col(f"v{i}"))), F.lit(0)) for i in range(SKETCH)])
    met = a.join(b, ["w", "hot", "x", "y"]).where(F.expr(which) & (F.col("na") >= least * F.col("nb")) & (F.col("nb") >= least * F.col("na")))
    # Of n + m words the share (1 - least) / (1 + least) may differ.
    return met.where((room * (1 + least) >= least * both - 1e-9) & (differ * (1 + least) <= (1 - least) * both + 1e-9)).select("a", "b").distinct()


def alike(met: DataFrame, left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard) of the pairs whose sets (id, t) are similar."""
    inter = F.size(F.array_intersect("ta", "tb"))
    pairs = met.join(left.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(right.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    return pairs.withColumn("jaccard", inter / (F.size("ta") + F.size("tb") - inter)).where(F.col("jaccard") >= least).select("a", "b", "jaccard")


def rare_phrases(df: DataFrame, id: str, text: str, share: int = 8) -> DataFrame:
    """(phrase, n): pairs of stems that at most max(3, rows / share) rows have."""
    pair = lambda w, i: F.struct(w.alias("w"), F.get("s", i + 1).alias("x"))
    pairs = F.transform(F.filter(F.transform("s", pair), lambda p: p["x"].isNotNull()), lambda p: F.concat_ws(" ", p["w"], p["x"]))
    # Every row has an empty phrase besides its own, so that rows are counted in the same pass.
    each = df.select(stems(text).alias("s")).select(F.explode(F.concat(F.array_distinct(pairs), F.array(F.lit("")))).alias("phrase"))
    counted = written(each.groupBy("phrase").agg(F.count("*").alias("n")), "phrase-counts")
    rows = counted.where("phrase = ''").first()
    return counted.where((F.col("phrase") != "") & (F.col("n") <= max(3, (rows["n"] if rows else 0) // share)))


def stem_frequency(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(F.array_distinct(stems(text))).alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))


def full_outer_merge(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Upsert: new values where there are some, old ones elsewhere, and where each row came from."""
    a, b = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns], F.lit(True).alias("_o")), new.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_n"))
    out = a.join(b, key, "full_outer")
    origin = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "old").otherwise("both")
    return out.select(key, *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in columns], origin.alias("origin"))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
