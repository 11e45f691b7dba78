"""Measurements of a corpus: distributions, shares, commonest values, and which words are lower-case in mid-sentence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions import fixed


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key: n, mean, median, p10, p90, min, max. The percentiles are the sorted value at the floor of
    p * (n - 1), which is no interpolation and no rank of percentile_disc.

    Values are counted first, so that a group is as large as its distinct values and not as its rows; the
    position of each value then comes from a running count within the key.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    up = Window.partitionBy(*keys).orderBy(value) if keys else Window.partitionBy(F.lit(0)).orderBy(value)
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = counted.withColumn("hi", F.sum("c").over(up)).withColumn("n", F.sum("c").over(whole)).withColumn("lo", F.col("hi") - F.col("c"))
    at = lambda p: F.max(F.when((F.floor(p * (F.col("n") - 1)) >= F.col("lo")) & (F.floor(p * (F.col("n") - 1)) < F.col("hi")), F.col(value)))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    here = lambda i: F.max(F.when((i >= F.col("lo")) & (i < F.col("hi")), F.col(value)))
    return ranked.groupBy(*keys).agg(
        F.max("n").alias("n"), (F.sum(F.col(value) * F.col("c")) / F.max("n")).alias("mean"), ((here(low) + here(high)) / 2.0).alias("median"),
        at(F.lit(0.1)).alias("p10"), at(F.lit(0.9)).alias("p90"), F.min(value).alias("least"), F.max(value).alias("most"),
    )


def share(condition: Column) -> Column:
    """Per cent of rows, 0 of none; not rounded."""
    n = F.count("*")
    return F.when(n > 0, 100.0 * F.count_if(condition) / n).otherwise(0.0)


def commonest(df: DataFrame, keys: Sequence[str], value: str | Column, most: int, name: str = "value") -> DataFrame:
    """(keys, name, n): the `most` commonest values of each key; ties go to the smaller value."""
    counted = df.groupBy(*keys, (F.col(value) if isinstance(value, str) else value).alias(name)).agg(F.count("*").alias("n")).where(F.col(name).isNotNull())
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), name) if keys else Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), name)
    return counted.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def word_case(df: DataFrame, text: str, least: int = 2, ratio: float = 1.5) -> DataFrame:
    """(word, low, cap): words that stand lower-case after another word `least` times or more, and at least
    `ratio` times as often as capitalised there."""
    words = df.select(F.explode(F.regexp_extract_all(text, F.lit("(?<=[a-z,] )([A-Za-z][A-Za-z'-]+)"), F.lit(1))).alias("w"))
    lower = F.lower("w")
    counted = words.groupBy(lower.alias("word")).agg(F.count_if(F.col("w") == lower).alias("low"), F.count_if(F.col("w") != lower).alias("cap"))
    return counted.where((F.col("low") >= least) & (F.col("low") >= ratio * F.col("cap")) & F.col("word").rlike("^[a-z][a-z'-]+$"))


def opening_shape(c: Column | str) -> Column:
    """How a text opens: its article, with '<Adjective>' and the noun where a described party follows; '<Name> …' for
    another capital; null for anything else."""
    t = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    described = r"^(An?|The)\s+([A-Z][\p{L}\p{N}_-]+)\s+([\p{L}\p{N}_]+)"
    article, noun = F.regexp_extract(t, described, 1), F.lower(F.regexp_extract(t, described, 3))
    return F.when(article != "", F.when(noun.isin(*fixed.DESCRIBED), F.concat(article, F.lit(" <Adjective> "), noun)).otherwise(article)).when(t.rlike("^[A-Z]"), "<Name> …")


def containing(df: DataFrame, text: Column, phrases: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, phrase, n): how many texts contain each of some phrases, of those that any does; one pass, whatever their number."""
    held = F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.coalesce(text, F.lit("")), p))
    return df.select(*keys, F.explode(held).alias("phrase")).groupBy(*keys, "phrase").agg(F.count("*").alias("n"))


def coverage(df: DataFrame, key: str, ok: Column, least: int = 5) -> DataFrame:
    """Per key: entries, good ones, and whether there are `least` good ones."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(ok).alias("good")).withColumn("enough", F.col("good") >= least)


def counters(df: DataFrame, source: str, new: Column) -> DataFrame:
    """Per source: rows found and new rows."""
    return df.groupBy(source).agg(F.count("*").alias("found"), F.count_if(new).alias("new"))


def newsletter_blocks(texts: DataFrame, id: str = "id", text: str = "text", rule: str = "-{30,}") -> DataFrame:
    """(id, line_no, section, title, url) of plain-text letters: a line in capitals before a rule of dashes names
    a section, a line 'title (url)' is an entry of the last section named."""
    lines = texts.select(id, F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line"))
    w = Window.partitionBy(id).orderBy("line_no")
    named = F.when(F.lead("line").over(w).rlike(f"^{rule}\\s*$"), F.trim("line"))
    lines = lines.withColumn("section", F.last(named, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    entry = r"^(.+?)\s+\((https?://[^)\s]+)\)\s*$"
    return lines.where(F.col("line").rlike(entry)).select(id, "line_no", "section", F.regexp_extract("line", entry, 1).alias("title"), F.regexp_extract("line", entry, 2).alias("url"))


def headline_letters(texts: DataFrame, id: str = "id", text: str = "text", section: str = "Latest Headlines") -> DataFrame:
    """(id, line_no, kind, section, headline, label, url) of letters that are lists of headlines: kind is item (an article),
    document (a download) or topic (a chain of legal topics, as headline).

    A line 'Latest headlines', 'Previous headlines' or 'Documents for download', or one that begins with 'Notable legal
    topics', names the section of what follows; before the first it is `section`. Articles outside the two sections of
    headlines count as latest; downloads are documents wherever they stand. A label is what stands in brackets or before
    a colon. What a line gives depends on itself and on the last section line before it, so a letter is a running last
    value over its lines. Null texts have no lines.
    """
    lines = texts.select(id, F.posexplode(F.split(text, "\n")).alias("line_no", "raw")).withColumn("s", F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")).where("s <> ''")
    low = F.lower("s")
    named = F.when(low.isin("latest headlines", "previous headlines", "documents for download"), F.initcap(low)).when(low.startswith("notable legal topics"), "Notable legal topics")
    w = Window.partitionBy(id).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("named", named).withColumn("section", F.coalesce(F.last("named", ignorenulls=True).over(w), F.lit(section))).where("named IS NULL")
    chain = F.regexp_replace(F.regexp_replace("s", r"\s*\(As discussed here.*$", ""), r"\s*\(https?://[^)]*\)", "")
    chain = F.btrim(F.regexp_replace(F.regexp_replace(chain, r"(?U)\s+", " "), r"\s*>\s*", " > "), F.lit(" )"))
    topic = (F.col("section") == "Notable legal topics") & F.contains("s", F.lit(" > "))
    title, url = F.trim(F.regexp_extract("s", fixed.LETTER_ITEM, 1)), F.regexp_extract("s", fixed.LETTER_ITEM, 2)
    kind = F.when(topic, "topic").when(F.contains(url, F.lit("/articles/")), "item").when(F.contains(url, F.lit("download.php")), "document")
    mark = F.regexp_extract(title, fixed.LETTER_LABEL, 1)
    labelled = (F.col("kind") == "item") & (mark != "") & (F.length(mark) < 26)
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").select(
        id, "line_no", "kind",
        F.when(topic, F.col("section")).when(F.col("kind") == "document", "Documents").when(F.col("section").isin("Latest Headlines", "Previous Headlines"), F.col("section")).otherwise("Latest Headlines").alias("section"),
        F.when(topic, chain).when(labelled, F.trim(F.regexp_replace(title, fixed.LETTER_LABEL, ""))).otherwise(title).alias("headline"),
        F.when(labelled, F.btrim(mark, F.lit("[]: "))).otherwise("").alias("label"), F.when(topic, "").otherwise(url).alias("url"),
    )


def briefing_letters(texts: DataFrame, id: str = "id", text: str = "text", section: str = "Today's Headlines") -> DataFrame:
    """(id, block, section, headline, url, blurb, date) of letters whose stories stand between rules of dashes.

    A line in capitals among the first four of a block, of six words at most and perhaps with a date, names the section
    from there on; what stands above it is no story. The first line left is the headline, the first link in brackets its
    url, the other lines its blurb. A block with neither, or of a footer, is none; one that begins with an invitation to
    subscribe ends the letter. date is the last one that a section line of the letter has. Null texts have no blocks.
    """
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    some = lambda ls: F.transform(ls, lambda x: trim(x) != "")

    def without_blank_ends(ls: Column) -> Column:
        first = F.array_position(some(ls), True)
        last = F.size(ls) - F.array_position(F.reverse(some(ls)), True) + 1
        return F.when(first > 0, F.slice(ls, first.cast("int"), (last - first + 1).cast("int"))).otherwise(F.array().cast("array<string>"))

    def without_blank_start(ls: Column) -> Column:
        first = F.array_position(some(ls), True)
        return F.when(first > 0, F.slice(ls, first.cast("int"), F.size(ls))).otherwise(F.array().cast("array<string>"))

    dated = r"(\d{1,2})\s+([A-Z][a-z]+)\s+(\d{4})$"
    bare = lambda x: F.regexp_replace(trim(x), r"\s+\d{1,2}\s+[A-Z][a-z]+\s+\d{4}$", "")
    names = lambda x: (x != "") & ~x.startswith("[") & (x == F.upper(x)) & x.rlike("[A-Z]{3}") & (F.size(F.split(x, r"\s+")) <= 6)
    b = texts.select(id, F.posexplode(F.split(text, fixed.LETTER_RULE)).alias("block", "t"))
    b = b.select(id, "block", without_blank_ends(F.split("t", "\n")).alias("ls")).where(F.size("ls") > 0)
    at = F.array_max(F.transform(F.slice("ls", 1, 4), lambda x, i: F.when(names(bare(x)), i)))
    b = b.withColumn("at", at).withColumn("head", F.when(F.col("at").isNotNull(), trim(F.get("ls", "at"))))
    name = trim(F.regexp_replace("head", dated, ""))
    # Each run of letters with a capital, as in headings, but not the s after an apostrophe.
    told = F.array_join(F.transform(F.regexp_extract_all(name, F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), lambda x: F.initcap(F.lower(x))), "")
    told = F.replace(F.replace(told, F.lit("'S"), F.lit("'s")), F.lit("’S"), F.lit("’s"))
    day = F.try_to_date(F.concat_ws(" ", *[F.regexp_extract("head", dated, n) for n in (1, 2, 3)]), "d MMMM yyyy")
    b = b.withColumns({"own": told, "day": day, "ls": without_blank_start(F.when(F.col("at").isNotNull(), F.slice("ls", F.col("at") + 2, F.size("ls"))).otherwise(F.col("ls")))})
    b = b.withColumn("headline", trim(F.get("ls", F.lit(0))))
    whole = Window.partitionBy(id)
    b = b.withColumn("stop", F.min(F.when(F.col("headline").startswith("Subscribe"), F.col("block"))).over(whole)).where("stop is null or block <= stop")
    order = Window.partitionBy(id).orderBy("block")
    so_far, all_ = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    b = b.withColumns({"section": F.coalesce(F.last("own", ignorenulls=True).over(so_far), F.lit(section)), "date": F.last("day", ignorenulls=True).over(all_)})
    rest = F.transform(F.slice("ls", 2, F.greatest(F.size("ls"), F.lit(1))), trim)
    link = F.get(F.filter(rest, lambda x: x.startswith("[http") & x.endswith("]")), F.lit(0))
    blurb = F.btrim(F.regexp_replace(F.array_join(F.filter(rest, lambda x: (x != "") & ~x.startswith("[")), " "), r"(?U)\s+", " "))
    footer = F.col("headline").startswith("[") | reduce(lambda x, y: x | y, [F.col("headline").startswith(f) for f in fixed.LETTER_FOOTER])
    out = b.where(F.size("ls") > 0).where(~footer).withColumns({"url": F.coalesce(F.substr(link, F.lit(2), F.length(link) - 2), F.lit("")), "blurb": blurb})
    return out.where("url <> '' or blurb <> ''").select(id, "block", "section", "headline", "url", "blurb", "date")
