"""What to ask a search for other copies of a story, and where a site keeps its feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.functions import fixed
from skeinflow.sources.courts import entries


def _quoted(names: Column, n: int) -> Column:
    return F.array_join(F.transform(F.slice(names, 1, n), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " ")


def queries(title: Column, states: Column, names: Column, claimants: Column, respondents: Column) -> Column:
    """Up to five queries for a story, in order and each once: the parties of its record, the names in its headline, its
    States, the court, its first words; with the acts that the headline names. states and names are those of the
    headline (operators.gazetteer, operators.cluster), in order. Nulls are empty; a query has two words or more."""
    none = F.array().cast("array<string>")
    listed = lambda c: F.filter(F.coalesce(c, none), lambda x: F.coalesce(x, F.lit("")) != "")
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), "[-/]", " "), "['’]s?\\b", "")
    short = F.create_map(*[F.lit(x) for kv in fixed.SHORT_STATES.items() for x in kv])
    plain = F.array_distinct(F.transform(listed(states), lambda s: F.coalesce(F.try_element_at(short, s), s)))
    others = F.filter(plain, lambda s: ~s.isin("US", "UK"))
    told = F.when(F.size(others) > 0, F.slice(others, 1, 3)).otherwise(F.slice(plain, 1, 2))
    found = F.array_distinct(F.transform(F.regexp_extract_all(flat, F.lit(f"(?i){fixed.ACTS}"), F.lit(1)), lambda a: F.lower(a)))
    found = F.filter(found, lambda a: ~a.isin("dispute", "claim"))
    place = lambda a: F.coalesce(*[F.when(a.startswith(o[:5]), i) for i, o in enumerate(fixed.ACT_ORDER)], F.lit(99))
    acts = F.transform(F.array_sort(F.transform(found, lambda a, i: F.struct(place(a).alias("p"), i.alias("i"), a.alias("a")))), lambda s: s["a"])
    acts = F.when(F.size(acts) > 0, F.slice(acts, 1, 2)).otherwise(F.array(F.lit("arbitration")))
    act, ents = acts[0], F.array_distinct(listed(names))
    parties = F.slice(F.concat(listed(claimants), listed(respondents)), 1, 2)
    anchor = F.when(F.size(ents) > 0, _quoted(ents, 1)).otherwise(_quoted(told, 2))
    stop = F.array(*[F.lit(w) for w in fixed.STEM5_STOP])
    words = F.filter(F.regexp_extract_all(flat, F.lit("[A-Za-z][A-Za-z'-]+"), F.lit(0)), lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, F.lower(w)))
    out = F.array(
        F.when(F.size(parties) > 0, F.concat_ws(" ", _quoted(parties, 2), act)),
        F.when(F.size(ents) > 0, F.concat_ws(" ", _quoted(ents, 2), act)),
        F.when(F.size(told) >= 2, F.concat_ws(" ", _quoted(told, 2), act)).when(F.size(told) == 1, F.concat_ws(" ", _quoted(told, 1), F.array_join(acts, " "))),
        F.when(flat.rlike(r"(?i)\b(court|judge|magistrate|circuit|tribunal)\b") & (anchor != ""), F.concat_ws(" ", anchor, F.lit("court"), act)),
        F.when(F.size(words) >= 3, F.array_join(F.slice(words, 1, 6), " ")),
    )
    return F.slice(F.array_distinct(F.filter(out, lambda q: q.isNotNull() & (F.size(F.split(q, " ")) >= 2))), 1, 5)


def feed_links(html: Column, url: Column, most: int = 6) -> Column:
    """Addresses of the feeds that a page names as alternates, in order and each once, without those of comments; relative
    ones are taken from the page's address."""
    tags = F.slice(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<link\b[^>]*\btype\s*=\s*[\"']?application/(?:rss|atom)\+xml[^>]*>"), F.lit(0)), 1, most)
    href = F.transform(tags, lambda t: F.replace(F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit("&amp;"), F.lit("&")))
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.concat(origin, F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*/|/)", 1), F.lit("")), F.lit("/")))

    def absolute(h: Column) -> Column:
        joined = (
            F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(F.substring_index(url, "//", 1), h))
            .when(h.startswith("/"), F.concat(origin, h)).otherwise(F.concat(folder, F.regexp_replace(h, r"^(?:\./)+", "")))
        )
        return joined

    named = F.transform(F.filter(href, lambda h: h != ""), absolute)
    return F.array_distinct(F.filter(named, lambda u: ~F.contains(F.lower(u), F.lit("comments"))))


def feed_candidates(html: Column, url: Column) -> Column:
    """feed_links, then the usual places of a section and of the site, each once."""
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    section = F.regexp_replace(F.regexp_extract(url, r"^([^?#]*)", 1), "/+$", "")
    paths = lambda base, n: F.array(*[F.concat(base, F.lit(p)) for p in fixed.FEED_PATHS[:n]])
    own = F.when(section != origin, paths(section, 4)).otherwise(F.array().cast("array<string>"))
    return F.when(origin != "", F.array_distinct(F.concat(feed_links(html, url), own, paths(origin, len(fixed.FEED_PATHS))))).otherwise(F.array().cast("array<string>"))


def freshness(payloads: DataFrame, as_of: Column, days: int = 45, undated: int = 3, most: int = 40) -> DataFrame:
    """(name, entries, newest, fresh) of feed payloads (name, payload): fresh if the newest of the first `most` entries is
    at most `days` old, or, where none has a date, if there are `undated` entries. Payloads without entries are in no row."""
    e = entries(payloads).groupBy("name").agg(F.count("*").alias("entries"), F.max(F.when(F.col("position") < most, F.col("day"))).alias("newest"))
    return e.withColumn("fresh", F.when(F.col("newest").isNull(), F.col("entries") >= undated).otherwise(F.datediff(as_of, "newest") <= days))
