"""Court lists, from payloads (name, source, country, lang, event_type, what, query, place, payload) as sources.origins gives them.

Entries of RSS and Atom come in one shape; each reader then takes apart what its
court puts into a title. Rows have the columns of payloads.RAW, and name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.functions import fixed
from skeinflow.functions import text as T
from skeinflow.operators.identity import first_of
from skeinflow.sources.payloads import one_or_many, parties, within

ENTRIES = (
    "channel struct<item: array<struct<title: string, link: string, description: string, pubDate: string, date: string, updated: string, author: string, source: struct<_VALUE: string, _url: string>>>>, "
    "entry array<struct<title: string, link: array<struct<_href: string, _rel: string>>, summary: string, content: string, published: string, updated: string, author: array<struct<name: string>>, "
    "source: struct<title: string>>>"
)


def date_of(*columns: Column) -> Column:
    """The first of some texts that is a date, in the forms of RSS and Atom. Times with a zone are taken as of UTC."""
    out = []
    for c in columns:
        bare = F.regexp_replace(F.trim(c), r"^\w{3}, ", "")
        stamp = F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z")])
        zoned = F.try_to_timestamp(F.when(F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}T"), F.trim(c)))
        out += [F.to_date(F.to_utc_timestamp(F.coalesce(stamp, zoned), F.current_timezone())), F.try_to_date(F.substring(F.trim(c), 1, 10), "yyyy-MM-dd")]
    return F.coalesce(*out)


def entries(payloads: DataFrame) -> DataFrame:
    """The payloads' columns without payload, with position, title, url, summary, outlet, author and day of every entry of
    an RSS or Atom feed. An entry's day is when it was published, else when it was updated; of an Atom entry's links the
    alternate one counts. A payload that is no feed gives no rows."""
    rest = [c for c in payloads.columns if c != "payload"]
    # The default name space and those of prefixes are dropped, for feeds differ in them and not in the rest.
    plain = F.regexp_replace(F.regexp_replace("payload", r"(</?)(?:dc|atom|a10):", "$1"), r"\sxmlns(?::\w+)?=\"[^\"]*\"", "")
    read = payloads.withColumn("_f", F.from_xml(plain, ENTRIES))
    rss = read.select(*rest, F.posexplode("_f.channel.item").alias("position", "x")).select(
        *rest, "position", F.col("x.title").alias("title"), F.col("x.link").alias("url"), F.col("x.description").alias("summary"), F.col("x.source._VALUE").alias("outlet"),
        F.col("x.author").alias("author"), date_of(F.col("x.pubDate"), F.col("x.date"), F.col("x.updated")).alias("day"),
    )
    links = F.coalesce("x.link", F.expr("cast(array() as array<struct<_href:string,_rel:string>>)"))
    alternate = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    atom = read.select(*rest, F.posexplode("_f.entry").alias("position", "x")).select(
        *rest, "position", F.col("x.title").alias("title"), F.coalesce(F.get(alternate, F.lit(0))["_href"], F.get(links, F.lit(0))["_href"]).alias("url"),
        F.coalesce(F.when(F.trim("x.summary") != "", F.col("x.summary")), F.col("x.content")).alias("summary"), F.col("x.source.title").alias("outlet"),
        F.get(F.col("x.author.name"), F.lit(0)).alias("author"), date_of(F.col("x.published"), F.col("x.updated")).alias("day"),
    )
    both = rss.unionByName(atom)
    return both.withColumns({"title": T.html_text("title"), "url": F.trim("url"), "summary": T.html_text("summary"), "author": F.trim("author")})


def feed(payloads: DataFrame, as_of: Column, days: int, relevant: Column | None = None) -> DataFrame:
    """Entries of the window, or without a date, as raw rows."""
    out = entries(payloads).where(within(F.col("day"), as_of, days)).withColumn("published_at", F.col("day").cast("string"))
    out = out.withColumn("lang", F.coalesce("lang", T.language(F.concat_ws(" ", "title", "summary"))) if "lang" in payloads.columns else T.language(F.concat_ws(" ", "title", "summary")))
    out = out.drop("day", "position", "author")
    return out if relevant is None else out.where(relevant)


def spoken_date(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "d MMMM yyyy"), F.lit("an unrecorded date"))


def kind(text: Column, default: str = "commercial_dispute", what: str = "arbitration-related judgment", kinds: Sequence[tuple[str, str, str]] = fixed.COURT_KINDS) -> Column:
    """struct(event_type, what) of the first of some kinds (pattern, event type, description) that a text matches."""
    out = F.struct(F.lit(default).alias("event_type"), F.lit(what).alias("what"))
    for pattern, event, label in reversed(list(kinds)):
        out = F.when(F.coalesce(text, F.lit("")).rlike(f"(?iu){pattern}"), F.struct(F.lit(event).alias("event_type"), F.lit(label).alias("what"))).otherwise(out)
    return out


def _rows(df: DataFrame, court: Column, country: Column, title: Column, ref: Column, day: Column, summary: Column, kind_: Column, lang: Column) -> DataFrame:
    sides = F.transform(parties(title), lambda x: F.btrim(x, F.lit(" ,;")))
    both = F.size(sides) == 2
    return df.select(
        "name", F.left(title, F.lit(300)).alias("title"), "url", F.concat(F.lit("Court: "), country).alias("source"), F.left(summary, F.lit(2000)).alias("summary"),
        day.cast("string").alias("published_at"), kind_["event_type"].alias("event_type"), F.when(ref != "", ref).alias("case_ref"),
        F.filter(F.slice(sides, 1, 1), lambda x: x != "").alias("claimants"), F.when(both, F.slice(sides, 2, 1)).otherwise(F.array().cast("array<string>")).alias("respondents"),
        F.concat(court, F.lit(": "), kind_["what"]).alias("flag_reason"), lang.alias("lang"), country.alias("country"),
    )


def searched(payloads: DataFrame, as_of: Column, days: int, base: str, codes: dict[str, str] = fixed.COURT_CODES) -> DataFrame:
    """Atom results of a judgment search (England and Wales): each payload answers one query, the first of which (by place)
    that finds a judgment labels it. base is the site whose addresses have court, year and number; codes are its courts."""
    e = entries(payloads).where(within(F.col("day"), as_of, days)).where("url <> ''")
    court = F.coalesce(F.when(F.col("author") != "", F.col("author")), F.lit("Court"))
    e = e.withColumn("_court", court).where(~court.rlike("Family|Crim|Tribunal|Administrative|Immigration|Employment|Magistrates"))
    e = first_of(e, "url", "place", "position")
    part = lambda n: F.regexp_extract("url", rf"\Q{base}\E/([a-z]+(?:/[a-z]+)?)/(\d{{4}})/(\d+)", n)
    known = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    code = F.coalesce(F.try_element_at(known, part(1)), F.upper(F.replace(part(1), F.lit("/"), F.lit(" "))))
    # A division stands after the number: [2026] EWHC 123 (Comm).
    cited = F.when(F.contains(code, F.lit("(")), F.concat(F.lit("["), part(2), F.lit("] "), F.substring_index(code, " ", 1), F.lit(" "), part(3), F.lit(" "), F.substring_index(code, " ", -1)))
    cited = F.when(part(1) == "", "").otherwise(F.coalesce(cited, F.concat(F.lit("["), part(2), F.lit("] "), code, F.lit(" "), part(3))))
    query = F.replace(F.regexp_replace("query", '^([^"]*)"', "$1‘"), F.lit('"'), F.lit("’"))
    told = F.concat(F.lit("Judgment of the "), "_court", F.lit(" handed down on "), spoken_date(F.col("day")), F.when(cited != "", F.concat(F.lit(", "), cited)).otherwise(""), F.lit(". Found by the Find Case Law search for "), query, F.lit("."))
    label = F.struct(F.col("event_type"), F.coalesce("what", F.lit("arbitration-related judgment")).alias("what"))
    return _rows(e, F.col("_court"), F.coalesce("country", F.lit("England and Wales")), F.col("title"), cited, F.col("day"), told, label, F.lit("en"))


def catchwords(payloads: DataFrame, as_of: Column, days: int, courts: dict[str, str] = fixed.CATCHWORD_COURTS) -> DataFrame:
    """A feed of judgments with catchwords (Singapore): those with a group that begins with arbitration. The title has the
    case name, the year, the court's letters and the number; the date of the decision stands after the catchwords."""
    e = entries(payloads)
    words, tail = F.substring_index("summary", "| Decision Date:", 1), F.regexp_extract("summary", r"(?s)\| Decision Date:(.*)$", 1)
    groups = F.transform(F.split(words, ";"), lambda g: F.trim(g))
    decided = F.try_to_date(F.regexp_extract(tail, r"(\d{1,2} \w{3} \d{4})", 1), "d MMM yyyy")
    e = e.where(F.exists(groups, lambda g: F.lower(g).startswith("arbitration"))).withColumn("_day", F.coalesce(decided, "day"))
    e = e.where(within(F.col("_day"), as_of, days))
    part = lambda n: F.regexp_extract("title", r"^(.+?)\s+\[(\d{4})\]\s+(SG[A-Z]+(?:\([A-Z]\))?)\s+(\d+)\s*$", n)
    cited = F.when(part(1) != "", F.concat(F.lit("["), part(2), F.lit("] "), part(3), F.lit(" "), part(4))).otherwise("")
    known = F.create_map(*[F.lit(x) for kv in courts.items() for x in kv])
    court = F.when(part(1) != "", F.coalesce(F.try_element_at(known, part(3)), part(3))).otherwise("Singapore courts")
    told = F.concat(court, F.lit(" decided on "), spoken_date(F.col("_day")), F.when(cited != "", F.concat(F.lit(", "), cited)).otherwise(""), F.lit(". Catchwords: "), F.array_join(groups, "; "), F.lit("."))
    name = F.when(part(1) != "", part(1)).otherwise(F.col("title"))
    e = e.withColumn("url", F.replace("url", F.lit(" "), F.lit("%20")))
    return _rows(e, court, F.coalesce("country", F.lit("Singapore")), name, cited, F.col("_day"), told, kind(words, "annulment_setaside", "recourse against an award"), F.lit("en"))


def ecli_list(payloads: DataFrame, as_of: Column, days: int) -> DataFrame:
    """An Atom list of decisions (Netherlands) whose titles have an ECLI, the court, a date and a case number: those whose
    title or summary speaks of arbitration."""
    e = entries(payloads).where(F.concat_ws(" ", "title", "summary").rlike("(?iu)arbitr|scheidsgerecht|scheidsrechter|arbitraal|arbitrage"))
    part = lambda n: F.regexp_extract("title", r"^(ECLI:NL:[A-Z]+:\d{4}:\d+),\s*([^,]+),\s*(\d{2}-\d{2}-\d{4})(?:,\s*(.+))?$", n)
    decided = F.try_to_date(part(3), "dd-MM-yyyy")
    e = e.where(within(F.coalesce("day", decided), as_of, days))
    court = F.when(part(1) != "", part(2)).otherwise("Dutch court")
    told = F.concat(court, F.lit(", uitspraak van "), spoken_date(F.coalesce(decided, F.col("day"))), F.when(part(1) != "", F.concat(F.lit(" ("), part(1), F.lit(")"))).otherwise(""), F.lit(". "), "summary")
    title = F.concat(court, F.when(part(4) != "", F.concat(F.lit(" · "), part(4))).otherwise(""))
    return _rows(e, court, F.coalesce("country", F.lit("Netherlands")), title, part(1), F.coalesce("day", decided), told, kind(F.col("summary")), F.lit("nl"))


def nested(payloads: DataFrame, as_of: Column, days: int, path: str, element: str, court: str, title: str, ref: str, date: str, url: str, summary: str, keep: str) -> DataFrame:
    """JSON results whose records are an object where there is one and a list where there are more (Austria, Switzerland).
    Names are those of the element's fields, dotted where they are nested."""
    r = payloads.select(*[c for c in payloads.columns if c != "payload"], F.explode(one_or_many(F.col("payload"), path, element)).alias("r"))
    at = lambda c: F.col(f"r.{c}")
    day = F.coalesce(F.try_to_date(F.trim(at(date)), "yyyy-MM-dd"), F.try_to_date(F.trim(at(date)), "dd.MM.yyyy"))
    r = r.where(F.concat_ws(" ", at(title), at(summary)).rlike(f"(?iu){keep}") & within(day, as_of, days)).withColumn("url", at(url))
    text = T.html_text(at(summary))
    return _rows(r, at(court), F.coalesce("country", F.lit("")), T.squeeze(at(title)), F.coalesce(at(ref), F.lit("")), day, text, kind(text), F.coalesce("lang", F.lit("de")))
