"""Payloads already fetched, read as raw rows: title, url, source, summary, published_at and what else a source knows.

Each parser takes a table with a payload column (JSON, XML, HTML or text) and
gives rows of one shape; rows() brings several together. Windows are parameters
(as_of and days); a payload that can't be parsed gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions import text as T
from skeinflow.operators.appoint import person, treaty

RAW = (
    "title string, url string, source string, summary string, published_at string, event_type string, institution string, treaty string, case_ref string, "
    "sectors array<string>, claimants array<string>, respondents array<string>, states array<string>, counsel array<string>, arbitrators array<string>, "
    "amount_usd double, flag_reason string, lang string, country string"
)


def rows(df: DataFrame) -> DataFrame:
    """df with the columns of RAW, those it lacks null."""
    kinds = dict(x.rsplit(" ", 1) for x in RAW.split(", "))
    return df.select(*[(F.col(c).cast(k) if c in df.columns else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()])


def registry(sources: dict[str, tuple[Callable[[], DataFrame], int]], enabled: dict[str, bool] | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """All sources (name to a builder and its tier) as one table with name and tier; settings may turn one off."""
    chosen = [(n, f, tier) for n, (f, tier) in sources.items() if (enabled or {}).get(n, True) and (only is None or n in only)]
    parts = [rows(f()).withColumns({"adapter": F.lit(n), "source_tier": F.lit(tier)}) for n, f, tier in chosen]
    return reduce(DataFrame.unionByName, parts)


def feeds(spark: SparkSession, settings: dict) -> DataFrame:
    """(name, url, lang, country, gated) of the feeds that settings (a parsed configuration) turn on: those of `rss` as they
    are, those of `national_press` under name and country and gated, which means that only relevant items are kept."""
    on = lambda f: bool(f.get("url")) and f.get("enabled", True)
    out = [(f.get("name") or f["url"], f["url"], f.get("lang"), f.get("country"), bool(f.get("filter"))) for f in settings.get("rss") or [] if on(f)]
    out += [(f"{f['name']} ({f['country']})", f["url"], f.get("lang", "en"), f["country"], True) for f in settings.get("national_press") or [] if on(f)]
    return spark.createDataFrame(out, "name string, url string, lang string, country string, gated boolean")


def within(day: Column, as_of: Column, days: int, undated: bool = True) -> Column:
    """Whether a date is in the window; undated rows are kept or not."""
    return F.coalesce((day >= F.date_sub(as_of, days)) & (day <= as_of), F.lit(undated))


def _json(column: str, schema: str) -> Column:
    return F.from_json(F.col(column), schema)


FEED = (
    "channel struct<item: array<struct<title: string, link: string, description: string, pubDate: string, source: struct<_VALUE: string, _url: string>>>>"
)


def feed(payloads: DataFrame, as_of: Column, days: int, relevant: Column | None = None) -> DataFrame:
    """RSS payloads (source, payload): one row for each entry of the window or without a date."""
    e = payloads.select("source", F.explode(F.from_xml("payload", FEED)["channel"]["item"]).alias("e"))
    day = F.coalesce(*[F.try_to_timestamp(F.regexp_replace("e.pubDate", "^\\w{3}, ", ""), F.lit(f)).cast("date") for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z")], F.try_to_date(F.substring("e.pubDate", 1, 10)))
    out = e.select(
        "source", F.trim("e.title").alias("title"), F.trim("e.link").alias("url"), T.html_text("e.description").alias("summary"), day.cast("string").alias("published_at"),
        F.col("e.source._VALUE").alias("outlet"), day.alias("day"),
    )
    out = out.where(within(F.col("day"), as_of, days)).withColumn("lang", T.language(F.concat_ws(" ", "title", "summary"))).drop("day")
    return out if relevant is None else out.where(relevant)


def collapse_sweep(found: DataFrame, *order: Column | str) -> DataFrame:
    """Search results without repeats of a headline under another outlet; the first in order stays."""
    from skeinflow.operators.identity import first_of

    return first_of(found.withColumn("_key", T.outlet_key("title")), "_key", *order).drop("_key")


CASES = (
    "array<struct<caseno: string, casetitle: string, econsector: string, instrumentinvk1: string, instrumentinvk2: string, caseproceedings: array<struct<"
    "claimant: string, respondent: string, arbitrators: string, president: string, dateregistered: string, dateconstituted: string, lastproc: string, "
    "reconstituted: string, clmnt_nationality: string, resp_nationality: string>>>>"
)


def case_register(payloads: DataFrame) -> DataFrame:
    """Register payloads (status, payload: a JSON list of cases) as cases with _status."""
    return payloads.select(F.explode(_json("payload", CASES)).alias("c"), F.col("status").alias("_status")).select("c.*", "_status")


def _step(text: Column) -> Column:
    t = F.lower(text)
    has = lambda *w: reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in w])
    return (
        F.when(has("annul", "ad hoc committee"), "annulment_setaside").when(has("award") & has("render", "issue", "dispatch"), "award_issued")
        .when(has("constituted", "appoint"), "tribunal_constituted").when(has("discontinu", "settle"), "award_issued").otherwise("commentary")
    )


def docket_events(cases: DataFrame, as_of: Column, days: int, url: str = "case/") -> DataFrame:
    """Two events of each proceeding where they fall into the window: its registration, and its last step (a
    date, a dash and a text) unless that is of the same day."""
    p = cases.select("*", F.explode("caseproceedings").alias("p"))
    date = lambda s: F.try_to_date(F.trim(s), "MMMM d, yyyy")
    registered, last = date(F.col("p.dateregistered")), date(F.regexp_extract("p.lastproc", "^([A-Za-z]+ \\d{1,2}, \\d{4})\\s*-", 1))
    text = T.squeeze(F.regexp_extract("p.lastproc", "(?s)^[A-Za-z]+ \\d{1,2}, \\d{4}\\s*-\\s*(.*)$", 1))
    events = F.array(
        F.struct(registered.alias("day"), F.lit("new_case_filed").alias("event_type"), F.lit("registered").alias("step")),
        F.when(~F.coalesce(registered == last, F.lit(False)), F.struct(last.alias("day"), _step(text).alias("event_type"), text.alias("step"))),
    )
    e = p.withColumn("e", F.explode(F.filter(events, lambda x: x["day"].isNotNull()))).where(within(F.col("e.day"), as_of, days, undated=False))
    firms = lambda c: F.transform(T.html_list(F.col(c)), lambda x: F.trim(F.substring_index(x, ",", 1)))
    return e.select(
        F.concat_ws(" — ", T.html_text("casetitle"), F.concat_ws(" ", F.lit("Case"), "caseno"), "e.step").alias("title"), F.concat(F.lit(url), F.col("caseno")).alias("url"),
        F.lit("case docket").alias("source"), F.col("e.day").cast("string").alias("published_at"), "e.event_type", F.col("caseno").alias("case_ref"),
        treaty(F.col("instrumentinvk1"), F.col("instrumentinvk2")).alias("treaty"), F.array_compact(F.array("econsector")).alias("sectors"),
        F.filter(F.array(T.html_text("p.resp_nationality")), lambda x: x != "").alias("states"), F.concat(firms("p.claimant"), firms("p.respondent")).alias("counsel"),
        F.transform(F.concat(T.html_list("p.arbitrators"), T.html_list("p.president")), lambda x: person(F.regexp_extract(x, "^[^(]*", 0))).alias("arbitrators"),
    )


FILINGS = "hits struct<hits: array<struct<_id: string, _source: struct<file_type: string, ciks: array<string>, display_names: array<string>, form: string, file_date: string>>>>"


def filings(payloads: DataFrame, as_of: Column, days: int, base: str = "filings/") -> DataFrame:
    """Full-text search hits, without contract and organisation exhibits, one row for each document."""
    h = payloads.select(F.explode(_json("payload", FILINGS)["hits"]["hits"]).alias("h")).select("h._id", "h._source.*").dropDuplicates(["_id"])
    h = h.where(~F.coalesce("file_type", F.lit("")).rlike("^EX-(10|2|3|4)(\\.|$)")).where(within(F.try_to_date("file_date"), as_of, days, undated=False))
    name = F.regexp_replace(F.get("display_names", F.lit(0)), "\\s*\\((?:[A-Z., -]+\\)\\s*)?\\(?CIK.*$|\\s*\\([A-Z., -]+\\)\\s*$", "")
    return h.select(
        F.concat_ws(" ", name, F.lit("discloses a dispute in its"), "form").alias("title"),
        F.concat(F.lit(base), F.regexp_replace(F.substring_index("_id", ":", 1), "-", ""), F.lit("/"), F.substring_index("_id", ":", -1)).alias("url"),
        F.lit("filings").alias("source"), F.col("file_date").alias("published_at"), F.array(name).alias("respondents"),
    )


def passage(text: Column, phrase: str, signal: str, clause: str, before: int = 260, after: int = 220) -> Column:
    """The text around the first occurrence of a phrase that a signal stands in and no contract clause, up to 700
    characters; occurrences are met in order by splitting at the phrase, so none is looked for twice."""
    low = F.regexp_extract_all(text, F.lit(f"(?is)(?:(?<=\\. )|^)[^.]{{0,{before}}}\\Q{phrase}\\E.{{0,{after}}}[^.]*\\.?"), F.lit(0))
    good = F.filter(F.transform(low, lambda x: T.squeeze(x)), lambda x: x.rlike(f"(?i){signal}") & ~F.substring(x, 1, 200).rlike(f"(?i){clause}") & (F.length(x) > 80))
    return F.substring(F.coalesce(F.get(good, F.lit(0)), F.lit("")), 1, 700)


def disclosures(
    payloads: DataFrame, documents: DataFrame, as_of: Column, days: int, queries: Sequence[str], signal: str, clause: str, base: str = "https://www.sec.gov/Archives/edgar/data/"
) -> DataFrame:
    """Filings whose own text discloses what was searched for. payloads: query and payload (search hits); documents: url
    and text, what was fetched of them. A hit whose document is missing, or has no passage with the query's first phrase
    that `signal` stands in and no contract clause, is none. A document that several queries find counts for the first."""
    h = payloads.where(F.col("query").isin(*queries)).select("query", F.explode(_json("payload", FILINGS)["hits"]["hits"]).alias("h")).select("query", "h._id", "h._source.*")
    h = h.where(~F.upper(F.coalesce("file_type", F.lit(""))).rlike("^EX-(?:10|2|3|4)") & within(F.try_to_date("file_date"), as_of, days, undated=False))
    bare = F.regexp_replace(F.substring_index("_id", ":", 1), "-", "")
    h = h.withColumn("url", F.concat(F.lit(base), F.ltrim(F.coalesce(F.get("ciks", F.lit(0)), F.lit("0")), F.lit("0")), F.lit("/"), bare, F.lit("/"), F.substring_index("_id", ":", -1)))
    texts = documents.where("text IS NOT NULL").groupBy("url").agg(F.min("text").alias("text"))
    h = h.join(texts, "url")
    found, place = F.lit(""), F.lit(len(queries))
    for i, q in reversed(list(enumerate(queries))):
        found = F.when(F.col("query") == q, passage(F.col("text"), q.split('" "')[0].strip('"'), signal, clause)).otherwise(found)
        place = F.when(F.col("query") == q, i).otherwise(place)
    h = h.withColumns({"quoted": found, "place": place}).where("quoted <> ''")
    h = h.groupBy("url").agg(F.min_by(F.struct(*[c for c in h.columns if c not in ("url", "text")]), F.struct("place", "_id")).alias("x")).select("url", "x.*")
    told = F.substring_index(F.coalesce(F.get("display_names", F.lit(0)), F.lit("Unknown filer")), "  (", 1)
    filer = F.when((F.upper(told) == told) & (F.lower(told) != told), F.replace(F.initcap(F.lower(told)), F.lit(" Llc"), F.lit(" LLC"))).otherwise(told)
    asked = F.replace(F.btrim("query", F.lit('"')), F.lit('" "'), F.lit(" and "))
    first = F.substring_index(F.btrim("query", F.lit('"')), '" "', 1)
    day = F.coalesce(F.date_format(F.try_to_date("file_date"), "d MMMM yyyy"), "file_date")
    return h.select(
        F.concat(filer, F.lit(" discloses "), asked, F.lit(" in "), F.coalesce("form", F.lit("SEC")), F.lit(" filing")).alias("title"), "url", F.lit("SEC EDGAR").alias("source"),
        F.concat(F.lit("In a "), "form", F.lit(" filed on "), day, F.lit(", "), filer, F.lit(" disclosed: “"), "quoted", F.lit("”")).alias("summary"), F.col("file_date").alias("published_at"),
        F.substring_index("_id", ":", 1).alias("case_ref"), F.concat(F.lit("SEC "), "form", F.lit(" filing text contains ‘"), first, F.lit("’")).alias("flag_reason"), F.array(filer).alias("respondents"),
    )


DOCKETS = "results array<struct<caseName: string, docket_absolute_url: string, court: string, docketNumber: string, dateFiled: string, party: array<string>, firm: array<string>, recap_documents: array<struct<description: string>>>>"
GOVERNMENT = r"(?i)\bunited states\b|department of|\bu\.?s\.?a?\b|attorney general|commissioner|\bunion\b|\blocal \d+"


def federal_dockets(payloads: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Docket search results without those whose parties are government or unions only; payloads: family, payload."""
    d = payloads.select("family", F.explode(_json("payload", DOCKETS)["results"]).alias("d")).select("family", "d.*").dropDuplicates(["docket_absolute_url"])
    parties = F.filter(F.coalesce("party", F.array().cast("array<string>")), lambda p: ~p.rlike(GOVERNMENT))
    sides = F.split("caseName", r"(?i)\s+v\.?\s+", 2)
    d = d.where((F.size(parties) > 0) & within(F.try_to_date("dateFiled"), as_of, days, undated=False))
    return d.select(
        F.concat_ws(", ", "caseName", "court", "docketNumber").alias("title"), F.col("docket_absolute_url").alias("url"), F.concat(F.lit("US federal docket / "), F.col("family")).alias("source"),
        F.get(F.col("recap_documents.description"), F.lit(0)).alias("summary"), F.col("dateFiled").alias("published_at"), F.slice(sides, 1, 1).alias("claimants"), F.slice(sides, 2, 1).alias("respondents"),
        F.slice(F.array_distinct("firm"), 1, 6).alias("counsel"), F.col("docketNumber").alias("case_ref"), F.lit("United States").alias("country"),
    )


def parties(title: Column) -> Column:
    """The two sides of a case name, in six languages of court lists; one side where there is no versus."""
    return F.transform(F.split(title, r"(?i)\s+(?:v\.?|vs\.?|c\.|contre|gegen|tegen)\s+", 2), lambda x: F.trim(x))


def one_or_many(payload: Column, path: str, element: str) -> Column:
    """An array from a JSON value that is an object in some payloads and a list in others."""
    value = F.get_json_object(payload, path)
    return F.when(F.ltrim(value).startswith("["), F.from_json(value, f"array<{element}>")).otherwise(F.array_compact(F.array(F.from_json(value, element))))


def judgments(payloads: DataFrame, as_of: Column, days: int, path: str, element: str, fields: dict[str, str], keep: str, country: str, source: str) -> DataFrame:
    """Court search results of any of the readers: where the records stand, what their fields are called (title,
    url, date, summary), which pattern keeps a row."""
    r = payloads.select(F.explode(one_or_many(F.col("payload"), path, element)).alias("r"))
    get = lambda name: F.col(f"r.{fields[name]}") if name in fields else F.lit(None).cast("string")
    day = F.coalesce(*[F.try_to_date(F.trim(get("date")), f) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "d MMMM yyyy", "dd/MM/yyyy")], F.try_to_date(F.substring(get("date"), 1, 10)))
    text = F.concat_ws(" ", get("title"), get("summary"))
    two = parties(get("title"))
    return r.where(text.rlike(f"(?iu){keep}") & within(day, as_of, days)).select(
        T.squeeze(get("title")).alias("title"), get("url").alias("url"), F.lit(f"Court: {source}").alias("source"), T.html_text(get("summary")).alias("summary"),
        day.cast("string").alias("published_at"), F.slice(two, 1, 1).alias("claimants"), F.slice(two, 2, 1).alias("respondents"), F.lit(country).alias("country"),
    )


DATED = r"(\d{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) \d{4})"


def register_pages(pages: DataFrame, notice: str = "notice of (?:intent|dispute|arbitration)") -> DataFrame:
    """Government register pages (url, html): the sentence with the latest date on each, as an event."""
    s = pages.select("url", F.explode(T.sentences(T.html_text("html"))).alias("s")).withColumn("d", F.try_to_date(F.regexp_extract("s", DATED, 1), "d MMMM yyyy")).where("d IS NOT NULL")
    last = s.groupBy("url").agg(F.max_by("s", F.struct("d", "s")).alias("title"), F.max("d").alias("d"))
    return last.select(
        "title", "url", F.lit("government register").alias("source"), F.col("d").cast("string").alias("published_at"),
        F.when(F.col("title").rlike(f"(?i){notice}"), "notice_of_intent").otherwise("new_case_filed").alias("event_type"),
    )


def first_leaf(value: Column, depth: int = 4) -> Column:
    """The first text in JSON that nests language maps and lists: English where a map has it, else the first entry."""
    for _ in range(depth):
        as_map = F.from_json(value, "map<string,string>")
        as_list = F.from_json(value, "array<string>")
        pick = F.coalesce(F.try_element_at(as_map, F.lit("eng")), F.try_element_at(as_map, F.lit("ENG")), F.get(F.map_values(as_map), F.lit(0)), F.lit(""))
        value = F.when(F.ltrim(value).startswith("{"), pick).when(F.ltrim(value).startswith("["), F.coalesce(F.get(as_list, F.lit(0)), F.lit(""))).otherwise(F.regexp_replace(value, '^"|"$', ""))
    return F.coalesce(value, F.lit(""))


# What marks a tender as international, and as one for legal services.
INTERNATIONAL = (
    "international arbitration", "investment treaty", "investment arbitration", "icsid", "uncitral", "bilateral investment", "arbitrage international",
    "arbitraje internacional", "arbitrato internazionale", "investor-state", "міжнародн", "інвестиційн",
)
LEGAL = ("legal", "juridique", "jurídic", "юридичн", "адвокат", "arbitr", "арбітраж", "представництв")
UAH_PER_USD, LEAST_USD = 41.5, 50_000


def _any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def tenders_union(payloads: DataFrame) -> DataFrame:
    """Notices of the European journal: legal ones; those without an international mark are commentary only."""
    n = payloads.select(F.explode(F.from_json(F.get_json_object("payload", "$.notices"), "array<string>")).alias("n"))
    leaf = lambda name: first_leaf(F.get_json_object("n", f"$['{name}']"))
    n = n.select(
        F.get_json_object("n", "$['publication-number']").alias("case_ref"), leaf("notice-title").alias("t"), leaf("buyer-name").alias("b"), leaf("buyer-country").alias("c"),
        first_leaf(F.get_json_object("n", "$.links.html")).alias("url"), F.substring(F.get_json_object("n", "$['publication-date']"), 1, 10).alias("published_at"),
    ).where("case_ref IS NOT NULL").dropDuplicates(["case_ref"])
    text = F.lower(F.concat_ws(" ", "t", "b"))
    some = lambda c: F.filter(F.array(c), lambda x: x != "")
    return n.where(_any(text, LEGAL)).select(
        F.concat_ws(": ", F.when(F.col("b") != "", F.col("b")), "t").alias("title"), "url", F.lit("procurement notices").alias("source"), "published_at",
        F.when(_any(text, INTERNATIONAL), "counsel_tender").otherwise("commentary").alias("event_type"), some("b").alias("respondents"), some("c").alias("states"), "case_ref",
    )


TENDER = (
    "data array<struct<tenderID: string, title: string, status: string, enquiryPeriod: struct<startDate: string, endDate: string>, tenderPeriod: struct<startDate: string>, "
    "procuringEntity: struct<name: string, identifier: struct<legalName: string>>, value: struct<amount: double, currency: string>>>"
)


def tenders_national(payloads: DataFrame, as_of: Column, days: int, base: str = "tender/") -> DataFrame:
    """National tenders: dated, legal, and international or of LEAST_USD or more; undated ones go."""
    t = payloads.select(F.explode(_json("payload", TENDER)["data"]).alias("t")).select("t.*").dropDuplicates(["tenderID"])
    day = F.try_to_date(F.substring(F.coalesce("enquiryPeriod.startDate", "tenderPeriod.startDate", "enquiryPeriod.endDate", F.regexp_extract("tenderID", r"^UA-(\d{4}-\d{2}-\d{2})", 1)), 1, 10))
    buyer = F.coalesce("procuringEntity.identifier.legalName", "procuringEntity.name", F.lit(""))
    usd = F.when(F.col("value.currency") == "UAH", F.col("value.amount") / UAH_PER_USD).otherwise(F.col("value.amount"))
    text = F.lower(F.concat_ws(" ", "title", buyer))
    keep = _any(text, LEGAL) & (_any(text, INTERNATIONAL) | (F.coalesce(usd, F.lit(0.0)) >= LEAST_USD)) & within(day, as_of, days, undated=False)
    return t.where(keep).select(
        F.concat_ws(": ", F.when(buyer != "", buyer), "title").alias("title"), F.concat(F.lit(base), F.col("tenderID")).alias("url"), F.lit("national procurement").alias("source"),
        day.cast("string").alias("published_at"), F.lit("counsel_tender").alias("event_type"), F.filter(F.array(buyer), lambda x: x != "").alias("respondents"),
        F.col("tenderID").alias("case_ref"), usd.alias("amount_usd"), F.lit("uk").alias("lang"),
    )


ARTICLES = "articles array<struct<url: string, domain: string, title: string, seendate: string, sourcecountry: string, language: string>>"


def world_news(payloads: DataFrame) -> DataFrame:
    """Articles of a global news index: the country tag is the State, the date is the first eight digits."""
    a = payloads.select(F.explode(_json("payload", ARTICLES)["articles"]).alias("a")).select("a.*")
    return a.select(
        F.substring(F.trim("title"), 1, 300).alias("title"), "url", F.concat(F.lit("news index / "), F.coalesce("domain", F.lit(""))).alias("source"),
        F.try_to_date(F.substring("seendate", 1, 8), "yyyyMMdd").cast("string").alias("published_at"), F.array_compact(F.array("sourcecountry")).alias("states"), F.col("language").alias("summary"),
    )


def front_page(pages: DataFrame, least: int = 5, most: int = 30, least_path: int = 12, relevant: Callable[[Column], Column] | None = None, sections: str = r"/(?:tag|topic|category|author|section)s?/") -> DataFrame:
    """Links of front pages (url, html) that read like headlines: least to most words, not in capitals, on the same
    host, a long path that is no section; each url once for a page. Their date is not known."""
    links = pages.select(F.col("url").alias("page"), F.explode(T.html_links("html")).alias("l")).select("page", F.col("l.label").alias("title"), T.absolute_url(F.col("l.href"), F.col("page")).alias("url"))
    n = F.size(F.split("title", " "))
    path = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    kept = links.where((n >= least) & (n <= most) & (F.upper("title") != F.col("title")) & (T.host("url") == T.host("page")) & (F.length(path) >= least_path) & ~path.rlike(sections))
    kept = kept if relevant is None else kept.where(relevant(F.col("title")))
    return kept.groupBy("page", "url").agg(F.min("title").alias("title")).select("title", "url", F.col("page").alias("source"))


def section_links(pages: DataFrame, label: str, path: str, most: int = 2) -> DataFrame:
    """(page, sections): up to `most` links of a page to its sections, by label of four words or fewer or by path; shortest first."""
    found = F.filter(
        F.transform(T.html_links("html"), lambda x: F.struct(F.length(x["href"]).alias("n"), T.absolute_url(x["href"], F.col("url")).alias("url"), x["label"].alias("label"))),
        lambda x: ((F.size(F.split(x["label"], " ")) <= 4) & x["label"].rlike(f"(?i){label}")) | x["url"].rlike(f"(?i){path}"),
    )
    return pages.select(F.col("url").alias("page"), F.slice(F.array_distinct(F.transform(F.array_sort(found), lambda x: x["url"])), 1, most).alias("sections"))


def labelled_blocks(texts: DataFrame, labels: Sequence[str], start: str) -> DataFrame:
    """(id, n, fields): texts in which blocks begin with the label `start`; fields maps each label to the text up to the next one."""
    names = "|".join(rf"\Q{x}\E" for x in labels)
    blocks = texts.select("id", F.posexplode(F.filter(F.split("text", rf"(?m)(?=^\s*\Q{start}\E\s*:)"), lambda b: F.contains(b, F.lit(start)))).alias("n", "block"))
    keys, values = (F.regexp_extract_all("block", F.lit(rf"(?ms)^\s*({names})\s*:(.*?)(?=^\s*(?:{names})\s*:|\z)"), F.lit(i)) for i in (1, 2))
    return blocks.select("id", "n", F.map_from_entries(F.arrays_zip(keys.alias("k"), F.transform(values, lambda v: T.squeeze(v)).alias("v"))).alias("fields"))


def write_relay(raw: DataFrame, path: str) -> None:
    """JSON lines {adapter, raw}."""
    raw.select("adapter", F.struct(*[c for c in raw.columns if c != "adapter"]).alias("raw")).write.json(path)


def read_relay(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a relay; lines that are no JSON, or lack title or url, are skipped."""
    lines = spark.read.text(path).select(F.from_json("value", f"adapter string, raw struct<{', '.join(x.replace(' ', ': ', 1) for x in RAW.split(', '))}>").alias("x"))
    return lines.where("x.raw.title IS NOT NULL AND x.raw.url IS NOT NULL").select(F.col("x.adapter").alias("adapter"), "x.raw.*")


def read_days(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Day files, unreadable ones skipped."""
    return spark.read.schema(schema + ", _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).where("date IS NOT NULL").drop("_bad")


def wires(found: DataFrame, outlets: str, gate: str, kinds: Sequence[tuple[str, str]]) -> DataFrame:
    """Company announcements from wire outlets that pass the text gate; the first pattern that a title matches is its type."""
    kind = F.lit("commentary")
    for pattern, name in reversed(kinds):
        kind = F.when(F.col("title").rlike(f"(?i){pattern}"), name).otherwise(kind)
    text = F.concat_ws(" ", "title", "summary")
    return found.where(F.col("source").rlike(f"(?i){outlets}") & text.rlike(f"(?i){gate}")).withColumn("event_type", kind)


def outlet_of_host(found: DataFrame, outlets: DataFrame) -> DataFrame:
    """found with the outlet (host, outlet) of its url's host, or else of the longest suffix of it that is an outlet's host."""
    parts = F.split(T.host("url"), "\\.")
    n = F.size(parts)
    tails = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(parts, i, n - i + 1), ".").alias("host")))
    t = found.withColumn("_t", F.explode(tails)).withColumn("host", F.col("_t.host")).join(outlets, "host")
    best = t.groupBy("url").agg(F.min_by("outlet", "_t.i").alias("outlet"))
    return found.join(best, "url", "left")
