"""Queries of text functions, urls and items, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinflow.functions import signals, text
from skeinflow.operators import classify, identity, select
from skeinflow.plans.items import FIRST_LINE, table, titled
from skeinflow.plans.registry import query


@query("long_dates", "SELECT o_orderkey, strftime(o_orderdate, '%-d %B %Y') AS told FROM orders")
def long_dates(spark, sf_dir):
    """Order dates written the American way, as '24 July 2023'."""
    return table(spark, sf_dir, "orders").select("o_orderkey", signals.long_date(F.date_format("o_orderdate", "MMMM d, yyyy")).alias("told"))


@query(
    "upper_share",
    r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '\p{L}')) AS n, len(regexp_extract_all(text, '\p{Lu}')) AS upper FROM documents)
SELECT doc_id, CASE WHEN n > 0 THEN upper / n END AS share FROM c""",
)
def upper_share(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.upper_share("text").alias("share"))


FORUMS = (("mail", "@"), ("key", "(?:token|secret) ="), ("number", "[0-9]{6}"), ("list", "(?m)^[-*] "), ("english", r"\bthe\b"))


@query(
    "first_label",
    r"""SELECT doc_id, CASE WHEN regexp_matches(text, '@') THEN 'mail' WHEN regexp_matches(text, '(?:token|secret) =') THEN 'key' WHEN regexp_matches(text, '[0-9]{6}') THEN 'number'
  WHEN regexp_matches(text, '(?m)^[-*] ') THEN 'list' WHEN regexp_matches(text, '\bthe\b') THEN 'english' ELSE 'none' END AS label FROM documents""",
)
def first_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", signals.first_label("text", FORUMS, "none").alias("label"))


@query(
    "listed_sources",
    """WITH s AS (SELECT lang, list_sort(list(DISTINCT source)) AS s FROM documents GROUP BY lang)
SELECT lang, CASE WHEN len(s) = 0 THEN '' WHEN len(s) = 1 THEN s[1] ELSE array_to_string(s[:len(s) - 1], ', ') || ' and ' || s[len(s)] END AS told FROM s""",
)
def listed_sources(spark, sf_dir):
    s = table(spark, sf_dir, "documents").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("s"))
    return s.select("lang", signals.listed(F.col("s")).alias("told"))


@query(
    "absolute_links",
    r"""WITH h AS (SELECT page_id, url, unnest(['/a/b', 'c', '//h/p', 'mailto:x', 'https://z/y']) AS href FROM pages),
p AS (SELECT *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS scheme, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS root, regexp_extract(url, '^[^?#]*') AS bare FROM h)
SELECT page_id, href, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN scheme || ':' || href WHEN starts_with(href, '/') THEN root || href
  WHEN bare = root THEN root || '/' || href ELSE regexp_replace(bare, '[^/]*$', '') || href END AS link FROM p""",
)
def absolute_links(spark, sf_dir):
    """Links of five kinds as every page would see them."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.array(*[F.lit(x) for x in ("/a/b", "c", "//h/p", "mailto:x", "https://z/y")])).alias("href"))
    return p.select("page_id", "href", text.absolute_url(F.col("href"), F.col("url")).alias("link"))


@query(
    "page_links",
    r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href FROM pages)
SELECT page_id, count(*) AS n, count(DISTINCT href) AS different, sum(length(href))::BIGINT AS chars FROM l GROUP BY page_id""",
)
def page_links(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(text.html_links("html")).alias("l"))
    return links.groupBy("page_id").agg(F.count("*").alias("n"), F.countDistinct("l.href").alias("different"), F.sum(F.length("l.href")).alias("chars"))


@query("labelled_updates", "SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN 'q' || l.quality ELSE d.source END AS source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def labelled_updates(spark, sf_dir):
    """Documents whose source a label replaces where there is one: update by key."""
    changes = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("source"))
    return identity.update_by_key(table(spark, sf_dir, "documents").select("doc_id", "source"), changes, "doc_id")


@query(
    "muted_titles",
    f"""WITH d AS (SELECT doc_id, lower({FIRST_LINE} || coalesce(text, '')) AS t FROM documents)
SELECT doc_id, contains(t, 'token') OR contains(t, '.de la') OR contains(t, '@mail') AS muted FROM d""",
)
def muted_titles(spark, sf_dir):
    return titled(spark, sf_dir).select("doc_id", classify.muted("title", "text", ("Token", ".De la", "@mail")).alias("muted"))


@query(
    "review_list",
    """SELECT doc_id AS id, source, 20 + doc_id % 61 AS score FROM documents WHERE contains(lower(text), 'token') AND doc_id % 30 >= 9
ORDER BY doc_id % 97 = 0 DESC, 20 + doc_id % 61 DESC, doc_id LIMIT 400""",
)
def review_list(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("title"), F.lit("").alias("summary"), "source", (F.col("doc_id") % 97 == 0).alias("pinned"), (20 + F.col("doc_id") % 61).alias("score"),
        F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("published_at"), F.lit(None).cast("timestamp").alias("fetched_at"),
    )
    return classify.review_list(d, F.lit("2026-01-10").cast("date"), like="token").select("id", "source", "score")


@query(
    "pending_items",
    """SELECT doc_id AS id, lang FROM documents WHERE doc_id % 3 = 1 ORDER BY DATE '2026-01-01' + (doc_id % 30)::INTEGER DESC, doc_id LIMIT 500""",
)
def pending_items(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "lang", F.when(F.col("doc_id") % 3 == 1, "none").otherwise("done").alias("llm_stage"), F.lit(True).alias("relevant"),
        F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("published_at"), F.lit(None).cast("timestamp").alias("fetched_at"),
    )
    return select.pending(d, "none").select("id", "lang")


@query(
    "raw_items",
    r"""SELECT url, coalesce(nullif(source, ''), 'feed') AS source, left(title, 500) AS title, length(left(summary, 4000)) AS summary_chars, 2 AS source_tier, coalesce(nullif(lang, ''), 'en') AS lang
FROM (SELECT 'http://x/' || doc_id AS url, source, """ + FIRST_LINE + r""" AS title, coalesce(text, '') AS summary, lang FROM documents) WHERE coalesce(title, '') <> ''""",
)
def raw_items(spark, sf_dir):
    """Documents as raw rows of a feed, brought to the schema of items."""
    raw = titled(spark, sf_dir).select(F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")).alias("url"), "source", "title", F.col("text").alias("summary"), "lang")
    return identity.items_from_raw(raw, "feed").select("url", "source", "title", F.length("summary").alias("summary_chars"), "source_tier", "lang")


@query(
    "citations",
    r"""WITH l AS (SELECT page_id, ['uksc', 'ewca/civ', 'ewhc/comm', 'eat'][page_id % 4 + 1] AS court, 1990 + page_id % 30 AS year FROM pages)
SELECT page_id, CASE court WHEN 'uksc' THEN '[' || year || '] UKSC ' || page_id WHEN 'ewca/civ' THEN '[' || year || '] EWCA Civ ' || page_id
  WHEN 'ewhc/comm' THEN '[' || year || '] EWHC ' || page_id || ' (Comm)' ELSE '[' || year || '] EAT ' || page_id END AS cited FROM l""",
)
def citations(spark, sf_dir):
    """Pages as addresses of judgments, cited."""
    court = F.get(F.array(*[F.lit(x) for x in ("uksc", "ewca/civ", "ewhc/comm", "eat")]), (F.col("page_id") % 4).cast("int"))
    link = F.concat_ws("/", F.lit("https://caselaw.nationalarchives.gov.uk"), court, (1990 + F.col("page_id") % 30).cast("string"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", signals.citation(link).alias("cited"))


@query(
    "named_words",
    r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{M}\p{N}_-])einheit($|[^\p{L}\p{M}\p{N}_-])') THEN 'einheit' END,
  CASE WHEN regexp_matches(text, '(^|[^\p{L}\p{M}\p{N}_-])De($|[^\p{L}\p{M}\p{N}_-])') THEN 'De' END, CASE WHEN regexp_matches(text, '(^|[^\p{L}\p{M}\p{N}_-])the($|[^\p{L}\p{M}\p{N}_-])') THEN 'the' END], lambda x: x IS NOT NULL), ',') AS names FROM documents""",
)
def named_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(signals.named("text", ("einheit", "De", "the")), ",").alias("names"))


@query(
    "docket_stories",
    """WITH c AS (SELECT c_custkey, c_name, n_name, r_name, lower(c_mktsegment) AS sector FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT c_custkey, c_name || ' has a claim against ' || n_name || CASE WHEN c_custkey % 2 = 0 THEN ' under the ' || r_name || ' treaty' ELSE '' END || ' in the ' || sector || ' sector.'
  || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' Firm A acts for the claimant.' ELSE ' Firm A and Firm B act for the claimant.' END || CASE WHEN c_custkey % 5 = 0 THEN ' Firm C for ' || n_name || '.' ELSE '' END
  || CASE c_custkey % 4 WHEN 0 THEN ' The tribunal has not yet been constituted.' WHEN 1 THEN ' The tribunal is X.' ELSE ' The tribunal is X, presiding; Y; Z.' END AS story FROM c""",
)
def docket_stories(spark, sf_dir):
    """Customers as claimants against their nations, told in a paragraph."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    names = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    k = F.col("c_custkey")
    counsel = F.when(k % 3 == 0, names()).when(k % 3 == 1, names("Firm A")).otherwise(names("Firm A", "Firm B"))
    seats = F.when(k % 4 == 0, names()).when(k % 4 == 1, names("X")).otherwise(names("X", "Y", "Z"))
    told = signals.docket_story(
        F.array("c_name"), F.col("n_name"), F.when(k % 2 == 0, F.concat("r_name", F.lit(" treaty"))), F.col("c_mktsegment"), F.lit(""), counsel, F.when(k % 5 == 0, names("Firm C")).otherwise(names()), seats
    )
    return c.select("c_custkey", told.alias("story"))


@query(
    "same_outlets",
    r"""WITH n AS (SELECT s_suppkey, regexp_replace(lower(coalesce(s_name, '')), '[^a-z]', '', 'g') AS x, regexp_replace(lower(n_name), '[^a-z]', '', 'g') AS y FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT s_suppkey, x <> '' AND y <> '' AND (x = y OR (length(x) >= 5 AND contains(y, x)) OR (length(y) >= 5 AND contains(x, y))) AS same FROM (SELECT s_suppkey, x || CASE WHEN s_suppkey % 2 = 0 THEN y ELSE '' END AS x, y FROM n)""",
)
def same_outlets(spark, sf_dir):
    """Suppliers' names, every other one with its nation's behind it, against that of the nation."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    name = F.concat(F.col("s_name"), F.lit(" - "), F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise(""))
    return s.select("s_suppkey", identity.same_outlet(name, F.col("n_name")).alias("same"))
