"""Queries of names from tables of forms, of records behind reports, and of earlier stories."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinflow.operators import cluster, corpus, issue, phrases, records
from skeinflow.operators.gazetteer import Gazetteer
from skeinflow.plans.items import table
from skeinflow.plans.registry import query

FORMS_SQL = r"""f AS (SELECT DISTINCT form, lower(form) AS name FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_-]+')) AS form FROM benchmark) WHERE regexp_matches(form, '^\p{Lu}\p{L}{3,}$'))"""


@query(
    "gazetteer_names",
    rf"""WITH {FORMS_SQL},
p AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '(\p{{L}})-([A-ZÀ-Ý])', '\1 \2', 'g'), '(\p{{L}})-([A-ZÀ-Ý])', '\1 \2', 'g') AS t FROM documents),
w AS (SELECT doc_id, unnest(l) AS form, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(t, '[\p{{L}}\p{{N}}_-]+') AS l FROM p)),
m AS (SELECT doc_id, name, count(*) AS n, min(i) AS i FROM w JOIN f USING (form) GROUP BY doc_id, name),
g AS (SELECT doc_id, sum(n)::BIGINT AS mentions, count(*) AS names, md5(string_agg(name, ' ' ORDER BY i)) AS names_md5 FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(mentions, 0) AS mentions, coalesce(names, 0) AS names, coalesce(names_md5, md5('')) AS names_md5 FROM p LEFT JOIN g USING (doc_id)""",
)
def gazetteer_names(spark, sf_dir):
    """Names in whole documents, from a table of forms: the capitalised words of the benchmark's texts."""
    forms = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0))).alias("form"))
    forms = forms.where(F.col("form").rlike(r"^\p{Lu}\p{L}{3,}$")).select("form", F.lower("form").alias("name"))
    g = Gazetteer(forms)
    found = table(spark, sf_dir, "documents").select("doc_id", g.spans(g.parted(F.coalesce("text", F.lit("")))).alias("spans"))
    names = F.array_distinct(F.transform("spans", lambda s: s["name"]))
    return found.select("doc_id", F.size("spans").cast("long").alias("mentions"), F.size(names).cast("long").alias("names"), F.md5(F.array_join(names, " ")).alias("names_md5"))


def _ranked(kind: str, condition: str, place: str) -> str:
    return f"SELECT '{kind}' AS kind, item_id, arg_min(doc_id, ({place}, doc_id)) AS doc_id FROM m WHERE {condition} GROUP BY item_id"


@query(
    "external_records",
    rf"""WITH b AS (
  SELECT item_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:4] AS names, DATE '2026-01-01' + (item_id % 900)::INT AS day
  FROM (SELECT item_id, regexp_extract_all(text, '[\p{{Lu}}][\p{{Ll}}]{{3,}}') AS l FROM benchmark)),
d AS (SELECT doc_id, lower(text) AS low, ' ' || trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ' AS norm, DATE '2024-01-01' + (doc_id % 1500)::INT AS filed FROM documents WHERE text IS NOT NULL),
c AS (
  SELECT item_id, doc_id, names, low, datediff('day', day, filed) AS late, list_transform(names[1:3], lambda n: contains(norm, ' ' || lower(n) || ' ')) AS stands
  FROM b JOIN d ON datediff('day', day, filed) BETWEEN -1460 AND 3),
m AS (
  SELECT item_id, doc_id, late, len(stands) > 0 AND NOT list_contains(stands, false) AS every, list_position(stands, true) AS one,
    len(list_filter(names, lambda n: NOT regexp_matches(n, '^[AEIOU]') AND contains(low, lower(n)))) > 0 AS company,
    len(list_filter(names, lambda n: NOT regexp_matches(n, '^[AEIOU]'))) > 0 AS companies,
    len(list_filter(names, lambda n: regexp_matches(n, '^[AEIOU]') AND (contains(low, lower(n)) OR (length(n) >= 5 AND contains(low, lower(left(n, 5))))))) AS states,
    regexp_matches(low, '\b(republic|government|kingdom|state of|federation|ministry|emirate|sultanate|commonwealth|nation)\b') AS sovereign
  FROM c WHERE list_contains(stands, true))
{_ranked("docket", "every AND (company OR states >= 2)", "-late")} UNION ALL
{_ranked("opinion", "every AND late >= -45 AND (company OR states >= 2 OR (late >= -14 AND states >= 1 AND sovereign AND NOT companies))", "-late")} UNION ALL
{_ranked("judgment", "late >= -30 AND (company OR states >= 2)", "one, -late")}""",
)
def external_records(spark, sf_dir):
    """For each benchmark item, taken as a report whose capitalised words are its parties, the document of each kind of
    record that carries them: whole texts, in the bands of dockets, opinions and judgments. Names with a vowel first are States."""
    found = F.regexp_extract_all("text", F.lit(r"[\p{Lu}][\p{Ll}]{3,}"), F.lit(0))
    reports = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select(
        F.col("item_id").alias("id"), F.slice(F.array_distinct(found), 1, 4).alias("names"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("item_id") % 900).cast("int")).alias("day")
    )
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("record"), F.col("text").alias("title"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 1500).cast("int")).alias("day")
    )
    names = reports.select(F.explode("names").alias("n")).where(F.col("n").rlike("^[AEIOU]"))
    g = Gazetteer(names.select(F.explode(F.array(F.col("n"), F.upper("n"))).alias("form"), F.upper("n").alias("name")))
    bands = {"docket": records.DOCKETS, "opinion": records.OPINIONS, "judgment": records.JUDGMENTS}
    found = records.match_each(reports, docs, g, bands)
    parts = [df.select(F.lit(k).alias("kind"), F.col("id").alias("item_id"), F.col("record").alias("doc_id")) for k, df in found.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    "issue_anchors",
    """SELECT o_orderkey AS id, year(o_orderdate) * 12 + month(o_orderdate) AS issue_id FROM orders
WHERE last_day(o_orderdate::DATE) < DATE '1998-06-15' AND o_orderdate::DATE >= DATE '1998-06-15' - 45""",
)
def issue_anchors(spark, sf_dir):
    """Orders as items, a month as the issue that carries them: those of issues before a day, published in the 45 days up to it."""
    day = F.col("o_orderdate").cast("date")
    number = (F.year(day) * 12 + F.month(day)).cast("long")
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), number.alias("issue_id"), day.alias("published_at"))
    months = table(spark, sf_dir, "orders").select(number.alias("issue_id"), F.last_day(day).alias("day")).distinct()
    return issue.anchors(items, months, F.lit("1998-06-15").cast("date"), 45).select("id", "issue_id")


CITED_SQL = r"""h AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^(www|amp|m)\.', '') AS host FROM pages),
r AS (SELECT *, CASE WHEN contains(host, 'example.com') THEN 1 WHEN contains(host, 'example.org') OR regexp_matches(host, '^blog($|[^\w])') THEN 2 ELSE 4 END AS rank FROM h WHERE url IS NOT NULL AND url <> ''),
t AS (SELECT *, min(page_id) OVER (PARTITION BY host) AS story FROM r),
b AS (SELECT story, count(*) AS n, arg_min(url, page_id) AS own, min(CASE WHEN page_id = story THEN rank END) AS own_rank,
  arg_min(url, (rank, page_id)) FILTER (page_id <> story) AS other, min(rank) FILTER (page_id <> story) AS other_rank FROM t GROUP BY story)"""


@query("cited_copies", rf"WITH {CITED_SQL.replace('PARTITION BY host', 'PARTITION BY length(host)')} SELECT story, CASE WHEN other_rank < own_rank THEN other ELSE own END AS url, n - 1 AS copies FROM b")
def cited_copies(spark, sf_dir):
    """Pages whose hosts are of one length, as copies of a story told by the first: which of them is cited."""
    from skeinflow.functions import text

    ranks = {1: ("example.com",), 2: ("example.org", "blog")}
    p = table(spark, sf_dir, "pages").where("url <> ''").select("page_id", "url", F.length(text.host("url")).alias("g"))
    copy = F.struct(F.lit("").alias("source"), F.col("url"), F.lit("").alias("title"))
    # The copies of a story are pre-aggregated lists, as cluster.merged makes them.
    listed = p.groupBy("g").agg(F.min("page_id").alias("story"), F.array_sort(F.collect_list(F.struct("page_id", copy.alias("c")))).alias("all"))
    stories = listed.select(
        "story", F.lit("").alias("source"), F.col("all")[0]["c"]["url"].alias("url"), F.lit("").alias("title"),
        F.transform(F.slice("all", 2, F.size("all")), lambda x: x["c"]).alias("also"),
    )
    cited = cluster.cite_best(stories, lambda s, u: text.outlet_rank(s, u, ranks))
    return cited.select("story", "url", F.size("also").cast("long").alias("copies"))


@query(
    "top_phrases",
    r"""WITH w AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS value FROM w WHERE len(w) >= 3)
SELECT value, count(*) AS n FROM g GROUP BY value ORDER BY n DESC, value LIMIT 50""",
)
def top_phrases(spark, sf_dir):
    """The 50 commonest runs of three words in whole documents."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(words.alias("w"))
    return phrases.commonest(docs, F.col("w"), 50, run=3)


SHAPE_SQL = r"""CASE WHEN regexp_matches(text, '^(An?|The)\s+([A-Z][\p{L}\p{N}_-]+)\s+([\p{L}\p{N}_]+)') THEN
  regexp_extract(text, '^(An?|The)\s', 1) || CASE WHEN lower(regexp_extract(text, '^(An?|The)\s+([A-Z][\p{L}\p{N}_-]+)\s+([\p{L}\p{N}_]+)', 3)) IN
    ('company','investor','contractor','group','court','tribunal','judge','businessman','developer','producer','miner','bank','insurer','consortium','arbitrator','panel')
    THEN ' <Adjective> ' || lower(regexp_extract(text, '^(An?|The)\s+([A-Z][\p{L}\p{N}_-]+)\s+([\p{L}\p{N}_]+)', 3)) ELSE '' END
  WHEN regexp_matches(text, '^[A-Z]') THEN '<Name> …' END"""


@query("opening_shapes", f"SELECT lang, shape, count(*) AS n FROM (SELECT lang, {SHAPE_SQL} AS shape FROM documents) WHERE shape IS NOT NULL GROUP BY lang, shape")
def opening_shapes(spark, sf_dir):
    """How documents open, by language."""
    return table(spark, sf_dir, "documents").select("lang", corpus.opening_shape("text").alias("shape")).where("shape IS NOT NULL").groupBy("lang", "shape").agg(F.count("*").alias("n"))


WORDS = ("has", "reportedly", "the ", "and ", "und ", "que ", "les ", "http", "@")


@query("phrase_counts", "SELECT phrase, count(*) AS n FROM documents, (SELECT unnest(['has','reportedly','the ','and ','und ','que ','les ','http','@']) AS phrase) WHERE contains(text, phrase) GROUP BY phrase")
def phrase_counts(spark, sf_dir):
    """How many documents contain each of some phrases."""
    return corpus.containing(table(spark, sf_dir, "documents"), F.col("text"), WORDS)
