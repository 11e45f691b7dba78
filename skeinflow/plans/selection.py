"""Queries of selection, linkage, evidence tests and story groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinflow.functions import fixed, text
from skeinflow.operators import ground, link
from skeinflow.operators import select as sel
from skeinflow.plans.items import FIRST_LINE, SCORE_SQL, scored_events, table, titled
from skeinflow.plans.registry import query

ORDER_SQL = "orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"


def orders_by_nation(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey"))


@query(
    "country_quota",
    f"""WITH r AS (SELECT o_orderkey, n_name, o_orderdate, row_number() OVER (PARTITION BY n_name ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM {ORDER_SQL})
SELECT o_orderkey, n_name, o_orderdate::DATE AS day FROM r WHERE rn <= 2 ORDER BY rn, o_orderdate DESC, o_orderkey LIMIT 30""",
)
def country_quota(spark, sf_dir):
    rows = sel.quota(orders_by_nation(spark, sf_dir), F.col("n_name"), F.desc("o_orderdate"), F.col("o_orderkey"), each=2, most=30)
    return rows.select("o_orderkey", "n_name", F.col("o_orderdate").cast("date").alias("day"))


@query(
    "top_each_list",
    "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 6",
)
def top_each_list(spark, sf_dir):
    return sel.top_each(table(spark, sf_dir, "customer"), "c_nationkey", F.desc("c_acctbal"), F.col("c_custkey")).select("c_nationkey", "c_custkey", "c_acctbal")


EVENT_DAYS_SQL = "e AS (SELECT event_id AS id, ts::DATE AS day, 'u' || user_id || '-' || floor(value * 10)::BIGINT % 50 AS url, event_type || ' ' || user_id % 10 || ' ' || props AS title FROM events)"


def event_days(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("date").alias("day"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), (F.floor(F.col("value") * 10).cast("long") % 50).cast("string")).alias("url"),
        F.concat_ws(" ", "event_type", (F.col("user_id") % 10).cast("string"), "props").alias("title"),
    )


@query(
    "shown_anti_join",
    f"""WITH {EVENT_DAYS_SQL}, k AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS key FROM e),
s AS (SELECT * FROM k WHERE day <> DATE '2024-01-15' AND abs(day - DATE '2024-01-15') <= 1)
SELECT id FROM k WHERE day = DATE '2024-01-15' AND url NOT IN (SELECT url FROM s) AND key NOT IN (SELECT key FROM s)""",
)
def shown_anti_join(spark, sf_dir):
    """Events of one day that neither the day before nor the day after carried, by url or title."""
    e, day = event_days(spark, sf_dir), F.lit("2024-01-15").cast("date")
    return sel.not_shown(e.where(F.col("day") == day), sel.shown_keys(e, day, band=1)).select("id")


@query(
    "story_pool",
    f"WITH {SCORE_SQL} SELECT id, floor(score * 1e6 + 0.5) / 1e6 AS score FROM (SELECT * FROM scored WHERE score >= 20 AND day BETWEEN DATE '2024-01-29' AND DATE '2024-01-31' ORDER BY score DESC, id LIMIT 144)",
)
def story_pool(spark, sf_dir):
    none = lambda kind: F.lit(None).cast(kind)
    items = scored_events(spark, sf_dir).withColumns({"relevant": F.lit(True), "issue_id": none("long"), "excluded": none("boolean"), "pinned": none("boolean")})
    return sel.pool(items, F.lit("2024-01-31").cast("date"), 2, 20.0, 144).select("id", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"))


@query(
    "story_cap",
    f"""WITH {SCORE_SQL}, d AS (SELECT * FROM scored WHERE day = DATE '2024-01-20'), t AS (SELECT count(*) AS n FROM d WHERE id % 97 = 0),
o AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rn FROM d WHERE id % 97 <> 0)
SELECT id FROM d WHERE id % 97 = 0 UNION ALL SELECT id FROM o, t WHERE rn <= greatest(0, 12 - n)""",
)
def story_cap(spark, sf_dir):
    day = scored_events(spark, sf_dir).where(F.col("published_at") == F.lit("2024-01-20").cast("date"))
    return sel.cap_stories(day, F.col("id") % 97 == 0, 12).select("id")


@query(
    "day_tiers",
    f"""WITH {SCORE_SQL}, r AS (SELECT id, day, id % 11 = 0 AS b, row_number() OVER (PARTITION BY day ORDER BY id % 11 = 0, score DESC, id) - 1 AS place FROM scored)
SELECT id, place, CASE WHEN b THEN 'brief' WHEN place = 0 THEN 'lead' WHEN place <= 6 THEN 'development' ELSE 'brief' END AS tier FROM r""",
)
def day_tiers(spark, sf_dir):
    rows = sel.tiers(scored_events(spark, sf_dir), "published_at", F.desc("score"), F.col("id"), brief=F.col("id") % 11 == 0)
    return rows.select("id", F.col("place").cast("long").alias("place"), "tier")


@query("issue_number", "SELECT ts::DATE AS day, dense_rank() OVER (ORDER BY ts::DATE) AS number FROM events GROUP BY ts::DATE")
def issue_number(spark, sf_dir):
    """Each day with events is an issue; its number is one more than that of the day before it."""
    from pyspark.sql import Window

    days = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day")).distinct()
    # A row a day: the window without partitions is over the calendar, not over the events.
    return days.select("day", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("day")).cast("long").alias("number"))


@query("next_issue", "SELECT count(DISTINCT ts::DATE) + 1 AS number FROM events")
def next_issue(spark, sf_dir):
    return sel.issue_number(issue_number(spark, sf_dir))


@query(
    "section_carry_forward",
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN left(text, 20) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS section
FROM conversations""",
)
def section_carry_forward(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return sel.carried(c, "conv_id", F.when(F.col("role") == "user", F.left("text", F.lit(20))), "turn", "role").select("conv_id", "turn", "section")


@query(
    "host_batches",
    "SELECT s_nationkey, s_suppkey, ((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)) - 1) // 8 AS batch FROM supplier",
)
def host_batches(spark, sf_dir):
    return sel.batches(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey").select("s_nationkey", "s_suppkey", "batch")


@query("sweep_plan", "SELECT DISTINCT r_name, n_name, c_mktsegment FROM region JOIN nation ON n_regionkey = r_regionkey, (SELECT DISTINCT c_mktsegment FROM customer)")
def sweep_plan(spark, sf_dir):
    """Every nation with every segment: a product of two lists of names, which is what a sweep plan is."""
    segments = [r[0] for r in table(spark, sf_dir, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return n.select("r_name", "n_name", F.explode(F.array(*[F.lit(s) for s in segments])).alias("c_mktsegment"))


@query(
    "feed_merge",
    """SELECT coalesce(s.k, c.k) AS k, coalesce(c.bal, s.bal) AS bal, CASE WHEN s.k IS NULL THEN 'new' WHEN c.k IS NULL THEN 'old' ELSE 'both' END AS origin
FROM (SELECT s_suppkey AS k, s_acctbal AS bal FROM supplier) s FULL JOIN (SELECT c_custkey AS k, c_acctbal AS bal FROM customer WHERE c_custkey % 3 = 0) c ON s.k = c.k""",
)
def feed_merge(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    return link.full_outer_merge(s, c, "k", ["bal"])


SHIP_SQL = """p AS (SELECT o_orderkey, l_linenumber, o_orderdate::DATE AS day, l_shipdate::DATE AS shipped FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  WHERE l_shipdate::DATE - o_orderdate::DATE BETWEEN -14 AND 3)"""


def shipments(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("day"))
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", F.col("l_shipdate").cast("date").alias("shipped"))
    return link.interval_join(o, i, "k", "day", "shipped", 14, 3)


@query("interval_link", f"WITH {SHIP_SQL} SELECT o_orderkey AS k, l_linenumber, shipped FROM p")
def interval_link(spark, sf_dir):
    return shipments(spark, sf_dir).select("k", "l_linenumber", "shipped")


@query("unique_interval_link", f"WITH {SHIP_SQL} SELECT o_orderkey AS k, min(l_linenumber) AS l_linenumber FROM p GROUP BY o_orderkey HAVING count(*) = 1")
def unique_interval_link(spark, sf_dir):
    return link.unique_match(shipments(spark, sf_dir), "k").select("k", "l_linenumber")


@query("newest_interval_link", f"WITH {SHIP_SQL} SELECT o_orderkey AS k, arg_max(l_linenumber, (shipped, -l_linenumber)) AS l_linenumber FROM p GROUP BY o_orderkey")
def newest_interval_link(spark, sf_dir):
    return link.first_match(shipments(spark, sf_dir), "k", F.desc("shipped"), F.col("l_linenumber")).select("k", "l_linenumber")


@query(
    "anchor_join",
    "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate >= DATE '2001-01-01' AND o_orderdate < DATE '2001-02-01' AND c_acctbal > 0",
)
def anchor_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= "2001-01-01") & (F.col("o_orderdate") < "2001-02-01"))
    return o.join(table(spark, sf_dir, "customer").where("c_acctbal > 0"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_custkey")


@query(
    "fullest_text",
    r"""WITH t AS (SELECT conv_id * 1000 + turn AS id, conv_id::VARCHAR AS title, coalesce(text, '') AS summary FROM conversations),
d AS (SELECT *, regexp_matches(summary, '(…|\.\.\.)\s*$') AS cut FROM t),
n AS (SELECT id, title, length(summary) AS own FROM d WHERE length(summary) < 200 OR cut),
w AS (SELECT title, max((length(summary), -id, summary)) AS b FROM d WHERE summary <> '' AND NOT cut AND NOT starts_with(lower(summary), lower(left(title, 40))) GROUP BY title)
SELECT id, own, b[1] AS found, md5(b[3]) AS md5 FROM n JOIN w USING (title) WHERE b[1] > own + 20""",
)
def fullest_text(spark, sf_dir):
    """Short turns of conversations for which a longer one stands in the same conversation."""
    t = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("id"), F.lit(None).cast("string").alias("url"), F.col("conv_id").cast("string").alias("title"), F.coalesce("text", F.lit("")).alias("summary")
    )
    found = link.fullest_summary(t).withColumnRenamed("summary", "best")
    return t.join(found, "id").select("id", F.length("summary").cast("long").alias("own"), F.length("best").cast("long").alias("found"), F.md5("best").alias("md5"))


@query(
    "record_cascade",
    """SELECT d.doc_id, coalesce('label ' || l.quality, 'bench ' || b.item_id, 'conv ' || c.conv_id) AS found FROM documents d
LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id LEFT JOIN (SELECT DISTINCT conv_id FROM conversations) c ON c.conv_id = d.doc_id""",
)
def record_cascade(spark, sf_dir):
    made = lambda name, key, label, value: table(spark, sf_dir, name).select(F.col(key).alias("doc_id"), F.concat(F.lit(f"{label} "), F.col(value).cast("string")).alias("found")).distinct()
    finders = (made("labels", "doc_id", "label", "quality"), made("benchmark", "item_id", "bench", "item_id"), made("conversations", "conv_id", "conv", "conv_id"))
    return link.cascade(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", *finders)


TIERS = {1: ("example.com",), 2: ("example.org", "blog"), 3: ("net",)}


@query(
    "outlet_rank",
    r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^(www|amp|m)\.', '') AS h FROM pages)
SELECT page_id, h AS host, CASE WHEN contains(h, 'example.com') THEN 1 WHEN contains(h, 'example.org') OR regexp_matches(h, '^blog($|[^\w])') THEN 2
  WHEN regexp_matches(h, '^net($|[^\w])') THEN 3 ELSE 4 END AS rank FROM h""",
)
def outlet_rank(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", text.host("url").alias("host"), text.outlet_rank(F.lit(""), "url", TIERS).alias("rank"))


@query(
    "best_citation",
    r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^(www|amp|m)\.', '') AS h,
  regexp_extract(html, '<title>(.*?)</title>', 1) AS t FROM pages),
r AS (SELECT page_id, left(t, 12) AS story, CASE WHEN contains(h, 'example.com') THEN 1 WHEN contains(h, 'example.org') OR regexp_matches(h, '^blog($|[^\w])') THEN 2 ELSE 4 END AS rank FROM h)
SELECT story, arg_min(page_id, (rank, page_id)) AS page_id FROM r GROUP BY story""",
)
def best_citation(spark, sf_dir):
    from skeinflow.operators.identity import first_of

    p = table(spark, sf_dir, "pages").select("page_id", F.left(F.regexp_extract("html", "<title>(.*?)</title>", 1), F.lit(12)).alias("story"), text.outlet_rank(F.lit(""), "url", {1: TIERS[1], 2: TIERS[2]}).alias("rank"))
    return first_of(p, "story", "rank", "page_id").select("story", "page_id")


@query(
    "html_links",
    r"""SELECT page_id, len(h) AS n, array_to_string(h, ' ') AS hrefs FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1) AS h FROM pages)""",
)
def html_links(spark, sf_dir):
    links = text.html_links("html")
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("n"), F.array_join(F.transform(links, lambda x: x["href"]), " ").alias("hrefs"))


@query(
    "html_text",
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') AS t FROM a)
SELECT page_id, md5(trim(regexp_replace(t, '[ \t\n\r\f\v\x{00a0}]+', ' ', 'g'))) AS text_md5 FROM b""",
)
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.html_text("html")).alias("text_md5"))


@query(
    "list_split",
    r"""SELECT page_id, len(list_filter(list_transform(regexp_split_to_array(html, '(?i)<br\s*/?>'), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\v\x{00a0}]+', ' ', 'g'))), lambda x: x <> '')) AS n FROM pages""",
)
def list_split(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(text.html_list("html")).cast("long").alias("n"))


@query(
    "tokens_frequency",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS w FROM documents WHERE lang = 'en'),
s AS (SELECT DISTINCT doc_id, left(w, 5) AS stem FROM w WHERE w NOT IN ('about', 'after', 'against', 'amid', 'before', 'between', 'court', 'from', 'over', 'says', 'said', 'that', 'their', 'there', 'these', 'this',
  'under', 'what', 'when', 'which', 'while', 'with', 'would', 'your', 'into', 'than', 'them', 'then', 'they', 'were', 'will', 'have', 'been', 'being', 'more', 'most'))
SELECT stem, count(*) AS n FROM s GROUP BY stem""",
)
def tokens_frequency(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang = 'en'")
    return d.select(F.explode(text.stems5("text")).alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))


def _stem_sql(w: str) -> str:
    cut = f"regexp_replace({w}, '{fixed.SUFFIX}', '')"
    return (
        f"CASE WHEN regexp_matches({w}, '^[0-9]+$') THEN {w} WHEN regexp_matches({w}, '^[0-9]+[mkb]n?$') THEN regexp_replace({w}, '[a-z]+$', '') "
        f"WHEN length({cut}) >= 3 THEN {cut} ELSE {w} END"
    )


def _tokens_sql(column: str) -> str:
    """Stems of a headline in order, as a list."""
    words = f"regexp_extract_all(lower(regexp_replace(strip_accents({column}), '[^\\x00-\\x7F]', '', 'g')), '[a-z0-9]+')"
    stop, short = (", ".join(f"'{w}'" for w in x) for x in (fixed.STOP, fixed.SHORT_WORDS))
    alias = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fixed.ALIASES.items()) + " ELSE w END"
    kept = f"list_filter({words}, lambda w: (length(w) >= 3 OR w IN ({short})) AND w NOT IN ({stop}))"
    return f"list_transform(list_transform({kept}, lambda w: {alias}), lambda w: {_stem_sql('w')})"


JACCARD_SQL = f"""s AS (SELECT min(doc_id) AS id, t FROM (SELECT doc_id, list_sort(list_distinct({_tokens_sql(FIRST_LINE)})) AS t FROM documents) WHERE len(t) > 0 GROUP BY t)"""


@query(
    "jaccard_pairs",
    f"""WITH {JACCARD_SQL}, p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.t, b.t)) AS i, len(a.t) + len(b.t) AS n FROM s a JOIN s b ON a.id < b.id)
SELECT a, b, i / (n - i) AS jaccard FROM p WHERE i / (n - i) >= 0.5""",
)
def jaccard_pairs(spark, sf_dir):
    return link.jaccard_pairs(titled(spark, sf_dir), "doc_id", "title")


@query(
    "rare_bigrams",
    f"""WITH s AS (SELECT doc_id, {_tokens_sql(FIRST_LINE)} AS s FROM documents),
b AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(s), 1)), lambda i: s[i] || ' ' || s[i + 1])) AS phrase FROM s)
SELECT phrase, count(*) AS n FROM b GROUP BY phrase HAVING count(*) <= greatest(3, (SELECT count(*) FROM documents) // 8)""",
)
def rare_bigrams(spark, sf_dir):
    return link.rare_phrases(titled(spark, sf_dir), "doc_id", "title")


@query("title_stems", f"WITH s AS (SELECT doc_id, unnest(list_distinct({_tokens_sql(FIRST_LINE)})) AS stem FROM documents) SELECT stem, count(*) AS n FROM s GROUP BY stem")
def title_stems(spark, sf_dir):
    return link.stem_frequency(titled(spark, sf_dir), "title")


def _content_sql(column: str) -> str:
    stop = ", ".join(f"'{w}'" for w in fixed.STEM5_STOP)
    words = f"list_filter(regexp_extract_all({column}, '[A-Za-z]{{4,}}'), lambda w: lower(w) NOT IN ({stop}))"
    return f"list_distinct(list_transform({words}, lambda w: regexp_replace(lower(w), '(ies|es|s|ed|ing)$', '')))"


@query(
    "ground_share",
    f"""SELECT item_id, len(list_intersect({_content_sql('b.text')}, {_content_sql('d.text')})) / len({_content_sql('b.text')}) AS share
FROM benchmark b JOIN documents d ON d.doc_id = b.item_id WHERE len({_content_sql('b.text')}) > 0""",
)
def ground_share(spark, sf_dir):
    """Share of an item's content stems that the document of the same number holds."""
    b = table(spark, sf_dir, "benchmark").select("item_id", ground.content_stems("text").alias("need")).where(F.size("need") > 0)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), ground.content_stems("text").alias("have"))
    return b.join(d, "item_id").select("item_id", (F.size(F.array_intersect("need", "have")) / F.size("need")).alias("share"))


@query("grounded_items")
def grounded_items(spark, sf_dir):
    """Sentences of each benchmark item against the document of the same number and the item's own first half."""
    b = table(spark, sf_dir, "benchmark")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("evidence"))
    own = b.select("item_id", F.expr("left(text, cast(length(text) / 2 as int))").alias("evidence"))
    return ground.grounded_text(ground.vetted(b, own.union(d.join(b.select("item_id"), "item_id", "left_semi")), "item_id"), "item_id")
