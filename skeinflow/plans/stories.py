"""Queries of signals in headlines, of story groups and of copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinflow.functions import signals, text
from skeinflow.operators import cluster, copies
from skeinflow.plans.items import table, titled
from skeinflow.plans.registry import query
from skeinflow.plans.selection import ORDER_SQL, orders_by_nation

PHRASES = {0: "windfall tax planned", 1: "export ban ends", 2: "moratorium holds", 3: "grain prices fall"}
TOPIC = {0: "windfall tax", 1: "export ban", 2: "moratorium"}


def gazetteer(spark, sf_dir) -> dict[str, str]:
    """Names of nations, of which there are a few dozen whatever the scale."""
    return {r["n_name"]: r["n_name"] for r in table(spark, sf_dir, "nation").select("n_name").collect()}


@query(
    "topic_pairs",
    f"""SELECT o_orderkey, CASE o_orderkey % 4 {" ".join(f"WHEN {k} THEN '{t}|' || lower(n_name)" for k, t in TOPIC.items())} ELSE '' END AS topics FROM {ORDER_SQL}""",
)
def topic_pairs(spark, sf_dir):
    """Measures and places of sentences made of an order's number and its customer's nation."""
    said = F.concat(*[F.when(F.col("o_orderkey") % 4 == k, p).otherwise("") for k, p in PHRASES.items()], F.lit(" in "), "n_name")
    return orders_by_nation(spark, sf_dir).select("o_orderkey", F.array_join(text.topics(said, gazetteer(spark, sf_dir)), ",").alias("topics"))


VERBS = {0: "revokes", 1: "praises", 2: "seizes on", 3: "cancels"}


@query(
    "measure_labels",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (1, 2) THEN 'commentary' WHEN c_custkey % 2 = 0 THEN 'state_measure' ELSE 'distress_event' END AS event_type FROM {ORDER_SQL}""",
)
def measure_labels(spark, sf_dir):
    """Headlines of a State's act upon a customer's licence; every second customer is an investor of means."""
    verb = F.concat(*[F.when(F.col("o_orderkey") % 4 == k, v).otherwise("") for k, v in VERBS.items()])
    title = F.concat_ws(" ", "n_name", F.lit("government"), verb, F.lit("licence of"), "c_name")
    majors = F.when(F.col("c_custkey") % 2 == 0, F.array("c_name")).otherwise(F.array().cast("array<string>"))
    return orders_by_nation(spark, sf_dir).select("o_orderkey", signals.measure_label(title, majors, {})["event_type"].alias("event_type"))


@query("relevant_documents")
def relevant_documents(spark, sf_dir):
    """Whether each document reads like a dispute story."""
    return table(spark, sf_dir, "documents").select("doc_id", signals.relevant("text", {}).alias("relevant"))


@query(
    "index_pages",
    r"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages),
m AS (SELECT page_id, regexp_matches(path, '/(?:regions?|category|categories|tags?|topics?|sections?)/(?:[^/]+/){0,2}([^/]*)$') AS fits,
  regexp_extract(path, '/(?:regions?|category|categories|tags?|topics?|sections?)/(?:[^/]+/){0,2}([^/]*)$', 1) AS label FROM p)
SELECT page_id, fits AND len(list_filter(string_split(label, '-'), lambda w: w <> '')) <= 4 AS listing FROM m""",
)
def index_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", signals.index_page("url").alias("listing"))


@query("short_parties", "SELECT c_custkey, split_part(c_name, '#', 1) || ' of ' || n_name AS party FROM customer JOIN nation ON n_nationkey = c_nationkey")
def short_parties(spark, sf_dir):
    """Customers' names with a legal form and a place, brought to their short names."""
    long = F.concat(F.substring_index("c_name", "#", 1), F.lit(" of "), "n_name", F.lit(" Holdings Ltd, and others"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return c.select("c_custkey", signals.short_party(long).alias("party"))


def _items(spark, sf_dir):
    """Documents as items: a day follows from the number."""
    d = titled(spark, sf_dir)
    none = lambda kind: F.lit(None).cast(kind)
    return d.select(
        F.col("doc_id").alias("id"), "title", none("string").alias("title_en"), F.substring("text", 1, 400).alias("summary"), F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")).alias("url"),
        "source", F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("published_at"), none("timestamp").alias("fetched_at"), "lang",
    )


@query("story_groups")
def story_groups(spark, sf_dir):
    """All documents by first line, as connected components of linked items."""
    return cluster.graph(_items(spark, sf_dir).drop("title_en"), cluster.Lexicon()).select("id", "story")


@query("story_fold")
def story_fold(spark, sf_dir):
    """The ordered fold over a pool, whose size is what selection leaves of a day: the 144 longest documents."""
    pool = titled(spark, sf_dir).orderBy(F.desc("n_chars"), "doc_id").limit(144).select(F.col("doc_id").alias("id"), "title", "lang")
    return cluster.fold(pool, cluster.Lexicon(), F.col("id"))


@query("story_copies")
def story_copies(spark, sf_dir):
    """Copies of the 14 longest documents, as many as a day chases, among all documents."""
    items = _items(spark, sf_dir)
    chased = titled(spark, sf_dir).orderBy(F.desc("n_chars"), "doc_id").limit(14).select(F.col("doc_id").alias("id"))
    found = copies.local_copies(items.join(chased, "id", "left_semi"), items, {})
    return chased.join(found, "id", "left").select("id", F.coalesce(F.size("copies"), F.lit(0)).alias("n"), F.array_join(F.transform(F.coalesce("copies.id", F.array().cast("array<bigint>")), lambda x: x.cast("string")), ",").alias("copies"))
