"""Queries over records: identity, classification, score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions import fixed, text
from skeinflow.operators import classify, identity
from skeinflow.operators import score as scoring
from skeinflow.plans.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FIRST_LINE = "split_part(text, chr(10), 1)"


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their first line as title."""
    return table(spark, sf_dir, "documents").withColumn("title", F.substring_index("text", "\n", 1))


CANONICAL_SQL = r"""
p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
q AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS root,
  regexp_replace(regexp_extract(regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', ''), '^[^?]*', 0), '/+$', '') AS path,
  CASE WHEN contains(u, '?') THEN substr(u, strpos(u, '?') + 1) ELSE '' END AS query FROM p),
k AS (SELECT *, list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(split_part(x, '=', 1), '^(utm_|fbclid|gclid|mc_|ref$)')) AS kept FROM q),
canonical AS (SELECT page_id, root || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM k)
"""


@query("canonical_url", f"WITH {CANONICAL_SQL} SELECT * FROM canonical")
def canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_url("url").alias("canonical"))


@query("url_fingerprint", f"WITH {CANONICAL_SQL} SELECT page_id, sha256(canonical) AS fingerprint FROM canonical")
def url_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.fingerprint("url", F.lit("")).alias("fingerprint"))


@query("title_key", rf"SELECT doc_id, sha256(trim(regexp_replace(lower({FIRST_LINE}), '[^a-z0-9]+', ' ', 'g'))) AS title_key FROM documents")
def title_key(spark, sf_dir):
    return titled(spark, sf_dir).select("doc_id", text.title_key("title").alias("title_key"))


@query(
    "insert_if_new",
    rf"""WITH k AS (SELECT doc_id, trim(regexp_replace(lower({FIRST_LINE}), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents)
SELECT min(doc_id) AS doc_id FROM k WHERE doc_id % 2 = 1 AND key NOT IN (SELECT key FROM k WHERE doc_id % 2 = 0) GROUP BY key""",
)
def insert_if_new(spark, sf_dir):
    """Documents of odd number arrive after those of even number; identity is the title's key."""
    docs = titled(spark, sf_dir).select("doc_id", text.title_key("title").alias("key"))
    return identity.insert_if_new(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0"), "key", "doc_id").select("doc_id")


@query("first_per_key", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def first_per_key(spark, sf_dir):
    return identity.first_of(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query(
    "paywall_filter",
    """WITH t AS (SELECT doc_id, lower(trim(CASE WHEN doc_id % 10 = 0 THEN 'Subscribe to read ' || text WHEN doc_id % 10 = 1 THEN '' ELSE text END)) AS t FROM documents)
SELECT doc_id, t = '' OR starts_with(t, 'subscribe to read') AS walled FROM t""",
)
def paywall_filter(spark, sf_dir):
    t = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("Subscribe to read "), "text")).when(F.col("doc_id") % 10 == 1, "").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.is_paywall(t).alias("walled"))


def _votes_sql() -> str:
    lists = {k: "[" + ", ".join(f"'{w}'" for w in v.split()) + "]" for k, v in fixed.LANGUAGE_WORDS.items()}
    return ", ".join(f"len(list_filter(w, lambda x: list_contains({v}, x))) AS {k}" for k, v in lists.items())


_OTHERS = [k for k in fixed.LANGUAGE_WORDS if k != "en"]
LANGUAGE_SQL = rf"""
t AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '\p{{L}}+') AS w FROM documents),
v AS (SELECT doc_id, lang, len(w) AS n, {_votes_sql().replace(" AS id", " AS id_").replace(" AS de", " AS de_")} FROM t),
g AS (SELECT doc_id, lang, CASE WHEN n < 3 THEN 'en' WHEN m >= 2 AND m > en THEN best ELSE 'en' END AS guess FROM (
  SELECT *, greatest({", ".join(k + ("_" if k in ("id", "de") else "") for k in _OTHERS)}) AS m,
    CASE {" ".join(f"WHEN {k + ('_' if k in ('id', 'de') else '')} = greatest({', '.join(j + ('_' if j in ('id', 'de') else '') for j in _OTHERS)}) THEN '{k}'" for k in _OTHERS)} END AS best
  FROM v))
"""


@query("language_guess", f"WITH {LANGUAGE_SQL} SELECT doc_id, guess FROM g")
def language_guess(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.language("text").alias("guess"))


@query("language_confusion", f"WITH {LANGUAGE_SQL} SELECT lang, guess, count(*) AS n FROM g GROUP BY ALL")
def language_confusion(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", text.language("text").alias("guess")).groupBy("lang", "guess").agg(F.count("*").alias("n"))


# Phrases over the invented prose, in the order in which types are tried.
EVENTS = (
    ("notice", ("worthless", "pathetic")),
    ("award", (" the and ", "tionth")),
    ("measure", ("token", "@mail")),
    ("filing", (" des ", " und ")),
)
SECTORS = (("north", ("than", "ing ")), ("south", ("eau", "ment")), ("east", ("keit", "lich")), ("west", ("ción", "queda")))


def _contains_sql(column: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


@query(
    "event_classify",
    f"""WITH t AS (SELECT doc_id, ' ' || lower({FIRST_LINE} || ' ' || text) || ' ' AS t FROM documents)
SELECT doc_id, CASE {" ".join(f"WHEN {_contains_sql('t', p)}" + (" AND NOT contains(t, 'thatble')" if k == 'award' else '') + f" THEN '{k}'" for k, p in EVENTS)} ELSE 'commentary' END AS event_type,
  CASE {" ".join(f"WHEN {_contains_sql('t', p)}" + (" AND NOT contains(t, 'thatble')" if k == 'award' else '') + " THEN CASE " + " ".join(f"WHEN contains(t, '{x}') THEN '{x}'" for x in p) + " END" for k, p in EVENTS)} END AS phrase FROM t""",
)
def event_classify(spark, sf_dir):
    t = classify.padded("title", "text")
    kind, phrase = classify.event_type(t, EVENTS, {"award": ~F.contains(t, F.lit("thatble"))})
    return titled(spark, sf_dir).select("doc_id", kind.alias("event_type"), phrase.alias("phrase"))


@query(
    "sector_tags",
    f"""SELECT doc_id, array_to_string(list_slice(list_filter([{", ".join(f"CASE WHEN {_contains_sql('lower(text)', p)} THEN '{k}' END" for k, p in SECTORS)}], lambda x: x IS NOT NULL), 1, 3), ',') AS sectors FROM documents""",
)
def sector_tags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(classify.tags(F.lower("text"), SECTORS), ",").alias("sectors"))


@query(
    "places_tag",
    """WITH t AS (SELECT o_orderkey, ' ' || n_name || ' and ' || r_name || ' ' AS t FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
f AS (SELECT o_orderkey, list_filter([CASE WHEN contains(t, ' ' || n || ' ') THEN n || '|' || strpos(t, ' ' || n || ' ') END for n in (SELECT list(n_name) FROM nation)], lambda x: x IS NOT NULL) AS found FROM t)
SELECT o_orderkey, coalesce(split_part(found[1], '|', 1), '') AS places FROM f""",
)
def places_tag(spark, sf_dir):
    """Nations named in a sentence made of nation and region; the gazetteer is the nation table (25 names)."""
    n = table(spark, sf_dir, "nation")
    forms = {r["n_name"]: r["n_name"] for r in n.select("n_name").collect()}
    t = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    t = t.join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    sentence = F.concat(F.lit(" "), "n_name", F.lit(" and "), "r_name", F.lit(" "))
    return t.select("o_orderkey", F.array_join(text.places(sentence, forms), ",").alias("places"))


WEIGHTS = {"click": 40.0, "view": 20.0, "purchase": 100.0, "signup": 68.0, "error": 55.0, "commentary": 10.0}


def event_items(spark, sf_dir) -> DataFrame:
    """events as items: the tier, the counsel, the language and the amount follow from their numbers."""
    e = table(spark, sf_dir, "events")
    empty = F.array().cast("array<string>")
    some = lambda cond, x: F.when(cond, F.array(x.cast("string"))).otherwise(empty)
    return e.select(
        F.col("event_id").alias("id"), "event_type", F.col("ts").cast("date").alias("published_at"), F.lit(None).cast("timestamp").alias("fetched_at"),
        F.concat(F.lit("source "), F.col("user_id").cast("string")).alias("source"), (F.col("user_id") % 3 + 1).cast("int").alias("source_tier"),
        F.concat(F.lit("User "), F.col("user_id").cast("string"), F.lit(" "), "event_type").alias("title"), F.col("props").alias("summary"),
        empty.alias("states"), empty.alias("claimants"), empty.alias("respondents"), empty.alias("sectors"), F.lit("").alias("treaty"),
        some(F.col("event_id") % 2 == 0, F.col("user_id")).alias("counsel"), (F.col("value") * 1e6).alias("amount_usd"),
        F.when(F.col("event_id") % 5 == 0, "fr").otherwise("en").alias("lang"), F.lit("none").alias("llm_stage"),
    )


TERMS = {"user 1": 0.3, "purchase": 0.2}
SCORE_SQL = f"""
e AS (SELECT event_id AS id, ts::DATE AS day, event_type, value * 1e6 AS amount, user_id % 3 + 1 AS tier, event_id % 2 = 0 AS counsel, event_id % 5 = 0 AS foreign_,
  lower('User ' || user_id || ' ' || event_type || ' ' || props || CASE WHEN event_id % 2 = 0 THEN ' ' || user_id ELSE '' END) AS hay,
  lower('User ' || user_id || ' ' || event_type || props) AS mutehay FROM events),
scored AS (SELECT id, day, tier, (CASE event_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items() if k != "commentary")} ELSE 10.0 END::DOUBLE
  * pow(0.5::DOUBLE, greatest(0, DATE '2024-01-31' - day)::DOUBLE / 6.0::DOUBLE) * (CASE tier WHEN 1 THEN 1.15 WHEN 2 THEN 1.0 ELSE 0.85 END)::DOUBLE
  * (1.0::DOUBLE + CASE WHEN contains(hay, 'user 1') THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN contains(hay, 'purchase') THEN 0.2 ELSE 0 END::DOUBLE)
  + CASE WHEN amount > 1e6 THEN least(20.0::DOUBLE, 4.0::DOUBLE * log10(amount / 1e6::DOUBLE)) ELSE 0 END)
  * CASE WHEN foreign_ THEN 0.55 ELSE 1 END::DOUBLE * CASE WHEN contains(mutehay, 'error') THEN 0.25 ELSE 1 END::DOUBLE AS score FROM e)
"""


def scored_events(spark, sf_dir) -> DataFrame:
    return scoring.score(event_items(spark, sf_dir), F.lit("2024-01-31").cast("date"), WEIGHTS, TERMS, ("error",))


@query("score_items", f"WITH {SCORE_SQL} SELECT id, floor(score * 1e6 + 0.5) / 1e6 AS score FROM scored")
def score_items(spark, sf_dir):
    return scored_events(spark, sf_dir).select("id", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"))


@query(
    "watchlist_boost",
    """SELECT c_custkey, CASE WHEN contains(lower(c_mktsegment), 'auto') THEN 0.4 ELSE 0.0 END::DOUBLE + CASE WHEN contains(lower(n_name), 'an') THEN 0.25 ELSE 0.0 END::DOUBLE AS boost
FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def watchlist_boost(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    a, b = scoring.watchlist(F.lower("c_mktsegment"), {"auto": 0.4})[0], scoring.watchlist(F.lower("n_name"), {"an": 0.25})[0]
    return c.select("c_custkey", (a + b).alias("boost"))


@query("top_ranked", f"WITH {SCORE_SQL} SELECT id, floor(score * 1e6 + 0.5) / 1e6 AS score FROM scored ORDER BY scored.score DESC, id LIMIT 50")
def top_ranked(spark, sf_dir):
    return scoring.top(scored_events(spark, sf_dir), 50).select("id", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"))
