"""Queries of corpus measurements and of event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinflow.operators import corpus
from skeinflow.plans.items import table
from skeinflow.plans.registry import query
from skeinflow.streaming import ingest


@query(
    "length_distribution",
    """WITH s AS (SELECT lang, list_sort(list(n_chars)) AS v FROM documents GROUP BY lang)
SELECT lang, len(v) AS n, list_avg(v) AS mean, (v[(len(v) - 1) // 2 + 1] + v[len(v) // 2 + 1]) / 2 AS median, v[floor(0.1 * (len(v) - 1))::BIGINT + 1] AS p10,
  v[floor(0.9 * (len(v) - 1))::BIGINT + 1] AS p90, v[1] AS least, v[len(v)] AS most FROM s""",
)
def length_distribution(spark, sf_dir):
    return corpus.distribution(table(spark, sf_dir, "documents"), ["lang"], "n_chars")


@query(
    "style_shares",
    r"""SELECT lang, 100.0::DOUBLE * count(*) FILTER (contains(text, '@')) / count(*) AS with_mail, 100.0::DOUBLE * count(*) FILTER (regexp_matches(text, '[0-9]')) / count(*) AS with_digit,
  100.0::DOUBLE * count(*) FILTER (contains(text, ' | ')) / count(*) AS with_bar FROM documents GROUP BY lang""",
)
def style_shares(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(
        corpus.share(F.contains("text", F.lit("@"))).alias("with_mail"), corpus.share(F.col("text").rlike("[0-9]")).alias("with_digit"),
        corpus.share(F.contains("text", F.lit(" | "))).alias("with_bar"),
    )


@query(
    "first_words",
    """WITH c AS (SELECT lang, split_part(text, ' ', 1) AS value, count(*) AS n FROM documents GROUP BY ALL)
SELECT lang, value, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, value) AS rn FROM c) WHERE rn <= 25""",
)
def first_words(spark, sf_dir):
    return corpus.commonest(table(spark, sf_dir, "documents"), ["lang"], F.substring_index("text", " ", 1), 25)


@query(
    "word_case_profile",
    r"""WITH w AS (SELECT unnest(regexp_extract_all(text, '[a-z,] ([A-Za-z][A-Za-z''-]+)', 1)) AS w FROM (SELECT regexp_replace(text, '([a-z,]) ', '\1  \1 ', 'g') AS text FROM documents WHERE lang = 'en')),
c AS (SELECT lower(w) AS word, count(*) FILTER (w = lower(w)) AS low, count(*) FILTER (w <> lower(w)) AS cap FROM w GROUP BY lower(w))
SELECT word, low, cap FROM c WHERE low >= 2 AND low >= 1.5 * cap AND regexp_matches(word, '^[a-z][a-z''-]+$')""",
)
def word_case_profile(spark, sf_dir):
    return corpus.word_case(table(spark, sf_dir, "documents").where("lang = 'en'"), "text")


@query("source_coverage", "SELECT source, count(*) AS n, count(*) FILTER (n_chars >= 1000) AS good, count(*) FILTER (n_chars >= 1000) >= 20 AS enough FROM documents GROUP BY source")
def source_coverage(spark, sf_dir):
    return corpus.coverage(table(spark, sf_dir, "documents"), "source", F.col("n_chars") >= 1000, 20)


@query("ingest_counters", "SELECT source, count(*) AS found, count(*) FILTER (l.doc_id IS NULL) AS new FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def ingest_counters(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("known"))
    return corpus.counters(table(spark, sf_dir, "documents").join(known, "doc_id", "left"), "source", F.col("known").isNull())


@query("page_yield", r"""SELECT page_id, len(regexp_extract_all(html, '<li>')) AS sections, len(regexp_extract_all(html, '<p[ >]')) AS headlines FROM pages""")
def page_yield(spark, sf_dir):
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", n("<li>").alias("sections"), n("<p[ >]").alias("headlines"))


@query(
    "failure_counts",
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value < 5 GROUP BY ALL)
SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM c) WHERE rn <= 4""",
)
def failure_counts(spark, sf_dir):
    return corpus.commonest(table(spark, sf_dir, "events").where("value < 5"), ["user_id"], "event_type", 4, "event_type")


@query(
    "event_tumbling",
    "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events GROUP BY ALL",
)
def event_tumbling(spark, sf_dir):
    return ingest.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", "event_type").withColumn("total", F.floor(F.col("total") * 100 + 0.5) / 100)


@query(
    "event_sliding",
    "SELECT time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL",
)
def event_sliding(spark, sf_dir):
    return ingest.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", "event_type", slide="30 minutes").select("start", "event_type", "n")


@query(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def event_sessions(spark, sf_dir):
    return ingest.sessions(table(spark, sf_dir, "events"), "ts", "6 hours", "user_id")
