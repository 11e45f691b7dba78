import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skeinflow.operators import chase, corpus, phrases
from skeinflow.operators.extract import counted, extracted
from skeinflow.operators.phrases import commonest, ngrams, trimmed


def test_trimmed_counts_are_low_by_at_most_what_was_cut():
    rnd = random.Random(1)
    held, true, lost = Counter(), Counter(), 0
    for _ in range(5000):
        v = int(rnd.paretovariate(0.7))
        held[v] += 1
        true[v] += 1
        if len(held) > 40:
            lost += trimmed(held, 10)
    assert lost and all(true[v] - lost <= held.get(v, 0) <= true[v] for v in true)


@pytest.mark.parametrize("counters", [2, 50, 100_000])
def test_commonest_is_exact_at_any_number_of_counters(spark, counters, monkeypatch):
    rnd = random.Random(2)
    rows = [(i, [str(int(rnd.paretovariate(0.6)) % 5000) for _ in range(rnd.randint(0, 30))] if rnd.random() > 0.05 else None) for i in range(2000)]
    rows += [(-1, [None, "1", None])]
    want = Counter(v for _, r in rows for v in r or [] if v is not None)
    df = spark.createDataFrame(rows, "id long, v array<string>").repartition(5)
    for most in (1, 20, 10**6):
        got = [(r["value"], r["n"]) for r in commonest(df, F.col("v"), most, counters, most_counters=2000).collect()]
        assert sorted(got) == sorted(sorted(want.items(), key=lambda kv: (-kv[1], kv[0]))[:most])
    monkeypatch.setattr(phrases, "MOST_SENT", 3)
    assert commonest(df, F.col("v"), 20, 100_000).count() == 20
    assert commonest(df.limit(0), F.col("v"), 5).count() == 0


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"],), (["a"],), ([],), (None,)], "w array<string>")
    assert [r[0] for r in df.select(ngrams(F.col("w"), 3)).collect()] == [["a b c", "b c d"], [], [], []]


def test_openings(spark):
    texts = ["A Dutch company has", "The Hague-based investor won", "An Orex thing", "The tribunal rose", "Orex won", "the court", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(corpus.opening_shape("t")).collect()] == ["A <Adjective> company", "The <Adjective> investor", "An", "<Name> …", "<Name> …", None, None, None]
    assert {(r["phrase"], r["n"]) for r in corpus.containing(df, F.col("t"), ("won", "tribunal", "zz")).collect()} == {("won", 2), ("tribunal", 1)}


def test_chunks_cross_batches_and_failures_pass_through(spark, tmp_path):
    """Calls fail for chunks with certain rows, some at the first try only; what was called is kept in files."""
    log = str(tmp_path)

    def call(chunk):
        import os
        import uuid

        ids = [r["id"] for r in chunk]
        with open(f"{log}/{ids[0]}-{uuid.uuid4().hex}", "w") as f:
            f.write(",".join(map(str, ids)))
        tries = sum(name.startswith(f"{ids[0]}-") for name in os.listdir(log))
        if 45 in ids or (25 in ids and tries == 1):
            raise RuntimeError("no answer")
        if 65 in ids:
            return [{}] * (len(ids) - 1)
        return [None if i == 3 else {"relevant": i % 2 == 0, "é": r["title"]} for i, r in zip(ids, chunk, strict=True)]

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(87).select("id", F.concat(F.lit("t"), "id").alias("title"), F.lit("old").alias("llm_stage"), F.lit("2026-01-01").cast("timestamp").alias("at"), F.array(F.lit("x")).alias("list")).coalesce(1)
        out = extracted(df, call, 20, "triaged", "untriaged")
        rows = {r["id"]: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(rows) == list(range(87)) and rows[5]["list"] == ["x"] and rows[5]["at"].year == 2026
    assert {tuple(map(int, (tmp_path / f).read_text().split(","))) for f in __import__("os").listdir(log)} == {tuple(range(k, min(k + 20, 87))) for k in range(0, 87, 20)}
    assert {i for i, r in rows.items() if r["llm_stage"] == "untriaged"} == {3, *range(40, 80)}
    assert all(r["answer"] is None for r in rows.values() if r["llm_stage"] == "untriaged") and rows[4]["answer"] == '{"relevant": true, "é": "t4"}'
    assert {i: rows[i]["attempts"] for i in (0, 20, 40, 60, 80)} == {0: 1, 20: 2, 40: 2, 60: 2, 80: 1}
    assert extracted(df.limit(0), call, 1, "a", "b").count() == 0
    tally = {r["stage"]: (r["rows"], r["attempts"]) for r in counted(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "llm_stage string, attempts long")).collect()}
    assert tally == {"a": (2, 3), "b": (1, 1)}


def test_chase_queries(spark):
    rows = [
        ("Halvar's award against Iraq-Türkiye upheld by US court", ["Iraq", "Turkey", "United States"], ["Halvar", "Halvar"], ["Halvar Energy"], [None, "", "Iraq"]),
        ("Panel weighs claim", ["United States"], [], None, None), (None, None, None, None, None), ("Licence", [], ["Orex"], [], []),
        ("Enforcement and treaty annulment in Congo", ["Congo (DRC)"], [], [], []),
    ]
    df = spark.createDataFrame(rows, "t string, s array<string>, n array<string>, c array<string>, r array<string>")
    got = [r[0] for r in df.select(chase.queries(F.col("t"), F.col("s"), F.col("n"), F.col("c"), F.col("r"))).collect()]
    assert got[0] == ['"Halvar Energy" "Iraq" award', '"Halvar" award', '"Iraq" "Turkey" award', '"Halvar" court award', "Halvar award Iraq rkiye upheld"]
    assert got[1] == ['"US" arbitration', "Panel weighs claim"] and got[2] == [] and got[3] == ['"Orex" licence']
    assert got[4][0] == '"Congo" treaty enforcement' and got[4][1:] == ["Enforcement treaty annulment Congo"]


def test_feeds_of_a_page(spark):
    html = """<link rel="alternate" type="application/rss+xml" href="/feed.xml?a=1&amp;b=2"><LINK href='news/atom.xml' type='application/atom+xml'>
      <link type="application/rss+xml" href="//cdn.example/f"><link type="application/rss+xml" href="/comments/feed"><link type="text/css" href="x.css">
      <link type="application/rss+xml" href="https://o.example/r"><link type="application/rss+xml">"""
    rows = [(html, "https://a.example/news/index.html?x#y"), (html, "https://a.example"), (None, "http://b/"), ("", None), ("", "no url")]
    df = spark.createDataFrame(rows, "h string, u string")
    got = [r[0] for r in df.select(chase.feed_links(F.col("h"), F.col("u"))).collect()]
    assert got[0] == ["https://a.example/feed.xml?a=1&b=2", "https://a.example/news/news/atom.xml", "https://cdn.example/f", "https://o.example/r"]
    assert got[1][1] == "https://a.example/news/atom.xml" and got[2] == []
    cands = [r[0] for r in df.select(chase.feed_candidates(F.col("h"), F.col("u"))).collect()]
    assert cands[0][4:9] == [*(f"https://a.example/news/index.html{p}" for p in ("/feed/", "/feed", "/rss", "/rss.xml")), "https://a.example/feed/"]
    assert cands[2][:2] == ["http://b/feed/", "http://b/feed"] and len(cands[2]) == 15 and cands[3] in ([], None) and cands[4] == []


def test_freshness(spark):
    def feed(*days):
        return "<rss><channel>" + "".join(f"<item><title>t</title>{f'<pubDate>{d}T00:00:00Z</pubDate>' if d else ''}</item>" for d in days) + "</channel></rss>"

    rows = [("new", feed("2026-02-01", "2020-01-01", None)), ("old", feed("2025-12-01")), ("edge", feed("2026-01-15")), ("bare", feed(None, None, None)), ("two", feed(None, None)), ("none", feed()), ("bad", "<html>")]
    got = {r["name"]: r["fresh"] for r in chase.freshness(spark.createDataFrame(rows, "name string, payload string"), F.lit("2026-03-01").cast("date")).collect()}
    assert got == {"new": True, "old": False, "edge": True, "bare": True, "two": False}


@pytest.mark.parametrize("run", [1, 2, 3])
@pytest.mark.parametrize("named", [0, 10_000])
def test_runs_are_made_in_blocks_where_they_are_counted(spark, run, named, monkeypatch):
    """As the runs of ngrams(), also across the blocks' borders, on every way to count them."""
    pa = pytest.importorskip("pyarrow")
    monkeypatch.setattr(phrases, "MOST_NAMED", named)
    rnd = random.Random(3)
    rows = [(i, [f"w{int(rnd.paretovariate(1))}" for _ in range(rnd.randint(0, 9))] if rnd.random() > 0.1 else None) for i in range(300)]
    want = Counter(" ".join(r[k : k + run]) for _, r in rows if r for k in range(len(r) - run + 1))
    df = spark.createDataFrame(rows, "id long, v array<string>").repartition(3)
    top = sorted(want.items(), key=lambda kv: (-kv[1], kv[0]))[:15]
    for counters in (100_000, 20, 3):
        got = commonest(df, F.col("v"), 15, counters, most_counters=100_000 if counters > 3 else 4, run=run)
        assert [tuple(r) for r in got.orderBy(F.desc("n"), "value").collect()] == top
    monkeypatch.setattr(phrases, "CHUNK", 2)
    lists = pa.array([["a", "b", "c"], None, [], ["d"], ["e", "f"], ["g", None, "h"]][: 5 if run == 1 else 6])
    made = [x for a in phrases.runs_of(lists, run) for x in a.to_pylist()]
    assert made == {1: [*"abcdef"], 2: ["a b", "b c", "e f", "g", "h"], 3: ["a b c", "g h"]}[run]
