"""Worked cases of operators that no query with SQL covers."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from skeinflow.functions import fixed, text
from skeinflow.operators import classify, ground, link
from skeinflow.operators import select as sel


def stems(t):
    return {re.sub("(ies|es|s|ed|ing)$", "", w.lower()) for w in re.findall("[A-Za-z]{4,}", t or "") if w.lower() not in fixed.STEM5_STOP}


def kept(sentence, evidence):
    if not sentence[-1:] in fixed.SENTENCE_ENDS or re.search(r"(?:…|\.\.\.)\s*$|^[a-z]", sentence):
        return False
    need = stems(sentence)
    if len(need) < fixed.GROUND_SHORT:
        return True
    numbers = re.findall("[0-9][0-9,.]*", sentence)
    return any(len(need & stems(e)) >= fixed.GROUND_SHARE * len(need) and all(n in e for n in numbers) for e in evidence if e)


def test_vetted_sentences_against_one_piece_of_evidence_at_a_time(spark):
    rnd = random.Random(6)
    words = "tribunal award Halvar mining licence revoked damages claims court Peru ordered 350 1,200 million treaty".split()
    sentence = lambda: rnd.choice(("The ", "the ", "")) + " ".join(rnd.sample(words, rnd.randint(2, 8))) + rnd.choice((".", ".", "...", "", "!"))
    texts = [(i, " ".join(sentence() for _ in range(rnd.randint(0, 4)))) for i in range(80)] + [(80, None), (81, "")]
    evidence = [(rnd.randrange(70), " ".join(rnd.sample(words, rnd.randint(5, 12)))) for _ in range(160)] + [(3, None), (4, "")]
    t = spark.createDataFrame(texts, "id long, text string")
    e = spark.createDataFrame(evidence, "id long, evidence string").repartition(4)
    split = {r["id"]: r["s"] for r in t.select("id", text.sentences("text").alias("s")).collect()}
    own = {}
    for i, x in evidence:
        own.setdefault(i, []).append(x)
    want = {(i, n, s): kept(s, own.get(i, [])) for i, parts in split.items() for n, s in enumerate(parts or [])}
    got = {(r["id"], r["at"], r["sentence"]): r["kept"] for r in ground.vetted(t, e, "id").collect()}
    assert got == want and 0 < sum(want.values()) < len(want)
    whole = {r["id"]: (r["text"], r["kept"], r["dropped"]) for r in ground.grounded_text(ground.vetted(t, e, "id"), "id").collect()}
    for i, row in whole.items():
        mine = sorted((n, s, k) for (j, n, s), k in want.items() if j == i)
        assert row == (" ".join(s for _, s, k in mine if k), sum(k for *_, k in mine), sum(not k for *_, k in mine))


def test_reclassify(spark):
    day = dt.date(2026, 1, 20)
    rows = [
        (1, "Paper", "award_issued", None, None, day), (2, "Paper", "commentary", "SEC filing", "none", day), (3, "Paper", "commentary", "SEC filing, joins firm", None, day),
        (4, "Paper", "award_issued", None, "read", day), (5, "Court: Lima", "award_issued", None, None, day), (6, "ICSID docket", "award_issued", None, None, day),
        (7, "Paper", "award_issued", None, None, dt.date(2025, 12, 1)), (8, "Paper", None, None, None, None), (9, "Paper", "settlement", None, None, None),
    ]
    items = spark.createDataFrame(rows, "id long, source string, event_type string, flag_reason string, llm_stage string, published_at date").withColumn(
        "fetched_at", F.when(F.col("id") == 8, F.lit("2026-01-19 10:00:00").cast("timestamp"))
    )
    rules = lambda df: df.withColumn("event_type", F.when(F.contains("flag_reason", F.lit("joins")), "lateral_move").otherwise("settlement"))
    got = {r["id"]: (r["event_type"], r["changed"]) for r in classify.reclassify(items, F.lit(day), rules).collect()}
    assert got == {1: ("settlement", True), 2: ("commentary", False), 3: ("lateral_move", True), 8: ("settlement", True)}


def test_releasing_days_and_pinning(spark):
    items = spark.createDataFrame([(1, 10, True, False), (2, 11, False, None), (3, 12, None, True), (4, None, False, False)], "id long, issue_id long, pinned boolean, excluded boolean")
    issues = spark.createDataFrame([(10, "2026-01-01", True), (11, "2026-01-02", False), (12, "2026-01-03", None)], "issue_id long, day string, sent boolean").withColumn("day", F.to_date("day"))
    freed, left = sel.release_days(items, issues, F.to_date(F.lit("2026-01-01")), F.to_date(F.lit("2026-01-02")))
    assert {r["id"]: r["issue_id"] for r in freed.collect()} == {1: 10, 2: None, 3: 12, 4: None} and {r["issue_id"] for r in left.collect()} == {10, 12}
    now = {r["id"]: (r["pinned"], r["excluded"]) for r in sel.pin(items, [1, 3, 4], "pinned").collect()}
    assert now == {1: (False, False), 2: (False, None), 3: (True, False), 4: (True, False)}
    out = {r["id"]: (r["pinned"], r["excluded"]) for r in sel.pin(items, [1], "excluded").collect()}
    assert out[1] == (False, True) and out[3] == (None, True)


def test_records_are_attached_first(spark):
    copy = "struct<source: string, url: string, title: string>"
    a, b = ("A", "u1", "x"), ("B", "u2", "y")
    df = spark.createDataFrame([(1, [a, b], ("R", "u2", "r")), (2, None, ("R", "u9", "r")), (3, [a], None), (4, None, None)], f"id long, c array<{copy}>, r {copy}")
    got = {r["id"]: None if r["c"] is None else [x["url"] for x in r["c"]] for r in df.select("id", link.attach(F.col("c"), F.col("r")).alias("c")).collect()}
    assert got == {1: ["u2", "u1"], 2: ["u9"], 3: ["u1"], 4: None}


def test_party_match_and_any_of(spark):
    rows = [("Halvar wins against Peru", ["Halvar", "Peru"], True), ("Peru talks", ["Peru"], False), ("Republic of Peru loses", ["Peru"], True), ("Peru and Iraq", ["Peru", "Iraq"], True), ("Grain", ["Halvar"], False)]
    df = spark.createDataFrame(rows, "t string, n array<string>, want boolean")
    assert all(r["got"] == r["want"] for r in df.select(link.party_match(F.col("n"), F.col("t"), ("Peru", "Iraq")).alias("got"), "want").collect())
    assert df.where(link.any_of(F.col("t") == "Grain", F.col("t") == "Peru talks")).count() == 2


def test_outlets(spark):
    df = spark.createDataFrame([("Court rules - again - The Paper",), ("No outlet",), (" - X",), (None,)], "t string")
    assert [r[0] for r in df.select(text.outlet_key("t")).collect()] == ["court rules again", "no outlet", "", ""]
    hosts = ["https://www.paper.co.uk/x", "http://news.site.example.org", "http://a.com.br/", "http://localhost", None, "http://com.pe/"]
    df = spark.createDataFrame([(h,) for h in hosts], "u string")
    assert [r[0] for r in df.select(text.registrable("u")).collect()] == ["paper", "example", "a", "", "", "com"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<meta property="og:description" content="one two three four five six seven eight nine ten eleven &amp; twelve">', "one two three four five six seven eight nine ten eleven & twelve"),
        ('<meta name="description" content="too short"><p>Subscribe to read this and all the other articles on this site, which are many and long.</p><p class="x">A first long <b>paragraph</b> that says what the page is about, in more than eighty characters.</p>',
         "A first long paragraph that says what the page is about, in more than eighty characters."),
        ("<p>short</p>", ""), ("", ""), (None, ""),
    ],
)
def test_page_summary(spark, page, want):
    assert spark.createDataFrame([(page,)], "h string").select(text.page_summary("h")).first()[0] == want
