import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from skeinflow.operators import issue
from skeinflow.operators.cluster import Lexicon

SCHEMA = (
    "id long, title string, title_en string, summary string, summary_en string, story string, url string, source string, source_tier int, score double, published_at date, "
    "fetched_at timestamp, event_type string, issue_id long, relevant boolean, excluded boolean, pinned boolean, claimants array<string>, respondents array<string>, states array<string>, "
    "counsel array<string>, amount_usd double, lang string, country string, case_ref string, also array<struct<source string, url string, title string>>"
)
NAMES = ["Halvar", "Zentil", "Korbank", "Aurix", "Dornex", "Melior", "Partan", "Quexo", "Rivalt", "Sombra", "Tessel", "Ulmar", "Vantor", "Wexel"]
# A headline's first word is never taken for a name, so the names stand later: of two headlines each with a name of its own no other likeness makes one story.
PLACES = ["Peru", "Mexico", "Turkey", "Iraq", "Czechia", "Ghana", "Chile"]
LEXICON = Lexicon(forms={p: p for p in PLACES}, common=("min",))


@pytest.fixture(autouse=True)
def interpreted(spark):
    """A day is some dozens of rows in many small plans: compiling them would take most of the time."""
    off = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows():
    out = []

    def add(day, title, score, event="award_issued", source="Paper", **more):
        i = len(out)
        r = dict.fromkeys([x.split()[0] for x in SCHEMA.split(", ") if not x.startswith(("url string>", "title string>"))])
        r |= {"id": i, "title": title, "url": f"http://x/{i}", "source": source, "source_tier": 2, "score": float(score), "published_at": dt.date(2026, 1, day), "event_type": event, "lang": "en"}
        r |= {"claimants": [], "respondents": [], "states": [], "counsel": [], "also": []} | more
        out.append(r)

    for k, n in enumerate(NAMES):
        day = 9 + k % 2
        add(day, f"Tribunal grants {n} an award against {PLACES[k % 7]} over the {n.lower()} plant", 90 - k, summary=f"A tribunal found for {n} Energy Group. It was a long case of many years.")
    add(9, "Arbitrators award Halvar damages against Peru over halvar plant, court says", 70)
    add(10, "Court lets Halvar award against Peru over the halvar plant stand in arbitration", 99, summary="A court left the award for Halvar Energy Group in place. Peru had asked for its annulment.")
    for k, n in enumerate(["Oristo", "Palvex", "Runeo"]):
        add(10, f"Ghana revokes licence of {n} Mining in sector {n} review", 60 - k, "state_measure")
    add(10, "Court of Lima enforces arbitration award for Belgar against Chile", 55, "enforcement_action", "Court: Lima", country="Peru")
    for k in range(5):
        add(10, f"Appeal {k} heard on bond matter {NAMES[k]}x", 5, "commentary", "Court: Lima", country="Peru")
    add(10, "Survey of arbitration awards 2025", 95)
    add(10, "Case registered for Norvik", 10, "new_case_filed", "ICSID docket")
    return out


def test_two_days_repeat_nothing(spark, tmp_path):
    data = rows()
    keys = [f.name for f in spark.createDataFrame([], SCHEMA).schema]
    items = spark.createDataFrame([tuple(r[k] for k in keys) for r in data], SCHEMA)
    shown = spark.createDataFrame([], "day date, url string, title string")
    s = issue.Settings(max_items=5, lexicon=LEXICON)
    after, issues, carried = issue.rebuild(spark, items, shown, ["2026-01-10", "2026-01-09"], s)
    assert [r["number"] for r in issues.orderBy("day").collect()] == [1, 2]
    got = {r["id"]: r["issue_id"] for r in after.where("issue_id IS NOT NULL").collect()}
    first, second = ({i for i, n in got.items() if n == k} for k in (1, 2))
    assert first and second and not first & second
    titles = {r["id"]: r["title"] for r in data}
    assert any("Halvar" in titles[i] for i in first) and not any("Halvar" in titles[i] for i in second)
    # The second day is quiet: headlines on the topic fill it up, and those are not tested for news.
    assert len(second) <= 6 and {i for i in got if "Survey" in titles[i]} <= second
    per_day = carried.groupBy("url").agg(F.countDistinct("day").alias("n")).where("n > 1")
    assert per_day.count() == 0


def test_parts_of_a_day(spark, tmp_path):
    data = rows()
    keys = [f.name for f in spark.createDataFrame([], SCHEMA).schema]
    items = spark.createDataFrame([tuple(r[k] for k in keys) for r in data], SCHEMA)
    none = spark.createDataFrame([], "issue_id long, number long, day date, sent boolean")
    shown = spark.createDataFrame([], "day date, url string, title string")
    s = issue.Settings(max_items=4, lexicon=LEXICON)
    parts = issue.build(items, none, shown, F.lit("2026-01-10").cast("date"), s)
    stories = parts["stories"].orderBy("place").collect()
    assert len(stories) == 4 and stories[0]["tier"] == "lead" and [r["score"] for r in stories] == sorted((r["score"] for r in stories), reverse=True)
    assert {r["event_type"] for r in parts["leads"].collect()} == {"state_measure"}
    assert [r["source"] for r in parts["enforcement"].collect()] == ["Court: Lima"]
    lists = {}
    for r in parts["records"].collect():
        lists.setdefault(r["list"], []).append(r["id"])
    assert len(lists["courts"]) == 2 and len(lists["docket"]) == 1
    issue.write_day(parts, "2026-01-10", str(tmp_path))
    (file,) = (tmp_path / "day=2026-01-10").glob("*.json")
    day = json.loads(file.read_text())
    assert day["date"] == "2026-01-10" and [x["place"] for x in day["stories"]] == [0, 1, 2, 3] and len(day["enforcement"]) == 1


def test_foreign_dockets_and_waiting_items(spark):
    from skeinflow.functions.text import places
    from skeinflow.operators.select import pending

    df = spark.createDataFrame(
        [(1, "US federal docket", "Smith v. Broker Inc", "consumer claim"), (2, "US federal docket", "In re Application of Halvar", None), (3, "US federal docket (sovereign)", "A v. B", None),
         (4, "US federal docket", "Halvar v. Peru", None), (5, "US federal docket", "A v. B", "Petition under the New York Convention")], "id long, source string, title string, summary string"
    )
    assert [r["id"] for r in df.where(issue.foreign_docket(places("title", LEXICON.forms))).orderBy("id").collect()] == [2, 3, 4, 5]
    rows = spark.createDataFrame([(1, "none", True, "2026-01-01", None), (2, "none", True, None, "2026-01-03"), (3, "done", True, "2026-01-05", None), (4, "none", False, "2026-01-05", None), (5, "none", True, None, None)], "id long, llm_stage string, relevant boolean, published_at string, fetched_at string")
    assert [r["id"] for r in pending(rows, "none", 2).collect()] == [2, 1]
    text = spark.createDataFrame([("Ruling on Halvar Petroleum",), ("Cabinet Group of Ministers",), ("Acme Co pays",)], "t string")
    assert [r[0] for r in text.select(F.col("t").rlike(issue.Settings().business)).collect()] == [True, False, True]


def frame(spark, data):
    keys = [f.name for f in spark.createDataFrame([], SCHEMA).schema]
    return spark.createDataFrame([tuple(r[k] for k in keys) for r in data], SCHEMA)


def test_a_thin_day_reaches_back_and_headlines_alone_go(spark):
    data = rows()
    for r in data:
        # Of the day's stories two keep their text; of the day before, which is out of a window of no days, all do.
        if r["published_at"] == dt.date(2026, 1, 10) and r["id"] not in (1, 3):
            r["summary"] = None
        r["source_tier"] = 1 if r["source"].startswith(("Court:", "ICSID")) else 2
    none = spark.createDataFrame([], "issue_id long, number long, day date, sent boolean")
    shown = spark.createDataFrame([], "day date, url string, title string")
    s = issue.Settings(max_items=5, today_days=0, lexicon=LEXICON)
    day = F.lit("2026-01-10").cast("date")
    got = issue.today(frame(spark, data), none, shown, day, s).collect()
    assert [r["id"] for r in got[:2]] == [1, 3] and len(got) == 5
    # The court's story of the day has its text from the day before, so it is held over with those of that day.
    assert {r["id"] for r in got[2:] if r["published_at"] != dt.date(2026, 1, 9)} <= {15}
    assert [r["flag_reason"] for r in got] == [None, None, *["held over from the previous day"] * 3]
    assert not any(r["brief_only"] for r in got)
    parts = issue.build_explained(frame(spark, data), none, shown, day, s)
    stories = parts["stories"].orderBy("place").collect()
    assert [r["id"] for r in stories] == [r["id"] for r in got] and [r["lead"] for r in stories] == [True, False, False, False, False]
    assert parts["leads"].count() == 0  # no text and nobody else reports them
    assert [r["source"] for r in parts["enforcement"].collect()] == ["Court: Lima"]


def test_text_and_lead_choice(spark):
    rows_ = [
        (1, "Tribunal grants Halvar an award against Peru", "A tribunal found for Halvar Energy Group after a long case of years.", "award_issued", 2, "Paper", ["x"]),
        (2, "Tribunal grants Zentil an award against Peru", "<p>Read more</p>", "award_issued", 2, "Paper", None),
        (3, "Halvar motion entry", "MISCELLANEOUS CASE INITIATING DOCUMENT MOTION FOR COURT ENTRY OF HALVAR CASE NOW", "new_case_filed", 1, "Court: X", []),
        (4, "Ghana revokes licence of Oristo Mining", "Ghana has revoked the licence of Oristo Mining after a review of all contracts. The post Oristo appeared first on Paper.", "state_measure", 2, "Paper", []),
        (5, "Panel picked", None, "award_issued", 2, "Trade Review", []),
    ]
    df = spark.createDataFrame(rows_, "id long, title string, summary string, event_type string, source_tier int, source string, corroboration array<string>")
    df = df.withColumns({"title_en": F.lit(None).cast("string"), "summary_en": F.lit(None).cast("string"), "url": F.lit("u")})
    s = issue.Settings(trade="Trade Review")
    assert [r["id"] for r in issue.with_text(df, s).orderBy("id").collect()] == [1, 3, 4, 5]
    assert [r["id"] for r in issue.backed(df).orderBy("id").collect()] == [1, 3, 4]
    assert issue.backed(df.drop("corroboration")).where("id in (2, 5)").count() == 0
    placed = df.select("id", "event_type", (F.col("id") - 1).alias("place"), (F.col("id") == 3).alias("brief_only"))
    lead = lambda d: [r["id"] for r in issue.lead_story(d).where("lead").collect()]
    assert lead(placed) == [4]  # a measure starts a dispute; the docket entry is told in brief
    assert lead(placed.where("id in (1, 2)")) == [1] and lead(placed.where("id = 3")) == [3] and lead(placed.limit(0)) == []
    assert lead(placed.withColumn("place", F.col("id") + F.when(F.col("id") == 4, 10).otherwise(0))) == [4]
