import json

from pyspark.sql import functions as F

from skeinflow.operators import identity
from skeinflow.sources import payloads as P



def day():
    return F.lit("2026-01-10").cast("date")



def table(spark, *values, **columns):
    names = ["payload", *columns]
    return spark.createDataFrame([(v, *[columns[c] for c in columns]) for v in values], ", ".join(f"{n} string" for n in names))


def test_feed(spark):
    xml = """<rss><channel><title>x</title><item><title>Court rules on the award in Peru</title><link>http://a/1</link><description>&lt;p&gt;The court &amp;amp; the award&lt;/p&gt;</description>
    <pubDate>Fri, 09 Jan 2026 10:00:00 +0000</pubDate></item><item><title>Old</title><link>http://a/2</link><pubDate>Fri, 02 Jan 2026 10:00:00 +0000</pubDate></item>
    <item><title>Undated</title><link>http://a/3</link></item></channel></rss>"""
    rows = P.feed(table(spark, xml, "broken", source="S"), day(), 3).orderBy("url").collect()
    assert [(r["url"], r["published_at"]) for r in rows] == [("http://a/1", "2026-01-09"), ("http://a/3", None)]
    assert rows[0]["summary"] == "The court & the award" and rows[0]["lang"] == "en"


def test_docket_events(spark):
    proc = {"dateregistered": "January 5, 2026", "lastproc": "January 9, 2026 - The Tribunal issues its award", "claimant": "Firm A, Paris<br>Firm B, Lima", "arbitrators": "Mr. X (French) - Appointed by the Claimant(s)", "resp_nationality": "Peru"}
    same = dict(proc, lastproc="January 5, 2026 - Registered")
    case = lambda n, p: {"caseno": n, "casetitle": "A v. B", "econsector": "Oil", "instrumentinvk1": "T1", "instrumentinvk2": "T2", "caseproceedings": [p]}
    cases = P.case_register(table(spark, json.dumps([case("1", proc), case("2", same)]), "nonsense", status="pending"))
    rows = {(r["case_ref"], r["event_type"]): r for r in P.docket_events(cases, day(), 7).collect()}
    assert set(rows) == {("1", "new_case_filed"), ("1", "award_issued"), ("2", "new_case_filed")}
    r = rows["1", "award_issued"]
    assert r["treaty"] == "T1 / T2" and r["states"] == ["Peru"] and r["counsel"] == ["Firm A", "Firm B"] and r["arbitrators"] == ["X"]
    assert P.docket_events(cases, day(), 2).count() == 1


def test_filings_and_dockets(spark):
    hit = lambda i, kind: {"_id": f"000-1-{i}:d.htm", "_source": {"file_type": kind, "display_names": ["Acme Corp (ACM) (CIK 0001)"], "form": "10-K", "file_date": "2026-01-08"}}
    rows = P.filings(table(spark, json.dumps({"hits": {"hits": [hit(1, "10-K"), hit(2, "EX-10.1"), hit(1, "10-K")]}})), day(), 5).collect()
    assert [(r["title"], r["url"]) for r in rows] == [("Acme Corp discloses a dispute in its 10-K", "filings/00011/d.htm")]
    d = lambda u, party: {"caseName": "Halvar Ltd v. Peru", "docket_absolute_url": u, "court": "DDC", "docketNumber": "1:26", "dateFiled": "2026-01-09", "party": party, "firm": ["F", "F"], "recap_documents": [{"description": "Petition"}]}
    rows = P.federal_dockets(table(spark, json.dumps({"results": [d("/1", ["Halvar Ltd", "Peru"]), d("/2", ["United States"])]}), family="sovereign"), day(), 5).collect()
    assert len(rows) == 1 and rows[0]["claimants"] == ["Halvar Ltd"] and rows[0]["respondents"] == ["Peru"] and rows[0]["counsel"] == ["F"]


def test_disclosures_need_a_passage(spark):
    hit = lambda i, kind="10-K", names=("ACME MINING LLC  (ACM)",): {"_id": f"000-1-{i}:d.htm", "_source": {"ciks": ["00042"], "file_type": kind, "display_names": list(names), "form": "10-K", "file_date": "2026-01-08"}}
    text = "Risk factors. In May the company received a notice of arbitration from Halvar Energy under the treaty with Peru and will defend itself. Other matters."
    clause = "Any dispute shall be settled after a notice of arbitration that a party has received under the rules of the chamber, which are final and binding on it."
    docs = spark.createDataFrame([("b/42/00011/d.htm", text), ("b/42/00012/d.htm", clause), ("b/42/00014/d.htm", text), ("b/42/00015/d.htm", None)], "url string, text string")
    found = json.dumps({"hits": {"hits": [hit(1), hit(2), hit(3), hit(4, "EX-10.2"), hit(5), hit(1, "10-K", [])]}})
    queries = ['"treaty claim" "x"', '"notice of arbitration" "treaty"', '"arbitration"']
    payloads = spark.createDataFrame([(q, found) for q in reversed(queries)] + [("other", found)], "query string, payload string")
    rows = P.disclosures(payloads, docs, day(), 5, queries, "received", "shall be settled", "b/").collect()
    assert len(rows) == 1 and rows[0]["url"] == "b/42/00011/d.htm"
    r = rows[0]
    assert r["title"].endswith("discloses notice of arbitration and treaty in 10-K filing") and r["summary"].startswith("In a 10-K filed on 8 January 2026, ") and "Halvar Energy" in r["summary"]
    assert r["case_ref"] == "000-1-1" and r["flag_reason"] == "SEC 10-K filing text contains ‘notice of arbitration’"


def test_judgments_take_objects_and_lists(spark):
    one = {"list": {"doc": {"t": "A gegen B, Schiedsspruch", "d": "09.01.2026", "u": "u1"}}}
    many = {"list": {"doc": [{"t": "C v D award", "d": "2026-01-08", "u": "u2"}, {"t": "Rent", "d": "2026-01-08", "u": "u3"}]}}
    rows = P.judgments(table(spark, json.dumps(one), json.dumps(many)), day(), 5, "$.list.doc", "struct<t: string, d: string, u: string>", {"title": "t", "date": "d", "url": "u"}, "award|schiedsspruch", "X", "Y").orderBy("url").collect()
    assert [(r["url"], r["published_at"], r["claimants"], r["respondents"]) for r in rows] == [("u1", "2026-01-09", ["A"], ["B, Schiedsspruch"]), ("u2", "2026-01-08", ["C"], ["D award"])]


def test_tenders(spark):
    notice = lambda n, title: {"publication-number": n, "notice-title": {"fra": [title], "eng": [title]}, "buyer-name": {"eng": ["Ministry"]}, "publication-date": "2026-01-08+01:00", "buyer-country": ["PER"], "links": {"html": {"ENG": "http://t"}}}
    rows = P.tenders_union(table(spark, json.dumps({"notices": [notice("1", "Legal services, international arbitration"), notice("2", "Legal advice"), notice("3", "Paper")]}))).orderBy("case_ref").collect()
    assert [(r["event_type"], r["title"], r["url"], r["states"]) for r in rows] == [
        ("counsel_tender", "Ministry: Legal services, international arbitration", "http://t", ["PER"]), ("commentary", "Ministry: Legal advice", "http://t", ["PER"]),
    ]
    t = lambda i, title, amount: {"tenderID": i, "title": title, "procuringEntity": {"name": "Utility"}, "value": {"amount": amount, "currency": "UAH"}}
    data = {"data": [t("UA-2026-01-09-1", "legal help", 41.5e5), t("UA-2026-01-09-2", "legal help", 41.5e3), t("UA-2026-01-09-3", "legal, ICSID", 1.0), t("none", "legal, ICSID", 1.0)]}
    rows = P.tenders_national(table(spark, json.dumps(data)), day(), 5).orderBy("case_ref").collect()
    assert [(r["case_ref"][-1], r["amount_usd"]) for r in rows] == [("1", 1e5), ("3", 1 / 41.5)]


def test_pages(spark):
    html = """<a href="/business/2026/windfall-tax-hits-oil">Windfall tax hits <b>oil</b> firms hard</a><a href="/x">Home</a><a href="//other.org/a-long-path-here">Five words on another host</a>
    <a href="/topic/all-the-stories">Five words but a section</a><a href="/laws/section">Case law</a><p>On 5 January 2026 a claim was filed. On 8 January 2026 a notice of dispute arrived. Later.</p>"""
    pages = spark.createDataFrame([("http://www.site.org/news/", html)], "url string, html string")
    assert [(r["title"], r["url"]) for r in P.front_page(pages).collect()] == [("Windfall tax hits oil firms hard", "http://www.site.org/business/2026/windfall-tax-hits-oil")]
    assert P.section_links(pages, "case law", "/cases").first()["sections"] == ["http://www.site.org/laws/section"]
    r = P.register_pages(pages).first()
    assert r["published_at"] == "2026-01-08" and r["event_type"] == "notice_of_intent"


def test_blocks_relay_and_registry(spark, tmp_path):
    text = "Case name: A v B\nSeat: Paris,\nFrance\nStatus: open\nCase name: C v D\nStatus: closed\n"
    rows = P.labelled_blocks(spark.createDataFrame([(1, text)], "id long, text string"), ["Case name", "Seat", "Status"], "Case name").orderBy("n").collect()
    assert [r["fields"] for r in rows] == [{"Case name": "A v B", "Seat": "Paris, France", "Status": "open"}, {"Case name": "C v D", "Status": "closed"}]
    a = spark.createDataFrame([("t", "http://u", ["X"])], "title string, url string, states array<string>")
    both = P.registry({"one": (lambda: a, 1), "two": (lambda: a, 3), "off": (lambda: a, 2)}, {"off": False})
    assert sorted((r["adapter"], r["source_tier"]) for r in both.collect()) == [("one", 1), ("two", 3)]
    P.write_relay(both.drop("source_tier"), str(tmp_path / "relay"))
    (tmp_path / "relay" / "bad.json").write_text('nonsense\n{"adapter": "x", "raw": {"title": "no url"}}\n')
    back = P.read_relay(spark, str(tmp_path / "relay")).collect()
    assert sorted(r["adapter"] for r in back) == ["one", "two"] and back[0]["states"] == ["X"]
    items = identity.items_from_raw(a, "one", 1).first()
    assert items["fingerprint"] and items["lang"] == "en" and items["claimants"] == []


def test_news_wires_and_hosts(spark):
    rows = P.world_news(table(spark, json.dumps({"articles": [{"url": "u", "title": " t ", "seendate": "20260109T1", "sourcecountry": "Peru"}, {"url": "v", "title": "w", "seendate": "x"}]}))).orderBy("url").collect()
    assert [(r["published_at"], r["states"]) for r in rows] == [("2026-01-09", ["Peru"]), (None, [])]
    found = spark.createDataFrame([("Firm wins licence", "s", "Wire One", "http://a.news.org/x"), ("Other", "s", "Blog", "http://z.io/")], "title string, summary string, source string, url string")
    assert [r["event_type"] for r in P.wires(found, "wire", "licence", [("wins", "award_issued")]).collect()] == ["award_issued"]
    outlets = spark.createDataFrame([("news.org", "News"), ("org", "Org")], "host string, outlet string")
    assert {r["url"]: r["outlet"] for r in P.outlet_of_host(found, outlets).collect()} == {"http://a.news.org/x": "News", "http://z.io/": None}
    p = spark.createDataFrame([("Intro text. On 8 September the Company received a notice of arbitration from Halvar over the terminated concession, and it will defend itself in full. More.",)], "t string")
    assert "Halvar" in p.select(P.passage(F.col("t"), "notice of arbitration", "received", "shall be settled")).first()[0]
    swept = spark.createDataFrame([(1, "Same story - Outlet A"), (2, "Same story - Outlet B"), (3, "Else")], "id long, title string")
    assert sorted(r["id"] for r in P.collapse_sweep(swept, "id").collect()) == [1, 3]


def test_feeds_of_a_configuration(spark):
    settings = {"rss": [{"name": "A", "url": "http://a"}, {"name": "off", "url": "http://o", "enabled": False}, {"name": "none"}], "national_press": [{"name": "B", "country": "Peru", "url": "http://b", "lang": "es"}, {"name": "C", "country": "Chad", "url": ""}]}
    from skeinflow.sources.payloads import feeds

    assert [tuple(r) for r in feeds(spark, settings).collect()] == [("A", "http://a", None, None, False), ("B (Peru)", "http://b", "es", "Peru", True)]
    assert feeds(spark, {}).count() == 0


def test_analytics_report(spark, tmp_path):
    from skeinflow.operators import appoint

    kind = "caseproceedings array<struct<arbitrators string, president string, claimant string, respondent string, dateregistered string, dateconstituted string, reconstituted string, clmnt_nationality string, resp_nationality string>>"
    seat = "Jane DOE (British) - Appointed by the Claimant(s)"
    rows = [(f"ARB/{i}", "A v. B", "Oil", "T", None, "pending", [(seat, "", "Firm, London", "Other, Paris", "May 1, 2025", "June 1, 2025", "", "X", "Peru")]) for i in range(3)]
    cases = spark.createDataFrame(rows, f"caseno string, casetitle string, econsector string, instrumentinvk1 string, instrumentinvk2 string, _status string, {kind}")
    appoint.write_analytics(cases, appoint.F.lit("2026-01-01").cast("date"), str(tmp_path), top=1)
    read = {n: spark.read.json(f"{tmp_path}/{n}").collect() for n in ("totals", "arbitrators", "counsel", "affinity", "recent")}
    assert read["totals"][0]["cases"] == read["totals"][0]["seats"] == 3 and read["totals"][0]["top_n_share"] == 1.0
    assert [r["total"] for r in read["arbitrators"]] == [3] and len(read["counsel"]) == 1 and read["affinity"][0]["appointments"] == 3 and len(read["recent"]) == 3
