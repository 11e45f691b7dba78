import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from skeinflow.sources import courts
from skeinflow.sources.origins import Origins, failures
from skeinflow.sources.payloads import rows

def as_of():
    return F.lit("2026-03-10").cast("date")


ATOM = """<?xml version="1.0" encoding="utf-8"?>
<feed xmlns="http://www.w3.org/2005/Atom" xmlns:x="urn:x">
 <title>Judgments</title>
 <entry><title type="html">Orex Ltd v Republic of Peru &amp;amp; another</title><link href="https://site.example/self" rel="self"/><link href="https://site.example/ewhc/comm/2026/123" rel="alternate"/>
  <author><name>Commercial Court</name></author><published>2026-03-01T23:30:00+02:00</published><updated>2026-03-05T00:00:00Z</updated><summary>short &lt;b&gt;text&lt;/b&gt;</summary></entry>
 <entry><title>Halvar v Nord</title><link href="https://site.example/uksc/2026/7"/><author><name>Supreme Court</name></author><updated>2026-03-02T10:00:00Z</updated></entry>
 <entry><title>A v B</title><link href="https://site.example/ewhc/fam/2026/9"/><author><name>Family Division</name></author><updated>2026-03-02T10:00:00Z</updated></entry>
 <entry><title>Old v Case</title><link href="https://site.example/uksc/2020/1"/><author><name>Supreme Court</name></author><updated>2020-03-02T10:00:00Z</updated></entry>
</feed>"""
RSS = """<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>x</title>
 <item><title>One &amp;amp; two</title><link> http://a/1 </link><description>&lt;p&gt;text&lt;/p&gt;</description><pubDate>Mon, 09 Mar 2026 23:30:00 -0300</pubDate><source url="http://o">Outlet</source></item>
 <item><title>Dated otherwise</title><link>http://a/2</link><dc:date>2026-03-08T01:00:00Z</dc:date></item>
 <item><title>No date</title><link>http://a/3</link></item>
 <item><title>Too old</title><link>http://a/4</link><pubDate>Mon, 09 Mar 2020 10:00:00 GMT</pubDate></item>
</channel></rss>"""
SLW = """<rss version="2.0"><channel>
 <item><title>CZQ v CZS [2026] SGHC(I) 16</title><link>http://s/a b.pdf</link><description>Arbitration — Award; Contract — Breach | Decision Date: 3 Mar 2026</description></item>
 <item><title>Orex v Nord, untitled</title><link>http://s/2</link><description>Contract — Breach; arbitration — Enforcement of award | Decision Date: someday</description><pubDate>Tue, 03 Mar 2026 10:00:00 GMT</pubDate></item>
 <item><title>Not Ours [2026] SGCA 1</title><link>http://s/3</link><description>Contract — Arbitration clauses aside | Decision Date: 3 Mar 2026</description></item>
</channel></rss>"""
ECLI = """<feed xmlns="http://www.w3.org/2005/Atom">
 <entry><title>ECLI:NL:GHAMS:2026:55, Gerechtshof Amsterdam, 03-03-2026, 200.1</title><link href="http://n/1" rel="alternate"/><summary>Vernietiging van een arbitraal vonnis.</summary><updated>2026-03-04T08:00:00Z</updated></entry>
 <entry><title>ECLI:NL:RBDHA:2026:1, Rechtbank Den Haag, 03-03-2026</title><link href="http://n/2"/><summary>Huur</summary><updated>2026-03-04T08:00:00Z</updated></entry>
 <entry><title>Uitspraak over arbitrage</title><link href="http://n/3"/><summary>Erkenning</summary><updated>2026-03-04T08:00:00Z</updated></entry>
</feed>"""


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    """The payloads through the data source, with an origin that isn't there, one that is no text, and one too large."""
    at = tmp_path_factory.mktemp("origins")
    files = {"a.xml": ATOM, "b.xml": ATOM, "rss.xml": RSS, "slw.xml": SLW, "nl.xml": ECLI, "broken.xml": "<rss><channel>", "large.xml": "x" * 5000}
    for k, v in files.items():
        (at / k).write_text(v)
    (at / "bytes.xml").write_bytes(b"\xff\xfe\x00")
    (at / "folder").mkdir()
    for k in ("one", "two"):
        (at / "folder" / f"{k}.json").write_text(json.dumps({"d": {"hits": {"t": f"A v B {k}", "on": "03.03.2026", "s": "Schiedsspruch, Aufhebung", "u": k, "c": "OGH", "r": k}}}))
    (at / "folder" / "zwei.json").write_text(json.dumps({"d": {"hits": [{"t": "C v D", "on": "2026-03-02", "s": "Schiedsspruch vollstreckbar"}, {"t": "E v F", "on": "2026-03-02", "s": "Miete"}]}}))
    origins = [
        {"name": "fcl-2", "location": str(at / "a.xml"), "query": '"section 9"', "event_type": "commercial_dispute", "what": "stay", "format": "search"},
        {"name": "fcl-1", "location": f"file://{at}/b.xml", "query": '"section 68"', "event_type": "annulment_setaside", "what": "challenge", "format": "search"},
        {"name": "rss", "location": str(at / "rss.xml"), "format": "feed"}, {"name": "slw", "location": str(at / "slw.xml"), "format": "catchwords"},
        {"name": "nl", "location": str(at / "nl.xml"), "format": "ecli"}, {"name": "broken", "location": str(at / "broken.xml"), "format": "feed"},
        {"name": "at", "location": str(at / "folder"), "format": "nested", "country": "Austria"}, {"location": str(at / "nowhere.xml"), "format": "feed"},
        {"name": "bytes", "location": str(at / "bytes.xml"), "format": "feed"}, {"name": "large", "location": str(at / "large.xml"), "format": "feed"},
    ]
    spark.dataSource.register(Origins)
    return spark.read.format("origins").option("list", json.dumps(origins)).option("most_bytes", "4000").load().cache()


def of(read, name):
    return read.where(F.col("format") == name)


def test_one_partition_an_origin_and_failures_as_a_table(spark, read):
    assert read.rdd.getNumPartitions() == 10 and read.count() == 12
    found = courts.feed(of(read, "feed"), as_of(), 30)
    bad = {r["name"].rsplit("/", 1)[-1]: (r["failed"], r["reason"].split(":")[0]) for r in failures(of(read, "feed"), found).collect()}
    assert bad == {"nowhere.xml": (1, "FileNotFoundError"), "bytes": (1, "UnicodeDecodeError"), "large": (1, "ValueError"), "broken": (1, "no rows")}
    none = spark.read.format("origins").option("list", "[]").load()
    assert none.count() == 0
    with pytest.raises(Exception, match="colour"):
        spark.read.format("origins").option("list", '[{"location": "x", "colour": 1}]').load().count()


def test_atom_and_rss_entries(read):
    got = {r["title"]: (r["url"], r["published_at"], r["summary"], r["outlet"]) for r in courts.feed(of(read, "feed"), as_of(), 30).collect()}
    assert got == {"One & two": ("http://a/1", "2026-03-10", "text", "Outlet"), "Dated otherwise": ("http://a/2", "2026-03-08", "", None), "No date": ("http://a/3", None, "", None)}
    atom = {r["title"]: (r["url"], r["day"], r["summary"]) for r in courts.entries(of(read, "search").where("name = 'fcl-1'")).collect()}
    assert atom["Orex Ltd v Republic of Peru & another"] == ("https://site.example/ewhc/comm/2026/123", dt.date(2026, 3, 1), "short text")
    assert atom["Halvar v Nord"][:2] == ("https://site.example/uksc/2026/7", dt.date(2026, 3, 2))


def test_search_results_are_labelled_by_the_first_query(read):
    got = {r["case_ref"]: r for r in courts.searched(of(read, "search"), as_of(), 30, "https://site.example").collect()}
    assert set(got) == {"[2026] EWHC 123 (Comm)", "[2026] UKSC 7"}
    r = got["[2026] EWHC 123 (Comm)"]
    assert (r["name"], r["event_type"], r["flag_reason"]) == ("fcl-2", "commercial_dispute", "Commercial Court: stay")
    assert r["summary"] == "Judgment of the Commercial Court handed down on 1 March 2026, [2026] EWHC 123 (Comm). Found by the Find Case Law search for ‘section 9’."
    assert (r["source"], r["claimants"], r["respondents"], r["published_at"]) == ("Court: England and Wales", ["Orex Ltd"], ["Republic of Peru & another"], "2026-03-01")


def test_catchwords(read):
    got = {r["url"]: r for r in courts.catchwords(of(read, "catchwords"), as_of(), 30).collect()}
    assert set(got) == {"http://s/a%20b.pdf", "http://s/2"}
    r = got["http://s/a%20b.pdf"]
    assert (r["title"], r["case_ref"], r["event_type"], r["published_at"]) == ("CZQ v CZS", "[2026] SGHC(I) 16", "annulment_setaside", "2026-03-03")
    assert r["summary"] == "Singapore International Commercial Court decided on 3 March 2026, [2026] SGHC(I) 16. Catchwords: Arbitration — Award; Contract — Breach."
    r = got["http://s/2"]
    assert (r["case_ref"], r["event_type"], r["published_at"], r["flag_reason"]) == (None, "enforcement_action", "2026-03-03", "Singapore courts: enforcement of an award")


def test_ecli_list(read):
    got = {r["url"]: r for r in courts.ecli_list(of(read, "ecli"), as_of(), 30).collect()}
    assert set(got) == {"http://n/1", "http://n/3"}
    r = got["http://n/1"]
    assert (r["title"], r["case_ref"], r["event_type"], r["lang"]) == ("Gerechtshof Amsterdam · 200.1", "ECLI:NL:GHAMS:2026:55", "annulment_setaside", "nl")
    assert r["summary"] == "Gerechtshof Amsterdam, uitspraak van 3 March 2026 (ECLI:NL:GHAMS:2026:55). Vernietiging van een arbitraal vonnis."
    assert got["http://n/3"]["title"] == "Dutch court" and got["http://n/3"]["claimants"] == ["Dutch court"]


def test_one_or_many_results(read):
    element = "struct<t: string, on: string, s: string, u: string, c: string, r: string>"
    got = courts.nested(of(read, "nested"), as_of(), 30, "$.d.hits", element, "c", "t", "r", "on", "u", "s", "schiedsspruch").collect()
    assert sorted((r["title"], r["event_type"], r["published_at"]) for r in got) == [
        ("A v B one", "annulment_setaside", "2026-03-03"), ("A v B two", "annulment_setaside", "2026-03-03"), ("C v D", "enforcement_action", "2026-03-02"),
    ]
    assert rows(courts.ecli_list(of(read, "ecli"), as_of(), 30)).columns[0] == "title"
