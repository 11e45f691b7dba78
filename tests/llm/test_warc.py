import base64
import gzip
import hashlib
import io

import pytest

from skeinflow.llm import warc as W
from skeinflow.llm.common import shared_path

PAGES = [
    (1, "http://a/ b", "x" * 1000), (2, None, None), (3, "u\nv", ""), (4, "é", "x" * 1000), (5, "http://b", "é" * 300), (6, "http://c", "WARC/1.1\r\n\r\n"),
    (7, "http://d", "y" * 300_000), (8, "http://e", "y" * 300_000),
]


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 1, 500])
def test_round_trip(spark, least):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, sha1 string")
    folder = shared_path(spark, "warc")
    files = W.write(df, folder, min_bytes=least, chunk=64, file_bytes=2000)
    rows = W.read(spark, folder, files, chunk=100).collect()
    data = {}
    for r in sorted(rows, key=lambda r: (r["record_id"], r["chunk_no"])):
        data[r["record_id"]] = data.get(r["record_id"], b"") + r["data"]
        assert r["digest"] == base64.b32encode(hashlib.sha1(data[r["record_id"]]).digest()).decode()
    last = {int(r["record_id"].split(":")[-1]): r for r in rows if r["last"]}
    assert len(last) == len(PAGES) == files.agg({"records": "sum"}).first()[0]
    first = {}
    for page, _, html in PAGES:
        body = (html or "").encode()
        f = first.setdefault(body, page) if len(body) >= least else page
        r = last[page]
        assert r["payload_bytes"] == len(body) and r["declared"] == digest(html)
        assert (r["type"], r["refers_to"]) == (("response", None) if f == page else ("revisit", f"urn:page:{f}"))
        assert data[f"urn:page:{page}"] == (body if f == page else b"")


def test_each_record_is_a_gzip_member(spark):
    df = spark.createDataFrame(PAGES[:3], "page_id long, url string, html string")
    folder = shared_path(spark, "warc")
    name = W.write(df, folder).first()["file"]
    with open(f"{folder.removeprefix('file://')}/{name}", "rb") as f:
        raw = f.read()
    assert gzip.decompress(raw).count(b"WARC/1.1\r\n") >= 1 and raw.count(b"\x1f\x8b\x08") >= 1


def test_plain_archives_and_damage():
    text = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <x>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert [r[-1] for r in W.records(W._Stream(io.BytesIO(text + text)), 3)] == [b"hel", b"lo"] * 2
    with pytest.raises(ValueError, match="within a record"):
        list(W.records(W._Stream(io.BytesIO(text[:-8]))))
    bad = text.replace(b"WARC-Type", b"WARC-Payload-Digest: sha1:" + b"A" * 32 + b"\r\nWARC-Type")
    with pytest.raises(ValueError, match="does not have its digest"):
        list(W.records(W._Stream(io.BytesIO(bad))))


def test_empty_table_and_repeats(spark):
    schema = "page_id long, url string, html string"
    folder = shared_path(spark, "warc")
    assert W.read(spark, folder, W.write(spark.createDataFrame([], schema), folder)).count() == 0
    folder = shared_path(spark, "warc")
    rows = W.read(spark, folder, W.write(spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (2, "u", "a")], schema), folder), with_data=False).collect()
    assert sorted((r["record_id"].split(":")[2], r["type"]) for r in rows) == [("1", "response")] * 2 + [("2", "revisit")]
    assert len({r["record_id"] for r in rows}) == 3


def test_pages_without_id(spark):
    rows = [(None, "u", "a"), (None, None, "a"), (4, "u", "a"), (5, "u", "a")]
    folder = shared_path(spark, "warc")
    read = W.read(spark, folder, W.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder), with_data=False).collect()
    assert sorted((r["record_id"].split(":")[2], r["type"], r["refers_to"]) for r in read) == [("4", "response", None), ("5", "revisit", "urn:page:4")] + [("None", "response", None)] * 2
    assert len({r["record_id"] for r in read}) == 4
