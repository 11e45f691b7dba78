import json

import pytest
from pyspark.sql import functions as F

from skeinflow.functions import fixed
from skeinflow.operators import issue
from skeinflow.sources import daystore
from skeinflow.sources.daystore import DayStore, clear, manifest, mark_sent, vacuum


@pytest.fixture
def store(spark, tmp_path):
    spark.dataSource.register(DayStore)
    return str(tmp_path / "days")


def rows(spark, *days, text="x", n=7):
    return spark.createDataFrame([(d, "stories", i, json.dumps({"title": f"{text} {i} é"})) for d in days for i in range(n)], "day string, part string, place long, record string").repartition(3)


def save(df, path, **options):
    df.write.format("daystore").mode("overwrite").options(path=path, **options).save()


def held(spark, path, **options):
    return sorted(tuple(r) for r in spark.read.format("daystore").options(path=path, **options).load().collect())


def test_days_are_replaced_whole(spark, store):
    save(rows(spark, "2026-01-01", "2026-01-02"), store)
    save(rows(spark, "2026-01-02", "2026-01-03", text="new", n=2), store)
    got = held(spark, store)
    assert len(got) == 7 + 2 + 2 and {json.loads(r[3])["title"] for r in got if r[0] == "2026-01-02"} == {"new 0 é", "new 1 é"}
    assert len(held(spark, store, day="2026-01-01")) == 7 and held(spark, store, day="2030-01-01") == []
    assert manifest(store)[0] == 2
    assert vacuum(store) > 0 and held(spark, store) == got
    save(rows(spark, "2026-01-04").limit(0), store)
    assert held(spark, store) == got


def test_a_write_that_fails_leaves_the_days(spark, store):
    save(rows(spark, "2026-01-01"), store)
    before = held(spark, store)
    bad = rows(spark, "2026-01-01", text="new").union(rows(spark, "no day", n=1))
    with pytest.raises(Exception, match="no day"):
        save(bad, store)
    assert held(spark, store) == before and manifest(store)[0] == 1


def test_a_write_killed_before_its_manifest_moves(spark, store, monkeypatch):
    save(rows(spark, "2026-01-01"), store)
    before = held(spark, store)
    writer = daystore.DayWriter(store, False)

    class Task:
        partitionId, taskAttemptId = (staticmethod(lambda: 0) for _ in range(2))

    monkeypatch.setattr(daystore.TaskContext, "get", staticmethod(lambda: Task))
    message = writer.write(iter([{"day": "2026-01-01", "part": "stories", "place": 0, "record": "{}"}]))
    assert held(spark, store) == before  # staged, and the driver is gone
    other = daystore.DayWriter(store, False)
    other.commit([other.write(iter([{"day": "2026-01-05", "part": "stories", "place": 0, "record": "{}"}])), None])
    with pytest.raises(RuntimeError, match="meanwhile"):
        writer.commit([message])
    writer.abort([message])
    assert held(spark, store) == sorted([*before, ("2026-01-05", "stories", 0, "{}")])


def test_sent_days_are_refused_unless_forced(spark, store):
    save(rows(spark, "2026-01-01", "2026-01-02"), store)
    mark_sent(store, "2026-01-02")
    before = held(spark, store)
    with pytest.raises(Exception, match="sent already: 2026-01-02"):
        save(rows(spark, "2026-01-02", "2026-01-03", text="new"), store)
    assert held(spark, store) == before
    with pytest.raises(daystore.Refused):
        clear(store, "2026-01-01", "2026-01-09")
    assert clear(store, "2026-01-01", "2026-01-01") == ["2026-01-01"] and clear(store, "2027-01-01", "2027-02-01") == []
    save(rows(spark, "2026-01-02", text="new"), store, force="true")
    assert {json.loads(r[3])["title"][:3] for r in held(spark, store)} == {"new"} and not manifest(store)[1]["2026-01-02"]["sent"]
    with pytest.raises(Exception, match="written whole"):
        rows(spark, "2026-01-02").write.format("daystore").mode("append").options(path=store).save()


def test_day_rows_have_the_fixed_fields(spark, store):
    stories = spark.createDataFrame([(1, "T", 0, "lead", 5.0, ["a"], 1)], "id long, title string, place int, tier string, score double, states array<string>, extra int")
    leads = spark.createDataFrame([(3, "L", 1.0), (2, "M", 2.0)], "id long, title string, score double")
    lists = spark.createDataFrame([(4, "D", 1.0, "docket")], "id long, title string, score double, list string")
    out = issue.day_rows({"stories": stories, "leads": leads, "records": lists}, F.lit("2026-01-01").cast("date"))
    save(out, store)
    got = {(r[1], r[2]): json.loads(r[3]) for r in held(spark, store)}
    assert set(got) == {("stories", 0), ("leads", 0), ("leads", 1), ("records/docket", 0)}
    assert tuple(got["stories", 0])[:28] == fixed.DAY_FIELDS and got["stories", 0]["states"] == ["a"] and "extra" not in got["stories", 0]
    assert got["stories", 0]["tier"] == "lead" and got["leads", 0]["id"] == 2 and got["leads", 1]["tier"] == "signal" and got["leads", 0]["case_ref"] is None
