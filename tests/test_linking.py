import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skeinflow.operators import link
from skeinflow.streaming.linking import first_seen, unique_links

START = dt.datetime(2026, 1, 1)


def at(hours):
    return START + dt.timedelta(hours=hours)


def files(spark, path, schema, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/b={i:03d}")
    return spark.readStream.schema(f"{schema}, b int").option("maxFilesPerTrigger", 1).parquet(path).drop("b")


def run(df, name, spark, tmp_path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"check-{name}")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_replayed_input_gives_the_batch_result(spark, tmp_path):
    rng = random.Random(4)
    left = sorted(((rng.choice("abcdefghij"), i, at(rng.uniform(0, 400))) for i in range(60)), key=lambda r: r[2])
    right = sorted(((rng.choice("abcdefghijk"), 1000 + i, at(rng.uniform(0, 400))) for i in range(60)), key=lambda r: r[2])
    a, b = "k string, lid long, lt timestamp", "k string, rid long, rt timestamp"
    end = at(5000)  # rows that only move the watermarks
    parts = lambda rows, flush: [rows[i : i + 12] for i in range(0, len(rows), 12)] + [[flush]] * 2
    sl = files(spark, str(tmp_path / "l"), a, parts(left, ("none", -1, end)))
    sr = files(spark, str(tmp_path / "r"), b, parts(right, ("other", -2, end)))
    got = run(unique_links(sl, sr, "k", "lid", "lt", "rid", "rt", "48 HOURS", "24 HOURS", "1 day"), "uniques", spark, tmp_path)
    want = {}
    for k, i, t in left:
        met = [j for m, j, u in right if m == k and t - dt.timedelta(hours=48) <= u <= t + dt.timedelta(hours=24)]
        if len(met) == 1:
            want[i] = met[0]
    assert want and {r["lid"]: r["rid"] for r in got} == want and len(got) == len(want)
    # The batch form works on days; on whole days the two are the same.
    days = lambda rows, c, n: spark.createDataFrame([(k, i, t.date()) for k, i, t in rows], f"k string, {c} long, {n} date")
    pairs = link.interval_join(days(left, "lid", "ld"), days(right, "rid", "rd"), "k", "ld", "rd", 2, 1)
    assert link.unique_match(pairs, "lid").count() > 0


def test_a_second_match_within_the_delay_undoes_and_a_later_one_does_not(spark, tmp_path):
    a, b = "k string, lid long, lt timestamp", "k string, rid long, rt timestamp"
    left = [[("x", 1, at(0)), ("y", 2, at(0)), ("z", 3, at(0)), (None, 4, at(0))], [("none", -1, at(30))], [("none", -1, at(900))], [("none", -1, at(901))], [("none", -1, at(902))], [("none", -1, at(903))]]
    right = [[("x", 10, at(1)), ("y", 20, at(1)), (None, 40, at(1))], [("other", -2, at(30)), ("y", 21, at(2))], [("other", -2, at(900))], [("other", -2, at(901))], [("x", 11, at(1)), ("other", -2, at(902))], [("other", -2, at(903))]]
    got = run(unique_links(files(spark, str(tmp_path / "l"), a, left), files(spark, str(tmp_path / "r"), b, right), "k", "lid", "lt", "rid", "rt", "5 HOURS", "5 HOURS", "2 days"), "late", spark, tmp_path)
    assert [(r["lid"], r["rid"]) for r in got] == [(1, 10)]  # y had two in time; x's second row came after all was decided


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_first_seen_is_bounded_and_survives_a_restart(spark, tmp_path, rocks):
    schema = "url string, id long, t timestamp"
    day = lambda d: START + dt.timedelta(days=d)
    batches = [[("a", 1, day(0)), ("a", 2, day(0)), ("b", 3, day(1)), (None, 4, day(1))], [("a", 5, day(20)), ("c", 6, day(20))], [("a", 7, day(45)), (None, 8, day(45))], [("b", 9, day(60)), ("a", 10, day(80))]]
    path = str(tmp_path / "in")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/b={i:03d}")
        stream = spark.readStream.schema(f"{schema}, b int").option("maxFilesPerTrigger", 1).parquet(path).drop("b")
        q = first_seen(stream, "url", "t", "id").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()  # every batch is a run of its own
    # a: seen on days 0, 20 and 45, so days 20 and 45 are repeats, and day 80 is 35 days later.
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 3, 4, 6, 8, 9, 10]
    rows = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert rows <= 8
    assert spark.read.parquet(out).columns == ["url", "id", "t"]
    assert spark.read.parquet(out).where(F.col("url").isNull()).count() == 2


def test_sketches_rule_out_only_what_differs(spark):
    """Sets of eight words that share a word or two: nearly no pairs are made but the similar ones, and none of those is lost."""
    import random

    draw = random.Random(7)
    sets = {i: sorted(draw.sample(range(300), 8)) for i in range(1500)}
    sets |= {2000 + i: sorted({*sets[i][: draw.randint(4, 7)], *draw.sample(range(300), 2)}) for i in range(200)}
    df = spark.createDataFrame([(i, [f"w{x}" for x in s]) for i, s in sets.items()], "id long, t array<string>")
    want = {(a, b) for a in sets for b in sets if a < b and len({*sets[a]} & {*sets[b]}) >= 0.5 * len({*sets[a]} | {*sets[b]})}
    counts = df.select(F.explode("t").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    rows = link.prefixes(df, counts, 0.5, 50)
    met = {tuple(r) for r in link.meetings(rows, rows, 0.5).where("a < b").collect()}
    assert want <= met and len(met) < 2 * len(want) + 100
    assert {(r["a"], r["b"]) for r in link.jaccard_sets(df, 0.5, 50).collect()} == want
