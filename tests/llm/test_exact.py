import hashlib
import re

from pyspark.sql import functions as F

from skeinflow.llm import exact as E
from skeinflow.llm.common import shared_path


def want(rows):
    norm = {i: re.sub("[ \t\n\x0b\x0c\r]", "", t or "") for i, t in rows}
    out = {}
    for i, t in rows:
        group = [(j, u or "") for j, u in rows if norm[j] == norm[i]]
        keep = min(group, key=lambda x: (-len(x[1]), x[0]))[0]
        out[i] = (keep, len(group), keep == i, hashlib.sha256(norm[i].encode()).hexdigest())
    return out


ROWS = [(0, "a b"), (1, "ab"), (2, "a\nb  "), (3, ""), (4, None), (5, " \t"), (6, "é x"), (7, "éx"), (8, "a\xa0b"), (9, "z" * 100_000), (10, "z" * 100_000), (11, "A b")]


def by_id(df):
    return {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()}


def test_groups_match_brute_force(docs):
    for bits in (256, 8, 4):  # few bits: digests clash, and texts decide
        assert by_id(E.exact_duplicates(docs(ROWS), bits=bits)) == want(ROWS)


def test_many_waves_levels_and_filters(spark, docs):
    rows = [(i, f"text {i % 37}" if i % 3 else f"lone {i}") for i in range(300)]
    path = shared_path(spark, "index")
    assert by_id(E.exact_duplicates(docs(rows), path=path, memtable_rows=6, fanout=2)) == want(rows)  # 24 rows a wave
    live = E.runs(spark, path)
    assert {r[1] for r in live} != {0} and len(live) <= 5 and len({r[1] for r in live}) == len(live)
    index = E.read_runs(spark, path, live)
    assert index.groupBy("digest").count().count() == len({v[3] for v in want(rows).values()})
    digests = spark.createDataFrame([(hashlib.sha256(t.encode()).digest(),) for t in ["text1", "lone0", *(f"no{i}" for i in range(500))]], "digest binary")
    maybe = {bytes(r["digest"]) for r in E.maybe_known(spark, path, digests, live).collect()}
    assert {hashlib.sha256(t).digest() for t in (b"text1", b"lone0")} <= maybe and len(maybe) < 60
    # Bits of a digest that is in the index are all set.
    assert E.maybe_known(spark, path, index.select("digest").distinct(), live).count() == index.select("digest").distinct().count()


def test_an_index_grows(spark, docs):
    path, old, new = shared_path(spark, "index"), docs([(1, "a b"), (2, "c"), (3, "same")]), docs([(4, "a  b"), (5, "c"), (6, "new"), (7, "new"), (0, "sa me")])
    E.exact_duplicates(old, path=path)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in E.exact_duplicates(new, path=path, earlier=old).collect()}
    assert got == {4: (4, 2, True), 5: (2, 2, False), 6: (6, 2, True), 7: (6, 2, False), 0: (0, 2, True)}
    assert sum(r[2] for r in E.runs(spark, path)) >= 4
    again = E.exact_duplicates(docs([(1, "a b"), (9, "fresh")]), path=path, earlier=old.union(new)).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in again} == {1: (4, 3, False), 9: (9, 1, True)}
    assert not E.exact_duplicates(docs([(9, "fresh")]), path=path).first()["kept"]  # the row that came first stays


def test_repeated_and_null_ids(docs):
    assert E.exact_duplicates(docs([])).count() == 0
    twice = docs([(1, "a"), (1, "a"), (2, "a")])
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in E.exact_duplicates(twice).collect()) == [(1, 1, 3, False), (1, 1, 3, True), (2, 1, 3, False)]
    nulls = docs([(None, "x"), (None, "x"), (None, "y"), (3, "y"), (None, None)])
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in E.exact_duplicates(nulls).collect()), key=repr)
    assert got == sorted([(None, None, 2, True), (None, None, 2, False), (None, 3, 2, False), (3, 3, 2, True), (None, None, 1, True)], key=repr)


def test_each_row_stays_or_goes_by_itself(docs):
    texts = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    kept = E.keep_first(docs(ROWS))
    assert kept.columns == docs([]).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, v in want(ROWS).items() if v[2])
    assert texts(E.keep_first(docs([(1, "alpha beta"), (5, "alpha beta"), (5, "unique text here")]))) == [(1, "alpha beta"), (5, "unique text here")]
    assert texts(E.keep_first(docs([(5, "t"), (5, "t"), (None, "t"), (None, "u"), (None, "u")]))) == sorted([(5, "t"), (None, "u")], key=repr)
    clashing = docs([(1, "a"), (2, "a")]).withColumn("row_", F.lit("mine")).withColumn("row", F.lit("too"))
    assert E.keep_first(clashing).select("row_", "row").collect() == [("mine", "too")]
