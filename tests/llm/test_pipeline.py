import re
from collections import Counter
from pathlib import Path

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from skeinflow.llm import exact, mixing, quality, simhash
from skeinflow.llm.common import written
from skeinflow.operators import graph


def test_stages_on_the_small_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    at = docs
    seen = []
    for name, f in corpus_pipeline.STAGES:
        out = written(f(spark, at, d), "stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            assert all(rows[r["doc_id"]] == r for r in out.collect())
        seen.append((at, out))
        at = out
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    field = quality.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert ids(seen[0][1]) == {i for i, r in rows.items() if quality.scores([r["text"] or ""], field)[0] >= 0.3}
    first, best = seen[1]
    groups = {}
    for r in first.collect():
        groups.setdefault("".join((r["text"] or "").split()), []).append((-len(r["text"] or ""), r["doc_id"]))
    assert ids(best) == {min(g)[1] for g in groups.values()}
    before = sorted(ids(seen[2][0]))
    prints = [simhash.simhash(rows[i]["text"], 5) for i in before]
    parent = {i: i for i in before}
    for a in range(len(before)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = before[a], before[b]
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[max(x, y)] = min(x, y)
    assert ids(seen[2][1]) == {i for i in before if parent[i] == i}
    counts = {r["doc_id"]: r["n"] for r in mixing.mix(seen[3][0]).groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert {r["doc_id"]: r["count"] for r in seen[3][1].groupBy("doc_id").count().collect()} == counts
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = at.collect()
    assert len(last) == sum(counts.values())
    assert all(r["ids"] == sp.encode(rows[r["doc_id"]]["text"] or "") and r["round_trip"] for r in last)


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None and exact


def test_small_tables_are_few_files(spark, docs):
    texts = [f"w{k % 90} " + " ".join(f"v{k % 90}x{j}" for j in range(12)) for k in range(200)]
    want = [sorted(r["doc_id"] for r in f(docs(texts)).collect()) for f in (exact.keep_first, simhash.keep_one)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    base = Path(re.sub("^file:/+", "/", graph._base(spark)))
    before = set(base.iterdir())
    try:
        for k, v in zip(held, ("40", "false"), strict=True):
            spark.conf.set(k, v)
        got = [sorted(r["doc_id"] for r in f(docs(texts)).collect()) for f in (exact.keep_first, simhash.keep_one)]
        pairs = spark.range(60).select(F.col("id").alias("u"), (F.col("id") + 60).alias("v"))
        assert {tuple(r) for r in graph.components(pairs).collect()} == {(k, k % 60) for k in range(120)}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == want and [len(x) for x in got] == [90, 90]
    files = Counter(p.parent for d in set(base.iterdir()) - before for p in d.rglob("part-*.parquet"))
    # 200 rows fill one file of any table; four tasks number the rows.
    assert {"run", "digest-hits", "digest-level", "nodes", "labels", "near-duplicates", "small"} <= {re.sub("-[0-9a-f]{32}", "", p.name) for p in files}
    assert max(files.values()) <= 4, files
