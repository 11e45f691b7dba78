import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skeinflow.llm import ranked
from skeinflow.llm.common import shared_path
from skeinflow.llm.ranked import build, search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=10):
    counted = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, q in asked.items():
        if i is None:
            continue
        found = []
        for d, c in counted:
            m = 25 + 75 * c.total() * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in q.items() if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=lambda r: r[:2])


def searched(spark, docs, items, built=None, **options):
    path = shared_path(spark, "index")
    build(docs, path, **(built or {}))
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, rank int, term string")
    rows = search(asked, path, **options).collect()
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows], key=lambda r: r[:2])


def corpus(n, rnd):
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(rnd.choices(words, weights, k=rnd.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"seeds": 1, "group_items": 7}, {"k": 3, "seeds": 5}, {"k": 500}])
@pytest.mark.parametrize("built", [{"block_docs": 4}, {"block_docs": 64, "block_terms": 200}])
def test_as_brute_force(spark, docs, options, built):
    rnd = random.Random(11)
    texts = corpus(300, rnd) + [(400 + i, "W3 w7, same-text w280") for i in range(60)]  # copies: ties by doc_id
    items = [(i, t) for i, t in corpus(20, rnd)] + [(90, "w280 w3 w3"), (91, "nowhere"), (92, None), (93, "")]
    assert searched(spark, docs(texts).repartition(6), items, built, **options) == brute(texts, items, options.get("k", 10))


def test_blocks_below_the_threshold_are_not_scored(spark, docs):
    """One block holds the answers; its seeds settle the threshold, and no other block's documents are looked at."""
    texts = [(i, "rare words here" if i < 16 else f"common x{i} y{i} z{i}") for i in range(400)]
    path, other = shared_path(spark, "index"), shared_path(spark, "index")
    build(docs(texts).coalesce(1), path, block_docs=16)
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.count() == 25
    q = spark.createDataFrame([(1, "rare words common")], "item_id long, text string")
    assert [r["doc_id"] for r in search(q, path, seeds=1).orderBy("rank").collect()] == list(range(10))
    # Where the forward index of the other blocks is unreadable, the answer is the same.
    for part in ("lexicon", "totals"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"{other}/{part}")
    spoilt = F.when(F.array_contains("terms", "rare"), F.col("places")).otherwise(F.array(F.lit(1 << 30)))
    blocks.withColumn("places", spoilt).write.parquet(f"{other}/blocks")
    assert [r["doc_id"] for r in search(q, other, seeds=1).orderBy("rank").collect()] == list(range(10))


def test_edges(spark, docs):
    texts = [(0, None), (1, ""), (2, " .,-"), (3, "ÀB ab AB Éa éa 中文 x"), (3, "ab"), (None, "ab ab"), (5, "ab"), (4, "ab"), (6, "a\u0080b 9z")]
    items = [(1, "AB"), (1, "x"), (2, "Éa éa éa"), (None, "ab"), (3, "9Z a\u0080b"), (4, None)]
    assert searched(spark, docs(texts), items) == brute(texts, items)
    assert searched(spark, docs(texts), []) == [] and searched(spark, docs(texts).limit(0), items) == []


def test_long_texts_in_windows(monkeypatch):
    rnd = random.Random(12)
    text = "".join(rnd.choice("abC 1é.\n") for _ in range(5000))
    monkeypatch.setattr(ranked, "WINDOW", 37)
    assert ranked.term_counts(text) == Counter(terms(text))


def test_weights_beyond_double_precision_are_whole(spark, docs):
    texts = [(0, "a b"), (1, "b c"), (2, "c"), (3, "d e f")]
    items = [(1, " ".join(["a"] * 400_000 + ["b"]))]
    assert searched(spark, docs(texts), items) == brute(texts, items)


def test_sizes_count_terms(spark):
    rnd = random.Random(13)
    texts = ["", "a", "b", " ", "é", "-"] + ["".join(rnd.choice("abC 1é中.\n") for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(2)
    got = df.mapInArrow(ranked._sizes, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    assert tuple(got) == (sum(bool(terms(t)) for t in texts), sum(len(terms(t)) for t in texts))
