import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np

from skeinflow.llm import quality as Q


def test_repeats_and_rates():
    x, size, lines = Q.line_features(["The cat cat cat sat.\n\nX | y | z", "", "ONE!!"])
    assert lines.tolist() == [2, 0, 1] and size.tolist() == [20, 9, 5]
    names = {n: 2 + i for i, n in enumerate(Q.NAMES)}
    assert np.isclose(x[0, names["repeats"]], 2 / 5) and np.isclose(x[1, names["bars"]], 2 / 5) and x[2, names["upper"]] == 1
    assert Q.line_features([])[0].shape == (0, Q.WIDTH)


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    lines = np.array([3, 0, 1, 5])
    e, pair = rng.normal(size=9), rng.normal(size=(2, 2))
    p, expected, z = Q._marginals(e, lines, pair)
    at, total = 0, np.zeros((2, 2))
    for k, n in enumerate(lines):
        weights, good, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for m in range(2**n if n else 0):
            s = [m >> i & 1 for i in range(n)]
            w = np.exp(sum(e[at + i] for i in range(n) if s[i]) + sum(pair[a, b] for a, b in zip(s, s[1:])))
            weights += w
            good += w * np.array(s)
            for a, b in zip(s, s[1:]):
                pairs[a, b] += w
        if n:
            assert np.allclose(p[at : at + n], good / weights) and np.isclose(z[k], np.log(weights))
            total += pairs / weights
        at += n
    assert np.allclose(expected, total)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = Q.op9_quality(spark, d).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == y for p, y in held]) > 0.95
    assert np.mean([p for p, y in held if y]) > 0.98


def test_edges(spark, docs):
    field = Q.fit(["Good words here.\nMore of them.", "BAD!! ## $$\n## !!"] * 20, np.array([1, 0] * 20))
    rows = {r["doc_id"]: r["score"] for r in Q.score(docs([None, "", "\n \n", "Good words here.", "x" * 200_000, "a\n" * 3000]), field).collect()}
    assert len(rows) == 6 and all(0 <= s <= 1 for s in rows.values()) and rows[0] == rows[1] == rows[2] == field.prior
    assert Q.score(docs([]), field).count() == 0
    none = Q.fit([], np.array([]))
    assert Q.scores(["text"], none)[0] == 0.5
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    df = docs([("## $$ !!\n## !!", "Good words here.\nMore of them.")[i % 2] for i in range(40)])
    kept = Q.keep_good(df, labels)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(range(1, 40, 2))


def test_windows_do_not_change_features(monkeypatch):
    rnd = random.Random(9)
    texts = ["\n".join(" ".join(rnd.choice(("the", "A1", "x|y", "été.", "")) for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(0, 40))) for _ in range(40)]
    texts += ["", "\n\n", "a" * 500, "a\n" * 300]
    want = Q.line_features(texts)
    for window in (1, 30, 400):
        monkeypatch.setattr(Q, "WINDOW", window)
        assert all(np.array_equal(a, b) for a, b in zip(want, Q.line_features(texts), strict=True))


def test_one_text_of_a_hundred_megabytes():
    """In a process of its own: less than 1 GB above what it takes before."""
    code = """
import resource, numpy as np
from skeinflow.llm import quality as Q
text = ("The quick line of a text that goes on for a while, as lines of texts do. " * 2 + "\\n") * (100_000_000 // 147)
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
rng = np.random.default_rng(1)
field = Q.Field(rng.normal(size=Q.WIDTH), np.zeros((2, 2)), 4.0, 0.0, 0.5)
before = peak()
s = Q.scores([text, "short"], field)
assert s.shape == (2,) and len(text) > 99_000_000
print(peak() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert float(out.stdout) < 1000
