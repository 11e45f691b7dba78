import math
import random

import pytest
from pyspark.sql import functions as F

from skeinflow.llm.negatives import mine

KEYS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, anchor, positives=5, negatives=5, window=80):
    good = [(i, label, v) for i, label, v in rows if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in {(i, label, tuple(v)) for i, label, v in good if anchor(i)}:
        score = lambda r: sum(int(x) * int(y) for x, y in zip(a[2], r[2], strict=True))  # noqa: E731, B023
        others = [(-score(r), r[0], r[1]) for r in good if len(r[2]) == len(a[2])]
        for s, p, _ in sorted(x for x in others if x[2] == a[1] and x[1] != a[0])[:positives]:
            fits = sorted(x for x in others if x[2] != a[1] and window * -s <= 100 * -x[0] <= 100 * -s)[:negatives]
            out += [(a[0], p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, label long, embedding array<double>, anchor long, score long, rank string").repartition(5)


def mined(df, **options):
    return sorted(tuple(r[k] for k in KEYS) for r in mine(df, F.col("vec_id") % 10 == 0, **options).collect())


@pytest.mark.parametrize("options", [{}, {"block_rows": 70}, {"group_bytes": 2000}, {"positives": 2, "negatives": 9, "window": 50}])
def test_as_brute_force(spark, options):
    rnd = random.Random(7)
    rows = [(i, rnd.randrange(3), [float(rnd.randint(-3, 9)) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, 1, [5.0] * 6) for i in range(150)] + [(2000 + i, 2, [5.0] * 6) for i in range(150)]  # a hot vector, in two labels
    want = brute(rows, lambda i: i % 10 == 0, **{k: v for k, v in options.items() if k in ("positives", "negatives", "window")})
    assert want and mined(frame(spark, rows), **options) == want


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [3.0, 4.0]), (10, 1, [3.0, 4.0]), (1, 1, [2.0, 4.0]), (1, 1, [2.0, 4.0]), (2, 2, [2.0, 4.0]), (2, 2, [2.0, 4.0]), (3, 2, [3.0, 3.0]),
        (20, None, [1.0, 1.0]), (None, 1, [9.0, 9.0]), (30, 1, None), (31, 1, [1.0, None]), (32, 2, [nan, 1.0]), (33, 2, [inf, 1.0]),
        (40, 1, [1.0, 2.0, 3.0]), (41, 2, [1.0, 2.0, 3.0]), (50, 1, []), (51, 2, []), (60, 3, [-1.0, -1.0]), (61, 3, [1.0, 1.0]),
        (70, 4, [0.0, 0.0]), (71, 4, [0.0, 0.0]), (0, 1, [3.0, 4.0]),
    ]
    assert mined(frame(spark, rows)) == brute(rows, lambda i: i % 10 == 0)


def test_scores_beyond_double_precision(spark):
    big = float(2**30)
    rows = [(0, 1, [big, big + 1]), (1, 1, [big, big]), (2, 2, [big, big - 1]), (3, 2, [big - 1, big]), (4, 2, [1.0, 1.0])]
    got = mined(frame(spark, rows))
    assert got == brute(rows, lambda i: i % 10 == 0) and got[0][4] > 2**53


def test_no_rows(spark):
    assert mined(frame(spark, []).where("vec_id = 1")) == []
    assert mined(frame(spark, [(1, 1, [1.0]), (2, 2, [1.0])])) == []


def test_query_takes_floors_and_labels(spark, tmp_path):
    from skeinflow.llm.queries import QUERIES

    rnd = random.Random(8)
    rows = [(i, rnd.randrange(10), [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(420)]
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    made = [(i, (label + 1) % 10 if i % 7 == 0 else label, [float(math.floor(256 * x)) for x in v]) for i, label, v in rows]
    got = sorted(tuple(r[k] for k in KEYS) for r in QUERIES["op13_hard_negatives"](spark, str(tmp_path)).collect())
    assert got == brute(made, lambda i: i % 100 == 0)
