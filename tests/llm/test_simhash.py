import numpy as np
import xxhash

from skeinflow.llm import simhash as S


def plain(text, k=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), seed=42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_the_definition():
    for t in ["", None, " \n", "One", "a B", "a b c", "É x\xa0y z w", "w " * 400 + "end", "\x1fa\x85b c d"]:
        assert S.simhash(t) == plain(t), t
    long = " ".join(str(i % 977) for i in range(70_000))
    assert S.simhash(long) == plain(long)


def test_anchors_bring_all_near_pairs_together(spark):
    rng = np.random.default_rng(0)
    pairs = []
    for _ in range(400):
        x = int(rng.integers(0, 1 << 63)) << 1 | int(rng.integers(0, 2))
        y = x
        for b in rng.choice(64, rng.integers(1, 4), replace=False):
            y ^= 1 << int(b)
        pairs.append(tuple(int(np.uint64(v).astype(np.int64)) for v in (x, y)))
    df = spark.createDataFrame(pairs, "a long, b long")
    from pyspark.sql import functions as F

    assert df.where(~F.arrays_overlap(S.anchors(F.col("a")), S.anchors(F.col("b")))).count() == 0


def brute(ids, prints, threshold=3):
    parent = dict(zip(ids, ids))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= threshold:
                a, b = find(ids[i]), find(ids[j])
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_match_brute_force_with_split_cells(spark, docs):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(list("abcdefghij"), 4)) + " " + " ".join(f"w{rng.integers(0, 50)}" for _ in range(150)) for _ in range(6)]
    texts = []
    for i in range(90):
        w = base[i % 6].split()
        if i >= 12:
            w[int(rng.integers(0, len(w)))] = f"x{i % 7}"
        texts.append(" ".join(w))
    texts += ["", None, " ", "one word", texts[0], texts[0]]
    df = docs(texts)
    want = brute(list(range(len(texts))), [plain(t) for t in texts])
    for cell in (4096, 5):
        got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(df, cell_rows=cell).collect()}
        assert got == want
    assert len(set(want.values())) < len(texts) - 10


def test_empty_table_and_repeated_ids(spark, docs):
    assert S.near_duplicates(docs([])).count() == 0
    twice = docs([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words are here now")])
    assert sorted((r["doc_id"], r["component_id"]) for r in S.near_duplicates(twice).collect()) == [(1, 1), (1, 1), (2, 1), (3, 3)]
    kept = S.keep_one(twice)
    assert kept.columns == twice.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_rows_of_one_id_are_judged_by_their_texts(spark, docs):
    a, b = "some words that make a text of their own", "quite another line of words about nothing at all"
    df = docs([(1, a), (5, a), (5, b), (None, b), (7, None), (None, "lone text of a row without an id"), (None, "another of the kind")])
    got = sorted(((r["doc_id"], r["component_id"]) for r in S.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 1), (5, 1), (5, 5), (None, 5), (7, 7), (None, None), (None, None)], key=repr)
    kept = sorted(((r["doc_id"], r["text"]) for r in S.keep_one(df).collect()), key=repr)
    assert kept == sorted([(1, a), (5, b), (7, None), (None, "lone text of a row without an id"), (None, "another of the kind")], key=repr)
