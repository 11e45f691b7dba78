import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skeinflow.llm import tokens as T
from skeinflow.llm.common import shared_path

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello, world's 42!", "", None, "It'S 'Re ²½ª x\x85y don’t", "<|endoftext|> a <|start", "İI ſ ǅ Σς", "日本語 mixed é e\u0301", " \t\n", "!'s 'rex ''s' _a_",
    " ".join(f"word{i}" for i in range(4000)), " ".join(f"word{i}" for i in range(4000)), "q" * 5000, "control \x1c\x1f char",
]


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(whole):
    e = T.word_encoder(PATH)
    for t in TEXTS:
        assert e.encode([t or ""])[0].tolist() == whole(t), t


def test_known_strings_are_bounded():
    k = T.Known(lambda s: s.encode(), limit=10, longest=4)
    for i in range(100):
        assert k[str(i)] == str(i).encode() and len(k) <= 5 and len(k.old) <= 5
    assert k["longer"] == b"longer" and "longer" not in k


def test_store_gives_back_every_id(spark, docs, whole):
    df = docs(list(reversed(list(enumerate(TEXTS)))))
    path = shared_path(spark, "store")
    T.write_store(df, PATH, path)
    want = {i: [*whole(t), 2] for i, t in enumerate(TEXTS)}
    start, starts = 0, {}
    for i in range(len(TEXTS)):
        starts[i], start = start, start + len(want[i])
    rows = {r["doc_id"]: tuple(r)[1:] for r in T.read_digests(spark, path).collect()}
    assert rows == {i: (starts[i], len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for i, w in want.items()}
    assert {r["doc_id"]: r["ids"] for r in T.read_ids(spark, path).collect()} == want
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    # Two equal documents share their chunks.
    used = spark.read.parquet(f"{path}/recipes").where("doc_id in (9, 10)").select("digests").collect()
    assert used[0] == used[1] and len(used[0]["digests"]) > 1
    assert spark.read.parquet(f"{path}/manifest").agg({"tokens": "sum"}).first()[0] == start


def test_every_fast_character_and_its_neighbours(whole):
    e = T.word_encoder(PATH)
    taken = 0
    for c in map(chr, range(T.FAST)):
        for t in (c, f"{c}li", f"a{c}b", f"A {c}'s{c}", f"7{c}é", f"{c}ɏ{c}"):
            parts = e.split(t)
            taken += parts is not None
            assert e.encode([t])[0].tolist() == whole(t), (hex(ord(c)), t)
    assert taken > 2000  # the fast form is in use
    for t in ("Əli", "Ɛwe", "Ɔkwan", "Ɖe Ʌ", "ȺȾɄ", "İ"):
        assert e.encode([t])[0].tolist() == whole(t)


def test_another_tokenizer_goes_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), T.word_encoder(path)
    for text in ("Hello, World's 42!", "", " x  y", "<|endoftext|>"):
        assert e.encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


def damaged(spark, docs, **changed):
    """A store of three documents with some of its tables replaced by what a function makes of them."""
    good, bad = shared_path(spark, "store"), shared_path(spark, "store")
    T.write_store(docs(["some text", "other text", "a third text"]), PATH, good)
    for name in ("chunks", "recipes", "manifest"):
        t = spark.read.parquet(f"{good}/{name}")
        changed.get(name, lambda x: x)(t).write.parquet(f"{bad}/{name}")
    return bad


@pytest.mark.parametrize("read", [T.read_digests, T.read_ids])
def test_damage_and_losses_are_found(spark, docs, read):
    from pyspark.sql import functions as F

    one = lambda t: t.where(F.col("digest") != t.agg(F.min("digest")).first()[0])
    cases = [
        ({"chunks": lambda t: t.withColumn("digest", F.sha2("ids", 256).cast("binary"))}, "does not hold|missing"),
        ({"chunks": lambda t: t.withColumn("ids", F.lit(t.first()["ids"]))}, "does not hold"),
        ({"chunks": one}, "missing"),
        ({"recipes": lambda t: t.where("doc_id <> 2")}, "recipes are missing"),
        ({"recipes": lambda t: t.where("doc_id <> 1")}, "recipes"),
        ({"recipes": lambda t: t.limit(0)}, "recipes are missing"),
        ({"recipes": lambda t: t.withColumn("digests", F.expr("slice(digests, 1, 0)")).withColumn("lengths", F.expr("slice(lengths, 1, 0)"))}, "missing"),
        ({"manifest": lambda t: t.withColumn("merkle", F.lit(b"x"))}, "root"),
        ({"manifest": lambda t: t.withColumn("tokens", F.col("tokens") + 1)}, "root|recipes"),
    ]
    for changed, says in cases:
        with pytest.raises(Exception, match=says):
            read(spark, damaged(spark, docs, **changed)).collect()
    assert read(spark, damaged(spark, docs)).count() == 3


def test_cuts_depend_on_the_ids_nearby():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 49_000, 20_000).astype(np.uint32), rng.integers(0, 49_000, 3_333).astype(np.uint32)
    own, moved = T.cuts(a), T.cuts(np.concatenate([b, a]))
    assert own[-1] == a.size and len(set(own) & {c - b.size for c in moved}) > 0.7 * len(own)
    assert max(np.diff([0, *own])) <= T.MAX_CHUNK
    assert T.cuts(np.zeros(0, np.uint32)) == [] and T.cuts(np.zeros(50_000, np.uint32))[-1] == 50_000


def test_joined_crcs():
    rng = np.random.default_rng(2)
    blobs = [[rng.bytes(int(n)) for n in rng.integers(0, 4000, k)] for k in (1, 5, 1, 3)]
    flat = [x for b in blobs for x in b]
    got = T.crc32_joined(np.array([zlib.crc32(x) for x in flat]), np.array([len(x) for x in flat]), np.array([len(b) for b in blobs]))
    assert got.tolist() == [zlib.crc32(b"".join(b)) for b in blobs]


def test_empty_table(spark, docs):
    path = shared_path(spark, "store")
    T.write_store(docs([]), PATH, path)
    assert T.read_digests(spark, path).count() == 0
