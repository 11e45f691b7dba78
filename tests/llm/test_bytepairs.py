import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from skeinflow.llm import bytepairs
from skeinflow.llm.bytepairs import GENERAL_PATTERN, Merger, RankQueue, decode, digests, encode, encoder

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder(PATH, GENERAL_PATTERN).merger.ranks, special_tokens={})


def ids_of(text):
    return [i for _, part in encoder(PATH, public_tokenizers.PATTERN).encode([text]) for i in part]


def test_the_patterns_are_one():
    assert public_tokenizers.PATTERN == GENERAL_PATTERN


def test_queue_gives_ranks_and_positions_in_order():
    rnd, queue, held = random.Random(2), RankQueue(300_000), {}
    for _ in range(3000):
        if rnd.random() < 0.7:
            rank, at = rnd.choice((rnd.randrange(300_000), rnd.randrange(50))), rnd.randrange(1000)
            queue.push(rank, at)
            held.setdefault(rank, set()).add(at)
        elif held:
            rank, positions = queue.pop()
            assert rank == min(held) and positions.tolist() == sorted(held.pop(rank))
    while held:
        rank, positions = queue.pop()
        assert rank == min(held) and positions.tolist() == sorted(held.pop(rank))
    assert queue.pop() is None


def one_by_one(ranks, piece):
    """Merges the leftmost pair of least rank until there is none."""
    parts = [bytes((b,)) for b in piece]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_any_ranks_merge_as_one_by_one():
    """Also ranks that no training gives, where a merge brings up pairs of lesser rank all the time."""
    rnd = random.Random(3)
    for _ in range(60):
        made = {bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 6))) for _ in range(30)}
        tokens = [*sorted(made), *(bytes((b,)) for b in range(256))]
        order = list(range(len(tokens)))
        rnd.shuffle(order)
        ranks = dict(zip(tokens, order, strict=True))
        pieces = [bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 60))) for _ in range(20)]
        for piece, got in zip(pieces, Merger(ranks).ids(pieces), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == one_by_one(ranks, piece)


def test_ranks_need_all_bytes():
    with pytest.raises(ValueError):
        Merger({b"a": 0})


def test_texts_as_the_library(library):
    rnd = random.Random(4)
    for _ in range(1500):
        text = "".join(rnd.choice(" \n\t\r'streavlmdAB1 2.,-é\u0085\x1c　中😀áǅ٣") for _ in range(rnd.randint(0, 70)))
        assert ids_of(text) == library.encode_ordinary(text)


@pytest.mark.parametrize("start", range(0, 0x110000, 0x11000))
def test_characters_as_the_library(library, start):
    text = "".join(f"a{c}a1{c}1 {c}.{c}\n {c} \n" for c in map(chr, range(start, start + 0x11000, 3)) if not 0xD800 <= ord(c) < 0xE000)
    assert ids_of(text) == library.encode_ordinary(text)


def test_long_pre_tokens(library):
    rnd = random.Random(5)
    for text in ("a" * 300_000, "".join(rnd.choice("abcdefgh") for _ in range(400_000)), " " * 300_000 + "x", "é" * 150_000, "-=" * 200_000):
        assert ids_of(text) == library.encode_ordinary(text)


def test_windows_do_not_change_pieces():
    e, rnd = encoder(PATH, GENERAL_PATTERN), random.Random(6)
    for _ in range(400):
        text = "".join(rnd.choice("ab 1'relvs\n .é") for _ in range(rnd.randint(0, 60)))
        for window in (5, 8, 13):
            assert [p for part in e.pieces(text, window) for p in part] == e.general.findall(text)


def test_forgetting_does_not_change_ids(monkeypatch, library):
    monkeypatch.setattr(bytepairs, "MOST_KNOWN", 10)
    monkeypatch.setattr(bytepairs, "LONGEST_KNOWN", 4)
    e = bytepairs.Encoder(encoder(PATH, GENERAL_PATTERN).merger.ranks, GENERAL_PATTERN)
    for text in ("one two three four five six", "seven eight one nine", "Wortzusammensetzung one", ""):
        assert [i for _, part in e.encode([text]) for i in part] == library.encode_ordinary(text)


def test_edges(spark, docs, library):
    texts = [None, "", "  ", "a b", "a b", "Grüße, 12 ñ\n\n", (3, "repeated id"), (None, "no id"), "word " * 200_000]
    df = docs(texts)
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in digests(df, PATH, public_tokenizers.PATTERN).collect()}
    want = set()
    for r in df.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.add((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == want
    back = decode(encode(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r["bytes"]).decode() for r in back) == sorted(r["text"] or "" for r in df.collect())
    assert digests(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query(spark, library):
    from skeinflow.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = QUERIES["op11_byte_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
