import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from skeinflow.llm import sentencepieces as S

PATH = public_tokenizers.path("piece_bpe_32k.model")


def field(number, value):
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (n > 127) << 7])
            n >>= 7
            if not n:
                return out

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def made_model(kind=1, remove_extra=1, dummy=1, fallback=1):
    """A small model written by hand, no training: letters, a few words, bytes."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    words = ["▁", "▁the", "▁th", "he", "the", "re", "▁there", "in", "ing", "▁in", "er", "t", "h", "e", "r", "i", "n", "g", "a", "▁a", "an", "and", "d"]
    pieces += [(w, -1.0 - i * 0.37, 1) for i, w in enumerate(words)]
    body = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, t)) for p, s, t in pieces)
    trainer = field(3, kind) + field(35, fallback) + field(4, len(pieces))
    rules = field(1, b"identity") + field(2, b"") + field(3, dummy) + field(4, remove_extra) + field(5, 1)
    return body + field(2, trainer) + field(3, rules)


ODD = ["", " ", "  ", " a", "a ", "a  b   c" + " " * 40 + "the", "<s></s><0x0A><unk>", "日本語 😀\n\n\t x", "a" * 40, "▁▁x ▁", "the thing and there in the ring", "thehe  ther\nanding"]
random.seed(5)
ODD += ["".join(random.choice(al) for _ in range(random.randint(1, 60))) for al in ("ab ", "aaab", "the and  ", "ab\n=-_", "e ést ö", "thering ") for _ in range(60)]


@pytest.mark.parametrize("raw", [S._read(PATH), made_model(1), made_model(2), made_model(1, 0), made_model(2, 1, 0), made_model(1, 1, 0)])
def test_parity(raw):
    ours, theirs = S.SentencePieces(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for t in ODD:
        ids = ours.encode([t])[0]
        assert ids.tolist() == theirs.encode(t), t
        assert ours.decode(ids) == theirs.decode(ids.tolist()), t


def test_batches_and_the_librarys_decoder():
    ours, sp = S.SentencePieces(S._read(PATH)), sentencepiece.SentencePieceProcessor(model_file=PATH)
    calls = []
    inner = ours.batch
    ours.batch = lambda t, parts: calls.append(len(parts)) or inner(t, parts)
    assert [x.tolist() for x in ours.encode(ODD)] == sp.encode(ODD) and len(calls) == 1 and calls[0] > 100
    assert [x.tolist() for x in ours.encode(ODD)] == sp.encode(ODD) and len(calls) == 1  # all known by now
    assert ours.library.decode(ours.library.encode(ODD[-1]).ids) == ODD[-1]


def test_a_piece_with_a_marker_inside():
    """Such a model's texts are not split before markers."""
    raw = made_model(2) + field(1, field(1, "d▁".encode()) + field(2, -0.5) + field(3, 1))
    ours, theirs = S.SentencePieces(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    assert ours.whole and all(ours.encode([t])[0].tolist() == theirs.encode(t) for t in ("and and the", "d d", "add  a"))


def test_encode_and_decode_tables(spark, docs):
    df = docs([*ODD, None, "long words " * 20_000])
    rows = S.encode(df, PATH, verify=True)
    assert rows.where("not parity").count() == 0 and rows.count() == len(ODD) + 2
    # A marker in the text itself comes back as a space.
    assert [ODD[r["doc_id"]] for r in rows.where("not round_trip").collect()] == [t for t in ODD if S.MARK in t]
    back = {r["doc_id"]: r["text"] for r in S.decode(rows, PATH).collect()}
    assert back == {i: (t or "").replace(S.MARK, " ") for i, t in enumerate([*ODD, None, "long words " * 20_000])}
    assert S.encode(docs([]), PATH).count() == 0
    assert S.encode(docs([(1, "a"), (1, "a")]), PATH).count() == 2


def test_unsupported_models_are_refused():
    for raw, says in [
        (made_model(3), "unigram and BPE"), (made_model() + field(2, field(3, 1) + field(24, 1)), "end of words"), (made_model() + field(3, field(5, 0)), "without"),
        (made_model() + field(5, field(2, b"map")), "denormalise"), (made_model() + field(1, field(1, b"x") + field(3, 4)), "user-defined"),
    ]:
        with pytest.raises(ValueError, match=says):
            S.parse(raw)
    assert S.parse(made_model() + field(2, field(3, 1) + field(44, b"?"))).unknown == "?"
