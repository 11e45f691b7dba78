"""SentencePiece models on the tokenizers library.

The model file's protobuf is read field by field; from it come the normaliser
(precompiled character map, white-space rules, dummy prefix), the white-space
marker, the pieces with scores, and byte fallback. A unigram model becomes the
library's Unigram with those scores; a BPE model becomes its BPE, with a merge
for each way to split a piece into two others, ordered by the piece's score.

Texts are split before white-space markers where no piece has one after another
character. The words of a batch that are not known yet, each once, go through
the library's encode_batch on its threads, and are kept; where the split does
not hold whole texts go through it. Only a unigram model's characters that fall
back to bytes are put together here, as the library's own fallback is another.
`verify` encodes with the sentencepiece library as well and compares. A model
file with a rule that is not rebuilt here is refused.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.llm.common import slices
from skeinflow.llm.tokens import Known, packed_ids

MARK = "▁"
WORDS = 50_000  # sent to the library at a time
# Field numbers and enumerations of the model's protobuf.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind in (1, 2, 5):
            n = 8 if kind == 1 else 4 if kind == 5 else varint()
            value, at = raw[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind} in a model file")
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    unknown: str = " ⁇ "


def parse(raw: bytes) -> Model:
    m = Model()
    for number, value in fields(raw):
        if number == 1:
            p = dict(fields(value))
            m.pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p.get(2, b"\0" * 4))[0], p.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
            m.kind, m.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            if trainer.get(24, 0):
                raise ValueError("models with the white-space marker at the end of words are not supported")
            if 44 in trainer:
                m.unknown = trainer[44].decode()
        elif number == 3:
            rules = dict(fields(value))
            m.charsmap = rules.get(2, b"")
            m.dummy_prefix, m.remove_extra = (bool(rules.get(k, 1)) for k in (3, 4))
            if not rules.get(5, 1):
                raise ValueError("models without a white-space marker are not supported")
        elif number == 5 and dict(fields(value)).get(2):
            raise ValueError("rules that denormalise decoded text are not supported")
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models can be rebuilt")
    if any(t == USER_DEFINED for _, _, t in m.pieces):
        raise ValueError("user-defined pieces are matched before the model runs; they are not supported")
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """Best piece first. Of pieces with one score the longer comes first: a run of equal characters is
    then joined from the left, one by one."""
    score = {p: s for p, s, t in m.pieces if t == NORMAL}
    out = []
    for p, s in score.items():
        out += [(-s, -len(p), i, p) for i in range(1, len(p)) if p[:i] in score and p[i:] in score]
    return [(p[:i], p[i:]) for _, _, i, p in sorted(out, key=lambda x: (x[0], x[1], -x[2]))]


def normaliser(m: Model):
    """The library's normaliser up to white space; the marker is added word by word."""
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("\\A +| +\\z"), "")]
    return normalizers.Sequence(steps) if steps else None


def library_model(m: Model, strict: bool = False):
    """The library's model. With strict, text that spells out a control or byte piece is no match for it, and
    unknown characters come as the unknown piece even with byte fallback (for unigram models)."""
    from tokenizers import models

    unknown = next(i for i, x in enumerate(m.pieces) if x[2] == UNKNOWN)
    if m.kind == UNIGRAM and strict:
        return models.Unigram([(p if t == NORMAL else f"\U0010ffff{i}\U0010ffff", s) for i, (p, s, t) in enumerate(m.pieces)], unknown, False)
    if m.kind == UNIGRAM:
        return models.Unigram([(p, s) for p, s, _ in m.pieces], unknown, m.byte_fallback)
    ids = {p: i for i, (p, _, _) in enumerate(m.pieces)}
    return models.BPE(ids, merges(m), unk_token=m.pieces[unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback)


def tokenizer(m: Model, whole: bool = False, strict: bool = False):
    """A Tokenizer of the library: its encode_batch() runs on threads, its decode() undoes it. Texts are normalised but
    for the markers. whole: texts are not split before markers."""
    from tokenizers import Regex, Tokenizer, decoders, normalizers, pre_tokenizers

    t = Tokenizer(library_model(m, strict))
    t.normalizer = normalizers.Sequence([*([normalizers.Prepend(MARK)] if m.dummy_prefix else []), normalizers.Replace(" ", MARK)])
    if not whole:
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+"), "merged_with_next")
    strip = [decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return t


class SentencePieces:
    """known: about how many words' ids are kept; others are encoded again."""

    def __init__(self, raw: bytes, known: int = 600_000):
        self.model = m = parse(raw)
        self.normalise = normaliser(m)
        from tokenizers import Tokenizer

        inner = library_model(m, strict=True)
        byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(m.pieces) if t == BYTE} if m.byte_fallback else {}
        unknown = next(i for i, x in enumerate(m.pieces) if x[2] == UNKNOWN)

        def ids_of(part: str) -> list[int]:
            found = inner.tokenize(part)
            if byte and any(t.id == unknown for t in found):
                return [i for t in found for i in ([byte[b] for b in t.value.encode()] if t.id == unknown else [t.id])]
            return [t.id for t in found]

        self.whole = any(re.search(f"[^{MARK}]{MARK}", p) for p, _, t in m.pieces if t == NORMAL)
        runs = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        # With a dummy prefix every part begins with a marker; one written without it stands for a word after one space.
        plain = m.dummy_prefix and not self.whole

        def split(text: str) -> list[str]:
            if plain and text and text[0] != " " and text[-1] != " " and "  " not in text and MARK not in text:
                return text.split(" ")
            text = (MARK + text if text and m.dummy_prefix else text).replace(" ", MARK)
            return ([text] if text else []) if self.whole else runs.findall(text)

        self.split = split
        self.ids_of = packed_ids(ids_of)
        self.marked = (lambda w: MARK + w if w[0] != MARK else w) if plain else (lambda w: w)
        self.known = Known(lambda w: self.ids_of(self.marked(w)), known)
        self.words = Tokenizer(inner)
        self.unmatched = unknown if byte and m.kind == UNIGRAM else None
        self.bytes = [
            bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else m.unknown.encode() if t == UNKNOWN else p.replace(MARK, " ").encode()
            for p, _, t in m.pieces
        ]

    @functools.cached_property
    def library(self):
        """A tokenizer of whole texts, made when it is asked for: most models need only that of words."""
        return tokenizer(self.model, self.whole, strict=self.model.kind == UNIGRAM)

    def normalised(self, text: str) -> str:
        if self.normalise:
            text = self.normalise.normalize_str(text)
        return text.rstrip(" " + MARK) if self.model.remove_extra else text

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode_normalised([self.normalised(t) for t in texts])

    def batch(self, tokenizer, parts: list[str]) -> list[bytes]:
        """Ids of texts or words, as bytes, by the library's threads."""
        out = [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        fallen = (lambda ids: self.unmatched is not None and (ids == self.unmatched).any())
        return [self.ids_of(p) if fallen(ids) else ids.tobytes() for p, ids in zip(parts, out, strict=True)]

    def encode_normalised(self, texts: list[str]) -> list[np.ndarray]:
        if self.whole and self.unmatched is None:
            return [np.frombuffer(x, "<u4") for x in self.batch(self.library, texts)]
        parts = [self.split(t) for t in texts]
        new = [w for w in set(chain.from_iterable(parts)) if w and w not in self.known and w not in self.known.old and len(w) <= self.known.longest]
        for at in range(0, len(new), WORDS):
            words = new[at : at + WORDS]
            for w, ids in zip(words, self.batch(self.words, [self.marked(w) for w in words]), strict=True):
                self.known.keep(w, ids)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, p)), "<u4") for p in parts]

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        if self.model.remove_extra:
            return out.lstrip(" ")
        return out[1:] if self.model.dummy_prefix and out.startswith(" ") else out


@functools.lru_cache(maxsize=2)
def _loaded(raw: bytes, known: int = 600_000) -> SentencePieces:
    return SentencePieces(raw, known)


@functools.lru_cache(maxsize=2)
def _reference(raw: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=raw)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str, verify: bool = False, keep_ids: bool = True, threads: int = 2, known: int = 600_000) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers), round_trip (decoding gives the text back), and ids; with verify also parity.

    model is a file on the driver; its bytes (a vocabulary, some hundred KB) go
    to the tasks, each of which encodes on `threads` threads; a worker process keeps the
    ids of `known` words or so, some 200 bytes a word, and the ids of all texts are the same with any number. Null texts count as
    empty and have no ids. Where the model's normaliser changes a text, round_trip
    compares with the normalised text. Rows stay rows, whatever their doc_id;
    other columns are not read, and an empty table gives no rows.
    """
    raw = _read(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        sp = _loaded(raw, known)
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                texts = [t or "" for t in b.column(1).to_pylist()]
                plain = [sp.normalised(t) for t in texts]
                ids = sp.encode_normalised(plain)
                cols = {
                    "doc_id": b.column(0),
                    "n_tokens": pa.array([x.size for x in ids], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    "round_trip": pa.array([sp.decode(x) == t for x, t in zip(ids, plain, strict=True)]),
                }
                if verify:
                    other = _reference(raw).encode(texts, num_threads=1)
                    cols["parity"] = pa.array([np.array_equal(x, y) for x, y in zip(ids, other, strict=True)])
                if keep_ids:
                    flat = np.concatenate(ids) if ids else np.empty(0)
                    ends = np.cumsum([0, *(x.size for x in ids)])
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    schema = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean" + ", parity boolean" * verify + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids), row by row; null ids count as none. Ids outside the vocabulary are an error. Other
    columns are not read."""
    raw = _read(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _loaded(raw)
        for b in batches:
            texts = [sp.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), verify=True, keep_ids=False)
