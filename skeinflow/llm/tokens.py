"""Token ids as a content-addressed store.

Documents are encoded with the tokenizers library, an end id is appended, and
the id stream of each document is cut into chunks where a rolling hash of the
last WINDOW ids has its low bits zero. The store is a folder:

  chunks/    Parquet (digest, n, crc32, ids): each distinct chunk once. digest is
             the SHA-256 of the ids as little-endian unsigned 32-bit integers;
             ids holds them as unsigned 16- or 32-bit integers, compressed with zstd.
  recipes/   Parquet (part, doc_id, start, n_tokens, merkle, digests, lengths) in ascending doc_id order:
             a document's chunks in order, and the Merkle root over their digests.
  manifest/  Parquet (part, first_doc, documents, start, tokens, chain, merkle): for each range of
             recipes the hash chain over their roots, and the Merkle root over all ranges.

Reading verifies: each chunk's ids against its digest, each recipe's Merkle
root against its digests, each range's chain, documents, tokens and places
against the manifest, and the manifest's root against its chains. What is
damaged or missing is an error. A document's CRC follows from its chunks'
CRCs, so whole documents need not be put together to check them.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm.common import shared_path, slices, written

WINDOW = 16
MIN_CHUNK, MASK_BITS, MAX_CHUNK = 128, 10, 8192

# How the word_bpe vocabulary file normalises and splits texts, and the same for characters below FAST.
NORMALISERS = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECES = re.compile(
    r"[a-z\xaa\xb5\xba\xdf-\xf6\xf8-ɏ]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|'(?:s|t|re|ve|m|ll|d)"
    r"|[^\s0-9a-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-ɏ]+"
)
_ASCII_PIECES = re.compile(r"[a-z]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s0-9a-z]+")
FAST = 0x250


class Known(dict):
    """Ids of strings, as little-endian unsigned 32-bit integers, from ids_of where they are not known yet.

    About `limit` short strings stay: when half of that are young they become
    the old ones, and old ones that are met again become young. Long strings
    are not kept.
    """

    def __init__(self, ids_of, limit: int = 600_000, longest: int = 64):
        self.ids_of, self.half, self.longest, self.old = ids_of, limit // 2, longest, {}

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.ids_of(key)
            if len(key) > self.longest:
                return out
        self.keep(key, out)
        return out

    def keep(self, key: str, ids: bytes) -> None:
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = ids


def packed_ids(ids_of):
    """A function that gives a list of ids as one that gives their bytes."""
    four: dict[int, bytes] = {}

    def run(key: str) -> bytes:
        ids = ids_of(key)
        try:
            return b"".join([four[i] for i in ids])
        except KeyError:
            four.update((i, i.to_bytes(4, "little")) for i in ids)
            return b"".join([four[i] for i in ids])

    return run


class CachedEncoder:
    """Encodes texts by parts that don't influence each other: the library encodes each distinct part once.

    split(text) gives the parts, or None where the text as a whole goes to the
    library; ids_of(part) gives a part's ids as bytes.
    """

    def __init__(self, tokenizer, split, ids_of):
        self.tokenizer, self.split, self.known = tokenizer, split, Known(ids_of)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            parts = self.split(t)
            if parts is None:
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32))
            else:
                out.append(np.frombuffer(b"".join(map(self.known.__getitem__, parts)), "<u4"))
        return out


def byte_characters(below: int = FAST) -> dict[int, str]:
    """For str.translate: each character as the characters that byte-level models have for its UTF-8 bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    return {c: "".join(byte[b] for b in chr(c).encode()) for c in range(below)}


def _splits_by_words(tokenizer) -> bool:
    """Whether a tokenizer normalises and splits as the fast form of the rule does."""
    rule = json.loads(tokenizer.to_str())
    steps = [(n["type"], n.get("pattern", {}).get("Regex")) for n in (rule["normalizer"] or {}).get("normalizers", [])]
    first = [x.get("pattern", {}).get("Regex") for x in (rule["pre_tokenizer"] or {}).get("pretokenizers", [])][:1]
    return steps == NORMALISERS and first == [SPLIT]


@functools.lru_cache(maxsize=4)
def word_encoder(path: str) -> CachedEncoder:
    """An encoder that gives the ids of the tokenizer file's own encode().

    The fast form is taken for texts of those characters below FAST that it
    encodes as the library does, alone, doubled and within a word (some capitals
    have a lower case beyond FAST); for other texts, texts with special tokens,
    and tokenizer files of another rule the library encodes whole texts.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, table = tokenizer.model, byte_characters()
    ids_of = packed_ids(lambda w: [t.id for t in model.tokenize(w if w.isascii() else w.translate(table))])

    def pieces(text: str) -> list[str]:
        return (_ASCII_PIECES if text.isascii() else _PIECES).findall(text.lower())

    def fast(text: str) -> list[int]:
        return np.frombuffer(b"".join(map(ids_of, pieces(text))), "<u4").tolist()

    def same(text: str) -> bool:
        return all(ord(c) < FAST for c in text.lower()) and fast(text) == tokenizer.encode(text, add_special_tokens=False).ids

    known = [c for c in map(chr, range(FAST)) if all(map(same, (c, c + c, f"a{c}b", f"1{c} {c}.", f"A{c}")))] if _splits_by_words(tokenizer) else []
    plain = re.compile(f"[{re.escape(''.join(known))}]*" if known else "")
    special = [t["content"] for t in json.loads(tokenizer.to_str())["added_tokens"]]

    def split(text: str) -> list[str] | None:
        if not plain.fullmatch(text) or any(t in text for t in special):
            return None
        return pieces(text)

    return CachedEncoder(tokenizer, split, ids_of)


# --- chunks ------------------------------------------------------------------------------------------------


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream. A cut depends on the last WINDOW ids only (and the size bounds),
    so equal passages are cut alike wherever they stand."""
    n = ids.size
    if n <= MIN_CHUNK:
        return [n] if n else []
    total = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(ids), dtype=np.uint64)])
    rolling = _mixed(total[WINDOW:] - total[:-WINDOW])  # of the WINDOW ids before each position
    marks = (np.flatnonzero(rolling & np.uint64((1 << MASK_BITS) - 1) == 0) + WINDOW).tolist()
    out, last = [], 0
    for m in [*marks, n]:
        while m - last > MAX_CHUNK:
            last += MAX_CHUNK
            out.append(last)
        if m - last >= MIN_CHUNK or m == n and m > last:
            out.append(m)
            last = m
    return out


def _packed(ids: np.ndarray, compressor) -> bytes:
    wide = ids.size and int(ids.max()) > 0xFFFF
    return (b"\1" if wide else b"\0") + compressor.compress(ids.astype("<u4" if wide else "<u2").tobytes())


def _unpacked(blob: bytes, decompressor) -> np.ndarray:
    return np.frombuffer(decompressor.decompress(blob[1:]), "<u4" if blob[0] else "<u2").astype("<u4")


CHUNKS = "doc_id long, row long, chunk_no int, digest binary, n int, crc32 long, ids binary"


def _chunked(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, zstd = word_encoder(path), zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                texts = [t or "" for t in b.column(2).to_pylist()]
                rows = []
                sent = set()  # of a batch, each chunk's ids are sent once
                for doc, row, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), encoder.encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    at = 0
                    for no, end in enumerate(cuts(ids)):
                        raw = ids[at:end].tobytes()
                        digest = hashlib.sha256(raw).digest()
                        rows.append((doc, row, no, digest, end - at, zlib.crc32(raw), None if digest in sent else _packed(ids[at:end], zstd)))
                        sent.add(digest)
                        at = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.binary()), strict=True)],
                    names=["doc_id", "row", "chunk_no", "digest", "n", "crc32", "ids"],
                )

    return run


def merkle(digests: list[bytes]) -> bytes:
    """Root of the binary tree over digests: pairs are hashed together, an odd one moves up as it is."""
    level = list(digests) or [b"\0" * 32]
    while len(level) > 1:
        level = [hashlib.sha256(level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


MANIFEST = "part int, first_doc long, documents long, start long, tokens long, chain binary, merkle binary"
PLACED = "part int, doc_id long, offset long, n_tokens long, merkle binary, chain binary, digests array<binary>, lengths array<int>"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted recipes the ids before each in its range, its Merkle root, and the hash chain of the roots so far."""
    from pyspark import TaskContext

    part, offset, chain = TaskContext.get().partitionId(), 0, b"\0" * 32
    for b in batches:
        cols = {k: [] for k in ("part", "offset", "n_tokens", "merkle", "chain")}
        for digests, lengths in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            root, n = merkle(digests), sum(lengths)
            chain = hashlib.sha256(chain + root).digest()
            for k, v in zip(cols, (part, offset, n, root, chain), strict=True):
                cols[k].append(v)
            offset += n
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        part_, offset_, n_, root_, chain_ = (pa.array(v, t) for v, t in zip(cols.values(), kinds, strict=True))
        yield pa.RecordBatch.from_arrays([part_, b.column(0), offset_, n_, root_, chain_, b.column(1), b.column(2)], names=[x.split()[0] for x in PLACED.split(", ")])


def write_store(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2) -> None:
    """Encodes docs and writes the store at path.

    Null texts count as empty: a document of the end id alone. Rows that repeat
    a doc_id are documents of their own, next to each other. An empty table
    gives an empty store.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), "text")
    staged = written(source.mapInArrow(_chunked(tokenizer, end_id), CHUNKS), "chunks-staged")
    # Equal chunks combine before the shuffle: a chunk in a third of all rows moves once for each task.
    unique = staged.where("ids IS NOT NULL").select("digest", "n", "crc32", "ids").dropDuplicates(["digest"])
    unique.write.option("compression", "uncompressed").parquet(f"{path}/chunks")
    recipe = (
        staged.groupBy("doc_id", "row")
        .agg(F.array_sort(F.collect_list(F.struct("chunk_no", "digest", "n"))).alias("c"))
        .select("doc_id", "row", F.col("c.digest").alias("digests"), F.col("c.n").alias("lengths"))
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = recipe.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "digests", "lengths")
    placed = written(ordered.mapInArrow(_placed, PLACED), "recipes-placed")
    # One row for each range of documents, whose number is that of the shuffle's partitions.
    ranges = placed.groupBy("part").agg(
        F.min("doc_id").alias("first_doc"), F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), F.max_by("chain", "offset").alias("chain")
    )
    before, manifest = 0, []
    for r in sorted(ranges.collect(), key=lambda r: r["part"]):
        manifest.append((r["part"], r["first_doc"], r["documents"], before, r["tokens"], bytes(r["chain"])))
        before += r["tokens"]
    root = merkle([m[-1] for m in manifest])
    manifest = spark.createDataFrame([(*m, root) for m in manifest], MANIFEST)
    placed.join(F.broadcast(manifest.select("part", "start")), "part").select(
        "part", "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "merkle", "digests", "lengths"
    ).write.parquet(f"{path}/recipes")
    manifest.coalesce(1).write.parquet(f"{path}/manifest")


# --- reading -----------------------------------------------------------------------------------------------


def _checked(digest: bytes, blob: bytes, zstd) -> np.ndarray:
    ids = _unpacked(blob, zstd)
    if hashlib.sha256(ids.tobytes()).digest() != digest:
        raise ValueError(f"chunk {digest.hex()} does not hold what its digest says")
    return ids


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zstd = zstandard.ZstdDecompressor()
    for b in batches:
        sizes, crcs = [], []
        for digest, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
            ids = _checked(digest, blob, zstd)
            sizes.append(ids.size)
            crcs.append(zlib.crc32(ids.tobytes()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(crcs, pa.int64())], names=["digest", "size", "crc32"])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The manifest's rows anew, from recipes (part, start, doc_id, n_tokens, merkle) of whole ranges in order."""
    names = [x.split()[0] for x in RANGES.split(", ")]
    row = None
    for b in batches:
        for part, start, doc, n, root in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row is None or row["part"] != part:
                if row is not None:
                    yield pa.RecordBatch.from_pylist([row], schema=_RANGES)
                row = dict(zip(names, (part, doc, 0, start, 0, b"\0" * 32), strict=True))
            if start != row["start"] + row["tokens"]:
                raise ValueError(f"the recipes before place {start} have {row['start'] + row['tokens']} ids")
            row["documents"] += 1
            row["tokens"] += n
            row["chain"] = hashlib.sha256(row["chain"] + root).digest()
    if row is not None:
        yield pa.RecordBatch.from_pylist([row], schema=_RANGES)


RANGES = "part int, first_doc long, documents long, start long, tokens long, chain binary"
_RANGES = pa.schema([("part", pa.int32()), ("first_doc", pa.int64()), ("documents", pa.int64()), ("start", pa.int64()), ("tokens", pa.int64()), ("chain", pa.binary())])


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Raises ValueError unless recipes, ranges and root agree. A row for each range (as many as the writing
    shuffle had partitions) comes to the driver."""
    manifest = sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in spark.read.parquet(f"{path}/manifest").collect()), key=lambda r: r[0])
    root, before = merkle([r[5] for r in manifest]), 0
    for r in manifest:
        if r[6] != root or r[3] != before:
            raise ValueError("the manifest's ranges do not match its root")
        before += r[4]
    recipes = spark.read.parquet(f"{path}/recipes").select("part", "start", "doc_id", "n_tokens", "merkle")
    parts = max((r[0] for r in manifest), default=0) + 1
    found = recipes.repartition(parts, "part").sortWithinPartitions("part", "start").mapInArrow(_ranges, RANGES).collect()
    if sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in found), key=lambda r: r[0]) != [r[:6] for r in manifest]:
        raise ValueError("recipes are missing or changed: they do not give the manifest's ranges")


def _times(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Matrices over GF(2), as 32 columns in the last axis, times vectors of 32 bits."""
    bits = (vectors[..., None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
    return np.bitwise_xor.reduce(matrix * bits, axis=-1)


@functools.lru_cache(maxsize=1 << 16)
def _shift(length: int) -> np.ndarray:
    """What appending `length` zero bytes does to a CRC-32, as a matrix over GF(2)."""
    power = np.array([0xEDB88320] + [1 << k for k in range(31)], np.uint32)  # one zero bit
    out = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(3):
        power = _times(power[None], power)  # one zero byte
    while length:
        if length & 1:
            out = _times(power[None], out)
        power = _times(power[None], power)
        length >>= 1
    return out


def crc32_joined(crcs: np.ndarray, lengths: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """CRC-32 of concatenations: crcs and byte lengths of all parts, one concatenation after another, and
    how many parts each has."""
    crcs = crcs.astype(np.uint32)
    kinds, kind = np.unique(lengths, return_inverse=True)
    matrix = np.stack([_shift(int(k)) for k in kinds]) if kinds.size else np.zeros((0, 32), np.uint32)
    first = np.cumsum(parts) - parts
    out = np.zeros(parts.size, np.uint32)
    at = 0
    while (live := np.flatnonzero(parts > at)).size:
        for block in np.array_split(live, -(-live.size // 4096)):
            i = first[block] + at
            out[block] = _times(matrix[kind[i]], out[block]) ^ crcs[i]
        at += 1
    return out


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = b.column(4)
        flat = parts.flatten()
        if flat.field("crc32").null_count:
            raise ValueError("a recipe's chunk is missing")
        if not flat.field("n").equals(flat.field("size")):
            raise ValueError("a recipe does not match the chunks found for it")
        n = parts.value_lengths().to_numpy(zero_copy_only=False)
        first = np.cumsum(n) - n
        digests = flat.field("digest").to_pylist()
        if any(merkle(digests[at : at + k]) != root for at, k, root in zip(first.tolist(), n.tolist(), b.column(3).to_pylist(), strict=True)):
            raise ValueError("a recipe does not match its Merkle root")
        size = flat.field("size").to_numpy(zero_copy_only=False).astype(np.int64)
        if not np.array_equal(np.add.reduceat(size, first) if n.size else size, b.column(2).to_numpy()):
            raise ValueError("a recipe's chunks do not add up to its ids")
        got = crc32_joined(flat.field("crc32").to_numpy(zero_copy_only=False), 4 * size, n)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(got.astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the store's files, all of it verified. Damaged
    and missing chunks and recipes are errors: the manifest's at once, the chunks' when the rows are read."""
    verify_manifest(spark, path)
    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "ids").mapInArrow(_verified, "digest binary, size int, crc32 long")
    # A recipe without chunks is damage too: every document has its end id.
    used = spark.read.parquet(f"{path}/recipes").select(
        "doc_id", "start", "n_tokens", "merkle", F.posexplode_outer(F.arrays_zip("digests", "lengths")).alias("no", "c")
    ).select("doc_id", "start", "n_tokens", "merkle", "no", F.col("c.digests").alias("digest"), F.col("c.lengths").alias("n"))
    parts = F.array_sort(F.collect_list(F.struct("no", "digest", "n", "size", "crc32"))).alias("parts")
    whole = used.join(chunks, "digest", "left").groupBy("doc_id", "start", "n_tokens", "merkle").agg(parts)
    return whole.mapInArrow(_combined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): each document's ids put together from its chunks, verified as in read_digests()."""
    verify_manifest(spark, path)
    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "ids")
    recipes = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", "n_tokens", F.posexplode_outer("digests").alias("no", "digest"))
    parts = F.array_sort(F.collect_list(F.struct("no", "digest", "ids"))).alias("parts")
    whole = recipes.join(chunks, "digest", "left").groupBy("doc_id", "start", "n_tokens").agg(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdDecompressor()
        for b in batches:
            ids = []
            for n, parts in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if any(p["ids"] is None for p in parts):
                    raise ValueError("a recipe's chunk is missing")
                ids.append(np.concatenate([_checked(p["digest"], p["ids"], zstd) for p in parts]).astype(np.int64))
                if ids[-1].size != n:
                    raise ValueError("a recipe's chunks do not add up to its ids")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return whole.mapInArrow(run, "doc_id long, start long, ids array<long>")


def op4_token_store(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "token-store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_digests(spark, path)
