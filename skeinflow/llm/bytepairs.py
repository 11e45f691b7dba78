"""Byte-level BPE from a file of ranks, with a hierarchical-bitmap rank queue.

A pattern splits a text into pre-tokens, and each is merged by itself: of all
neighbours that together are in the vocabulary, the pair of least rank merges
first, the leftmost of equals. The queue has a bucket of start positions for
each rank that occurs and a bitmap over ranks, in levels of 64-bit words; the
next rank is found by find-first-set from the top word down. Entries are never
searched for when a merge makes them void: they are skipped when they come up.

Many pre-tokens, or one that is very long, lie in one linked list of tokens, so
a bucket's merges are done at once. Overlapping ones go leftmost first. Where a
merge brings up a pair of lesser rank, the later merges of that pre-token wait
in the bucket. So the steps are as many as there are merges, and a pre-token
of any length costs some 50 bytes of memory a byte.

Distinct pre-tokens are encoded once and remembered; texts are split in
windows, so one very long text is never a list of all its parts.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from skeinflow.llm.common import slices

WINDOW = 1 << 18
#: Characters of texts that are split and merged at one time.
HAND = 8 << 20
#: A match is final if so many characters follow it in the window: no branch of the pattern looks further.
AHEAD = 4
#: Pre-tokens that are remembered (about, and more only while one hand of texts has more), and the longest of them.
MOST_KNOWN, LONGEST_KNOWN = 1_200_000, 64

# The pattern for texts of ASCII characters alone, where it means the same as the general one.
ASCII_PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r 0-9A-Za-z]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
GENERAL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class RankQueue:
    """Buckets of positions by rank; the bucket of the least rank comes first."""

    def __init__(self, ranks: int):
        self.levels = [[0] * (-(-ranks // 64) or 1)]
        while len(self.levels[-1]) > 1:
            self.levels.append([0] * -(-len(self.levels[-1]) // 64))
        self.buckets: dict[int, list] = {}

    def push(self, rank: int, positions: int | np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            if level[word]:
                level[word] |= bit
                return
            level[word] = bit
            rank = word

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if ranks.size <= 64:
            for rank, at in zip(ranks.tolist(), positions.tolist(), strict=True):
                self.push(rank, at)
            return
        order = ranks.argsort(kind="stable")
        ranks, positions = ranks[order], positions[order]
        first = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
        for rank, at in zip(ranks[first].tolist(), np.split(positions, first[1:]), strict=True):
            self.push(rank, at)

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The least rank and the positions of its bucket, ascending and distinct, or None."""
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            if not word:
                return None
            rank = (rank << 6) + (word & -word).bit_length() - 1
        bucket, out = self.buckets.pop(rank), rank
        for level in self.levels:
            word = rank >> 6
            level[word] &= ~(1 << (rank & 63))
            if level[word]:
                break
            rank = word
        if len(bucket) == 1 and isinstance(bucket[0], int):
            return out, np.array(bucket, np.int32)
        positions = np.hstack(bucket).astype(np.int32)
        positions.sort()
        return out, positions[np.concatenate([[True], positions[1:] != positions[:-1]])]


class Merger:
    """Merges the bytes of pre-tokens by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes((b,)) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack single bytes: {missing[:5]}")
        self.ranks, self.end = ranks, max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes((b,))] for b in range(256)], np.int32)
        # All ways to put a token together from two, as one number each; the last one is never asked for.
        pairs = {(ranks[t[:i]] * (self.end + 1) + ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.keys = np.array([*sorted(pairs), np.iinfo(np.int64).max], np.int64)
        self.values = np.array([pairs.get(k, -1) for k in self.keys.tolist()], np.int32)
        made = self.values[:-1]
        left, right = np.divmod(self.keys[:-1], self.end + 1)
        #: Ranks whose merge may bring up a pair of lesser rank.
        self.lowers = np.zeros(self.end + 1, bool)
        self.lowers[left[left > made]] = self.lowers[right[right > made]] = True

    def together(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, -1 where there is none."""
        key = left.astype(np.int64) * (self.end + 1) + right
        at = self.keys.searchsorted(key)
        return np.where(self.keys[at] == key, self.values[at], np.int32(-1))

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers. Empty pieces have none."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = int(sizes.sum()) + len(pieces) + 1
        if n >= 1 << 31:
            raise ValueError("pieces of more than 2**31 bytes at once")
        token = np.full(n, self.end, np.int32)  # an end mark stands before, between and after pieces
        ends = np.cumsum(sizes + 1)
        inside = np.ones(n, bool)
        inside[0] = inside[ends] = False
        token[inside] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        pair = np.full(n, -1, np.int32)  # the rank of a token and the next, at its start
        for at in range(0, n - 1, 1 << 20):
            to = min(n - 1, at + (1 << 20))
            pair[at:to] = self.together(token[at:to], token[at + 1 : to + 1])
        queue = RankQueue(self.end)
        first = np.flatnonzero(pair >= 0).astype(np.int32)
        queue.push_all(pair[first], first)
        while (found := queue.pop()) is not None:
            rank, p = found
            p = p[pair[p] == rank]
            if not p.size:
                continue
            q, waiting = after[p], p
            if p.size > 1 and (chained := q[:-1] == p[1:]).any():
                i = np.arange(p.size)
                run = np.maximum.accumulate(np.where(np.concatenate([[True], ~chained]), i, 0))
                p = p[(i - run) % 2 == 0]
                q = after[p]
            r = after[q]
            if self.lowers[rank]:
                p, q, r = self._until_lower(queue, waiting, rank, p, q, r, token, before, ends)
            token[p], token[q], pair[q] = rank, -1, -1
            after[p], before[r] = r, p
            o = before[p]
            own, left = self.together(token[p], token[r]), self.together(token[o], token[p])
            pair[p], pair[o] = own, left
            ranks, at = np.concatenate([own, left]), np.concatenate([p, o])
            some = ranks >= 0
            if some.any():
                queue.push_all(ranks[some], at[some])
        token = token[token >= 0]
        marks = (4 * np.flatnonzero(token == self.end)).tolist()
        blob = token.astype("<u4").tobytes()
        return [blob[a + 4 : b] for a, b in zip(marks, marks[1:], strict=False)]

    def _until_lower(self, queue, waiting, rank, p, q, r, token, before, ends):
        """The merges of each piece up to the first that brings up a pair of lesser rank; the others go back to their bucket."""
        prior = token[before[p]]
        prior[1:][r[:-1] == p[1:]] = rank
        made = np.full(p.size, rank, np.int32)
        left, right = self.together(prior, made), self.together(made, token[r])
        low = (left >= 0) & (left < rank) | (right >= 0) & (right < rank)
        if not low.any():
            return p, q, r
        piece = ends.searchsorted(p)
        earlier = np.cumsum(low) - low
        first = np.concatenate([[True], piece[1:] != piece[:-1]])
        go = earlier == earlier[first][np.cumsum(first) - 1]
        if not go.all():
            queue.push(rank, np.setdiff1d(waiting, p[go], assume_unique=True))
        return p[go], q[go], r[go]


class Encoder:
    """Encodes texts by the ranks, part by part. What is not known yet of the parts in hand is merged at one time."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merger = Merger(ranks)
        self.general = regex.compile(pattern)
        self.ascii = re.compile(ASCII_PATTERN) if pattern == GENERAL_PATTERN else None
        self.known: dict[str, bytes] = {}
        self.bytes_of = [b""] * self.merger.end
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def pieces(self, text: str, window: int = WINDOW) -> Iterator[list[str]]:
        """The pre-tokens of a text, in lists of about `window` characters; a longer pre-token is in a list of its own."""
        at, size = 0, len(text)
        split = self.ascii if self.ascii is not None and text.isascii() else self.general
        take = window
        while at < size:
            end = min(size, at + take)
            found = split.findall(text, at, end)
            done = end
            while end < size and found and done > end - AHEAD:
                done -= len(found.pop())
            if found:
                at, take = done, window
                yield found
            elif end == size:
                break
            else:
                take *= 2

    def _ids(self, parts: list[list[str]]) -> list[bytes]:
        known, ranks = self.known, self.merger.ranks
        met = set().union(*parts)
        if len(known) + len(met) > MOST_KNOWN:
            self.known = known = {p: known[p] for p in met if p in known}  # what is in use stays
        new = list(met.difference(known))
        wholes = [p.encode() for p in new]
        longs = [p for p in new if len(p) > LONGEST_KNOWN]
        rest = [i for i, b in enumerate(wholes) if b not in ranks]
        known.update((p, ranks[b].to_bytes(4, "little")) for p, b in zip(new, wholes, strict=True) if b in ranks)
        known.update(zip([new[i] for i in rest], self.merger.ids([wholes[i] for i in rest]), strict=True))
        out = [b"".join(map(known.__getitem__, part)) for part in parts]
        for p in longs:
            del known[p]
        return out

    def encode(self, texts: list[str], hand: int = HAND) -> Iterator[tuple[int, array]]:
        """(index of a text, ids of its next part): all parts of the first text, then those of the second, and so on."""
        rows, parts, size = [], [], 0
        for row, text in enumerate(texts):
            at = 0
            for part in self.pieces(text):
                rows.append(row)
                parts.append(part)
                n = min(WINDOW, len(text) - at)
                at += n
                size += n
                if size >= hand:
                    yield from self._parts(rows, parts)
                    rows, parts, size = [], [], 0
        yield from self._parts(rows, parts)

    def _parts(self, rows: list[int], parts: list[list[str]]) -> Iterator[tuple[int, array]]:
        for row, blob in zip(rows, self._ids(parts) if parts else [], strict=True):
            ids = array("I")
            ids.frombytes(blob)
            yield row, ids

    def decode(self, ids: array) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """An encoder for a rank file: lines of a token in base64 and its rank."""
    with open(path, "rb") as f:
        lines = [line.split() for line in f if line.strip()]
    return Encoder({base64.b64decode(token): int(rank) for token, rank in lines}, pattern)


def _texts(b: pa.RecordBatch) -> list[str]:
    return [t or "" for t in b.column(1).to_pylist()]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the token ids of every row's whole text, a null or empty text having none. Rows that repeat a
    doc_id are encoded row by row; other columns are not read; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for whole in batches:
            for b in slices(whole, "text", HAND):
                ids = [array("I") for _ in range(b.num_rows)]
                for row, part in e.encode(_texts(b)):
                    ids[row].extend(part)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes): what ids stand for. Null ids decode to nothing; an id that is not in the file is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            out = [e.decode(array("I", ids or ())) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: its text is encoded, and the ids are decoded,
    part by part, so that no row has to hold all ids of a text. Null counts as empty (no ids; the digests of no bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for whole in batches:
            for b in slices(whole, "text", HAND):
                counts = [0] * b.num_rows
                shown, decoded = ([hashlib.sha256() for _ in counts] for _ in range(2))
                for row, ids in e.encode(_texts(b)):
                    shown[row].update((" " if counts[row] else "").encode() + " ".join(map(str, ids)).encode())
                    decoded[row].update(e.decode(ids))
                    counts[row] += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(counts, pa.int64()), pa.array([x.hexdigest() for x in shown]), pa.array([x.hexdigest() for x in decoded])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
