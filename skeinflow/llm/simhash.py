"""SimHash near-duplicates by anchor-point covering.

A fingerprint has one bit for each of 64 positions: set if more than half of
the document's shingle hashes have it set. Two fingerprints link at `threshold`
(3) or fewer differing bits.

Anchors: of the two 32-bit halves of a linked pair one differs in at most
threshold // 2 = 1 bits. On 31 bits of each half the anchors are the words of
the perfect (31, 26) Hamming code, which cover every word with radius 1. A
fingerprint is replicated to every anchor within radius 1 + 1 = 2, which is at
most 16 anchors a half, so each linked pair meets in at least one anchor's
cell; the cell then compares whole fingerprints. A code for all 64 bits at
once with that radius would need some ten thousand replicas of each row.

Cells with more than `cell_rows` fingerprints are dealt out as pairs of blocks,
so no task holds more than two blocks. A block emits a spanning forest of its
links; one of fewer than 48 fingerprints emits its links as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.llm.common import components, gathered, joined_sorted, written

SEED = 42
BLOCK = 1 << 16


def simhash(text: str | None, words: int = 3) -> int:
    """Fingerprint of a text: A-Z lower-cased, words between ASCII white space, shingles of `words`
    words with repeats, XXH64 of each. Fewer words: one shingle of all; none (or null): 0."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = w[at : min(at + BLOCK, n) + words - 1]
        raw = b" ".join(part)
        length = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(length + 1) - 1
        m = max(1, len(part) - words + 1)
        starts = (ends - length)[:m].tolist()
        stops = ends[min(words, len(part)) - 1 :].tolist()
        h = np.fromiter(
            map(xxhash.xxh64_intdigest, [raw[a:b] for a, b in zip(starts, stops, strict=True)], repeat(SEED)), np.uint64, m
        )
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    fingerprint = np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0]
    return int(fingerprint)


def fingerprints(docs: DataFrame, words: int = 3, row: str | None = None) -> DataFrame:
    """(doc_id, fp), and row where a column's name is given: fp is the fingerprint as a signed 64-bit integer. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", "row"][: b.num_columns])

    more = [F.col(row).cast("long").alias("row")] if row else []
    return docs.select(F.col("doc_id").cast("long"), "text", *more).mapInArrow(run, "doc_id long, fp long" + ", row long" * bool(row))


def _masks() -> list[list[int]]:
    """For each syndrome of the (31, 26) Hamming code, what to flip to reach each code word within 2."""
    bit = lambda i: 1 << (i - 1)
    return [
        [0] if not s else [bit(s), *(bit(i) | bit(i ^ s) for i in range(1, 32) if i < i ^ s)] for s in range(32)
    ]


def _flipped(masks: Column, key: Column) -> Column:
    return F.transform(masks, lambda m: key.bitwiseXOR(m))


def anchors(fp: Column) -> Column:
    """All (half, code word) keys within distance 2 of a fingerprint, as an array of longs."""
    masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in _masks()])
    out = []
    for half in (0, 1):
        x = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit((1 << 31) - 1).cast("long"))
        syndrome = F.lit(0)
        for k in range(5):
            parity = sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)
            syndrome = syndrome + F.bit_count(x.bitwiseAND(F.lit(parity).cast("long"))) % 2 * (1 << k)
        key = x.bitwiseOR(F.lit(half << 32).cast("long"))
        out.append(_flipped(F.get(masks, syndrome), key))
    return F.concat(*out)


def spanning(fp: np.ndarray, node: np.ndarray, threshold: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges that join the linked fingerprints of one block; each node enters once."""
    left = np.arange(fp.size)
    us, vs = [], []
    while left.size > 1:
        seed, left = left[0], left[1:]
        todo = [seed]
        while todo and left.size:
            x = todo.pop()
            near = np.bitwise_count(fp[left] ^ fp[x]) <= threshold
            if near.any():
                hit, left = left[near], left[~near]
                us.append(np.full(hit.size, node[seed]))
                vs.append(node[hit])
                todo.extend(hit.tolist())
    return us, vs


def _compare(threshold: int, shifts: int = 48):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in joined_sorted(batches, ["cell", "i", "j"]):
            cell, i, j, node, fp = (t.column(k).to_numpy() for k in ("cell", "i", "j", "node", "fp"))
            fp = fp.view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
            new = np.concatenate([[True], (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, cell.size))
            group = np.repeat(np.arange(first.size), size)
            us, vs = [], []
            for k in np.flatnonzero(size > shifts):  # large cells: visit and shrink
                s = slice(first[k], first[k] + size[k])
                a, b = spanning(fp[s], node[s], threshold)
                us += a
                vs += b
            small = size[group] <= shifts
            fp, node, group = fp[small], node[small], group[small]
            for d in range(1, shifts):  # small cells: all of them at once, by distance in the sorted order
                same = np.flatnonzero(group[d:] == group[:-d])
                if not same.size:
                    break
                near = same[np.bitwise_count(fp[same] ^ fp[same + d]) <= threshold]
                us.append(node[near])
                vs.append(node[near + d])
            if us:
                pairs = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])

    return run


def links(nodes: DataFrame, threshold: int = 3, cell_rows: int = 4096) -> DataFrame:
    """Edges (u, v) between nodes (node, fp) of different fingerprints within threshold; enough of them
    to join all that is reachable. threshold: 0 to 3, what the anchors cover."""
    if not 0 <= threshold <= 3:
        raise ValueError("the anchors cover thresholds 0 to 3")
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select("node", "fp", F.explode(anchors(F.col("fp"))).alias("cell"))
    hot = (
        rows.groupBy("cell").count().where(F.col("count") > cell_rows)
        .select("cell", F.ceil(F.col("count") / cell_rows).cast("int").alias("blocks"))
    )
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    lone = F.col("blocks").isNull()
    dealt = (
        rows.join(hot, "cell", "left")
        .withColumn("b", F.when(lone, 0).otherwise(block))
        .withColumn("other", F.explode(F.when(lone, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
        .select("cell", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "node", "fp")
    )
    return (
        dealt.repartition(parts, "cell", "i", "j")
        .sortWithinPartitions("cell", "i", "j")
        .mapInArrow(_compare(threshold), "u long, v long")
    )


def near_duplicates(docs: DataFrame, words: int = 3, threshold: int = 3, cell_rows: int = 4096, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, fp (signed), component_id (smallest doc_id reachable by links), and
    where a column's name is given row and group (a number for each component).

    Null and empty texts have fingerprint 0 and link like any other; equal
    fingerprints always link. Other columns of docs are not read. A row that
    repeats a doc_id stays a row of the result, with the group of its own text.
    A null doc_id is nobody's component_id unless a group has no other.
    """
    prints = written(fingerprints(docs, words, row), "fingerprints")
    # A fingerprint is a node, as a doc_id may stand for several texts.
    n = prints.count()
    nodes = written(gathered(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), n), "nodes")
    # Eight links a node or so: more of them only make larger files.
    comp = components(links(nodes.select(F.col("fp").alias("node"), "fp"), threshold, cell_rows), rows=8 * n)
    label = nodes.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    label = written(gathered(label, n), "labels")
    first = label.groupBy("component").agg(F.min("least").alias("component_id"))
    told = label.join(first, "component").select("fp", "component_id", F.col("component").alias("group"))
    return prints.join(told, "fp").select("doc_id", "fp", "component_id", *(["row", "group"] if row else []))


def keep_one(docs: DataFrame, words: int = 5, threshold: int = 3) -> DataFrame:
    """docs with one row of each group of near-duplicates: of those with the smallest doc_id (null only if there is
    no other) the first. The rows are numbered in a written copy, so a doc_id that comes twice is two rows."""
    number = "row_"
    while number in docs.columns:
        number += "_"
    numbered = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = written(gathered(near_duplicates(numbered, words, threshold, row=number), numbered.count()), "near-duplicates")
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("group").agg(F.min("row").alias(number))
    return numbered.join(first.select(number), number, "left_semi").select(*docs.columns)


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
