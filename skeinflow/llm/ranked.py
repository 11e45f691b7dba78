"""Ranked lexical search with block-max pruning.

An index of a table is a folder:

  totals/    Parquet, one row: documents with a term, and all their terms.
  blocks/    Parquet, a row for each block of `block_docs` documents (a range of the
             input as it is read): its terms with the largest impact of each, and how
             many of its documents hold it; the forward index: doc_ids, sizes (terms
             of each document with repeats), and for each document its entries (place
             of the term in the block's terms, count), one after another.
  lexicon/   Parquet (term, df).

A query's bound for a block is the sum of its weights times the block's maxima,
and no document of the block scores more. Searching reads terms and maxima first:
the `seeds` blocks of the highest bounds of each query are scored, and the k-th
best score is the query's first threshold. Then tasks take their blocks in falling
order of their bounds, score the documents from the forward index, raise the
threshold as their lists fill, and leave a query's remaining blocks when a bound
drops below it. The lists of all tasks are merged by score. The result is that of
scoring every document, and no row of the index is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinflow.llm.common import delete, shared_path, slices

# Fixed value: what a term is.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of UTF-8 that are part of a term: those of ASCII letters and digits, and all beyond ASCII.
_IN_TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_TERMS, _GAP = re.compile(TERM), re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
WINDOW = 1 << 20

BLOCKS = pa.schema(
    [("block", pa.int64()), ("terms", pa.list_(pa.string())), ("maxima", pa.list_(pa.int32())), ("dfs", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())),
     ("sizes", pa.list_(pa.int64())), ("entries", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]
)
BLOCKS_SQL = (
    "block long, terms array<string>, maxima array<int>, dfs array<int>, doc_ids array<long>, sizes array<long>, entries array<int>, places array<int>, counts array<int>"
)


def term_counts(text: str | None) -> Counter:
    """How often each term occurs in a whole text, taken in windows that end between terms."""
    out: Counter = Counter()
    at, size = 0, len(text or "")
    while at < size:
        end = min(size, at + WINDOW)
        if end < size:
            gap = _GAP.search(text, end)
            end = gap.start() if gap else size
        out.update(_TERMS.findall(text[at:end].encode().lower().decode()))  # bytes.lower() is for A-Z alone
        at = end
    return out


@dataclass(frozen=True)
class Measure:
    """How a term counts: weights from document frequencies, impacts from counts and document sizes."""

    documents: int
    terms: int

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))

    def impact(self, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        m = 100 - 75 + (75 * sizes * self.documents) // max(1, self.terms)
        return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


def _blocks(measure: Measure, block_docs: int, block_terms: int):
    def block(number: int, docs: list[tuple[int | None, Counter]]) -> dict:
        terms: dict[str, int] = {}
        places = np.array([terms.setdefault(t, len(terms)) for _, c in docs for t in c])
        counts = np.array([n for _, c in docs for n in c.values()])
        sizes, entries = [c.total() for _, c in docs], [len(c) for _, c in docs]
        maxima = np.zeros(len(terms), np.int64)
        np.maximum.at(maxima, places, measure.impact(counts, np.repeat(sizes, entries)))
        return {
            "block": number, "terms": list(terms), "maxima": maxima, "dfs": np.bincount(places, minlength=len(terms)),
            "doc_ids": [d for d, _ in docs], "sizes": sizes, "entries": entries, "places": places, "counts": counts,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        docs, held = [], 0
        for whole in batches:
            for b in slices(whole, "text"):
                done = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    c = term_counts(text)
                    if not c:
                        continue
                    docs.append((doc, c))
                    held += len(c)
                    if len(docs) >= block_docs or held >= block_terms:
                        done.append(block(number, docs))
                        docs, held, number = [], 0, number + 1
                if done:
                    yield pa.RecordBatch.from_pylist(done, BLOCKS)
        if docs:
            yield pa.RecordBatch.from_pylist([block(number, docs)], BLOCKS)

    return run


def _spread(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and the row of each."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), n)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch of texts: how many have a term, and all their terms."""
    for whole in batches:
        for b in slices(whole, "text"):
            text = b.column(0)
            offsets = np.frombuffer(text.buffers()[1], np.int32 if pa.types.is_string(text.type) else np.int64)[text.offset : text.offset + len(text) + 1]
            held = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            inside = np.concatenate([[False], _IN_TERM[held]])
            start = inside[1:] & ~inside[:-1]
            first = (offsets[:-1] - offsets[0])[np.diff(offsets) > 0]
            start[first] = inside[1:][first]  # a text begins anew
            counts = np.add.reduceat(start.astype(np.int64), first) if first.size else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (int((counts > 0).sum()), int(counts.sum()))], names=["documents", "terms"])


@contextmanager
def _few_rows(spark: SparkSession, rows: int = 64) -> Iterator[None]:
    """While blocks are read: they are rows of some hundred KB, of which the usual batches of thousands would not fit."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, str(rows))
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def build(docs: DataFrame, path: str, block_docs: int = 64, block_terms: int = 1 << 18) -> None:
    """Writes the index of (doc_id, text). A block ends after block_docs documents or block_terms entries. Null, empty
    and term-less texts are in no block. Rows that repeat a doc_id are documents of their own."""
    spark = docs.sparkSession
    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    text.mapInArrow(_sizes, "documents long, terms long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("documents", "terms")]).write.parquet(f"{path}/totals")
    made = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_blocks(_measure(spark, path), block_docs, block_terms), BLOCKS_SQL)
    made.write.parquet(f"{path}/blocks")
    with _few_rows(spark):
        each = spark.read.schema(BLOCKS_SQL).parquet(f"{path}/blocks").select(F.explode(F.arrays_zip("terms", "dfs")).alias("t"))
        each.groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df")).write.parquet(f"{path}/lexicon")


def _measure(spark: SparkSession, path: str) -> Measure:
    return Measure(**spark.read.parquet(f"{path}/totals").first().asDict())


@dataclass
class Queries:
    """A group of queries: their terms, and for each query the places of its terms and its weights."""

    items: list
    terms: pa.Array
    weights: np.ndarray  # queries x terms, of double precision where all sums are exact in it

    @classmethod
    def of(cls, rows: list, measure: Measure) -> Queries:
        """From (item_id, term, count, df)."""
        items = sorted({r["item_id"] for r in rows})
        terms = sorted({r["term"] for r in rows})
        place, row = {t: i for i, t in enumerate(terms)}, {x: i for i, x in enumerate(items)}
        w = np.zeros((len(items), len(terms)), np.int64)
        for r in rows:
            w[row[r["item_id"]], place[r["term"]]] = r["count"] * measure.weight(r["df"])
        # An impact is below 10**6, so no sum of a query reaches 2**53 where its weights stay below that share.
        exact = w.sum(1, dtype=np.float64).max(initial=0) * 1e6 < 2.0**53
        return cls(items, pa.array(terms, pa.string()), w.astype(np.float64) if exact else w)

    def scores(self, values: np.ndarray, place: np.ndarray, row: np.ndarray, rows: int, item: np.ndarray | slice = slice(None)) -> np.ndarray:
        """queries (all, or those named) x rows: sums of weight times value over entries (row, place of a term), by row."""
        weights = self.weights[item]
        out = np.zeros((len(weights), rows), np.int64)
        for at in range(0, rows, 256):
            lo, hi = np.searchsorted(row, [at, at + 256])
            dense = np.zeros((len(self.terms), min(256, rows - at)), self.weights.dtype)
            dense[place[lo:hi], row[lo:hi] - at] = values[lo:hi]
            out[:, at : at + 256] = weights @ dense
        return out

    def places(self, terms: pa.Array) -> np.ndarray:
        """The place of each term, -1 where no query has it."""
        return pc.fill_null(pc.index_in(terms, self.terms), -1).to_numpy(zero_copy_only=False)


def _bounds(q: Queries, terms: pa.Array, maxima: pa.Array) -> np.ndarray:
    """queries x blocks."""
    out = np.zeros((len(q.items), len(terms)), np.int64)
    for at in range(0, len(terms), 256):
        values, row = _spread(maxima.slice(at, 256))
        place = q.places(terms.slice(at, 256).flatten())
        have = place >= 0
        out[:, at : at + 256] = q.scores(values[have], place[have], row[have], len(terms.slice(at, 256)))
    return out


def _seeds(sent, most: int):
    """Of blocks (block, terms, maxima): (item, block, bound) of each item's `most` highest bounds above 0 in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for b in batches:
            bounds = _bounds(q, b.column(1), b.column(2))
            block = b.column(0).to_numpy()
            first = np.lexsort((np.broadcast_to(block, bounds.shape), -bounds), axis=1)[:, :most]
            item, bound = np.repeat(np.arange(len(bounds)), first.shape[1]), np.take_along_axis(bounds, first, 1).ravel()
            have = bound > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[have]) for x in (item, block[first].ravel(), bound)], names=["item", "block", "bound"])

    return run


def _block_scores(q: Queries, item: np.ndarray, b: pa.RecordBatch, measure: Measure) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one block: its doc_ids, which of them are null, and the named queries x documents."""
    terms, ids, sizes, entries, places, counts = (b.column(b.schema.get_field_index(c)).flatten() for c in ("terms", "doc_ids", "sizes", "entries", "places", "counts"))
    entries, place = entries.to_numpy(), q.places(terms)[places.to_numpy()]
    have = place >= 0
    doc = np.repeat(np.arange(len(ids)), entries)[have]
    impact = measure.impact(counts.to_numpy()[have].astype(np.int64), sizes.to_numpy()[doc])
    return ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), q.scores(impact, place[have], doc, len(ids), item)


SCORED = "item long, doc_id long, missing boolean, score long"


def _scored(sent, least, asked, measure: Measure, k: int):
    """Of blocks: the best k documents of each item in the task. The blocks of a batch are taken by falling bound, so an
    item leaves them when its k-th best score is above the bound. asked (block to items) may narrow what is scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, floor = sent.value, np.maximum(least.value, 1)
        best: list[list[tuple]] = [[] for _ in q.items]  # (-score, doc_id is null, doc_id)
        for b in batches:
            bounds = _bounds(q, *(b.column(b.schema.get_field_index(c)) for c in ("terms", "maxima")))
            block = b.column(b.schema.get_field_index("block")).to_pylist()
            for at in np.argsort(-bounds.max(0, initial=0), kind="stable").tolist():
                item = np.flatnonzero(bounds[:, at] >= floor)
                if asked is not None:
                    item = np.intersect1d(item, asked.value.get(block[at], []))
                if not item.size:
                    continue
                ids, missing, scores = _block_scores(q, item, b.slice(at, 1), measure)
                rows, docs = np.nonzero(scores >= floor[item][:, None])
                for r in np.unique(rows).tolist():
                    i, d = int(item[r]), docs[rows == r]
                    found = zip((-scores[r, d]).tolist(), missing[d].tolist(), ids[d].tolist(), strict=True)
                    best[i] = sorted([*best[i], *found])[:k]
                    if len(best[i]) == k:
                        floor[i] = max(floor[i], -best[i][-1][0])
        rows = [(i, None if x[1] else x[2], x[1], -x[0]) for i, found in enumerate(best) for x in found]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["item", "doc_id", "missing", "score"])

    return run


def search(items: DataFrame, path: str, k: int = 10, seeds: int = 2, group_terms: int = 1 << 14, group_items: int = 256) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item (item_id, text) the k documents of the index at `path` with the
    highest scores above 0, ties by ascending doc_id (null last), ranks from 1.

    Rows that repeat an item_id are one item, with the terms of all of them. Items without a term that the index knows
    have no row, nor has a null item_id. Items are searched in groups of about group_items items and group_terms terms,
    a group being what is broadcast.
    """
    spark = items.sparkSession
    measure = _measure(spark, path)
    words = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), F.col("text")).mapInArrow(_item_terms, "item_id long, term string, count long")
    at = shared_path(spark, "item-terms")
    words.groupBy("item_id", "term").agg(F.sum("count").alias("count")).join(spark.read.parquet(f"{path}/lexicon"), "term").write.parquet(at)
    terms = spark.read.parquet(at)
    size = terms.agg(F.count("*").alias("terms"), F.count_distinct("item_id").alias("items")).first()
    groups = max(1, -(-size["terms"] // group_terms), -(-size["items"] // group_items))
    out = shared_path(spark, "ranked")
    blocks = spark.read.schema(BLOCKS_SQL).parquet(f"{path}/blocks")
    scored = ["block", "terms", "maxima", "doc_ids", "sizes", "entries", "places", "counts"]
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), "missing", "doc_id")
    by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "block")
    with _few_rows(spark):
        for g in range(groups):
            # What is sent is bounded by the group: its terms, `seeds` blocks and a threshold for each item.
            q = Queries.of(terms.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect(), measure)
            floor, asked = np.zeros(len(q.items), np.int64), {}
            sent, none = spark.sparkContext.broadcast(q), spark.sparkContext.broadcast(floor)

            def best(among: DataFrame, least, asked=None, sent=sent) -> DataFrame:
                found = among.select(scored).mapInArrow(_scored(sent, least, asked, measure, k), SCORED)
                return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)

            bounds = blocks.select("block", "terms", "maxima").mapInArrow(_seeds(sent, seeds), "item long, block long, bound long")
            for r in bounds.withColumn("n", F.row_number().over(by_bound)).where(F.col("n") <= seeds).collect():
                asked.setdefault(r["block"], []).append(r["item"])
            chosen = spark.createDataFrame([(b,) for b in asked], "block long")
            wanted = spark.sparkContext.broadcast(asked)
            for r in best(blocks.join(F.broadcast(chosen), "block", "left_semi"), none, wanted).where(F.col("rank") == k).select("item", "score").collect():
                floor[r["item"]] = r["score"]
            least = spark.sparkContext.broadcast(floor)
            names = spark.createDataFrame(list(enumerate(q.items)), "item long, item_id long")
            best(blocks, least).join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score").write.mode("append").parquet(out)
            for b in (sent, none, wanted, least):
                b.destroy()
    delete(spark, at)
    return spark.read.schema("item_id long, rank int, doc_id long, score long").parquet(out)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, t, n) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t, n in term_counts(text).items()]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["item_id", "term", "count"])


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "ranked-index")
    build(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    out = search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), path)
    delete(spark, path)
    return out


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
t AS (SELECT row, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d),
f AS (SELECT row, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM t GROUP BY row, term),
g AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
w AS (SELECT term, floor(1000 * ln((2 * g.docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, g GROUP BY term, g.docs),
i AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
s AS (
  SELECT item_id, row, any_value(doc_id) AS doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * g.docs) // g.total))))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN f USING (term), g GROUP BY item_id, row)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""
