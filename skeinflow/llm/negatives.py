"""Hard negatives by blocked matrix products.

Anchors are dealt to groups of bounded size; each group is broadcast, and every
task multiplies its blocks of candidates with it in double precision. Components
are whole numbers, so the products are exact below 2**53; the few pairs whose
product could be larger are computed in Python's integers. A first pass keeps the
best positives of each anchor, a task's partial lists being merged by score; a
second pass keeps, within the window of scores that each positive sets, the best
negatives. No row is shuffled, only those lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.llm.common import delete, shared_path
from skeinflow.operators.graph import written_at

EXACT = 2.0**53
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _finite(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(vec_id, label, whole-number matrix) of the rows (vec_id, label, embedding) that take part, by number of components."""
    vectors = b.column(2)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = pa.array(np.flatnonzero(sizes == size))
        part = b.take(at)
        flat = part.column(2).flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, int(size))  # nulls are NaN
        good = np.isfinite(x).all(1)
        if good.any():
            ids, labels = (part.column(k).to_numpy()[good] for k in (0, 1))
            yield ids, labels, x[good]


def _products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of rows with rows."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = a @ c.T
        most_a, most_c = np.abs(a).max(1, initial=0), np.abs(c).max(1, initial=0)
        if most_a.max() * most_c.max() * max(1, a.shape[1]) < EXACT:
            return out.astype(np.int64)
        large = np.argwhere(most_a[:, None] * most_c[None] * a.shape[1] >= EXACT)
        out[large[:, 0], large[:, 1]] = 0
    out = out.astype(np.int64)
    for i, j in large.tolist():
        out[i, j] = sum(int(x) * int(y) for x, y in zip(a[i], c[j], strict=True))  # OverflowError beyond 64 bits
    return out


class Best:
    """The best k (score, id) of each row, higher scores first and ties by smaller id."""

    def __init__(self, rows: int, k: int):
        self.score, self.id = np.full((rows, k), LOW), np.full((rows, k), HIGH)

    def add(self, first: int, score: np.ndarray, ids: np.ndarray, take: np.ndarray) -> None:
        """Offers the scores of rows first, first + 1, ... with the candidates `ids`, where `take` holds."""
        rows, k = score.shape[0], self.score.shape[1]
        least, last = self.score[first : first + rows, -1:], self.id[first : first + rows, -1:]
        i, j = np.nonzero(take & ((score > least) | (score == least) & (ids[None] < last)))
        if not i.size:
            return
        hit = np.unique(i)
        row = np.concatenate([np.repeat(hit, k), i])
        s = np.concatenate([self.score[first + hit].ravel(), score[i, j]])
        x = np.concatenate([self.id[first + hit].ravel(), ids[j]])
        order = np.lexsort((x, -1 - s, row))  # -1 - s falls as s grows, without overflow
        row, s, x = row[order], s[order], x[order]
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        kept = (start[:, None] + np.arange(k)).ravel()
        self.score[first + hit], self.id[first + hit] = s[kept].reshape(-1, k), x[kept].reshape(-1, k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = np.nonzero(self.id != HIGH)
        return i, self.id[i, j], self.score[i, j]


def _collected(rows: DataFrame) -> dict[int, tuple[np.ndarray, ...]]:
    """By number of components: (vec_id, label, matrix, place of each row in the group)."""
    out, place = {}, 0
    for b in rows.toArrow().combine_chunks().to_batches():
        for ids, labels, x in _finite(b):
            out.setdefault(x.shape[1], []).append((ids, labels, x, np.arange(place, place + len(ids))))
            place += len(ids)
    return {dim: tuple(np.concatenate(part) for part in zip(*parts, strict=True)) for dim, parts in out.items()}


def _scan(group, block_rows: int, best_of, compare):
    """A function of batches that offers every block of candidates to the lists that best_of() makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        size = 64  # blocks grow, so that the first lists come from few rows
        for b in batches:
            for ids, labels, x in _finite(b):
                anchors = group.value.get(x.shape[1])
                if anchors is None:
                    continue
                if x.shape[1] not in best:
                    best[x.shape[1]] = best_of(anchors)
                lists, end = best[x.shape[1]], 0
                while end < len(ids):
                    c = slice(end, end + size)
                    end, size = end + size, min(block_rows, size * 2)
                    for at in range(0, len(anchors[0]), 512):
                        a = slice(at, at + 512)
                        compare(lists, at, tuple(v[a] for v in anchors), _products(anchors[2][a], x[c]), ids[c], labels[c])
        for dim, lists in best.items():
            place = group.value[dim][3]
            for k, one in enumerate(lists):
                i, ids, score = one.rows()
                yield pa.RecordBatch.from_arrays([pa.array(place[i]), pa.array(np.full(len(i), k)), pa.array(ids), pa.array(score)], names=["anchor", "no", "other", "score"])

    return run


LISTS = "anchor long, no long, other long, score long"


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """The first k of each (anchor, no), with their rank."""
    w = Window.partitionBy("anchor", "no").orderBy(F.desc("score"), "other")
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, window: int = 80, block_rows: int = 4096, group_bytes: int = 64 << 20
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (vec_id, label, embedding)
    whose components are whole numbers.

    Anchors are the rows where `anchor` holds. A row's score is its inner product with the anchor; higher scores come
    first, ties by smaller vec_id. An anchor's positives are its first `positives` rows of its label and of another
    vec_id; for each, the first `negatives` rows of another label whose score is at most the positive's and at least
    `window` percent of it.

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part. Vectors are compared
    only with those of as many components. Rows that repeat a vec_id are candidates of their own; anchors that are the
    same in all three columns count once. A score beyond 64 bits is an error. Other columns are not read; an empty
    table, or one without anchors, gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    shown = [F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")]
    own_at = shared_path(spark, "anchors")
    own = written_at(rows.where(anchor).select(*shown).distinct(), own_at)
    rows = rows.select(*shown)
    size = own.agg(F.coalesce(F.sum(8 * F.size("embedding") + 24), F.lit(0))).first()[0]
    groups = max(1, -(-size // group_bytes))
    out = shared_path(spark, "negatives")
    number = F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(groups))
    for g in range(groups):
        anchors = _collected(own.where(number == g))
        group = spark.sparkContext.broadcast(anchors)

        def same(lists, at, a, score, ids, labels):
            lists[0].add(at, score, ids, (a[1][:, None] == labels[None]) & (a[0][:, None] != ids[None]))

        first = rows.mapInArrow(_scan(group, block_rows, lambda a: [Best(len(a[0]), positives)], same), LISTS)
        found = _merged(first, positives).toArrow()  # at most `positives` rows for each anchor of the group
        total = sum(len(a[0]) for a in anchors.values())
        best, low, ids = np.full((total, positives), LOW), np.full((total, positives), HIGH), np.zeros((total, positives), np.int64)
        place, rank = found["anchor"].to_numpy(), found["rank"].to_numpy() - 1
        best[place, rank], ids[place, rank] = found["score"].to_numpy(), found["other"].to_numpy()
        low[place, rank] = [-(-window * s // 100) for s in found["score"].to_pylist()]
        bounds = spark.sparkContext.broadcast((best, low))

        def other(lists, at, a, score, ids, labels, bounds=bounds):
            apart = a[1][:, None] != labels[None]
            for k, one in enumerate(lists):
                top, least = (v[a[3], k][:, None] for v in bounds.value)
                one.add(at, score, ids, apart & (score <= top) & (score >= least))

        second = rows.mapInArrow(_scan(group, block_rows, lambda a: [Best(len(a[0]), negatives) for _ in range(positives)], other), LISTS)
        vec_id = np.empty(total, np.int64)
        for a in anchors.values():
            vec_id[a[3]] = a[0]
        known = spark.sparkContext.broadcast((vec_id, ids, best))

        def named(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for b in batches:
                anchor, no, rank, other, score = (c.to_numpy() for c in b.columns)
                vec_id, ids, best = known.value
                columns = [vec_id[anchor], ids[anchor, no], rank.astype(np.int32), other, best[anchor, no], score]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

        _merged(second, negatives).select("anchor", "no", "rank", "other", "score").mapInArrow(named, FOUND).write.mode("append").parquet(out)
        for sent in (group, bounds, known):
            sent.destroy()
    delete(spark, own_at)
    return spark.read.schema(FOUND).parquet(out)


FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    def whole(x):
        scaled = 256 * x.cast("double")
        return F.when(F.abs(scaled) < EXACT, F.floor(scaled).cast("double")).otherwise(scaled)  # beyond, every double is whole

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", whole).alias("embedding"),
    )
    return mine(rows, F.col("vec_id") % 100 == 0)


OP13_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other))::INT AS rank,
       s.other AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY rank <= 5
"""
