"""Embedding near-duplicates over an inverted multi-index.

Unit vectors are cut in two halves, each with a codebook of its own; the pairs
of codewords form a grid of cells, and a vector lives in the cell of its two
nearest codewords. A query visits cells by multi-sequence traversal: per half
the codewords are sorted by the least distance a vector of their region can
have (the largest distance to one of the planes that bound the region), and of
the pairs not yet visited the one with the least sum of squares is next. It
stops at the first cell beyond the radius. With target_recall 1 the radius is
that of the threshold itself and no link can be missed; a lower target takes
the radius at which that share of the sample's linked pairs is found. What a
cell holds is then verified by the cosine in double precision.

Codebooks grow with the table, to about `cell_rows` vectors of the largest
group in a cell (2 to 256 codewords). They are fitted on at most `sample_rows`
vectors (by hash of vec_id); every vector is indexed. A query travels once for
each codeword of the first half that it visits, with the list of its cells there.

Equal vectors are one node with a count. Each pair of nodes meets in one cell,
of which blocks of `block_rows` stored vectors and as many queries are compared
at a time; a block emits sums of links and a spanning forest, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.llm.common import components, joined_sorted, written


def _apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None], 0)


@dataclass(frozen=True)
class Codebooks:
    halves: tuple[np.ndarray, np.ndarray]

    @property
    def width(self) -> int:
        return len(self.halves[1])

    def chunk(self) -> int:
        return max(1, (1 << 21) // max(len(h) for h in self.halves) ** 2)

    def bounds(self, unit: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per half: the nearest codeword of each vector, and the least distance to each codeword's region."""
        cut = unit.shape[1] // 2
        near, least = [], []
        for x, c in zip((unit[:, :cut], unit[:, cut:]), self.halves, strict=True):
            d = _apart(x, c)
            apart = np.sqrt(_apart(c, c))
            np.fill_diagonal(apart, np.inf)
            apart[apart < 1e-6] = np.inf
            planes = (d[:, :, None] - d[:, None, :]) / (2 * apart[None])
            near.append(d.argmin(1))
            least.append(np.maximum(planes.max(2), 0))
            least[-1][np.arange(len(x)), near[-1]] = 0
        return near, least

    def homes(self, unit: np.ndarray) -> np.ndarray:
        cut = unit.shape[1] // 2
        return _apart(unit[:, :cut], self.halves[0]).argmin(1) * self.width + _apart(unit[:, cut:], self.halves[1]).argmin(1)

    def visits(self, unit: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Chunks of (row, codeword, codeword) in the order of each row's visits, nearest cell first, to the radius.

        All rows of a chunk take their next step at once; a row that has met a cell beyond the radius is done.
        """
        for at in range(0, len(unit), self.chunk()):
            _, least = self.bounds(unit[at : at + self.chunk()])
            order = [x.argsort(1, kind="stable") for x in least]
            first, second = (np.take_along_axis(x, o, 1) ** 2 for x, o in zip(least, order, strict=True))
            second = np.pad(second, ((0, 0), (0, 1)), constant_values=np.inf)
            live = np.arange(len(first))
            reached = np.zeros(first.shape, np.int64)  # for each codeword of the first list, how far the second has been gone through
            out = []
            while live.size:
                cost = first[live] + np.take_along_axis(second[live], reached[live], 1)
                i = cost.argmin(1)
                go = cost[np.arange(live.size), i] <= radius**2 + 1e-9
                live, i = live[go], i[go]
                j = reached[live, i]
                reached[live, i] += 1
                out.append((live + at, order[0][live, i], order[1][live, j]))
            yield tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros((3, 0), np.int64))


def codewords_for(rows: int, cell_rows: int, sample: int) -> int:
    """Codewords a half for so many vectors in the largest group, and no more than a sample of that size can tell apart."""
    return int(max(2, min(256, np.ceil(np.sqrt(rows / cell_rows)), max(2, sample // 16))))


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = _apart(x, c).argmin(1)
        size = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def _matrix(values: pa.Array, rows: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that tiny and huge vectors keep their direction
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit(nodes: DataFrame, threshold: float, codewords: int | None, cell_rows: int, sample_rows: int, target_recall: float) -> dict[int, tuple[Codebooks, float]]:
    """Codebooks and radius by dimension, from a bounded sample of (node, least, dim, label, embedding)."""
    sizes = {r["dim"]: r["n"] for r in nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()}  # a row a dimension
    sample = nodes.orderBy(F.xxhash64("least"), "least", "node").limit(sample_rows).select("dim", "embedding")
    by: dict[int, list] = {}
    for r in sample.toLocalIterator():
        by.setdefault(r["dim"], []).append(np.array(r["embedding"]))
    out = {}
    for dim, rows in by.items():
        x = _unit(np.stack(rows))
        cut = dim // 2
        k = codewords or codewords_for(sizes[dim], cell_rows, len(x))
        books = Codebooks((_kmeans(x[:, :cut], k), _kmeans(x[:, cut:], k)))
        radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
        if target_recall < 1:
            found = []
            for at in range(0, len(x), books.chunk()):
                near, (a, b) = books.bounds(x[at : at + books.chunk()])
                i, j = np.nonzero(x[at : at + books.chunk()] @ x.T >= threshold)
                home = np.stack(np.divmod(books.homes(x[j]), books.width)) if j.size else np.zeros((2, 0), np.int64)
                found.append(np.sqrt(a[i, home[0]] ** 2 + b[i, home[1]] ** 2)[i + at != j])
            found = np.concatenate(found) if found else np.zeros(0)
            radius = min(radius, float(np.quantile(found, target_recall))) if found.size else radius
        out[dim] = (books, radius)
    return out


PLACED = "label long, dim int, first int, role int, node long, n long, home int, cells array<int>, embedding array<{}>"


def _cells(index: dict[int, tuple[Codebooks, float]], default: float):
    def books(dim: int) -> tuple[Codebooks, float]:
        if dim in index:
            return index[dim]
        cut = dim // 2  # a dimension that the sample lacks has one cell
        return Codebooks((np.zeros((1, cut)), np.zeros((1, dim - cut)))), default

    def rows(b: pa.RecordBatch, at: np.ndarray, first: np.ndarray, role: int, home: np.ndarray, cells: pa.Array) -> pa.RecordBatch:
        t = b.take(pa.array(at))
        ints = lambda v: pa.array(v.astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [t.column(0), t.column(1), ints(first), ints(np.full(len(at), role)), t.column(2), t.column(3), ints(home), cells, t.column(4)],
            names=["label", "dim", "first", "role", "node", "n", "home", "cells", "embedding"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = whole.column(1).to_numpy()
            for dim in np.unique(dims):
                b = whole.filter(pa.array(dims == dim))
                book, radius = books(int(dim))
                x = _unit(_matrix(b.column(4), b.num_rows))
                home = book.homes(x)
                for at in range(0, b.num_rows, 8192):
                    part = np.arange(at, min(at + 8192, b.num_rows))
                    yield rows(b, part, home[part] // book.width, 0, home[part], pa.nulls(len(part), pa.list_(pa.int32())))
                for row, i, j in book.visits(x, radius):
                    # Of two vectors the one with the smaller home visits the other.
                    on = i * book.width + j >= home[row]
                    row, i, j = row[on], i[on], j[on]
                    order = np.lexsort((j, i, row))
                    row, i, j = row[order], i[order], j[order]
                    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (i[1:] != i[:-1])])) if row.size else np.zeros(0, np.int64)
                    ends = np.append(new, row.size)
                    for at in range(0, new.size, 8192):
                        part = new[at : at + 8192]
                        stops = ends[at : at + len(part) + 1]
                        lists = pa.ListArray.from_arrays(pa.array((stops - stops[0]).astype(np.int32)), pa.array(j[stops[0] : stops[-1]].astype(np.int32)))
                        yield rows(b, row[part], i[part], 1, home[row[part]], lists)

    return run


KEYS = ["label", "dim", "first", "i", "j"]


def _compare(threshold: float, widths: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in joined_sorted(batches, KEYS):
            t = t.combine_chunks()
            keys = np.stack([t.column(k).to_numpy() for k in KEYS])
            first = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
            for a, b in zip(first, np.append(first[1:], t.num_rows), strict=True):
                yield from one(t.slice(a, b - a), widths.get(int(keys[1, a]), 1))

    def one(t: pa.Table, width: int) -> Iterator[pa.RecordBatch]:
        role, home, node, n = (t.column(k).to_numpy() for k in ("role", "home", "node", "n"))
        base, query = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        if not base.size or not query.size:
            return
        x = _unit(_matrix(t.column("embedding").combine_chunks(), t.num_rows))
        lists = t.column("cells").combine_chunks().take(pa.array(query))
        visited = np.zeros((query.size, width), bool)
        visited[np.repeat(np.arange(query.size), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = True
        m = np.zeros((query.size, base.size), bool)
        second = home[base] % width
        for j in np.unique(second):
            s, q = np.flatnonzero(second == j), np.flatnonzero(visited[:, j])
            if q.size:
                m[np.ix_(q, s)] = x[query[q]] @ x[base[s]].T >= threshold
        # In their own cell both sides are there as both; each pair counts once, and none with itself.
        m &= (home[query][:, None] != home[base][None]) | (node[query][:, None] < node[base][None])
        qs, bs = m.any(1), m.any(0)
        if not qs.any():
            return
        m = m[qs][:, bs]
        qn, bn, qw, bw = node[query][qs], node[base][bs], n[query][qs], n[base][bs]
        label = bn.copy()
        while True:
            lq = np.where(m, label[None], np.iinfo(np.int64).max).min(1)
            new = np.minimum(label, np.where(m, lq[:, None], np.iinfo(np.int64).max).min(0))
            if (new == label).all():
                break
            label = new
        u = np.concatenate([qn, bn])
        v = np.concatenate([lq, label])
        links = np.concatenate([m @ bw, qw @ m])
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(links.astype(np.int64))], names=["u", "v", "links"])

    return run


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, codewords: int | None = None, cell_rows: int = 16, sample_rows: int = 20_000, block_rows: int = 2048,
    target_recall: float = 1.0,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their dimensions are
    equal, and their cosine is threshold or more. A vector that is null, empty,
    zero, or holds a null or non-finite component links with nothing, nor does
    one without a label or vec_id. Rows that repeat a vec_id count as vectors of
    their own. Numbers are read as floats or, of any other type, as doubles.
    Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast(f"array<{kind}>"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("good", good)
    nodes = written(
        rows.where("good").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
        .select("label", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("node"), "least", "n", "embedding"),
        "vector-nodes",
    )
    index = fit(nodes, threshold, codewords, cell_rows, sample_rows, target_recall)
    placed = written(
        nodes.select("label", "dim", "node", "n", "embedding").mapInArrow(_cells(index, float(np.sqrt(max(0.0, 2 - 2 * threshold)))), PLACED.format(kind)), "vector-cells"
    )
    counts = placed.groupBy("label", "dim", "first").agg(F.count_if(F.col("role") == 0).alias("b"), F.count_if(F.col("role") == 1).alias("q"))
    blocks = counts.where("b > 0").select(
        "label", "dim", "first", F.ceil(F.col("b") / block_rows).cast("int").alias("bs"), F.ceil(F.greatest("q", F.lit(1)) / block_rows).cast("int").alias("qs")
    )
    spread = lambda n, all_: F.when(F.col("role") == n, F.array(F.pmod(F.xxhash64("node"), F.col(all_)).cast("int"))).otherwise(F.sequence(F.lit(0), F.col(all_) - 1))
    dealt = placed.join(blocks, ["label", "dim", "first"]).withColumn("i", F.explode(spread(0, "bs"))).withColumn("j", F.explode(spread(1, "qs")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = written(
        dealt.select(*KEYS, "role", "node", "n", "home", "cells", "embedding").repartition(parts, *KEYS).sortWithinPartitions(*KEYS)
        .mapInArrow(_compare(threshold, {dim: b.width for dim, (b, _) in index.items()}), "u long, v long, links long"),
        "vector-links",
    )
    links = found.groupBy("u").agg(F.sum("links").alias("links"))
    comp = components(found.select("u", "v")).withColumnRenamed("node", "c_")
    table = written(
        nodes.join(links, nodes["node"] == links["u"], "left").join(comp, F.col("node") == F.col("c_"), "left")
        .select("label", "embedding", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("component")),
        "vector-table",
    )
    first = table.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = rows.where("good").join(table.join(first, "component"), ["label", "embedding"]).select("vec_id", F.col("links").alias("n_links"), "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(vec_id, reached) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.w FROM r JOIN l ON l.u = r.reached),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n ON n.u = c.vec_id
"""
