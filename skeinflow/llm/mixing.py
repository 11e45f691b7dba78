"""Mixing sources to target weights by Poisson replication.

A source with weight w, of all weights W, should make up w / W of the mixture.
Each of its documents is repeated a Poisson number of times whose mean is the
source's target rows over its own rows; the number comes from inverting the
distribution at a uniform value hashed from seed and doc_id, so a document's
count never depends on where it is read. A mean above MOST_MEAN is dealt out to
several Poisson variables of equal mean, each with a uniform value of its own:
their sum has the same distribution. Copies are then shuffled over the whole
mixture by another hash: sorted by it, in ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.functions.text import bound
from skeinflow.llm.common import written

SEED = 42
MOST_MEAN = 500.0  # exp(-mean) and the inverted sums are exact enough below it
BLOCK = 4096  # copies that are made at a time
MOST_SENT = 4096  # sources whose rates are sent to every task, a row of at most some 10 KB each


def uniform(*parts: Column | str) -> Column:
    """In [0, 1), from the first 13 hexadecimal digits of the MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_cdf(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... as an array, to where the rest is below what a double can tell."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    step = lambda a, k: F.struct(
        (a["p"] * mean / k).alias("p"), (a["c"] + a["p"] * mean / k).alias("c"), F.concat(a["all"], F.array(a["c"] + a["p"] * mean / k)).alias("all")
    )
    first = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), last), first, step, lambda a: a["all"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0) -> DataFrame:
    """(source, rate, variables): the mean repetitions of a document of each source, and the number of Poisson variables they are the sum of.

    weights: by source; sources that it lacks get weight 0, and without it all
    sources weigh the same. size: rows of the mixture over rows of docs.
    Documents without a source are the source of that name, null. No rows, or
    weights that are all 0 for the sources there are, give no copies.
    """
    by = docs.groupBy("source").agg(F.count("*").alias("rows"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, w in sorted(weights.items()):
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    by = written(by.withColumn("weight", weight), "source-counts")
    total = by.agg(F.sum("weight").alias("weight"), F.sum("rows").alias("rows")).first()
    rate = F.col("weight") / F.lit(total["weight"] or 1.0) * F.lit((total["rows"] or 0) * size) / F.col("rows")
    return by.select("source", rate.alias("rate")).withColumn("variables", F.greatest(F.ceil(F.col("rate") / MOST_MEAN), F.lit(1)).cast("int"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, seed: int = SEED, shuffle: bool = True) -> DataFrame:
    """docs with each document repeated, plus copy (0, 1, ...) and place (the shuffle's hash, ascending).

    Rows whose count is 0 go, which is what the weights ask for. Repeated rows
    of one doc_id get the same count, as do rows without one. Columns of docs
    named copy or place are replaced; all others stay as they are, whatever they are called.
    """
    docs = docs.drop("copy", "place")
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        while name.lower() in taken:
            name += "_"
        return name

    # The names of the working columns are none of docs.
    source, cdf, variables, n, block = (free(x) for x in ("source_", "cdf", "variables", "n", "block_"))
    table = rates(docs, weights, size)
    table = table.select(F.col("source").alias(source), poisson_cdf(F.col("rate") / F.col("variables")).alias(cdf), F.col("variables").alias(variables))
    table = written(table, "source-rates")
    # A source may hold a third of all rows. Up to MOST_SENT sources the documents stay where they are; beyond
    # that they are joined by source, and Spark splits the skewed ones.
    if table.limit(MOST_SENT + 1).count() <= MOST_SENT:
        table = F.broadcast(table)
    joined = docs.join(table, F.col("source").eqNullSafe(F.col(source)))
    own = F.col("doc_id").cast("string")

    def count(j: Column | None = None) -> Column:
        u = uniform(F.lit(f"count-{seed}"), own, *([] if j is None else [j.cast("string")]))
        return bound(u, lambda x: F.size(F.filter(cdf, lambda c: c <= x)))

    more = F.aggregate(F.sequence(F.lit(1), F.col(variables) - 1), F.lit(0), lambda sum_, j: sum_ + count(j))
    copies = count() + F.when(F.col(variables) > 1, more).otherwise(0)
    out = (
        joined.withColumn(n, copies).where(F.col(n) > 0)
        .withColumn(block, F.explode(F.sequence(F.lit(0), ((F.col(n) - 1) / BLOCK).cast("int"))))
        .withColumn("copy", F.explode(F.sequence(F.col(block) * BLOCK, F.least(F.col(block) * BLOCK + BLOCK, F.col(n)) - 1)))
        .withColumn("place", uniform(F.lit(f"place-{seed}"), own, F.col("copy").cast("string")))
        .select(*docs.columns, "copy", "place")
    )
    if not shuffle:
        return out
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # place is uniform, so even ranges of it are known without a sample of the rows.
    return out.repartitionById(parts, F.floor(F.col("place") * parts).cast("int")).sortWithinPartitions("place", "doc_id")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "source", "copy", "place", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP7_SQL = r"""
WITH RECURSIVE s AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
t AS (SELECT source, 1.0::DOUBLE / (sum(1.0::DOUBLE) OVER ()) * ((sum(n) OVER ()) * 1.0::DOUBLE) / n AS total FROM s),
r AS (SELECT source, greatest(ceil(total / 500.0::DOUBLE), 1)::INTEGER AS variables, total / greatest(ceil(total / 500.0::DOUBLE), 1) AS rate FROM t),
c(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM c WHERE k < ceil(rate + 12 * sqrt(rate) + 40)),
d AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
v AS (SELECT d.*, unnest(range(0, r.variables)) AS j FROM d JOIN r ON r.source IS NOT DISTINCT FROM d.source),
u AS (SELECT doc_id, source, text_sha256,
        ('0x' || substr(md5('count-42:' || doc_id::VARCHAR || CASE WHEN j > 0 THEN ':' || j::VARCHAR ELSE '' END), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
      FROM v),
n AS (SELECT doc_id, source, text_sha256, sum((SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND c.c <= u.u)) AS n FROM u GROUP BY ALL),
x AS (SELECT doc_id, source, text_sha256, unnest(range(0, n::BIGINT))::INTEGER AS copy FROM n WHERE n > 0)
SELECT doc_id, source, copy,
       ('0x' || substr(md5('place-42:' || doc_id::VARCHAR || ':' || copy::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS place,
       text_sha256
FROM x
"""
