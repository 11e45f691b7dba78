"""Exact duplicates through a log-structured merge index of digests, in DataFrame functions only.

A document's normalised text is its text without ASCII white space; the index
key is that text's SHA-256. Rows go to a log, and from it in waves to the index:

  flush    The wave's rows are grouped by digest. A task of that shuffle is a memtable of about
           `memtable_rows` rows: it leaves one file sorted by digest, with Parquet's bloom filter. A wave
           has as many memtables as the shuffle has partitions, fewer if its rows don't fill them; its
           files are a run of level 0.
  filter   Each run has a blocked bloom filter: a digest sets PLACES bits in one block of BLOCK bits.
  lookup   A wave's digests are looked up in older runs only where a run's filter has their bits. What is
           found, and what a wave holds twice, is a hit.
  compact  `fanout` runs of a level are merged into one of the next, which keeps of each digest the
           longest original text and then the smallest identifier.

Hits (digests with more than one row) get byte verification: the least and the
greatest normalised text of a digest must be equal, and digests that fail are
grouped again by the text itself. Texts move only for hits and combine before
the shuffle, so a group with a third of all rows costs one row for each task.

An index stays where it is written: more documents are added by naming its path
again. `bits` cuts the digest, for tests that need collisions.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm.common import gathered, shared_path, written

MEMTABLE_ROWS, FANOUT, WAVES = 1 << 20, 4, 2
BLOCK, PLACES, BITS_A_KEY = 1 << 15, 4, 12  # BLOCK is what bitmap_construct_agg builds


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def _key(sha: Column, bits: int) -> Column:
    return F.substring(sha, 1, bits // 8) if bits % 8 == 0 else F.unhex(F.substring(F.hex(sha), 1, bits // 4))


def _points(text: str = "text") -> Column:
    return F.length(F.coalesce(text, F.lit(""))).cast("long")


def _best(batch: int) -> Column:
    """Least for the row that stays: most code points, then the smallest doc_id (null last), then the row that came first."""
    return F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", F.lit(batch).cast("long").alias("batch"), "row")


def log(docs: DataFrame, bits: int = 256, row: str | None = None) -> DataFrame:
    """(row, doc_id, sha, digest, points), written once. row numbers the rows of docs: its column of that name if given."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(number.alias("row"), F.col("doc_id").cast("long"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("sha"), _points().alias("points"))
    return written(rows, "digest-log").withColumn("digest", _key(F.col("sha"), bits))


# --- the index -----------------------------------------------------------------------------------------------

RUN = "run string, level int, rows long, blocks long"


def _merged(entries: DataFrame) -> DataFrame:
    return entries.groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("digest"), blocks)


def _places() -> Column:
    """The bits of a digest within its block."""
    h = F.xxhash64("digest", F.lit(1))
    return F.array(*[F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(BLOCK - 1).cast("long")) for i in range(PLACES)])


def add_run(spark: SparkSession, path: str, entries: DataFrame, level: int, most: int) -> tuple:
    """Writes a run, of `most` rows or so at most, and its filter; gives its line for the manifest."""
    name = shared_path(spark, "run").rsplit("/", 1)[1]
    (
        gathered(entries, most).sortWithinPartitions("digest").write.option("parquet.bloom.filter.enabled#digest", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true").parquet(f"{path}/{name}")
    )
    run = spark.read.parquet(f"{path}/{name}")
    rows = run.count()
    blocks = max(1, math.ceil(rows * BITS_A_KEY / BLOCK))
    bits = run.select(_block(F.lit(blocks)).alias("block"), F.explode(_places()).alias("place")).groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))
    gathered(bits, blocks * BLOCK // 512).withColumn("run", F.lit(name)).write.parquet(f"{path}/{name}-filter")
    return name, level, rows, blocks


def runs(spark: SparkSession, path: str) -> list[tuple]:
    """The live runs of an index, as its last manifest has them; none where there is no index."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return []
    lines = spark.read.parquet(f"{path}/manifest")
    last = lines.agg(F.max("version")).first()[0]
    return sorted(tuple(r)[1:] for r in lines.where(F.col("version") == last).collect())


def commit(spark: SparkSession, path: str, live: list[tuple], version: int) -> None:
    """Makes runs the live ones. Runs that a lost driver left behind without this are never read."""
    spark.createDataFrame([(version, *r) for r in live], f"version long, {RUN}").coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _rows(live: list[tuple]) -> int:
    return sum(rows for _, _, rows, _ in live)


def read_runs(spark: SparkSession, path: str, live: list[tuple]) -> DataFrame:
    return spark.read.parquet(*[f"{path}/{r[0]}" for r in live])


def maybe_known(spark: SparkSession, path: str, entries: DataFrame, live: list[tuple]) -> DataFrame:
    """The digests of entries whose bits are all set in a live run's filter: all known ones, and about one other in a hundred."""
    filters = spark.read.parquet(*[f"{path}/{r[0]}-filter" for r in live])
    asked = F.array(*[F.struct(F.lit(name).alias("run"), _block(F.lit(blocks)).alias("block")) for name, _, _, blocks in live])
    probes = entries.select("digest", F.inline(asked)).withColumn("places", _places())
    bit = lambda p: F.getbit(F.conv(F.hex(F.substr("bits", (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int"), (p % 8).cast("int")) == 1
    return probes.join(filters, ["run", "block"]).where(F.forall("places", bit)).select("digest").distinct()


def compact(spark: SparkSession, path: str, live: list[tuple], fanout: int) -> list[tuple]:
    """Merges runs while a level has `fanout` or more of them."""
    while True:
        by_level = {k: [r for r in live if r[1] == k] for k in {r[1] for r in live}}
        level = next((k for k in sorted(by_level) if len(by_level[k]) >= fanout), None)
        if level is None:
            return live
        merged = add_run(spark, path, _merged(read_runs(spark, path, by_level[level])), level + 1, _rows(by_level[level]))
        live = [*(r for r in live if r[1] != level), merged]


def ingest(rows: DataFrame, path: str, memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT) -> tuple[DataFrame, int]:
    """Adds a log to the index at path: (digest, best, n) of the log's digests that now stand for more than one row,
    and the batch's number."""
    spark = rows.sparkSession
    width = memtable_rows * int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = rows.count()
    waves = max(WAVES, math.ceil(total / width))
    live = runs(spark, path)
    version = 1 + (spark.read.parquet(f"{path}/manifest").agg(F.max("version")).first()[0] if live else 0)
    hits = []
    for wave in range(waves):
        mine = rows.where(F.pmod(F.xxhash64("row"), F.lit(waves)) == wave)
        entries = mine.groupBy("digest").agg(F.min(_best(version)).alias("best"), F.count("*").alias("n"))
        added = add_run(spark, path, entries, 0, math.ceil(total / waves))
        run = read_runs(spark, path, [added])
        found = [run.where("n > 1").select("digest")]
        if live:
            found.append(read_runs(spark, path, live).join(maybe_known(spark, path, run, live), "digest", "left_semi").select("digest"))
        hits.append(written(gathered(reduce(DataFrame.union, found).distinct(), _rows([added])), "digest-hits"))
        live = compact(spark, path, [*live, added], fanout)
        commit(spark, path, live, version + wave)
    known = reduce(DataFrame.union, hits).distinct()
    return written(gathered(_merged(read_runs(spark, path, live).join(known, "digest", "left_semi")), _rows(live)), "digest-level"), version


# --- duplicates ----------------------------------------------------------------------------------------------


def exact_duplicates(
    docs: DataFrame, bits: int = 256, row: str | None = None, path: str | None = None, earlier: DataFrame | None = None,
    memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT,
) -> DataFrame:
    """One row per row of docs: row, doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are one group, as are texts of white space only. Of
    rows that tie in length and doc_id too one stays; a null doc_id comes after
    all others, and its keep_id is null where it stays. kept is never null. An
    empty table gives no rows; columns but doc_id, text and `row` (a column that
    numbers the rows, if there is one) are not read.

    path: an index to add to; groups then count its earlier rows, and a new row
    is kept only if it beats them. earlier: the documents it holds, whose texts
    are verified as well; without them hits on them rest on the digest.
    """
    spark = docs.sparkSession
    rows = log(docs, bits, row)
    hits, batch = ingest(rows, path or shared_path(spark, "digest-index"), memtable_rows, fanout)

    asked = rows.join(hits.select("digest"), "digest", "left_semi").select(F.col("doc_id").alias("asked")).distinct()
    texts = docs.select("doc_id", "text") if earlier is None else docs.select("doc_id", "text").union(earlier.select("doc_id", "text"))
    texts = texts.select(F.col("doc_id").cast("long"), normalised(F.col("text")).alias("norm"))
    if earlier is None:
        texts = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("asked")), "left_semi")
    texts = texts.withColumn("sha", F.unhex(F.sha2("norm", 256))).withColumn("digest", _key(F.col("sha"), bits))
    checked = texts.groupBy("digest").agg((F.min("norm") == F.max("norm")).alias("same"))
    clash = written(checked.where("not same").select("digest"), "digest-clashes")

    stays = F.col("best").isNull() | ((F.col("best.batch") == batch) & (F.col("best.row") == F.col("row")))
    columns = ("row", "doc_id", "keep_id", "group_size", "kept", "text_sha256")

    def judged(r: DataFrame) -> DataFrame:
        return r.select(
            "row", "doc_id", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), stays.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
        )

    if not clash.head(1):
        return judged(rows.join(hits, "digest", "left")).select(*columns)
    # Different texts under one digest: the text is the key.
    apart = texts.join(clash, "digest", "left_semi").select(F.col("doc_id").alias("asked"), F.col("sha").alias("its"), "norm").distinct()
    own = rows.join(clash, "digest", "left_semi").join(apart, F.col("doc_id").eqNullSafe(F.col("asked")) & (F.col("sha") == F.col("its"))).drop("asked", "its")
    groups = own.groupBy("norm").agg(F.min(_best(batch)).alias("best"), F.count("*").alias("n"))
    rest = rows.join(clash, "digest", "left_anti").join(hits, "digest", "left")
    return judged(rest).unionByName(judged(own.join(groups, "norm"))).select(*columns)


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the rows of which an equal one stays. The rows are numbered in a written copy, so that each
    stays or goes by itself where a doc_id comes twice."""
    number = "row_"
    while number in docs.columns:
        number += "_"
    numbered = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    gone = exact_duplicates(numbered, row=number).where("not kept").select(F.col("row").alias(number))
    return numbered.join(gone, number, "left_anti").select(*docs.columns)


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
