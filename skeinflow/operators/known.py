"""An index of stories that earlier days carried, for tables of any size.

New items probe it and are added to it, a batch at a time; nothing that is in it
is folded or compared again. It holds, batch by batch: under each key of
cluster.graph the least item of each side, the items that wait for another side,
the distinct word sets with their prefixes, and the links found. The links of all
batches connect the same items as one batch with everything would, so stories day
by day are those of all days at once.

What is rare, and the order of words by rarity, is frozen when the index is
created, for both depend on what is compared: counts of a corpus do for it.

A batch becomes part of the index when its last folder is written. One that was
broken off is not read, and the next one takes its number and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions import fixed
from skeinflow.functions import text as T
from skeinflow.operators import cluster, link
from skeinflow.operators.graph import components, delete, shared_path, written_at

PARTS = {
    "items": "id long, case string",
    "least": "k string, g string, own boolean, a long, b long",
    "waiting": "k string, g string, side boolean, id long",
    "members": "s string, id long, e array<string>, c string",
    "sets": "id string, t array<string>",
    "prefixes": "id string, n int, at int, w long, hot boolean, " + ", ".join(f"s{i} long" for i in range(link.SKETCH)),
    "pairs": "a string, b string",
    "links": "u long, v long",
    "done": "n long",
}
HOT = 1000


def background(items: DataFrame, share: int = 8) -> tuple[DataFrame, DataFrame]:
    """(k) of the phrases and names that more than max(3, rows / share) of the items have, and (w, n) of their words."""
    head = items.select(F.coalesce(F.when(F.col("title_en") != "", F.col("title_en")), F.col("title")).alias("t") if "title_en" in items.columns else F.col("title").alias("t"))
    keys = F.concat(F.transform(T.bigrams("t"), lambda b: F.concat(F.lit("b:"), b)), F.transform(T.propers("t"), lambda n: F.concat(F.lit("n:"), n)))
    most = F.greatest(F.lit(3), F.floor(F.lit(head.count()) / share))
    common = head.select(F.explode(keys).alias("k")).groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > most).select("k")
    return common, head.select(F.explode(T.tokens("t")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


class StoryIndex:
    """The index in a folder that all executors share.

    Items have id (long, unique in the index), title and what else cluster.features reads. An item whose id the index
    holds already is not added again and is known. A null title is an empty one; an empty batch changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, lexicon: cluster.Lexicon):
        self.spark, self.path, self.lexicon = spark, path.rstrip("/"), lexicon

    @classmethod
    def create(cls, spark: SparkSession, path: str, lexicon: cluster.Lexicon, common: DataFrame, words: DataFrame) -> StoryIndex:
        out = cls(spark, path, lexicon)
        common.select("k").distinct().write.parquet(f"{out.path}/background/common")
        words.select("w", F.col("n").cast("long").alias("n")).write.parquet(f"{out.path}/background/words")
        for part, schema in PARTS.items():
            spark.createDataFrame([], schema).withColumn("batch", F.lit(0)).limit(0).write.parquet(f"{out.path}/{part}/batch=0")
        return out

    def _read(self, part: str, before: int) -> DataFrame:
        whole = self.spark.read.schema(f"{PARTS[part]}, batch int").parquet(f"{self.path}/{part}")
        return whole.where(F.col("batch").between(1, before - 1)).drop("batch")

    def batches(self) -> int:
        """How many batches are in the index."""
        return self.spark.read.schema("n long, batch int").parquet(f"{self.path}/done").agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0]

    def _write(self, part: str, batch: int, rows: DataFrame) -> DataFrame:
        at = f"{self.path}/{part}/batch={batch}"
        rows.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(PARTS[part]).parquet(at)

    def add(self, items: DataFrame) -> DataFrame:
        """(id, known) of every item: whether its story has an item of an earlier batch. The items are part of the index then."""
        batch = self.batches() + 1
        case = F.when(F.col("case_ref") != "", F.col("case_ref")) if "case_ref" in items.columns else F.lit(None).cast("string")
        held = self._read("items", batch)
        # The rows are written first, so that what follows sees the same ones whatever the source does.
        at = shared_path(self.spark, "new-items")
        new = written_at(items.where("id IS NOT NULL").dropDuplicates(["id"]).join(held.select("id"), "id", "left_anti"), at)
        df = cluster.features(new, self.lexicon, common=self.spark.read.parquet(f"{self.path}/background/common")).withColumn("_case", case)
        told = ("_toks", "_names", "_ents", "_rare", "_phrases", "_jur", "_parties", "_states", "_stage", "_case")
        kinds_at = shared_path(self.spark, "new-kinds")
        rows = df.select("id", *[F.array_sort(c).alias(c) if c not in ("_stage", "_case") else F.col(c) for c in told])
        rows = written_at(rows.withColumn("_same", F.sha2(F.to_json(F.struct(*told)), 256)), kinds_at)
        first = rows.groupBy("_same").agg(F.min_by(F.struct("id", *told), "id").alias("x")).select("_same", "x.*")

        dealt_at = shared_path(self.spark, "new-meetings")
        dealt = written_at(self._dealt(first, batch), dealt_at)
        links = self._write("links", batch, self._links(rows, first, dealt, batch))
        comp = components(links)
        old = comp.join(new.select(F.col("id").alias("node")), "node", "left_anti").select("component").distinct().withColumn("_old", F.lit(True))
        met = new.select("id").join(comp, F.col("id") == F.col("node"), "left").join(old, "component", "left").select("id", F.coalesce("_old", F.lit(False)).alias("known"))
        again = items.select("id").join(held.select("id"), "id", "left_semi").distinct().select("id", F.lit(True).alias("known"))
        out = written_at(met.union(again), shared_path(self.spark, "known-items"))
        self._write("items", batch, rows.select("id", F.col("_case").alias("case")))
        self._write("done", batch, self.spark.range(1).select(F.lit(batch).cast("long").alias("n")))
        delete(self.spark, at, kinds_at, dealt_at)
        return out

    def _dealt(self, first: DataFrame, batch: int) -> DataFrame:
        """(id, k, g, side, own): the groups in which the batch's items meet others, and old items those of new sets."""
        none = F.array().cast("array<string>")
        keys, sides = cluster.meeting_keys()
        mark = lambda m, c: F.concat(F.lit(m), c)
        case = F.col("_case").alias("c")
        rows = first.select("id", F.explode(keys).alias("k"), F.col("_ents").alias("e"), F.col("_jur").alias("j"), case).withColumn("k", mark("m:", F.col("k")))
        rows = rows.union(first.select("id", F.explode(sides).alias("k"), none.alias("e"), none.alias("j"), case).withColumn("k", mark("p:", F.col("k"))))
        rows = rows.union(first.select("id", mark("s:", F.col("_same")).alias("k"), none.alias("e"), none.alias("j"), F.lit(None).cast("string").alias("c")))
        # Sets of words: new ones are compared with all, and their pairs are keys under which the items of both meet.
        own = first.where(F.size("_toks") > 0).select(F.sha1(F.array_join("_toks", " ")).alias("s"), "id", "_toks", F.col("_ents").alias("e"), case)
        self._write("members", batch, own.select("s", "id", "e", "c"))
        before = self._read("sets", batch)
        sets = self._write("sets", batch, own.groupBy("s").agg(F.any_value("_toks").alias("t")).select(F.col("s").alias("id"), "t").join(before.select("id"), "id", "left_anti"))
        words = self.spark.read.parquet(f"{self.path}/background/words")
        fresh = self._write("prefixes", batch, link.prefixes(sets, words, fixed.JACCARD_ALONE, HOT))
        met = link.meetings(fresh, self._read("prefixes", batch).union(fresh), fixed.JACCARD_ALONE)
        met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        every = before.union(sets)
        pairs = self._write("pairs", batch, link.alike(met, every, every, fixed.JACCARD_ALONE).select("a", "b"))
        named = lambda p: p.select(F.concat_ws(" ", "a", "b").alias("k"), F.explode(F.array("a", "b")).alias("s"))
        mine = own.select("s").distinct()
        for_new = named(self._read("pairs", batch).union(pairs)).join(mine, "s", "left_semi").union(mine.select(F.col("s").alias("k"), "s"))
        for_old = named(pairs).join(before.select(F.col("id").alias("s")), "s", "left_semi")
        shown = ["id", mark("w:", F.col("k")).alias("k"), F.col("e"), none.alias("j"), F.col("c")]
        rows = rows.union(own.join(for_new, "s").select(*shown)).union(self._read("members", batch).join(for_old, "s").select(*shown))
        lists = cluster._lists()
        return rows.withColumn("p", cluster._lacking(lists)).select("id", "k", F.inline(cluster.dealing(lists, range(8)))).distinct()

    def _links(self, rows: DataFrame, first: DataFrame, dealt: DataFrame, batch: int) -> DataFrame:
        new = dealt.groupBy("k", "g").agg(F.max("own").alias("own"), F.min(F.when(~F.col("side"), F.col("id"))).alias("a"), F.min(F.when(F.col("side"), F.col("id"))).alias("b"))
        touched = new.select("k", "g")
        old = self._read("least", batch).join(touched, ["k", "g"], "left_semi").groupBy("k", "g").agg(F.min("a").alias("oa"), F.min("b").alias("ob"))
        both = new.join(old, ["k", "g"], "left").select("k", "g", "own", "oa", "ob", F.least("a", "oa").alias("a"), F.least("b", "ob").alias("b"))
        at = shared_path(self.spark, "new-least")
        both = written_at(both, at)
        self._write("least", batch, both.select("k", "g", "own", "a", "b"))
        self._write("waiting", batch, dealt.where("not own").select("k", "g", "side", "id"))
        mine = dealt.drop("own").join(both, ["k", "g"]).select(F.when(F.col("own") | F.col("side"), F.col("a")).otherwise(F.col("b")).alias("u"), F.col("id").alias("v"))
        # The least ones of before stand for those that they are linked to already.
        firsts = both.select(F.explode(F.array(
            F.struct(F.when(F.col("own"), F.col("a")).otherwise(F.col("b")).alias("u"), F.col("oa").alias("v")), F.struct(F.col("a").alias("u"), F.col("ob").alias("v")),
        )).alias("l")).select("l.*")
        # Where one side was alone so far, nothing connects its items yet.
        met = both.where("not own and (oa is null) <> (ob is null) and a is not null and b is not null").select("k", "g", "a", "b")
        alone = self._read("waiting", batch).join(met, ["k", "g"]).select(F.when(F.col("side"), F.col("a")).otherwise(F.col("b")).alias("u"), F.col("id").alias("v"))
        same = rows.select("id", "_same").join(first.select("_same", F.col("id").alias("u")), "_same").select("u", F.col("id").alias("v"))
        every = mine.union(firsts).union(alone).union(same).where("u is not null and v is not null and u <> v")
        return every.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def stories(self) -> DataFrame:
        """(id, story) of all items, as cluster.graph gives them."""
        n = self.batches() + 1
        labelled = self._read("items", n).join(components(self._read("links", n)), F.col("id") == F.col("node"), "left").select("id", "case", F.coalesce("component", "id").alias("c"))
        return cluster.by_case(labelled)
