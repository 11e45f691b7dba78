"""Primary records behind reports, over loaded tables: dockets, opinions, judgments.

A report asks for its parties; a record answers with the name of its case and a
day. Both meet under the rarest word of the rarest party, within buckets of days,
so the join is on equal keys and grows with what a rare word has. What meets is
then held against the full rule, and the first by rank is the report's record.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.operators.gazetteer import Gazetteer, parties_named
from skeinflow.operators.graph import delete, shared_path, written_at


@dataclass(frozen=True)
class Band:
    """Days before and after the report in which a record counts; the days of the narrower band, if any, in which one
    State may carry the match; and whether the parties are asked for one after the other, in place of all at once."""

    before: int
    after: int = 3
    tight: int | None = None
    one_by_one: bool = False


# The bands of the three kinds of records.
DOCKETS, OPINIONS, JUDGMENTS = Band(4 * 365), Band(45, tight=14), Band(30, one_by_one=True)
#: How many parties are asked for, and how many may carry the match.
ASKED, CARRYING = 3, 4
UNDATED = -(1 << 40)


def phrase(c: Column) -> Column:
    """A text as lower-case words between single spaces, one before and one after, so that whole words can be looked for."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def _words(phrased: Column) -> Column:
    return F.array_distinct(F.split(F.trim(phrased), " "))


def _day(c: str) -> Column:
    return F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("long")


def match(reports: DataFrame, records: DataFrame, gazetteer: Gazetteer, band: Band, today: Column | None = None) -> DataFrame:
    """(id, record): the best record of each report that has one.

    reports (id, names array<string>, day date), records (record, title, day date). The first three names that are not
    null or blank must stand in the title as whole words, a State under any of its forms of three letters or more; or,
    with `one_by_one`, one of them, the first that finds a record deciding. The title must carry the parties as in
    `parties_named`, by the first four names. A record without a day is in every band; a report without one is taken as
    of `today` (the current date by default). Of several records the newest comes first, undated ones last, then the
    least record. Reports that repeat an id are one report for the purpose of the result; rows of records with a null
    record or title match nothing.
    """
    return match_each(reports, records, gazetteer, {"": band}, today)[""]


def match_each(reports: DataFrame, records: DataFrame, gazetteer: Gazetteer, bands: dict[str, Band], today: Column | None = None) -> dict[str, DataFrame]:
    """match() in each of several bands; the words of the records are taken apart once for all of them."""
    spark = reports.sparkSession
    report_at, entry_at = shared_path(spark, "reports"), shared_path(spark, "case-words")
    names = F.slice(F.filter(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.trim(F.regexp_replace(n, r"[^\p{L}\p{N}]+", "")) != ""), 1, CARRYING)
    asked = reports.select("id", names.alias("names"), F.coalesce(_day("day"), F.datediff(today if today is not None else F.current_date(), F.lit("1970-01-01").cast("date"))).cast("long").alias("at"))
    asked = asked.where("id IS NOT NULL AND size(names) > 0").withColumn("known", gazetteer.known(F.col("names"))).withColumn("forms", gazetteer.forms_of(F.col("known")))
    alone = F.zip_with("names", "forms", lambda n, f: F.when(F.size(f) > 0, F.filter(f, lambda x: F.length(x) >= 3)).otherwise(F.array(n)))
    asked = asked.withColumn("row", F.monotonically_increasing_id()).withColumn("phrases", F.transform(F.slice(alone, 1, ASKED), lambda forms: F.array_distinct(F.transform(forms, phrase))))
    asked = written_at(asked.drop("forms"), report_at)

    # What the reports ask for: a name by its place, each of its forms by its words.
    each = asked.select("row", "at", F.posexplode("phrases").alias("no", "forms")).select("row", "at", "no", F.posexplode("forms").alias("form", "phrase"))
    words = each.select("row", "at", "no", "form", F.explode(_words(F.col("phrase"))).alias("word"))
    wanted = words.select("word").distinct()
    held = records.where("record IS NOT NULL AND title IS NOT NULL").select("record", "title", _day("day").alias("filed"))
    entries = held.select("record", "filed", F.explode(_words(phrase(F.col("title")))).alias("word"))
    entries = written_at(entries.join(wanted, "word", "left_semi"), entry_at)
    df = entries.groupBy("word").agg(F.count("*").alias("n"))

    # Of each form the rarest word, of each report the name whose forms have the fewest records; a word that no record has can't be met.
    rarest = words.join(df, "word", "left").groupBy("row", "at", "no", "form").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("key"))
    by_name = rarest.groupBy("row", "at", "no").agg(F.sum("key.n").alias("n"), F.collect_set("key.word").alias("words"))
    found = {k: written_at(_matched(band, by_name, entries, asked, held, gazetteer), shared_path(spark, "matched")) for k, band in bands.items()}
    delete(spark, report_at, entry_at)
    return found


def _matched(band: Band, by_name: DataFrame, entries: DataFrame, asked: DataFrame, held: DataFrame, gazetteer: Gazetteer) -> DataFrame:
    if not band.one_by_one:
        by_name = by_name.groupBy("row", "at").agg(F.min(F.struct("n", "no", "words")).alias("best")).select("row", "at", "best.*")
    width = band.before + band.after + 1
    bucket = F.coalesce(F.floor(F.col("filed") / width), F.lit(UNDATED))
    buckets = F.concat(F.sequence(F.floor((F.col("at") - band.before) / width), F.floor((F.col("at") + band.after) / width)), F.array(F.lit(UNDATED)))
    keys = by_name.where("n > 0").withColumn("word", F.explode("words")).withColumn("bucket", F.explode(buckets)).select("row", "no", "word", "bucket")
    met = keys.join(entries.select("record", "word", bucket.alias("bucket")), ["word", "bucket"]).select("row", "no", "record").distinct()

    pairs = met.join(asked, "row").join(held, "record")
    in_band = lambda days: F.col("filed").between(F.col("at") - days, F.col("at") + band.after)
    stands = lambda forms: F.exists(forms, lambda f: F.contains(F.col("_title"), f))
    pairs = pairs.where(F.col("filed").isNull() | in_band(band.before)).withColumn("_title", phrase(F.col("title")))
    pairs = pairs.where(stands(F.get("phrases", "no")) if band.one_by_one else F.forall("phrases", stands))
    tight = F.coalesce(in_band(band.tight), F.lit(False)) if band.tight is not None else None
    pairs = pairs.withColumn("_mentioned", gazetteer.mentions("title"))
    pairs = pairs.where(parties_named(F.col("names"), F.col("known"), F.col("_mentioned"), F.col("title"), tight=tight))
    place = F.struct((F.col("no") if band.one_by_one else F.lit(0)).alias("no"), F.coalesce(-F.col("filed"), F.lit(1 << 40)).alias("age"), "record")
    return pairs.groupBy("id").agg(F.min(place).alias("best")).select("id", "best.record")
