"""The commonest values of arrays (n-grams, openings) in two passes.

The first pass keeps a bounded summary in each task: counts of which the least
are subtracted from all and dropped when there are too many, so a count is too
low by at most what was subtracted. Summaries add up, and bound every count from
both sides; only values that can be among the commonest are counted exactly in
the second pass. The n-grams themselves are never shuffled as a whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.functions.text import bound
from skeinflow.operators.graph import delete, shared_path, written_at

MOST_SENT = 1_000_000  # candidates of the second pass that are sent to every task


def ngrams(words: Column, n: int) -> Column:
    """The runs of n of an array's words, joined by spaces; none of fewer."""

    def runs(w: Column) -> Column:
        run = lambda x, i: F.array_join(F.slice(w, i + 1, n), " ")
        return F.when(F.size(w) >= n, F.transform(F.slice(w, 1, F.greatest(F.size(w) - n + 1, F.lit(1))), run)).otherwise(F.array().cast("array<string>"))

    return bound(words, runs)


def trimmed(held: Counter, counters: int) -> int:
    """Subtracts the count of the value after the first `counters` from all and drops what is left with none; gives that count."""
    if len(held) <= counters:
        return 0
    cut = sorted(held.values(), reverse=True)[counters]
    for value, n in list(held.items()):
        if n <= cut:
            del held[value]
        else:
            held[value] = n - cut
    return cut


CHUNK = 1 << 18  # runs that are made at a time


def runs_of(lists: pa.ListArray, n: int) -> Iterator[pa.Array]:
    """The runs of n of each array's words as ngrams() makes them, some at a time."""
    words, row = lists.flatten(), pc.list_parent_indices(lists)
    for at in range(0, len(words) - n + 1, CHUNK):
        size = min(CHUNK, len(words) - n + 1 - at)
        if n == 1:
            yield words.slice(at, size)
            continue
        whole = pc.equal(row.slice(at, size), row.slice(at + n - 1, size))
        yield pc.binary_join_element_wise(*[words.slice(at + i, size).filter(whole) for i in range(n)], " ", null_handling="skip")


def _exact(chosen: list[str], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        for b in batches:
            for runs in runs_of(b.column(0), n):
                found = pc.value_counts(runs.filter(pc.is_in(runs, value_set=pa.array(chosen, runs.type))))
                held.update(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["value", "n"])

    return run


def _summary(counters: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lost = Counter(), 0
        for b in batches:
            for runs in runs_of(b.column(0), n):
                found = pc.value_counts(runs.drop_null())
                values, counts = found.field("values"), found.field("counts")
                if len(counts) > counters:  # trimmed as below, before anything is taken out of the block
                    cut = int(np.partition(counts.to_numpy(), -counters - 1)[-counters - 1])
                    most = pc.greater(counts, cut)
                    values, counts = values.filter(most), pc.subtract(counts.filter(most), cut)
                    lost += cut
                held.update(dict(zip(values.to_pylist(), counts.to_pylist(), strict=True)))
                if len(held) > 4 * counters:
                    lost += trimmed(held, counters)
        values = [None, *held]
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array([lost, *held.values()], pa.int64())], names=["value", "n"])

    return run


MOST_NAMED = 10_000  # candidates that go along with the second pass's function, which counts them without a join


def commonest(df: DataFrame, values: Column, most: int, counters: int = 20_000, most_counters: int = 1 << 20, run: int = 1) -> DataFrame:
    """(value, n): the `most` commonest values in the arrays of all rows, each as often as it stands there, with exact
    counts; ties go to the smaller value. Null arrays and null values count nothing. With `run`, not the values but
    their runs of that length (see ngrams()) are counted, which are made in blocks where they are counted.

    Where the summaries don't settle which values can be among them, they are made again with eight times the
    counters, and beyond most_counters all values are counted in one full exchange.
    """
    spark = df.sparkSession
    rows = df.select(F.coalesce(values, F.array().cast("array<string>")).alias("values"))
    each = rows.select(F.explode("values" if run == 1 else ngrams(F.col("values"), run)).alias("value"))
    while counters <= most_counters:
        at = shared_path(spark, "summaries")
        held = written_at(rows.mapInArrow(_summary(counters, run), "value string, n long").groupBy("value").agg(F.sum("n").alias("n")), at)
        lost = held.where("value IS NULL").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        top = held.where("value IS NOT NULL").orderBy(F.desc("n")).limit(most).agg(F.count("*").alias("rows"), F.min("n").alias("least")).first()
        least = top["least"] if top["rows"] == most else 0
        if lost == 0 or lost < least:
            # A value that can be among them has at least so much in the summaries; one that is in none has at most `lost`.
            chosen = held.where(F.col("value").isNotNull() & (F.col("n") + lost >= least)).select("value")
            some = chosen.limit(MOST_SENT + 1).count()
            if some <= min(MOST_NAMED, MOST_SENT):
                counted = rows.mapInArrow(_exact([r["value"] for r in chosen.collect()], run), "value string, n long").groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(most)
            else:
                counted = _counted(each.join(F.broadcast(chosen) if some <= MOST_SENT else chosen, "value", "left_semi"), most)
            out = written_at(counted, shared_path(spark, "commonest"))
            delete(spark, at)
            return out
        delete(spark, at)
        counters *= 8
    return _counted(each.where("value IS NOT NULL"), most)


def _counted(each: DataFrame, most: int) -> DataFrame:
    return each.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)
