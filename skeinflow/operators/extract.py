"""The seam for extractors outside Spark (models, services): rows in chunks, failures passed through."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructType

TRIAGE, EXTRACT, EDIT = 20, 1, 8  # rows of a call at the three stages


def extracted(
    rows: DataFrame, call: Callable[[list[dict]], list[dict | None]], size: int, done: str, failed: str, attempts: int = 2, stage: str = "llm_stage", answer: str = "answer"
) -> DataFrame:
    """rows with stage, answer (JSON, null where there is none) and attempts.

    call gets chunks of `size` rows as dicts, formed across the ends of batches within a partition (the last one of a
    partition may be smaller), and gives an answer for each row, in order; None refuses a row. A chunk whose call raises
    or gives another number of answers is tried again, up to `attempts` times; then its rows pass through with stage
    `failed`. Refused rows have stage `failed` too, all others `done`. Columns named as the three are replaced. A task
    that is lost runs its calls again, so they must bear that.
    """
    rows = rows.drop(stage, answer, "attempts")
    schema = StructType([*rows.schema.fields]).add(stage, StringType()).add(answer, StringType()).add("attempts", LongType())
    arrow = to_arrow_schema(schema)

    def answered(chunk: list[dict]) -> pa.RecordBatch:
        answers, tries = None, 0
        while answers is None and tries < attempts:
            tries += 1
            try:
                got = call([dict(r) for r in chunk])
                answers = got if len(got) == len(chunk) else None
            except Exception:  # noqa: BLE001 - whatever the extractor does, the rows go on
                answers = None
        out = [
            r | {stage: failed if a is None else done, answer: None if a is None else json.dumps(a, ensure_ascii=False, default=str), "attempts": tries}
            for r, a in zip(chunk, answers or [None] * len(chunk), strict=True)
        ]
        return pa.RecordBatch.from_pylist(out, arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []
        for b in batches:
            for at in range(0, b.num_rows, size):
                waiting += b.slice(at, size).to_pylist()
                while len(waiting) >= size:
                    yield answered(waiting[:size])
                    del waiting[:size]
        if waiting:
            yield answered(waiting)

    return rows.mapInArrow(run, schema)


def counted(rows: DataFrame, stage: str = "llm_stage") -> DataFrame:
    """(stage, rows, attempts): how the calls went."""
    return rows.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("rows"), F.sum("attempts").alias("attempts"))
