"""Fetched payloads as a Spark data source: one partition for each origin.

    spark.dataSource.register(Origins)
    df = spark.read.format("origins").option("list", json.dumps([{"name": ..., "location": ..., ...}])).load()

A row is an origin with its payload, as sources.payloads and sources.courts read
it. An origin that can't be read is no failure of the job: its row has a null
payload and says why, so failures() counts them, and the others are read.
Executors read the locations themselves: files and folders by path or URI of any
store that Arrow opens; a folder gives a row for each of its files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "name string, format string, source string, country string, lang string, event_type string, what string, query string, place int, location string, payload string, failure string"
_TOLD = ("name", "format", "source", "country", "lang", "event_type", "what", "query")


@dataclass
class Origin(InputPartition):
    place: int
    told: tuple
    location: str
    most_bytes: int


class Origins(DataSource):
    """Options: list, a JSON list of origins with location and any of name, format, source, country, lang, event_type, what
    and query (name is the location by default); most_bytes, beyond which a payload is refused (64 MB)."""

    @classmethod
    def name(cls) -> str:
        return "origins"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return OriginReader(json.loads(self.options["list"]), int(self.options.get("most_bytes", 64 << 20)))


class OriginReader(DataSourceReader):
    def __init__(self, origins: list[dict], most_bytes: int):
        unknown = {k for o in origins for k in o} - {*_TOLD, "location"}
        if unknown:
            raise ValueError(f"origins don't have {sorted(unknown)}")
        self.origins, self.most_bytes = origins, most_bytes

    def partitions(self) -> list[Origin]:
        return [Origin(i, tuple({"name": o.get("location"), **o}.get(k) for k in _TOLD), o.get("location") or "", self.most_bytes) for i, o in enumerate(self.origins)]

    def read(self, origin: Origin) -> Iterator[tuple]:
        if origin is None:  # an empty list of origins has one partition without any
            return
        try:
            for location, payload in _payloads(origin.location, origin.most_bytes):
                yield (*origin.told, origin.place, location, payload, None)
        except Exception as e:  # noqa: BLE001 - whatever an origin does, the others are read
            yield (*origin.told, origin.place, origin.location, None, f"{type(e).__name__}: {e}"[:300])


def _payloads(location: str, most_bytes: int) -> Iterator[tuple[str, str]]:
    store, path = fs.FileSystem.from_uri(location) if "://" in location else (fs.LocalFileSystem(), location)
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound or not path:
        raise FileNotFoundError(location)
    if info.type == fs.FileType.Directory:
        files = sorted((f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File), key=lambda f: f.path)
    else:
        files = [info]
    for f in files:
        if f.size > most_bytes:
            raise ValueError(f"{f.path} has {f.size} bytes, more than {most_bytes}")
        with store.open_input_stream(f.path, compression=None) as stream:
            yield f.path, stream.read().decode("utf-8", "strict").removeprefix("﻿")


def failures(read: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(name, failed, reason): of each origin how often it failed and the first reason. found (name) are the rows parsed
    from the payloads, if given: an origin that was read and of which none came has failed by giving nothing."""
    failed = read.groupBy("name").agg(F.count_if(F.col("failure").isNotNull()).alias("failed"), F.min("failure").alias("reason"))
    if found is not None:
        failed = failed.join(found.select("name").distinct().withColumn("_has", F.lit(True)), "name", "left")
        nothing = (F.col("failed") == 0) & F.col("_has").isNull()
        failed = failed.select("name", F.when(nothing, 1).otherwise(F.col("failed")).alias("failed"), F.when(nothing, "no rows").otherwise(F.col("reason")).alias("reason"))
    return failed.where("failed > 0").select("name", F.col("failed").cast("long").alias("failed"), "reason")
