"""Days of an issue as a Spark data source that commits in two phases.

    spark.dataSource.register(DayStore)
    rows.write.format("daystore").mode("overwrite").option("path", folder).save()
    spark.read.format("daystore").option("path", folder).load()

A store is a folder that driver and executors share:

  data/<job>/      JSON lines, what the tasks of one write have staged.
  manifests/<n>    JSON: for each day its files, its number of rows and whether it was sent.

Tasks stage files of their own names; nothing is visible until the commit writes
the next manifest, under another name first and then moved into place. So a write
replaces whole days, all of its days or none, and one that is broken off leaves
the days as they were. A day that was sent is refused unless `force` is given. A
store has one writer at a time; of two that commit the same manifest number, one
is an error.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "day string, part string, place long, record string"


class Refused(ValueError):
    """A day that was sent is not written again."""


def _open(path: str) -> tuple[fs.FileSystem, str]:
    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store, at.rstrip("/")


def _text(store: fs.FileSystem, path: str) -> str:
    with store.open_input_stream(path) as f:
        return f.read().decode()


def _put(store: fs.FileSystem, path: str, text: str) -> None:
    with store.open_output_stream(path) as f:
        f.write(text.encode())


def manifest(path: str) -> tuple[int, dict[str, dict]]:
    """The number of the newest manifest and its days (day to files, rows, sent); 0 and no days for an empty store."""
    store, at = _open(path)
    found = [int(f.base_name) for f in store.get_file_info(fs.FileSelector(f"{at}/manifests", allow_not_found=True)) if f.base_name.isdigit()]
    return (n := max(found, default=0)), json.loads(_text(store, f"{at}/manifests/{n:09d}")) if n else {}


def _commit(path: str, after: int, days: dict[str, dict]) -> None:
    store, at = _open(path)
    store.create_dir(f"{at}/manifests")
    place, draft = f"{at}/manifests/{after + 1:09d}", f"{at}/manifests/draft-{uuid.uuid4().hex}"
    if store.get_file_info(place).type != fs.FileType.NotFound:
        raise RuntimeError("another write to the store was committed meanwhile")
    _put(store, draft, json.dumps(days, sort_keys=True))
    store.move(draft, place)


def mark_sent(path: str, day: str) -> None:
    """From now on the day is only written with force. A day that the store does not have is an error."""
    n, days = manifest(path)
    _commit(path, n, days | {day: days[day] | {"sent": True}})


def clear(path: str, first: str, last: str, force: bool = False) -> list[str]:
    """Takes the days of a range out of the store, all of them or, if one was sent and force is not given, none."""
    n, days = manifest(path)
    gone = [d for d in sorted(days) if first <= d <= last]
    _refuse(days, gone, force)
    if gone:
        _commit(path, n, {d: v for d, v in days.items() if d not in gone})
    return gone


def _refuse(days: dict[str, dict], touched: Iterable[str], force: bool) -> None:
    sent = [d for d in touched if days.get(d, {}).get("sent")]
    if sent and not force:
        raise Refused(f"sent already: {', '.join(sorted(sent))}; force writes it again")


class DayStore(DataSource):
    """Rows are (day, part, place, record): record is JSON, as issue.day_rows makes it. Options: path, force, and for
    reading day (one day) or none (all)."""

    @classmethod
    def name(cls) -> str:
        return "daystore"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return DayReader(self.options["path"], self.options.get("day"))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if not overwrite:
            raise ValueError("days are written whole: use mode('overwrite')")
        names = [f.name for f in schema]
        if sorted(names) != ["day", "part", "place", "record"]:
            raise ValueError(f"rows have day, part, place and record, not {names}")
        return DayWriter(self.options["path"], self.options.get("force", "false").lower() == "true")


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str, int]] = field(default_factory=list)  # day, file, rows


class DayWriter(DataSourceWriter):
    def __init__(self, path: str, force: bool):
        self.path, self.force, self.job = path, force, uuid.uuid4().hex
        self.after, self.days = manifest(path)

    def write(self, rows: Iterator) -> Staged:
        store, at = _open(self.path)
        store.create_dir(f"{at}/data/{self.job}")
        task = TaskContext.get()
        out, opened = Staged(), {}
        try:
            for r in rows:
                day = str(r["day"])
                dt.date.fromisoformat(day)
                if day not in opened:
                    name = f"data/{self.job}/{day}-{task.partitionId()}-{task.taskAttemptId()}.jsonl"
                    opened[day] = [store.open_output_stream(f"{at}/{name}"), name, 0]
                opened[day][0].write((json.dumps([r["part"], r["place"], r["record"]], ensure_ascii=False) + "\n").encode())
                opened[day][2] += 1
        finally:
            for f, _, _ in opened.values():
                f.close()
        out.files = [(day, name, n) for day, (_, name, n) in opened.items()]
        return out

    def commit(self, messages: list[Staged | None]) -> None:
        written: dict[str, dict] = {}
        for m in messages:
            for day, name, n in m.files if m else ():
                d = written.setdefault(day, {"files": [], "rows": 0, "sent": False})
                d["files"].append(name)
                d["rows"] += n
        _refuse(self.days, written, self.force)
        if written:
            _commit(self.path, self.after, self.days | written)

    def abort(self, messages: list[Staged | None]) -> None:
        store, at = _open(self.path)
        if store.get_file_info(f"{at}/data/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/data/{self.job}")


@dataclass
class DayPartition(InputPartition):
    day: str
    file: str


class DayReader(DataSourceReader):
    def __init__(self, path: str, day: str | None):
        self.path = path
        _, days = manifest(path)
        self.files = [DayPartition(d, f) for d, v in sorted(days.items()) if day in (None, d) for f in v["files"]]

    def partitions(self) -> list[DayPartition]:
        return self.files

    def read(self, p: DayPartition | None) -> Iterator[tuple]:
        if p is None:
            return
        store, at = _open(self.path)
        with store.open_input_stream(f"{at}/{p.file}") as f:
            rest = b""
            while chunk := f.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                for line in lines:
                    yield (p.day, *json.loads(line))


def vacuum(path: str) -> int:
    """Deletes staged files that the newest manifest does not name, and older manifests; how many files went. Not while
    a write or a read of an older manifest is under way."""
    store, at = _open(path)
    n, days = manifest(path)
    used = {f"{at}/{f}" for d in days.values() for f in d["files"]}
    files = [f.path for f in store.get_file_info(fs.FileSelector(f"{at}/data", recursive=True, allow_not_found=True)) if f.type == fs.FileType.File]
    old = [f.path for f in store.get_file_info(fs.FileSelector(f"{at}/manifests", allow_not_found=True)) if f.base_name != f"{n:09d}"]
    gone = [f for f in files if f not in used] + old
    for f in gone:
        store.delete_file(f)
    return len(gone)
