"""WARC archives written and read as tables of chunks.

A payload of any size travels as rows (record, chunk number, bytes). The writer
takes the rows of a partition in order and appends them to its archive, so it
holds one chunk at a time and hashes as it goes; the reader gives the rows back
from the archive's stream, each with the SHA-1 of the payload so far. Of pages
with equal payloads the one with the smallest page_id is written as response,
the others as revisit records that refer to it and carry no payload.

Archives are files `part-<partition>-<attempt>-<number>.warc.gz`, each record a
gzip member of its own. Every attempt of a task writes files of its own names,
and only those of the attempt that Spark takes are listed, so a task that runs
twice or is lost leaves no file half replaced; what is not listed is never
read. They go through pyarrow's file systems, so the folder may be any that
those reach from all executors.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm.common import shared_path, written

CHUNK = 1 << 18
FILE_BYTES = 64 << 20
DATE = "2020-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunks(pages: DataFrame, min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Rows to write: page_id, repeated (another row has that page_id, or it is null), url, sha1 (hexadecimal),
    payload_bytes, first (page_id of the response, null for a response), chunk_no, chunks, data. Revisits have one row, without data.

    Null html is an empty payload. Payloads of fewer than min_bytes are always
    responses. Rows that repeat a page_id with the same payload are alike; one
    without a page_id is a response. Other columns are not read.
    """
    body = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    body = body.withColumn("sha1", F.sha1("payload")).withColumn("payload_bytes", F.length("payload").cast("long"))
    # A digest that a third of all pages share is one row for each task before the shuffle; the join back
    # on it carries no payload, and Spark splits it.
    light = written(body.select("page_id", "sha1", "payload_bytes"), "warc-digests")
    first = light.where(F.col("payload_bytes") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"))
    twice = light.groupBy("page_id").agg(F.count("*").alias("rows")).where("rows > 1").select("page_id", F.lit(True).alias("repeated"))
    own = light.join(first, "sha1", "left").join(twice, "page_id", "left")
    later = F.when((F.col("page_id") != F.col("first")) & (F.col("payload_bytes") >= min_bytes), F.col("first"))
    # Only pages that these say something of; the payloads move once, for the join with them.
    marks = own.select("page_id", "sha1", later.alias("first"), "repeated").where("first IS NOT NULL OR repeated").distinct()
    rows = body.join(marks, ["page_id", "sha1"], "left").withColumn("repeated", F.coalesce("repeated", F.col("page_id").isNull()))
    n = F.when(F.col("first").isNotNull(), 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / chunk))).cast("int")
    rows = rows.withColumn("chunks", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    data = F.when(F.col("first").isNull(), F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk)))
    return rows.select("page_id", "repeated", "url", "sha1", "payload_bytes", "first", "chunk_no", "chunks", data.alias("data"))


def _base32(sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1)).decode()


def _head(page: int | None, own: str, url: str | None, sha1: str, size: int, first: int | None, date: str) -> bytes:
    """Headers of a record up to its payload: WARC's, then HTTP's. own: what tells apart records of one page_id."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    uri = re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "about:blank"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page}{own}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{_base32(sha1)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (size if first is None else 0)}",
    ]
    if first is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{first}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _writer(folder: str, date: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out = name = gz = sha = None
        files, records, size = 0, 0, 0
        done = []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((name, records, size))
            out = None

        for batch in batches:
            for i in range(batch.num_rows):
                page, repeated, url, sha1, total, first, no, last, data = (c[i].as_py() for c in batch.columns)
                if no == 0:
                    if out is not None and size >= file_bytes:
                        close()
                    if out is None:
                        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{files:04d}.warc.gz"
                        out, files, records, size = store.open_output_stream(f"{root}/{name}", compression=None), files + 1, 0, 0
                    gz, sha = zlib.compressobj(1, wbits=31), hashlib.sha1(usedforsecurity=False)
                    records += 1
                    own = f":{task.partitionId()}-{files}-{records}" if repeated else ""
                    size += out.write(gz.compress(_head(page, own, url, sha1, total, first, date)))
                if data:
                    sha.update(data)
                    size += out.write(gz.compress(data))
                if no == last - 1:
                    if first is None and sha.hexdigest() != sha1:
                        raise ValueError(f"the chunks of page {page} are not its payload")
                    size += out.write(gz.compress(b"\r\n\r\n") + gz.flush())
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["file", "records", "bytes"])

    return run


def write(pages: DataFrame, folder: str, min_bytes: int = 0, chunk: int = CHUNK, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Writes archives under folder, a path that all executors share; returns (file, records, bytes)."""
    # A page's chunks come from one row, so they stand together and in order wherever Spark puts it.
    rows = chunks(pages, min_bytes, chunk)
    return written(rows.mapInArrow(_writer(folder, date, file_bytes), "file string, records long, bytes long"), "warc-files")


class _Stream:
    """Bytes of an archive, gzip or plain, as lines and as pieces of bounded size."""

    def __init__(self, source):
        self.source, self.kept, self.gz, self.raw = source, b"", None, b""
        self.zipped = None

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(1 << 16)
        if self.zipped is None:
            self.zipped = self.raw[:2] == b"\x1f\x8b"
        if not self.raw:
            return False
        if not self.zipped:
            self.kept, self.raw = self.kept + self.raw, b""
            return True
        if self.gz is None:
            self.gz = zlib.decompressobj(wbits=31)
        self.kept += self.gz.decompress(self.raw, 1 << 18)
        self.raw = self.gz.unconsumed_tail
        if self.gz.eof:
            self.raw, self.gz = self.gz.unused_data, None
        return True

    def line(self) -> bytes | None:
        while (k := self.kept.find(b"\n")) < 0:
            if not self._more():
                return None
        out, self.kept = self.kept[: k + 1], self.kept[k + 1 :]
        return out

    def piece(self, most: int) -> bytes:
        while not self.kept:
            if not self._more():
                raise ValueError("an archive ends within a record")
        out, self.kept = self.kept[:most], self.kept[most:]
        return out


def _headers(stream: _Stream) -> tuple[dict[str, str], int]:
    out, read = {}, 0
    while (line := stream.line()) is not None:
        read += len(line)
        if not line.strip():
            return out, read
        key, _, value = line.decode("utf-8", "replace").partition(":")
        out[key.strip().lower()] = value.strip()
    raise ValueError("an archive ends within headers")


def records(stream: _Stream, chunk: int = CHUNK) -> Iterator[tuple]:
    """(record_id, refers_to, type, uri, declared digest, payload bytes, chunk_no, last, digest so far, data)."""
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        head, _ = _headers(stream)
        left = int(head["content-length"])
        kind = head["warc-type"].lower()
        declared = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        of = (head["warc-record-id"].strip("<>"), head.get("warc-refers-to", "").strip("<>") or None, kind, head.get("warc-target-uri"), declared)
        size = None
        if head.get("content-type", "").startswith("application/http") and left:
            status = stream.line()
            http, n = _headers(stream)
            left -= len(status) + n
            size = int(http["content-length"]) if "content-length" in http else None
        size = left if size is None or kind != "revisit" else size
        sha, no = hashlib.sha1(usedforsecurity=False), 0
        while True:
            parts, want = [], min(chunk, left)
            while want:
                parts.append(stream.piece(want))
                want -= len(parts[-1])
            data = b"".join(parts)
            left -= len(data)
            sha.update(data)
            digest = base64.b32encode(sha.digest()).decode()
            if not left and kind != "revisit" and declared and digest != declared:
                raise ValueError(f"the payload of {of[0]} does not have its digest")
            yield (*of, size, no, left == 0, digest, data)
            no += 1
            if not left:
                break


READ = "record_id string, refers_to string, type string, uri string, declared string, payload_bytes long, chunk_no int, last boolean, digest string, data binary"


def read(spark: SparkSession, folder: str, files: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The archives' records as rows of chunks; digest is the SHA-1 (base32) of the payload up to the row's end.

    files has a column file, names under folder. A record of no payload has one
    row. Payloads are checked against their declared digest, and a mismatch or
    a cut archive is an error. Without with_data only each record's last row comes, data null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for r in records(_Stream(source), chunk):
                        if with_data:
                            held += len(r[-1])
                        elif not r[7]:
                            continue
                        else:
                            r = (*r[:-1], None)
                        rows.append(r)
                        if held >= 4 << 20 or len(rows) >= 4096:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file").repartition(parts, "file").mapInArrow(run, READ)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    files = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    last = read(spark, folder, files, with_data=False)
    page = lambda c: F.nullif(F.regexp_extract(c, "^urn:page:(-?[0-9]+)", 1), F.lit("")).cast("long")
    return last.select(
        page("record_id").alias("page_id"), "payload_bytes", F.when(F.col("type") == "revisit", F.col("declared")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), page("refers_to").alias("refers_to"),
    )
