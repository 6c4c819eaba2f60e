"""WARC archives: a writer with revisit records and a splittable reader.

The writer turns rows into gzipped WARC records, one gzip member each, in archive
files of bounded size under a folder that all executors share. Files carry the
task attempt in their name, and only those in the manifest (a written table, so
only of tasks that succeeded) count; a task that dies leaves a file nobody reads.

The reader cuts files into byte ranges, one task each. A task looks for the gzip
magic in its range, checks a candidate by inflating the beginning and finding a
WARC version line and a header block with a record id, and owns the records whose
first byte lies in its range; the last one may end beyond it. So a file of any
size is read in parallel, without an index.

Defined cases: a null payload is empty; rows with a null id are written with an
empty id and read back as null; equal rows of the chosen id are all responses;
an empty table gives an empty archive. Damaged members are skipped: the scan goes
on behind the magic that did not hold.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor.llm.common import text_of
from corridor.operators.frames import join_unique
from corridor.scratch import new_path, stored

MAGIC = b"\x1f\x8b\x08"
FILE_BYTES = 1 << 27
RANGE_BYTES = 1 << 23
READ_BYTES = 1 << 20
HEADER_BYTES = 1 << 16
MOST_TASKS = 20_000
LEAST_BYTES = 0
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "path string, bytes bigint, records bigint"
RECORDS = (
    "path string, start bigint, record_id string, record_type string, target_uri string, refers_to_id string, "
    "payload_digest string, payload_bytes bigint, payload binary"
)


def _file(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a URI or an absolute local path."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def digest32(payload: bytes) -> str:
    """SHA-1 as bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def marked_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """The rows with ``_revisits``: the id of the response that a row repeats, else null.

    Of rows with equal payloads of at least ``least`` bytes the one with the
    largest id is the response; a row without an id repeats it like any other, and
    rows that all have none are responses. Payloads meet by SHA-1 and length; the largest id
    is a partial aggregate, so many copies do not meet in one task, and hot
    payloads get it by broadcast.
    """
    payload = text_of(payload_col).cast("binary")
    keyed = pages.withColumn("_key", F.concat_ws(":", F.sha1(payload), F.octet_length(payload)))
    groups = stored(
        keyed.where(F.octet_length(payload) >= least).groupBy("_key").agg(F.max(id_col).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1"),
        "warc-copies",
    )
    joined = join_unique(keyed, groups.drop("_n"), ["_key"], "left", groups.select("_key", "_n"))
    return joined.withColumn("_revisits", F.when(~F.col("_first").eqNullSafe(F.col(id_col)), F.col("_first"))).drop("_key", "_first")


def _record(row_id: str, uri: str, payload: bytes, revisits: str | None) -> bytes:
    """One WARC record. A revisit has no payload; its header names the digest and length of the full one."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if revisits is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if revisits is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{row_id}>",
        f"WARC-Target-URI: {uri}", f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisits is not None:
        head += [f"WARC-Refers-To: <urn:page:{revisits}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _one_line(value: object) -> str:
    """A header value: control characters would end the line."""
    return "".join(c if c >= " " else " " for c in str(value)) if value is not None else ""


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
               least: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row under ``folder``; returns the manifest ``(path, bytes, records)``."""
    spark = pages.sparkSession
    base, place = _file(folder)
    base.create_dir(place, recursive=True)

    def each(frames):
        context = TaskContext.get()
        name = f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}"
        system = None
        number = held = records = 0
        out = path = None
        for frame in frames:
            if system is None:
                system, _ = _file(folder)
            for row in frame.itertuples(index=False):
                if out is None:
                    path = f"{name}-{number:04d}.warc.gz"
                    out, held, records = system.open_output_stream(_file(path)[1], compression=None), 0, 0
                member = _member(_record(_one_line(row.id), _one_line(row.uri), row.payload or b"", row.revisits))
                out.write(member)
                held, records = held + len(member), records + 1
                if held >= file_bytes:
                    out.close()
                    yield pd.DataFrame({"path": [path], "bytes": [held], "records": [records]})
                    out, number = None, number + 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "bytes": [held], "records": [records]})

    rows = marked_revisits(pages.select(id_col, uri_col, payload_col), id_col, payload_col, least).select(
        F.col(id_col).cast("string").alias("id"), F.col(uri_col).cast("string").alias("uri"),
        text_of(payload_col).cast("binary").alias("payload"), F.col("_revisits").cast("string").alias("revisits"),
    )
    manifest = rows.mapInPandas(each, MANIFEST)
    path = new_path(spark, "warc-manifest")
    manifest.write.parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)


def _header(block: bytes) -> dict[str, str] | None:
    """Fields of a WARC header block, or None if the bytes are no whole header."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"WARC/") or end < 0:
        return None
    fields = {}
    for line in block[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return fields if "warc-record-id" in fields and "content-length" in fields else None


class _Window:
    """Bytes of a file from a moving start, read on demand."""

    def __init__(self, source, start: int):
        self.source, self.start, self.data = source, start, b""
        source.seek(start)

    def more(self) -> bool:
        chunk = self.source.read(READ_BYTES)
        self.data += chunk
        return bool(chunk)

    def drop(self, count: int) -> None:
        self.data, self.start = self.data[count:], self.start + count


def _inflate(window: _Window, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """(header, whole record, compressed length) of the member at ``at`` of the window, or None if it is none.

    A candidate is given up as soon as its first inflated bytes are no header.
    """
    unpacker, pieces, used = zlib.decompressobj(31), [], at
    fields, size = None, 0
    while not unpacker.eof:
        if used == len(window.data) and not window.more():
            return None
        piece = window.data[used : used + READ_BYTES]
        try:
            pieces.append(unpacker.decompress(piece))
        except zlib.error:
            return None
        used += len(piece)
        size += len(pieces[-1])
        if fields is None:
            first = b"".join(pieces)
            pieces = [first]
            fields = _header(first)
            if fields is None and (len(first) >= HEADER_BYTES or not b"WARC/1.".startswith(first[:7])):
                return None
    if fields is None:
        return None
    return fields, b"".join(pieces), used - len(unpacker.unused_data) - at


def records_in(source, start: int, stop: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``(offset, header, record)`` of the records that start in ``[start, stop)`` of an open file."""
    window = _Window(source, start)
    while window.start < stop:
        at = window.data.find(MAGIC)
        if at < 0:
            window.drop(max(0, len(window.data) - len(MAGIC) + 1))
            if window.start >= stop or not window.more():
                return
            continue
        window.drop(at)
        if window.start >= stop:
            return
        found = _inflate(window, 0)
        if found is None:
            window.drop(1)
            continue
        fields, record, length = found
        yield window.start, fields, record
        window.drop(length)


def _payload(fields: dict[str, str], record: bytes) -> bytes:
    """The HTTP body of a record, or its whole block if it is no HTTP message."""
    start = record.find(b"\r\n\r\n") + 4
    block = record[start : start + int(fields["content-length"])]
    if fields.get("content-type", "").startswith("application/http"):
        return block[block.find(b"\r\n\r\n") + 4 :]
    return block


def ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(path, start, stop)`` byte ranges of files ``(path, bytes)``."""
    starts = F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {range_bytes}L)"))
    return files.select("path", "bytes", starts.alias("start")).select(
        "path", "start", F.least(F.col("start") + range_bytes, F.col("bytes")).alias("stop")
    )


def read_warc(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the files ``(path, bytes)``: see ``RECORDS``. A revisit's digest and length are its header's.

    Ranges are dealt evenly to as many tasks, up to ``MOST_TASKS``, beyond which a
    task reads several; batches go out after about 32 MB of payload.
    """

    def each(frames):
        for frame in frames:
            for part in frame.itertuples(index=False):
                system, plain = _file(part.path)
                batch, held = [], 0
                with system.open_input_file(plain) as source:
                    for at, fields, record in records_in(source, part.start, part.stop):
                        revisit = fields.get("warc-type") == "revisit"
                        payload = None if revisit else _payload(fields, record)
                        batch.append((
                            part.path, at, fields["warc-record-id"].strip("<>"), fields.get("warc-type"), fields.get("warc-target-uri"),
                            fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
                            fields.get("warc-payload-digest", "").removeprefix("sha1:") or None if revisit else digest32(payload),
                            int(fields.get("x-payload-length", 0)) if revisit else len(payload), payload,
                        ))
                        held += len(payload or b"") + 500
                        if held > 1 << 25:
                            yield pd.DataFrame(batch, columns=names)
                            batch, held = [], 0
                if batch:
                    yield pd.DataFrame(batch, columns=names)

    names = [part.strip().split(" ")[0] for part in RECORDS.split(",")]
    cut = ranges(files, range_bytes)
    tasks = min(max(cut.count(), 1), MOST_TASKS)
    return cut.repartition(tasks).mapInPandas(each, RECORDS)


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, bytes)`` of all ``.warc.gz`` files under any folder Spark can list, without reading them."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder)
    return listed.select("path", F.col("length").alias("bytes"))
