"""WARC archives of pages: written with an index, read through it.

``write`` puts a record for each page, compressed on its own as usual for .warc.gz, into archives in the shared folder, one archive for each task attempt, and
returns an index row for every record: archive, offset, length, URL, digest. Only rows of attempts that succeed
are in the index, so an archive of a lost attempt is never read. ``read`` takes selected index rows, deals them by
archive and stretch, sorts them by offset and joins neighbouring byte ranges into one read.
"""

from __future__ import annotations

import gzip
import hashlib
import math
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Equal payloads of at least so many bytes are written once.
REVISIT_BYTES = 100
#: Ranges closer than _GAP are read together, up to _STRETCH at once.
_GAP, _STRETCH = 1 << 16, 1 << 23
#: Bytes of archives that one task reads, on average.
_TASK_BYTES = 1 << 27
_DATE = "1970-01-01T00:00:00Z"

INDEX = "page_id long, archive string, offset long, length long, url string, digest string, record_type string"
_INDEX = pa.schema([("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())])


def plan(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, record_type, refers_to): null html is empty.

    Of equal payloads of REVISIT_BYTES or more the smallest page_id is the response; rows that share it and the
    payload are responses too. Payloads are compared by SHA-256; only digests that repeat are joined back.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    first = own.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    out = own.join(first, "digest", "left").withColumn("revisit", F.coalesce(F.col("page_id") > F.col("first"), F.col("first").isNotNull() & F.col("page_id").isNull()))
    return out.select("page_id", "url", "html", "digest", F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"), F.when(F.col("revisit"), F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has its HTTP head but not its payload."""
    target = quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~")
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {digest}")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Bytes: {len(payload)}", "Content-Type: application/http;msgtype=response",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to} {digest}')}>", f"X-Refers-To-Page: {refers_to}"]
    else:
        body += payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of one record; ValueError if its lengths or its digest don't agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not one whole record")
    payload = rest[:size].partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] != "revisit" and fields["WARC-Payload-Digest"] != "sha256:" + hashlib.sha256(payload).hexdigest():
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is not what its digest says")
    return fields, payload


def write(planned: DataFrame, folder: str) -> DataFrame:
    """Write archives into ``folder`` (a URI) and return their index. Keep the index before reading: each run of it writes anew."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        c = TaskContext.get()
        name = f"part-{c.partitionId():05d}-{c.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        out, at = None, 0
        try:
            for b in it:
                rows = []
                for r in b.to_pylist():
                    if out is None:
                        system.create_dir(path, recursive=True)
                        out = system.open_output_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20)
                    raw = gzip.compress(record(r["page_id"], r["url"], r["html"].encode("utf-8", "surrogatepass"), r["digest"], r["record_type"], r["refers_to"]), 1, mtime=0)
                    out.write(raw)
                    rows.append((r["page_id"], name, at, len(raw), r["url"], r["digest"], r["record_type"]))
                    at += len(raw)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    return planned.mapInArrow(run, INDEX)


def _stretches(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Archive, start and length of each read, and the records in it, from rows sorted by archive and offset."""
    now: tuple[str, int, int, list[tuple[int, int]]] | None = None
    for archive, offset, length in rows:
        if now and now[0] == archive and offset - (now[1] + now[2]) <= _GAP and offset + length - now[1] <= _STRETCH:
            now = (archive, now[1], max(now[2], offset + length - now[1]), now[3] + [(offset, length)])
        else:
            if now:
                yield now
            now = (archive, offset, length, [(offset, length)])
    if now:
        yield now


_RECORD = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("url", pa.string()), ("payload", pa.binary())])


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of selected index rows, parsed; without ``payloads`` that column is null."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        opened: dict = {}
        for b in it:
            rows = list(zip(*[b.column(c).to_pylist() for c in ("archive", "offset", "length")], strict=True))
            for archive, start, length, records in _stretches(rows):
                if archive not in opened:
                    for f in opened.values():
                        f.close()
                    opened = {archive: system.open_input_file(f"{path}/{archive}")}
                raw = opened[archive].read_at(length, start)
                out = []
                for offset, n in records:
                    fields, payload = parse(gzip.decompress(raw[offset - start : offset - start + n]))
                    revisit = fields["WARC-Type"] == "revisit"
                    out.append((
                        int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, fields["WARC-Type"], int(fields["X-Refers-To-Page"]) if revisit else None, int(fields["X-Payload-Bytes"]),
                        fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Target-URI"], payload if payloads and not revisit else None,
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), _RECORD, strict=True)], schema=_RECORD)
        for f in opened.values():
            f.close()

    stretch = (F.col("offset") / _STRETCH).cast("long").alias("stretch")
    # index rows are few bytes for what they make a task read, so their number of tasks is not left to their size
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, math.ceil(size / _TASK_BYTES))
    dealt = index.select("archive", "offset", "length", stretch).repartition(tasks, "archive", "stretch").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(run, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, payload binary")
