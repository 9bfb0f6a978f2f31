"""WARC archives: writing one gzip member per record, and reading byte ranges in parallel.

Writing: every Spark task writes files of its own under names that hold its attempt, and returns a
manifest row for each.  The manifest is a table, committed by Spark's writer, so files of attempts that failed or
ran twice are never read.

Reading: the bytes of the files named in the manifest are cut into ranges.  A task looks for the magic of
gzip in its range, takes a candidate for a record only if it inflates to the head of a WARC record, and owns all
records that start in its range, reading past its end to finish the last.

Executors reach the archives through ``pyarrow.fs``, by the URI of a folder that all of them share.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskgraph.llm.common import stored
from deskgraph.session import shared_folder

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RANGE_BYTES = 16 << 20
FILE_BYTES = 256 << 20
HEAD_BYTES = 1 << 16
LEVEL = 6
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def file_system(folder: str):
    """The file system and the path of a folder given as a URI or a path."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def _member(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(VERSION + f"{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def _file_head() -> bytes:
    import uuid

    head = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("Content-Type", "application/warc-fields"),
    ]
    return _member(head, b"format: WARC File Format 1.1\r\n")


def _record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _clean(value: str | None) -> str:
    """A header's value: without line ends, percent-encoded beyond ASCII."""
    from urllib.parse import quote

    return quote(value or "", safe="!#$%&'()*+,/:;=?@[]~ -._")


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One record as a gzip member.  A revisit keeps the HTTP head, whose length is the whole payload's, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_uri(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", _clean(url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_uri(first))]
    return _member(head, http if revisit else http + payload)


def planned(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` with payload digest, and ``first``: the smallest page_id with an equal payload of ``least_bytes`` or more.

    Digests are counted with partial aggregates, and only those that occur more than once meet the pages again.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("sha1", F.sha1("payload"))
    again = (
        rows.where(F.octet_length("payload") >= least_bytes)
        .groupBy("sha1")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .select("sha1", "first")
    )
    return rows.join(again, "sha1", "left")


def write(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); the manifest (path, bytes, records) comes back, stored.

    A null html is an empty payload.  Rows that repeat a page_id with the same payload are all first or all
    revisits, as the rule looks at the page_id only; a null page_id is never the first of others.
    """
    base = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        system, root = file_system(base)
        system.create_dir(root, recursive=True)
        out, path, size, count, done = None, "", 0, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, size, count))
                out = None

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    context = TaskContext.get()
                    name = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}.warc.gz"
                    path, count = f"{base}/{name}", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    size = out.write(_file_head())
                digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                revisit = row["first"] is not None and row["first"] != row["page_id"]
                size += out.write(page_record(row["page_id"], row["url"], row["payload"], digest, row["first"], revisit))
                count += 1
                if size >= file_bytes:
                    close()
        close()
        if done:
            columns = list(zip(*done, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["path", "bytes", "records"]
            )

    return stored(planned(pages, least_bytes).mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


def _parse(record: bytes) -> tuple | None:
    """The fields of a response or revisit record, None for any other; raises ValueError for what is no record."""
    head, mark, block = record.partition(b"\r\n\r\n")
    if not mark or not head.startswith(VERSION):
        raise ValueError("no WARC record")
    fields = {}
    for line in head[len(VERSION) :].split(b"\r\n"):
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode()] = value.strip().decode()
    kind = fields.get("warc-type")
    block = block[: int(fields["content-length"])]
    if kind not in ("response", "revisit"):
        return None
    from urllib.parse import unquote

    number = lambda uri: None if uri is None or uri == "<urn:page:none>" else int(uri[10:-1])
    http, _, payload = block.partition(b"\r\n\r\n")
    if kind == "response":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if f"sha1:{digest}" != fields["warc-payload-digest"]:
            raise OSError(f"payload of {fields['warc-record-id']} does not have its digest")
    else:
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
    return number(fields["warc-record-id"]), unquote(fields.get("warc-target-uri", "")), size, digest, kind, number(fields.get("warc-refers-to")), payload


def records_in(data, start: int, end: int) -> Iterator[bytes]:
    """Records whose gzip member starts in [start, end) of the seekable file ``data``, inflated."""
    data.seek(start)
    buffer, at, base = data.read(end - start + HEAD_BYTES), 0, start
    while True:
        at = buffer.find(MAGIC, at)
        if at < 0 or base + at >= end:
            return
        head = zlib.decompressobj(31)
        try:
            good = head.decompress(buffer[at : at + HEAD_BYTES], len(VERSION)) == VERSION
        except zlib.error:
            good = False
        if not good:
            at += 1
            continue
        inflate = zlib.decompressobj(31)
        parts = [inflate.decompress(memoryview(buffer)[at:])]
        while not inflate.eof:
            more = data.read(1 << 20)
            if not more:
                raise OSError("the last record is cut off")
            base, buffer, at = base + len(buffer), more, 0
            parts.append(inflate.decompress(more))
        yield b"".join(parts)
        at = len(buffer) - len(inflate.unused_data)


def read(manifest: DataFrame, range_bytes: int = RANGE_BYTES, payload: bool = True) -> DataFrame:
    """The records of the manifest's files: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Every response's payload is checked against its digest.  ``payload`` False leaves the payloads out.
    """
    ranges = manifest.select(
        "path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"), "bytes"
    ).select("path", "start", F.least(F.col("start") + range_bytes, "bytes").alias("end"))
    spark = manifest.sparkSession
    wanted = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                system, path = file_system(row["path"])
                rows, held = [], 0
                with system.open_input_file(path) as data:
                    for record in records_in(data, row["start"], row["end"]):
                        if (fields := _parse(record)) is None:
                            continue
                        rows.append(fields if payload else (*fields[:-1], None))
                        held += len(record) if payload else 200
                        if held >= 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return ranges.repartition(wanted, "path", "start").mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, least_bytes: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Archive ``pages`` in the cluster's shared folder and read the archives back, without the payloads."""
    folder = shared_folder(pages.sparkSession, "llm-warc")
    return read(write(pages, folder, least_bytes), range_bytes, payload=False).drop("payload")
