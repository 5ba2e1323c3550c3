"""WARC archives: an index first, then coalesced range reads.

Writing: every page becomes a gzip member of its own in an archive file of its task; the task
returns an index row (file, offset, length, URL, digest) per record, and the index is kept as a
Parquet table.  Of pages with equal payloads the one with the largest id is a ``response``; the
others are ``revisit`` records that name it and carry no payload.  Each attempt of a task writes
files of its own and only index rows of the attempt that succeeded are kept, so lost executors and
repeated tasks leave unused files but no wrong rows.

Reading: the selected index rows are sorted by file and offset; neighbouring ranges become one
read, from which the members are cut and unpacked.

Archives go to the folder in ``spark.checkpoint.dir``, on any file system that pyarrow opens; the
schemes of Hadoop's S3 connectors are read as ``s3``.  The payloads themselves are never shuffled unless
more than ``BROADCAST_ROWS`` different payloads occur several times.

Defined results: a null html has an empty payload; a null url or page id leaves the header out and
reads back as null; pages that repeat both the largest id and the payload are all responses; a null
page id never is the one referred to; an empty table gives an empty result.  Extra columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, materialize, shared_path, slices, small, table

#: Payloads of at least this many bytes may be revisits.
LEAST = 0
#: A new archive file begins beyond this size; ranges are joined across small gaps up to a size.
FILE_BYTES, GAP_BYTES, READ_BYTES = 1 << 30, 1 << 16, 8 << 20
#: Records read before they are handed on, and bytes of archive in a read task at most (rows stream, so memory doesn't follow).
RECORDS, TASK_BYTES = 256, 128 << 20
DATE = "1970-01-01T00:00:00Z"

INDEX = "file string, offset bigint, length bigint, url string, digest string, page_id bigint, record_type string"
SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _name(page_id: int) -> str:
    return f"<urn:x-page:{page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit (``refers_to`` given) has the HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: {_name(page_id) if page_id is not None else f'<urn:uuid:{uuid.uuid4()}>'}")
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]-._~"))
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record; a response's digest and size are those of the payload found."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")).split(b": ")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page = fields["WARC-Record-ID"].removeprefix("<urn:x-page:").removesuffix(">")
    to = fields.get("WARC-Refers-To")
    if to is None and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": None if page.startswith("<") else int(page),
        "url": None if url is None else unquote(url),
        "payload": payload if to is None else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": None if to is None else int(to.removeprefix("<urn:x-page:").removesuffix(">")),
    }


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    scheme, _, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    out, name, at = None, "", 0
    for b in slices(batches):
        rows = []
        for page, url, html, to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
            if out is None or at > FILE_BYTES:
                if out is not None:
                    out.close()
                name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            payload = (html or "").encode()
            digest = sha1_base32(payload)
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = packer.compress(record(page, url, payload, digest, to)) + packer.flush()
            out.write(member)
            rows.append((f"{folder}/{name}", at, len(member), url, digest, page, "response" if to is None else "revisit"))
            at += len(member)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
    if out is not None:
        out.close()


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> DataFrame:
    """Writes one record per page and returns the index. pages: page_id, url, html."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "html", F.unhex(F.sha1(html.cast("binary"))).alias("sum"), (F.octet_length(html) >= least).alias("large"))
    kept = rows.filter("large").groupBy(F.col("sum").alias("kept_sum")).agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    kept = small(materialize(kept, "kept-pages"))
    rows = rows.join(kept, (F.col("sum") == F.col("kept_sum")) & F.col("large"), "left")
    to = F.when(F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("page_id")), F.col("kept"))
    return materialize(rows.select("page_id", "url", "html", to.alias("refers_to")).transform(in_arrow, lambda it: _write(it, folder), INDEX), "warc-index")


def coalesced(ranges: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Groups of positions in a sorted list of (offset, length) that one read serves."""
    group: list[int] = []
    for i, (offset, length) in enumerate(ranges):
        if group:
            begin, (last, n) = ranges[group[0]][0], ranges[group[-1]]
            if offset - (last + n) > GAP_BYTES or offset + length - begin > READ_BYTES:
                yield group
                group = []
        group.append(i)
    if group:
        yield group


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    columns = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    if payloads:
        columns |= {"url": pa.string(), "payload": pa.binary()}
    for b in slices(batches, 4 * RECORDS):
        files, offsets, lengths = (b.column(c).to_pylist() for c in ("file", "offset", "length"))
        at = 0
        while at < len(files):
            end = next((i for i in range(at, len(files)) if files[i] != files[at]), len(files))
            ranges = list(zip(offsets[at:end], lengths[at:end], strict=True))
            store, path = _store(files[at])
            with store.open_input_file(path) as f:
                for group in coalesced(ranges):
                    begin, stop = ranges[group[0]][0], sum(ranges[group[-1]])
                    data = memoryview(f.read_at(stop - begin, begin))
                    for i in range(0, len(group), RECORDS):
                        found = []
                        for j in group[i : i + RECORDS]:
                            fields = parse(zlib.decompress(data[ranges[j][0] - begin : sum(ranges[j]) - begin], 31))
                            found.append([fields[c] for c in columns])
                        yield pa.RecordBatch.from_pydict({c: pa.array(x, t) for (c, t), x in zip(columns.items(), zip(*found, strict=True), strict=True)})
            at = end


def read_records(index: DataFrame, payloads: bool = False, chunk: int | None = None) -> DataFrame:
    """The records of the given index rows. A task reads whole chunks of files, in order.

    Chunks hold ``TASK_BYTES`` of archive; where that would leave cores idle they shrink, down to the size of one read.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    chunk = chunk or min(TASK_BYTES, max(READ_BYTES, total // (2 * index.sparkSession.sparkContext.defaultParallelism)))
    tasks = -(-total // chunk)
    rows = index.select("file", "offset", "length", F.floor(F.col("offset") / chunk).alias("chunk"))
    rows = rows.repartition(max(1, tasks), "file", "chunk").sortWithinPartitions("file", "offset")
    return rows.select("file", "offset", "length").transform(in_arrow, lambda it: _read(it, payloads), SCHEMA + ", url string, payload binary" * payloads)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(write_archives(table(spark, sf_dir, "pages")))


OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS kept FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(((('0x' || substr(h, (5 * g + 1)::INTEGER, 5))::INTEGER >> s::INTEGER) & 31) + 1)::INTEGER]), '')), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM kept AND kept IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM k
"""
