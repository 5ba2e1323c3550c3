"""Zipped CSV as a data source of Spark: members are split by byte range, rows go out in Arrow batches.

Planning reads only the central directory of each archive, which names every member's place in
the file. A partition is a list of member ranges of about ``splitBytes`` unpacked bytes: small members of an
archive travel together, and each task seeks to its members and inflates them as a stream, so that neither an
archive nor a member is ever held whole, and many tasks read one archive.  A stored member, which
needs no inflating, is itself split at line ends; a deflated one can only be read from its start.

Reader options: ``path`` (a folder), ``prefix`` and ``contains`` (of file names; case ignored in the
second; names with ``key`` in them are left out), ``columns`` (JSON list; default: the first member's header),
``splitBytes``, ``blockBytes`` (a line must fit), ``multiLine`` (values hold line breaks; stored members
are then not split).  All columns are text and null where a member lacks them; ``file_no`` is the last number
in the archive's name.

Writer options: ``path``, ``prefix``, ``memberRows``. Each task writes one archive beside the table; the
commit moves the archives of the attempts that succeeded to their place, so a repeated or lost task
leaves no rows behind.
"""

from __future__ import annotations

import csv
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import IntegerType, StringType, StructType

#: Unpacked bytes of a partition, and of a block of lines.
SPLIT, BLOCK = 128 << 20, 8 << 20
#: Bytes read from a file at a time, archives whose directories are read together, rows of a written member.
CHUNK, LISTERS, MEMBER_ROWS = 1 << 20, 32, 1_000_000
#: Length of a local file header, and where the lengths of the name and the extra field stand in it.
LOCAL_HEADER, LENGTHS_AT = 30, 26


@dataclass(frozen=True)
class Range:
    """Bytes ``start`` to ``stop`` of the unpacked member that begins at ``offset`` of the archive."""

    archive: str
    member: str
    file_no: int
    offset: int
    packed: int
    size: int
    stored: bool
    crc: int
    start: int
    stop: int


class Ranges(InputPartition):
    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or of a local path."""
    scheme, _, rest = uri.partition("://")
    if not rest:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


def archives(folder: str, prefix: str = "", contains: str = "") -> list[str]:
    """Paths of the folder's zip files that the names select, in order."""
    where, path = store(folder)
    names = [i.path for i in where.get_file_info(fs.FileSelector(path, allow_not_found=True)) if i.type == fs.FileType.File]

    def fits(name: str) -> bool:
        return name.startswith(prefix) and name.lower().endswith(".zip") and "key" not in name.lower() and contains.lower() in name.lower()

    return sorted(p for p in names if fits(p.rsplit("/", 1)[-1]))


class Seekable(io.RawIOBase):
    """An Arrow file as ``zipfile`` takes it: a seek to before the file's start, which it tries on archives of a few bytes, is an OSError."""

    def __init__(self, f: pa.NativeFile):
        self.f = f

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.f.tell()

    def seek(self, to: int, whence: int = io.SEEK_SET) -> int:
        at = to + (0, self.f.tell(), self.f.size())[whence]
        if at < 0:
            raise OSError(f"seek to {at}")
        return self.f.seek(at)

    def readinto(self, into) -> int:
        data = self.f.read(len(into))
        into[: len(data)] = data
        return len(data)


def members(folder: str, path: str) -> list[Range]:
    """The CSV members of an archive, from its central directory, each as one range; an archive may have none."""
    numbers = re.findall(r"\d+", path.rsplit("/", 1)[-1])
    with store(folder)[0].open_input_file(path) as f, zipfile.ZipFile(Seekable(f)) as z:
        out = []
        for i in sorted(z.infolist(), key=lambda i: i.filename):
            if i.filename.lower().endswith(".csv") and i.file_size:
                if i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or i.flag_bits & 1:
                    raise ValueError(f"{path}: {i.filename} is neither stored nor deflated, or encrypted")
                out.append(Range(path, i.filename, int(numbers[-1]) if numbers else 0, i.header_offset, i.compress_size, i.file_size, i.compress_type == zipfile.ZIP_STORED, i.CRC, 0, i.file_size))
    return out


def planned(found: Sequence[Range], split: int, cut_stored: bool = True) -> list[list[Range]]:
    """Partitions of about ``split`` bytes: long stored members are cut, short ones of an archive are put together."""
    out: list[list[Range]] = []
    room = 0
    for m in found:
        n = -(-m.size // split) if m.stored and cut_stored else 1
        cuts = [m.size * i // n for i in range(n + 1)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = Range(**{**m.__dict__, "start": a, "stop": b})
            if not out or b - a > room or out[-1][0].archive != m.archive:
                out.append([])
                room = split
            out[-1].append(part)
            room -= b - a
    return out


def data_at(f: pa.NativeFile, r: Range) -> int:
    """Where the member's bytes begin: behind its local header, whose lengths may differ from the directory's."""
    name, extra = struct.unpack("<HH", f.read_at(LOCAL_HEADER, r.offset)[LENGTHS_AT:])
    return r.offset + LOCAL_HEADER + name + extra


def unpacked(f: pa.NativeFile, r: Range) -> Iterator[bytes]:
    """The member's bytes from ``start`` on, to its end; whole members are checked against their CRC."""
    begin, crc = data_at(f, r), 0
    at, end = begin + r.start * r.stored, begin + r.packed
    inflate = None if r.stored else zlib.decompressobj(-15)
    while at < end:
        raw = f.read_at(min(CHUNK, end - at), at)
        if not raw:
            raise ValueError(f"{r.archive}: {r.member} ends early")
        at += len(raw)
        while raw:  # what is inflated from a chunk is bounded too
            block = inflate.decompress(raw, 8 * CHUNK) if inflate else raw
            raw = inflate.unconsumed_tail if inflate else b""
            crc = zlib.crc32(block, crc)
            if block:
                yield block
    if inflate and (rest := inflate.flush()):
        crc = zlib.crc32(rest, crc)
        yield rest
    if r.start == 0 and crc != r.crc:
        raise ValueError(f"{r.archive}: the checksum of {r.member} is wrong")


def own_lines(f: pa.NativeFile, r: Range) -> Iterator[bytes]:
    """Bytes of the lines that begin in the range, of which the last may end behind it."""
    if r.start:
        r = Range(**{**r.__dict__, "start": r.start - 1})  # a line that begins right at the range is its own
    at, begun = r.start, r.start == 0
    for block in unpacked(f, r):
        if not begun:
            cut = block.find(b"\n") + 1
            at += cut or len(block)
            if at >= r.stop:  # no line begins before the range ends
                return
            if not cut:
                continue
            block, begun = block[cut:], True
        if at + len(block) >= r.stop and r.stop < r.size:
            last = block.find(b"\n", max(0, r.stop - 1 - at))
            if last >= 0:
                yield block[: last + 1]
                return
        at += len(block)
        yield block


class Stream(io.RawIOBase):
    """Blocks as a file to read."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.rest = blocks, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.rest:
            block = next(self.blocks, None)
            if block is None:
                return 0
            self.rest = memoryview(block)
        n = min(len(into), len(self.rest))
        into[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def header(f: pa.NativeFile, r: Range) -> list[str]:
    line = b""
    for block in unpacked(f, Range(**{**r.__dict__, "start": 0})):
        line += block
        if b"\n" in block:
            break
    return next(csv.reader([line.split(b"\n", 1)[0].decode("utf-8-sig").strip("\r")]), [])


class ZipCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zipcsv"

    def found(self) -> list[str]:
        return archives(self.options["path"], self.options.get("prefix", ""), self.options.get("contains", ""))

    def schema(self) -> StructType:
        columns = json.loads(self.options.get("columns", "null"))
        if columns is None:
            first = next((m for path in self.found() for m in members(self.options["path"], path)), None)
            if first is None:
                raise ValueError(f"no {self.options.get('prefix', '')}*.zip in {self.options['path']}")
            with store(self.options["path"])[0].open_input_file(first.archive) as f:
                columns = header(f, first)
        schema = StructType()
        for c in columns:
            schema.add(c, StringType())
        return schema.add("file_no", IntegerType())

    def reader(self, schema: StructType) -> ZipCsvReader:
        return ZipCsvReader(self, [f.name for f in schema.fields if f.name != "file_no"])

    def writer(self, schema: StructType, overwrite: bool) -> ZipCsvWriter:
        return ZipCsvWriter(dict(self.options), overwrite)


class ZipCsvReader(DataSourceReader):
    def __init__(self, source: ZipCsv, columns: list[str]):
        self.source, self.columns, self.folder = source, columns, source.options["path"]
        self.multi = source.options.get("multiline", "false").lower() == "true"
        self.split, self.block = int(source.options.get("splitbytes", SPLIT)), int(source.options.get("blockbytes", BLOCK))

    def partitions(self) -> list[Ranges]:
        with ThreadPoolExecutor(LISTERS) as pool:
            found = [m for own in pool.map(lambda p: members(self.folder, p), self.source.found()) for m in own]
        return [Ranges(p) for p in planned(found, self.split, not self.multi)] or [Ranges([])]  # of no partitions Spark makes one that is None

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        where = store(self.folder)[0]
        texts = pc.ConvertOptions(include_columns=self.columns, include_missing_columns=True, column_types=dict.fromkeys(self.columns, pa.string()), strings_can_be_null=True, null_values=[""])
        for r in partition.ranges:
            with where.open_input_file(r.archive) as f:
                blocks = own_lines(f, r)
                first = next(blocks, None)
                if first is None:  # a line longer than the range
                    continue
                lines = io.BufferedReader(Stream(self._again(first, blocks)), CHUNK)
                names = header(f, r) if r.start else None
                for b in pc.open_csv(lines, pc.ReadOptions(block_size=self.block, column_names=names), pc.ParseOptions(newlines_in_values=self.multi), texts):
                    columns = [c.cast(pa.string()) for c in b.columns]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([r.file_no] * b.num_rows, pa.int32())], names=[*self.columns, "file_no"])

    @staticmethod
    def _again(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
        yield first
        yield from rest


class Written(WriterCommitMessage):
    def __init__(self, staged: str, name: str):
        self.staged, self.name = staged, name


class ZipCsvWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folder, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.prefix, self.rows = options.get("prefix", "part"), int(options.get("memberrows", MEMBER_ROWS))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, path = store(self.folder)
        number = TaskContext.get().partitionId()
        staging = f"{path}/_staging-{self.job}"
        where.create_dir(staging, recursive=True)
        staged, member, held, out, rows = f"{staging}/{uuid.uuid4().hex}", 0, None, None, 0
        with where.open_output_stream(staged, compression=None) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
            for b in iterator:
                for at in range(0, b.num_rows, self.rows):
                    piece = b.slice(at, self.rows)
                    if out is None or rows + piece.num_rows > self.rows:
                        if out is not None:
                            out.close()
                            held.close()
                        held = z.open(f"{self.prefix}-{member:05d}.csv", "w", force_zip64=True)
                        out, rows, member = pc.CSVWriter(held, b.schema), 0, member + 1
                    out.write_batch(piece)
                    rows += piece.num_rows
            if out is not None:
                out.close()
                held.close()
        if not member:  # a task without rows leaves no archive
            where.delete_file(staged)
            return Written("", "")
        return Written(staged, f"{path}/{self.prefix}-{self.job[:8]}_file-{number}.zip")

    def commit(self, messages: list[Written | None]) -> None:
        where, path = store(self.folder)
        before = archives(self.folder) if self.overwrite else []
        for m in messages:
            if m is not None and m.staged:
                where.move(m.staged, m.name)
        for old in before:
            where.delete_file(old)
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        where, path = store(self.folder)
        staging = f"{path}/_staging-{self.job}"
        if where.get_file_info(staging).type != fs.FileType.NotFound:
            where.delete_dir(staging)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipCsv)


def read_zips(spark: SparkSession, folder: str, prefix: str = "", contains: str | None = None, columns: Sequence[str] | None = None, split: int = SPLIT, **options: str) -> DataFrame:
    """The CSV rows of a folder's zip files."""
    register(spark)
    reader = spark.read.format("zipcsv").options(path=folder, prefix=prefix, contains=contains or "", splitBytes=str(split), **options)
    return (reader.option("columns", json.dumps(list(columns))) if columns is not None else reader).load()


def write_zips(df: DataFrame, folder: str, prefix: str = "part", mode: str = "append", member_rows: int = MEMBER_ROWS) -> None:
    """The rows as zipped CSV, an archive for each task."""
    register(df.sparkSession)
    df.write.format("zipcsv").options(path=folder, prefix=prefix, memberRows=str(member_rows)).mode(mode).save()
