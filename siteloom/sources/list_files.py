"""Files of ranked lists as a Spark data source: ``spark.read.format("ranked_list").option("provider", p).load(path)``.

A row is one line or record, all columns strings, cut by nothing but the file's own format; cleaning and
typing are columns (:mod:`lists`).  Files are read as streams of about 4 MB, whatever their size, so that no file and
no zip member is ever one value.  Plain files of lines are split at ``splitBytes``; gzip and zip files and those
with a header are one partition each, because they can only be read from their start.
"""

from __future__ import annotations

import csv
import gzip
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Column and the header names that it goes by, lower case; providers without a header give lines.
HEADERS: dict[str, dict[str, tuple[str, ...]]] = {
    "majestic": {"GlobalRank": ("globalrank",), "Domain": ("domain",), "RefSubNets": ("refsubnets",), "RefIPs": ("refips",)},
    "openpagerank": {"rank": ("rank",), "domain": ("domain",), "open_page_rank": ("open page rank", "open_page_rank"), "referring_domains": ("referring domains", "referring_domains")},
    "crux_top": {"origin": ("origin",), "rank": ("rank",)},
}
#: Header names without which a file is refused.
REQUIRED = {"majestic": ("GlobalRank", "Domain"), "openpagerank": ("rank", "domain"), "crux_top": ("origin", "rank")}
LINES = ("tranco", "cc_webgraph", "lines")
BLOCK = 4 << 20


def _file_system(path: str):
    """The file system of a path or URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder but hidden ones."""
    from pyarrow import fs

    system, inner = _file_system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    root = path.rstrip("/")
    rows = [(f"{root}/{f.path[len(inner.rstrip('/')) + 1:]}", f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted(rows)


@dataclass
class Stretch(InputPartition):
    """The lines of a file that begin in [start, end); end None: the whole file."""

    path: str
    start: int = 0
    end: int | None = None


def _opened(path: str) -> io.BufferedIOBase:
    """The content of a plain, gzip or zip file (first member that is no folder) as a stream of bytes."""
    system, inner = _file_system(path)
    raw, low = system.open_input_file(inner), path.lower()
    if low.endswith(".zip"):
        archive = zipfile.ZipFile(raw)
        members = [m for m in archive.infolist() if not m.is_dir()]
        if not members:
            raise ValueError(f"{path}: no member in the archive")
        return archive.open(members[0])
    return gzip.GzipFile(fileobj=raw) if low.endswith(".gz") else raw


def _line_start(stream: io.BufferedIOBase, at: int) -> int:
    """Where the first line begins that begins at or after ``at``; the file's size if there is none."""
    if not at:
        return 0
    at -= 1
    stream.seek(at)
    while block := stream.read(BLOCK):
        cut = block.find(b"\n")
        if cut >= 0:
            return at + cut + 1
        at += len(block)
    return at


def _blocks(part: Stretch) -> Iterator[bytes]:
    """Blocks of whole lines of a stretch.  A line belongs to the stretch in which it begins."""
    stream, left = _opened(part.path), None
    if part.end is not None:
        begin, stop = _line_start(stream, part.start), _line_start(stream, part.end)
        left = stop - begin
        stream.seek(begin)
    rest: list[bytes] = []
    while block := stream.read(BLOCK if left is None else min(BLOCK, left)):
        left = None if left is None else left - len(block)
        cut = block.rfind(b"\n") + 1
        if cut:
            yield b"".join([*rest, block[:cut]])
            rest = []
        if cut < len(block):
            rest.append(block[cut:])
    if rest:
        yield b"".join(rest)


def _line_batches(part: Stretch) -> Iterator[pa.RecordBatch]:
    for block in _blocks(part):
        lines = block.decode("utf-8", "replace").split("\n")
        if not lines[-1]:
            lines.pop()
        yield pa.record_batch([pa.array([x.removesuffix("\r") for x in lines], pa.string())], names=["value"])


def _record_batches(part: Stretch, provider: str) -> Iterator[pa.RecordBatch]:
    names = HEADERS[provider]
    with io.TextIOWrapper(_opened(part.path), "utf-8-sig", errors="replace", newline="") as text:
        rows = csv.reader(text)
        header = [c.strip().lower() for c in next(rows, [])]
        place = [next((header.index(k) for k in keys if k in header), None) for keys in names.values()]
        lacking = [n for n, p in zip(names, place, strict=True) if p is None and n in REQUIRED[provider]]
        if lacking and header:
            raise ValueError(f"{part.path}: no column {', '.join(lacking)} in the header {header}")
        made, size = [[] for _ in names], 0
        batch = lambda: pa.record_batch([pa.array(c, pa.string()) for c in made], names=list(names))
        for row in rows:
            if not row:
                continue
            for column, p in zip(made, place, strict=True):
                column.append(row[p] if p is not None and p < len(row) else None)
            size += sum(map(len, row)) + 64
            if size > BLOCK:
                yield batch()
                made, size = [[] for _ in names], 0
        yield batch()


class _Reader(DataSourceReader):
    def __init__(self, provider: str, path: str, split: int) -> None:
        self.provider, self.path, self.split = provider, path, split

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, size in _files(self.path):
            if self.provider in HEADERS or path.lower().endswith((".gz", ".zip")):
                out.append(Stretch(path))
            else:
                out.extend(Stretch(path, a, min(a + self.split, size)) for a in range(0, size, self.split))
        return out

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file with content
            return iter(())
        return _record_batches(partition, self.provider) if self.provider in HEADERS else _line_batches(partition)


class RankedListSource(DataSource):
    """Lists of the providers ``tranco``, ``majestic``, ``openpagerank``, ``crux_top`` and ``cc_webgraph``, and ``lines`` of any file.

    Options: ``provider`` and ``splitBytes`` (134217728).  Providers without a header give ``value`` (a line without its end); the others
    the columns of :data:`HEADERS`, found by header name in any case; a short record's missing fields are null, fields beyond
    the header are passed over, empty lines give no row, bytes that are no UTF-8 are replaced.  An unknown provider, a path that is not there,
    an archive without a member and a header without the needed columns are errors; an empty file gives no rows.
    Paths are those that ``pyarrow.fs`` opens on every executor: shared folders, ``file:``, ``hdfs:``, ``s3:``, ``gs:``.
    """

    @classmethod
    def name(cls) -> str:
        return "ranked_list"

    def _provider(self) -> str:
        p = self.options.get("provider", "lines")
        if p not in HEADERS and p not in LINES:
            raise ValueError(f"unknown list provider {p!r}: one of {sorted([*HEADERS, *LINES])}")
        return p

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in HEADERS.get(self._provider(), ("value",)))

    def reader(self, schema) -> DataSourceReader:
        split = int(self.options.get("splitBytes", 128 << 20))
        if split < 1:
            raise ValueError("splitBytes must be positive")
        return _Reader(self._provider(), self.options["path"], split)


def list_file(spark: SparkSession, provider: str, path: str, **options: str) -> DataFrame:
    """The rows of a provider's file or folder of files, by the ``ranked_list`` source, which is registered on the way."""
    spark.dataSource.register(RankedListSource)
    return spark.read.format("ranked_list").options(provider=provider, **options).load(path)
