"""Spark data sources ``fasta`` and ``fastq``: files in byte ranges, each from its first record start to that of the next range.

Batches leave as Arrow. A record's place is (file, split, row), so record numbers need the sizes of the splits only; the option
``counts`` gives these without making records. As a stream the sources read each file once, when it appears in the folder.

Paths are those that ``pyarrow.fs`` opens: local or mounted folders, ``s3://``, ``gs://``, ``hdfs://`` and others. Compressed files
(by extension) can't be cut and are one split each.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SPLIT_BYTES = 64 << 20
_BLOCK = 4 << 20
_RECORDS = 10_000
_COMPRESSED = (".gz", ".bz2", ".zst", ".lz4")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it; a plain path is local."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listed(path: str) -> list[tuple[str, int]]:
    """(file, size) of a file, or of the files in a folder by name; hidden ones are left out."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(inner, recursive=False))
    names = sorted((posixpath.basename(f.path), f.size) for f in found if f.type == fs.FileType.File)
    return [(f"{path.rstrip('/')}/{name}", size) for name, size in names if not name.startswith((".", "_"))]


def is_compressed(path: str) -> bool:
    return path.endswith(_COMPRESSED)


class Split(InputPartition):
    def __init__(self, file: str, begin: int, end: int):
        super().__init__((file, begin, end))
        self.file, self.begin, self.end = file, begin, end


def splits_of(files: list[tuple[str, int]], size: int) -> list[Split]:
    """Byte ranges of ``size``; -1 stands for the end of a compressed file."""
    out = []
    for file, length in files:
        if is_compressed(file):
            out.append(Split(file, 0, -1))
        else:
            out += [Split(file, at, min(at + size, length)) for at in range(0, length, size)]
    return out


def fasta_start(f: pa.NativeFile, at: int, size: int) -> int:
    """The first place from ``at`` on where a line begins with ``>``; the file's first line is a header whatever it begins with."""
    if at == 0 or at >= size:
        return min(at, size)
    f.seek(at - 1)
    base, tail = at - 1, b""
    while block := f.read(_BLOCK):
        found = (tail + block).find(b"\n>")
        if found >= 0:
            return base - len(tail) + found + 1
        base, tail = base + len(block), block[-1:]
    return size


def fastq_start(f: pa.NativeFile, at: int, size: int) -> int:
    """The first header from ``at`` on. A quality line may begin with ``@`` too, but two lines below it is a sequence, never ``+``."""
    if at == 0 or at >= size:
        return min(at, size)
    width = 1 << 16
    while True:
        f.seek(at - 1)
        window = f.read(width)
        lines, place = window.split(b"\n"), at - 1 + window.find(b"\n") + 1
        for k in range(1, len(lines) - 2):
            if lines[k].startswith(b"@") and lines[k + 2].startswith(b"+"):
                return place
            place += len(lines[k]) + 1
        if len(window) < width:
            return size
        width *= 4


def _blocks(split: Split, start) -> Iterator[bytes]:
    """The bytes of the records that begin in the split."""
    system, inner = opened(split.file)
    if split.end < 0:
        with system.open_input_stream(inner, compression="detect") as f:
            while block := f.read(_BLOCK):
                yield block
        return
    with system.open_input_file(inner) as f:
        size = f.size()
        begin, end = start(f, split.begin, size), start(f, split.end, size)
        while begin < end:
            f.seek(begin)
            block = f.read(min(_BLOCK, end - begin))
            if not block:
                return
            begin += len(block)
            yield block


def fasta_records(split: Split) -> Iterator[list[bytes]]:
    """Lists of records: a header without its first ``>``, and lines."""
    parts: list[bytes] = []  # of the record that is not complete: a long one is joined once
    for block in _blocks(split, fasta_start):
        if parts and parts[-1].endswith(b"\n") and block.startswith(b">"):
            parts[-1] = parts[-1][:-1]
            yield [b"".join(parts)]
            parts, block = [], block[1:]
        *whole, last = block.split(b"\n>")
        if whole:
            yield [b"".join([*parts, whole[0]]), *whole[1:]]
            parts = []
        parts.append(last)
    if any(parts):
        yield [b"".join(parts)]


def fastq_lines(split: Split) -> Iterator[list[bytes]]:
    """Lists of lines, four for each record; an incomplete record at the end is left out."""
    parts: list[bytes] = []
    lines: list[bytes] = []
    for block in _blocks(split, fastq_start):
        *whole, last = block.split(b"\n")
        if whole:
            lines += [b"".join([*parts, whole[0]]), *whole[1:]]
            parts = []
            full = len(lines) // 4 * 4
            if full:
                yield lines[:full]
                lines = lines[full:]
        parts.append(last)
    if any(parts):
        lines.append(b"".join(parts))
    if len(lines) == 4:
        yield lines


def _text(values: list[bytes]) -> pa.Array:
    return pa.array([v.decode("utf-8", "replace") for v in values], pa.string())


def _batch(split: Split, row: int, columns: dict[str, list[bytes]]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    place = {"file": pa.array([split.file] * n, pa.string()), "split": pa.array([split.begin] * n, pa.int64()), "row": pa.array(range(row, row + n), pa.int64())}
    return pa.RecordBatch.from_pydict(place | {name: _text(v) for name, v in columns.items()})


def _sequences(record: bytes) -> tuple[bytes, bytes]:
    head, _, body = record.partition(b"\n")
    return head.lstrip(b">").rstrip(), body.replace(b"\n", b"")


def fasta_batches(split: Split) -> Iterator[pa.RecordBatch]:
    row = 0
    for records in fasta_records(split):
        for at in range(0, len(records), _RECORDS):
            found = [_sequences(r) for r in records[at : at + _RECORDS]]
            yield _batch(split, row, {"id": [h for h, _ in found], "sequence": [s for _, s in found]})
            row += len(found)


def fastq_batches(split: Split) -> Iterator[pa.RecordBatch]:
    row = 0
    for lines in fastq_lines(split):
        for at in range(0, len(lines), 4 * _RECORDS):
            part = lines[at : at + 4 * _RECORDS]
            yield _batch(split, row, {name: part[k::4] for k, name in enumerate(("id", "sequence", "strand", "quality"))})
            row += len(part) // 4


def paired_batches(forward: Split, first: int, n: int, backward: list[tuple[int, Split]]) -> Iterator[pa.RecordBatch]:
    """(read_no, id, fwd, bwd) of the ``n`` records of a forward split, of which the first has the number ``first``, by the splits of backward
    mates that hold these numbers, each with the number of its first record; records without a mate are left out."""

    def mates() -> Iterator[list[bytes]]:
        for at, split in backward:
            for lines in fastq_lines(split):
                found = lines[1::4]
                yield found[max(0, first - at) : max(0, first + n - at)]
                at += len(found)
                if at >= first + n:
                    break

    rest, others, number = [], mates(), first
    for lines in fastq_lines(forward):
        for a in range(0, len(lines), 4 * _RECORDS):
            part = lines[a : a + 4 * _RECORDS]
            ids, own = part[::4], part[1::4]
            while len(rest) < len(ids) and (more := next(others, None)) is not None:
                rest += more
            size = min(len(ids), len(rest))
            yield pa.RecordBatch.from_pydict({"read_no": pa.array(range(number, number + size), pa.int64()), "id": _text(ids[:size]), "fwd": _text(own[:size]), "bwd": _text(rest[:size])})
            rest, number = rest[size:], number + size
            if size < len(ids):
                return


_PLACE = "file string, split long, row long"


class _Reading:
    """What batch and stream readers share."""

    def __init__(self, kind: str, options: dict):
        self.kind, self.path = kind, options["path"]  # names are in lower case here
        self.size = int(options.get("splitbytes", SPLIT_BYTES))
        self.counts = str(options.get("counts", "false")).lower() == "true"

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if self.counts:
            found = fasta_records(split) if self.kind == "fasta" else (x[::4] for x in fastq_lines(split))
            yield pa.RecordBatch.from_pydict({"file": pa.array([split.file], pa.string()), "split": pa.array([split.begin], pa.int64()), "n": pa.array([sum(map(len, found))], pa.int64())})
            return
        yield from fasta_batches(split) if self.kind == "fasta" else fastq_batches(split)


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[Split]:
        # Without a file there is still one, empty, task.
        return splits_of(listed(self.path), self.size) or [Split(self.path, 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if split.end != 0:
            yield from super().read(split)


class _Stream(_Reading, DataSourceStreamReader):
    """Offsets are the names of the files that were seen: the folder is listed once a batch."""

    def initialOffset(self) -> dict:
        return {"files": []}

    def latestOffset(self) -> dict:
        return {"files": [name for name, _ in listed(self.path)]}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        new = set(end["files"]) - set(start["files"])
        return splits_of([(name, size) for name, size in listed(self.path) if name in new], self.size)

    def commit(self, end: dict) -> None:
        pass


class _Sequences(DataSource):
    FIELDS = ""

    def schema(self) -> str:
        return "file string, split long, n long" if str(self.options.get("counts", "false")).lower() == "true" else f"{_PLACE}, {self.FIELDS}"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.name(), dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.name(), dict(self.options))


class Fasta(_Sequences):
    """(file, split, row, id, sequence); options path, splitBytes, counts."""

    FIELDS = "id string, sequence string"

    @classmethod
    def name(cls) -> str:
        return "fasta"


class Fastq(_Sequences):
    """(file, split, row, id, sequence, strand, quality); options path, splitBytes, counts."""

    FIELDS = "id string, sequence string, strand string, quality string"

    @classmethod
    def name(cls) -> str:
        return "fastq"


def register(spark: SparkSession) -> None:
    """``spark.read.format("fasta")`` and ``format("fastq")``, also with ``readStream``."""
    for source in (Fasta, Fastq):
        spark.dataSource.register(source)
