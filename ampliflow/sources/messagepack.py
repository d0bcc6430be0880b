"""MessagePack for databases: one document, structures as arrays of their fields in order; maps by name are read as well.

For exchange with other tools, like the JSON document, whose shape it has. Elements are packed side by side, and pieces of a megabyte are put one
after another into the file by one task, which holds one at a time; one task reads it as a stream of rows. Tables in Parquet are the form of this library.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliflow.operators.staging import stage
from ampliflow.sources.sequences import listed, opened

#: Fields in order; these are fixed by the format.
DATABASE = ("k", "regions", "names", "amplified")
REGION = ("primer", "unique_pairs", "unique_kmers", "matrix", "perfect_match")
MATRIX = ("cols", "data", "col_index", "row_index")

#: Lead bytes of the format, by kind: the short form's base and size, then lead bytes and struct codes of the longer forms.
_SIZED = {"str": (0xA0, 32, ((0xD9, "B"), (0xDA, "H"), (0xDB, "I"))), "array": (0x90, 16, ((0xDC, "H"), (0xDD, "I"))), "map": (0x80, 16, ((0xDE, "H"), (0xDF, "I"))), "bin": (0, 0, ((0xC4, "B"), (0xC5, "H"), (0xC6, "I")))}
_NUMBERS = {0xCA: "f", 0xCB: "d", 0xCC: "B", 0xCD: "H", 0xCE: "I", 0xCF: "Q", 0xD0: "b", 0xD1: "h", 0xD2: "i", 0xD3: "q"}
_LONGER = {lead: (kind, code) for kind, (_, _, forms) in _SIZED.items() for lead, code in forms}


def _head(kind: str, n: int) -> bytes:
    base, short, forms = _SIZED[kind]
    if n < short:
        return bytes([base | n])
    for lead, code in forms:
        if n < 1 << 8 * struct.calcsize(code):
            return struct.pack(f">B{code}", lead, n)
    raise ValueError("too long for MessagePack")


def _number(x: int) -> bytes:
    if -32 <= x < 128:
        return struct.pack("b", x) if x < 0 else bytes([x])
    for lead, code in ((0xCC, "B"), (0xCD, "H"), (0xCE, "I"), (0xCF, "Q")) if x > 0 else ((0xD0, "b"), (0xD1, "h"), (0xD2, "i"), (0xD3, "q")):
        bits = 8 * struct.calcsize(code) - (x < 0)
        if -(1 << bits) <= x < 1 << bits:
            return struct.pack(f">B{code}", lead, x)
    raise OverflowError("an integer of more than 64 bits")


def packed(value) -> bytes:
    """None, booleans, integers, floats, strings, bytes, lists and dictionaries."""
    out: list[bytes] = []

    def put(x) -> None:
        if x is None or isinstance(x, bool):
            out.append(b"\xc0" if x is None else b"\xc3" if x else b"\xc2")
        elif isinstance(x, int):
            out.append(_number(x))
        elif isinstance(x, float):
            out.append(struct.pack(">Bd", 0xCB, x))
        elif isinstance(x, (str, bytes)):
            data = x.encode() if isinstance(x, str) else x
            out.append(_head("str" if isinstance(x, str) else "bin", len(data)) + data)
        elif isinstance(x, (list, tuple)):
            out.append(_head("array", len(x)))
            for y in x:
                put(y)
        elif isinstance(x, dict):
            out.append(_head("map", len(x)))
            for item in x.items():
                put(item[0])
                put(item[1])
        else:
            raise TypeError(f"can't pack {type(x).__name__}")

    put(value)
    return b"".join(out)


def unpacked(data: bytes):
    """The value in ``data``; a cut or longer input is an error."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise EOFError("MessagePack ends early")
        at += n
        return data[at - n : at]

    def sized(kind: str, n: int):
        if kind == "str":
            return take(n).decode()
        if kind == "bin":
            return take(n)
        if kind == "array":
            return [get() for _ in range(n)]
        return {get(): get() for _ in range(n)}

    def get():
        lead = take(1)[0]
        if lead < 0x80 or lead >= 0xE0:
            return lead if lead < 0x80 else lead - 256
        if lead < 0xC0:
            kind = "map" if lead < 0x90 else "array" if lead < 0xA0 else "str"
            return sized(kind, lead & (31 if kind == "str" else 15))
        if lead in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[lead]
        if lead in _NUMBERS:
            return struct.unpack(f">{_NUMBERS[lead]}", take(struct.calcsize(_NUMBERS[lead])))[0]
        if lead in _LONGER:
            kind, code = _LONGER[lead]
            return sized(kind, struct.unpack(f">{code}", take(struct.calcsize(code)))[0])
        raise ValueError(f"MessagePack type {lead:#x} is not used in databases")

    value = get()
    if at < len(data):
        raise ValueError("more than one MessagePack value")
    return value


def _fields(x, names: tuple[str, ...]) -> dict:
    found = x if isinstance(x, dict) else dict(zip(names, x))
    if set(names) - set(found):
        raise ValueError(f"no {', '.join(sorted(set(names) - set(found)))} in the database")
    return found


def to_json(data: bytes) -> str:
    """The JSON document of a packed database."""
    doc = _fields(unpacked(data), DATABASE)
    regions = [_fields(r, REGION) for r in doc["regions"]]
    listed_ = lambda x: list(x) if isinstance(x, bytes) else x
    regions = [r | {"matrix": _fields(r["matrix"], MATRIX), "perfect_match": [int(x) for x in listed_(r["perfect_match"])]} for r in regions]
    return json.dumps(doc | {"regions": regions, "amplified": [int(x) for x in listed_(doc["amplified"])]})


def from_json(text: str) -> bytes:
    """A packed database from its JSON document."""
    doc = json.loads(text)
    regions = [[[float(x) for x in r[f]["data"]] if g == "data" else r[f][g] for g in MATRIX] if f == "matrix" else r[f] for r in doc["regions"] for f in REGION]
    rows = [regions[k : k + len(REGION)] for k in range(0, len(regions), len(REGION))]
    return packed([rows if f == "regions" else doc[f] for f in DATABASE])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A row ``value`` with the JSON document of each packed file at ``path``."""

    @F.pandas_udf("string")
    def documents(content: pd.Series) -> pd.Series:
        return content.map(lambda x: to_json(bytes(x)))

    return spark.read.format("binaryFile").load(path).select(documents("content").alias("value"))


def write_document(document: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes the one row ``value`` of ``document`` as a packed file; it has its name only when it is whole."""
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError(f"mode is 'errorifexists' or 'overwrite', not {mode!r}")
    try:
        if listed(path) and mode == "errorifexists":
            raise FileExistsError(path)
    except FileNotFoundError:
        pass

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame["value"]:
                system, inner = opened(path)
                part = f"{inner}.{uuid.uuid4().hex}.part"
                data = from_json(text)
                with system.open_output_stream(part) as f:
                    f.write(data)
                system.move(part, inner)
                yield pd.DataFrame({"bytes": [len(data)]})

    document.mapInPandas(write, "bytes long").collect()  # one number


#: Bytes of a piece of a document that is written, and of a file that is read at a time.
PIECE = 1 << 20
#: Rows of a batch of a document that is read.
_ROWS = 20_000
#: An element of a list of the document: the list and the place in it, and one or two integers, a string or a float.
ELEMENT = "list int, at long, also long, kind string, a long, b long, s string, x double"


def write_lists(elements: DataFrame, heads: list[bytes], path: str, mode: str = "errorifexists") -> None:
    """Writes ``heads[0]``, the array of the elements of list 0, ``heads[1]``, the array of list 1 and so on; ``elements`` are as ``ELEMENT`` says.

    The file has its name only when it is whole.
    """
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError(f"mode is 'errorifexists' or 'overwrite', not {mode!r}")
    try:
        if listed(path) and mode == "errorifexists":
            raise FileExistsError(path)
    except FileNotFoundError:
        pass

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, now, size, n, out = 0, None, 0, 0, []
        for frame in frames:
            for which, part, kind, a, b, s, x in zip(*[frame[c].tolist() for c in ("list", "part", "kind", "a", "b", "s", "x")]):
                if out and (which != now[0] or size >= PIECE):
                    yield pd.DataFrame({"list": [now[0]], "part": [now[1]], "seq": [seq], "n": [n], "data": [b"".join(out)]})
                    seq, size, n, out = seq + 1, 0, 0, []
                now = which, part
                data = packed(s if kind == "string" else x if kind == "float" else int(a) if kind == "int" else [int(a), int(b)])
                out.append(data)
                size, n = size + len(data), n + 1
        if out:
            yield pd.DataFrame({"list": [now[0]], "part": [now[1]], "seq": [seq], "n": [n], "data": [b"".join(out)]})

    order = ["list", "at", "also"]
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("a", "b")]  # as floats, pandas would lose digits
    rows = elements.select(*order, "kind", *numbers, "s", "x").repartitionByRange(*order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)
    found = stage(rows.mapInPandas(pieces, "list int, part int, seq int, n long, data binary"), "messagepack-pieces")
    sizes = {r["list"]: r["n"] for r in found.groupBy("list").agg(F.sum("n").alias("n")).collect()}  # lists are few for each region
    starts = [head + _head("array", sizes.get(n, 0)) for n, head in enumerate(heads)]

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, inner = opened(path)
        part, begun = f"{inner}.{uuid.uuid4().hex}.part", 0
        with system.open_output_stream(part) as f:
            for frame in frames:
                for which, data in zip(frame["list"], frame["data"]):
                    f.write(b"".join(starts[begun : which + 1]))
                    begun = max(begun, which + 1)
                    f.write(data)
            f.write(b"".join(starts[begun:]))
        system.move(part, inner)
        yield pd.DataFrame({"done": [True]})

    # A few rows at a time: each is a piece.
    spark = elements.sparkSession
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "16")
    try:
        found.repartition(1).sortWithinPartitions("list", "part", "seq").mapInPandas(write, "done boolean").collect()  # one row
    finally:
        spark.conf.set(name, before)


class _Stream:
    """Values of a stream, one after another; lists are walked through, never held."""

    def __init__(self, f):
        self.f, self.data, self.at = f, b"", 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            parts, size = [self.data[self.at :]], len(self.data) - self.at
            while size < n:
                block = self.f.read(PIECE)
                if not block:
                    raise EOFError("MessagePack ends early")
                parts.append(block)
                size += len(block)
            self.data, self.at = b"".join(parts), 0
        self.at += n
        return self.data[self.at - n : self.at]

    def ended(self) -> bool:
        if self.at < len(self.data):
            return False
        self.data, self.at = self.f.read(PIECE), 0
        return not self.data

    def head(self):
        """(kind, number) of what is sized, and (None, value) of what is read already."""
        lead = self.take(1)[0]
        if lead < 0x80 or lead >= 0xE0:
            return None, lead if lead < 0x80 else lead - 256
        if lead < 0xC0:
            kind = "map" if lead < 0x90 else "array" if lead < 0xA0 else "str"
            return kind, lead & (31 if kind == "str" else 15)
        if lead in (0xC0, 0xC2, 0xC3):
            return None, {0xC0: None, 0xC2: False, 0xC3: True}[lead]
        if lead in _NUMBERS:
            return None, struct.unpack(f">{_NUMBERS[lead]}", self.take(struct.calcsize(_NUMBERS[lead])))[0]
        if lead in _LONGER:
            kind, code = _LONGER[lead]
            return kind, struct.unpack(f">{code}", self.take(struct.calcsize(code)))[0]
        raise ValueError(f"MessagePack type {lead:#x} is not used in databases")

    def value(self):
        kind, n = self.head()
        if kind == "str":
            return self.take(n).decode()
        if kind == "bin":
            return self.take(n)
        if kind == "array":
            return [self.value() for _ in range(n)]
        return n if kind is None else {self.value(): self.value() for _ in range(n)}

    def skip(self) -> None:
        kind, n = self.head()
        if kind in ("str", "bin"):
            self.take(n)
        elif kind:
            for _ in range(n if kind == "array" else 2 * n):
                self.skip()

    def each(self) -> Iterator:
        """The elements of a list; of bytes, numbers."""
        kind, n = self.head()
        if kind == "bin":
            yield from self.take(n)
        elif kind != "array":
            raise ValueError("a list is missing in the database")
        else:
            for _ in range(n):
                yield self.value()

    def length(self) -> int:
        kind, n = self.head()
        if kind != "array":
            raise ValueError("a list is missing in the database")
        return n

    def fields(self, names: tuple[str, ...]) -> Iterator[str]:
        """The names of the fields of a structure, each when its value is next."""
        kind, n = self.head()
        if kind not in ("array", "map"):
            raise ValueError("a structure is missing in the database")
        seen = set()
        for k in range(n):
            name = self.value() if kind == "map" else names[k] if k < len(names) else None
            if name in names:
                seen.add(name)
                yield name
            else:
                self.skip()
        if set(names) - seen:
            raise ValueError(f"no {', '.join(sorted(set(names) - seen))} in the database")


#: A value of a document: its field, the region, the place in its list, and the integers, string or float that it is.
_VALUE = "field string, region int, at long, a long, b long, s string, x double"


def _values(f) -> Iterator[tuple]:
    """(field, region, place, a, b, s, x) of a document."""
    stream = _Stream(f)

    def numbers(field: str, region: int) -> Iterator[tuple]:
        return ((field, region, at, int(v), 0, None, 0.0) for at, v in enumerate(stream.each()))

    def strings(field: str, region: int) -> Iterator[tuple]:
        return ((field, region, at, 0, 0, v, 0.0) for at, v in enumerate(stream.each()))

    def region(r: int) -> Iterator[tuple]:
        for field in stream.fields(REGION):
            if field == "primer":
                fwd, bwd = stream.value()
                yield "primer", r, 0, 0, 0, json.dumps([fwd, bwd]), 0.0
            elif field == "unique_pairs":
                yield from ((field, r, at, v[0], v[1], None, 0.0) for at, v in enumerate(stream.each()))
            elif field == "unique_kmers":
                n = stream.length()
                for k in range(n):
                    yield from strings(("fwd", "bwd")[k], r)
            elif field == "perfect_match":
                yield from numbers(field, r)
            else:
                for inner in stream.fields(MATRIX):
                    if inner == "cols":
                        stream.skip()
                    elif inner == "data":
                        yield from ((inner, r, at, 0, 0, None, float(v)) for at, v in enumerate(stream.each()))
                    else:
                        yield from numbers(inner, r)

    for field in stream.fields(DATABASE):
        if field == "k":
            yield "k", 0, 0, int(stream.value()), 0, None, 0.0
        elif field == "regions":
            for r in range(stream.length()):
                yield from region(r)
        elif field == "names":
            yield from strings(field, 0)
        else:
            yield from numbers(field, 0)
    if not stream.ended():
        raise ValueError("more than one MessagePack value")


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """The values of the packed file at ``path`` as ``_VALUE`` says, read by one task that holds a batch of them."""
    files = [name for name, _ in listed(path)]
    names = [x.split()[0] for x in _VALUE.split(", ")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name in frame["file"]:
                system, inner = opened(name)
                rows = []
                with system.open_input_stream(inner) as f:
                    for row in _values(f):
                        rows.append(row)
                        if len(rows) == _ROWS:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    given = spark.createDataFrame([(name,) for name in files[:1]], "file string")
    return stage(given.repartition(1).mapInPandas(read, _VALUE), "messagepack-values")
