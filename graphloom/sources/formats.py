"""Data sources: ``uim`` (interchange files) and ``jsondocs`` (JSON documents one after another).

    register(spark)
    spark.read.format("uim").option("kind", "nodes").schema("id long, path string").load(folder)
    df.write.format("jsondocs").mode("append").save(folder)

Paths are those of ``pyarrow.fs``: plain or ``file:``, and ``hdfs:``, ``s3:`` or
``gs:`` where the workers have them. A ``uim`` file is cut at records into
partitions of about ``partitionBytes``; only the fields of the schema are
decoded, and records that a pushed filter on ``kind``, ``path`` or ``id`` rules
out are not decoded further. ``jsondocs`` needs no delimiter between documents:
they are told apart by the depth of braces and brackets outside strings. Both
writers put files under ``_temporary`` and move them at commit; aborted jobs
leave nothing.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from graphloom.runtime import prepare
from graphloom.sources import uim

PARTITION_BYTES = 64 << 20
#: Bytes that are read at a time.
CHUNK = 1 << 20
#: Records of an Arrow batch.
BATCH = 1024


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """Files at or below ``path`` with their sizes, without names that begin with ``_`` or ``.``."""
    system, root = _open(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    below = [f for f in found if f.type == fs.FileType.File and not any(p[:1] in ("_", ".") for p in f.path[len(root) :].strip("/").split("/"))]
    return sorted((f.path, f.size) for f in below)


@dataclass
class Range(InputPartition):
    """Bytes of one file, or of whole records in it."""

    file: str
    start: int
    end: int


def records(stream, size: int, start: int = 0) -> Iterator[tuple[int, int, int]]:
    """Start, body start and end of each length-delimited record; bodies are skipped, not read."""
    at = start
    while at < size:
        stream.seek(at)
        head = stream.read(10)
        length, body = uim.varint(head, 0)
        yield at, at + body, at + body + length
        at += body + length


def cut(stream, size: int, most: int) -> list[tuple[int, int]]:
    """Ranges of whole records of at least ``most`` bytes each, but for the last."""
    out, begin = [], 0
    for _, _, end in records(stream, size):
        if end - begin >= most:
            out.append((begin, end))
            begin = end
    return [*out, (begin, size)] if begin < size else out


class UimReader(DataSourceReader):
    def __init__(self, path: str, kind: str, schema: StructType, most: int) -> None:
        self.path, self.kind, self.schema, self.most = path, kind, schema, most
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on single columns narrow what is decoded; Spark still applies them."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in uim.EARLY.get(self.kind, ()):
                values = set(f.value) if isinstance(f, In) else {f.value}
                own = self.wanted.setdefault(f.attribute[0], values)
                own &= values
            yield f

    def partitions(self) -> list[Range]:
        system, _ = _open(self.path)
        out = []
        for file, size in files(self.path):
            with system.open_input_file(file) as stream:
                out += [Range(file, a, b) for a, b in cut(stream, size, self.most)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = _open(self.path)
        names, arrow = set(self.schema.names), to_arrow_schema(self.schema)
        held: list[dict] = []
        with system.open_input_file(part.file) as stream:
            at = part.start
            while at < part.end:
                stream.seek(at)
                data, base = stream.read(min(max(CHUNK, 10), part.end - at)), at
                place = 0
                while place < len(data):
                    try:
                        length, body = uim.varint(data, place)
                    except IndexError:  # the chunk ends within a length
                        break
                    if body + length > len(data):
                        if place == 0:  # a record longer than a chunk
                            stream.seek(base + body)
                            whole = stream.read(length)
                            held += uim.record(whole, self.kind, names, self.wanted, base, body + length)
                            place = body + length
                        break
                    held += uim.record(data[body : body + length], self.kind, names, self.wanted, base + place, body + length - place)
                    place = body + length
                    if len(held) >= BATCH:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held = []
                at = base + place
                if not place:
                    raise ValueError(f"{part.file}: a record is cut off at byte {at}")
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)


class Uim(DataSource):
    """Options: ``kind`` (``nodes`` or ``items``), ``partitionBytes``. The schema may be any part of the full one."""

    @classmethod
    def name(cls) -> str:
        return "uim"

    def _kind(self) -> str:
        kind = self.options.get("kind", "nodes")
        if kind not in uim.KINDS:
            raise ValueError(f"kind {kind!r}: nodes or items")
        return kind

    def schema(self) -> StructType:
        return uim.full_schema(self._kind())

    def reader(self, schema: StructType) -> UimReader:
        return UimReader(self.options["path"], self._kind(), schema, int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        """Nodes with their plain fields and the offsets and types of their tokens."""
        if self._kind() != "nodes":
            raise ValueError("only nodes can be written")
        return RecordWriter(self.options["path"], overwrite, "uim", uim.encode_node)


_QUOTE, _ESCAPE = ord('"'), ord("\\")


class Documents:
    """Cuts bytes that come in chunks into JSON documents; state is the depth, and whether a string or an escape is open."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.depth, self.string, self.escaped = 0, False, False

    def feed(self, data: bytes) -> Iterator[bytes]:
        raw = np.frombuffer(data, np.uint8)
        # Only quotes, backslashes and brackets change the state; the bytes between are skipped.
        marks = np.flatnonzero((raw == _QUOTE) | (raw == _ESCAPE) | np.isin(raw, list(b"{}[]")))
        begin, after_escape = 0, 0 if self.escaped else -1
        self.escaped = False
        for at in marks.tolist():
            if at == after_escape:
                continue
            c = data[at]
            if self.string:
                if c == _ESCAPE:
                    after_escape = at + 1
                elif c == _QUOTE:
                    self.string = False
            elif c == _QUOTE:
                self.string = True
            elif c in b"{[":
                if not self.depth:
                    if data[begin:at].strip(b" \t\r\n,"):
                        raise ValueError(f"not a document: {data[begin:at][:40]!r}")
                    begin = at
                self.depth += 1
            elif c in b"}]":
                self.depth -= 1
                if self.depth < 0:
                    raise ValueError("a bracket closes that was not opened")
                if not self.depth:
                    yield b"".join([*self.parts, data[begin : at + 1]])
                    self.parts, begin = [], at + 1
        self.escaped = after_escape == len(data) and after_escape > 0
        rest = data[begin:]
        if self.depth:
            self.parts.append(rest)
        elif rest.strip(b" \t\r\n,") or self.string:
            raise ValueError(f"not a document: {rest[:40]!r}")

    def end(self) -> None:
        if self.depth:
            raise ValueError("the last document is cut off")


class JsonReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Range]:
        return [Range(f, 0, n) for f, n in files(self.path)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        docs, held, size = Documents(), [], 0
        with system.open_input_file(part.file) as stream:
            while data := stream.read(CHUNK):
                for one in docs.feed(data):
                    held.append(one.decode())
                    size += len(one)
                    if size >= CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(held)], ["value"])
                        held, size = [], 0
        docs.end()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held)], ["value"])


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


def _json_bytes(row: dict) -> bytes:
    return json.dumps(row, ensure_ascii=False, separators=(",", ":"), default=str).encode()


class RecordWriter(DataSourceWriter):
    """One file a task, each row encoded and appended; written beside and moved when the job commits."""

    def __init__(self, path: str, overwrite: bool, suffix: str, encode: Callable[[dict], bytes]) -> None:
        self.path, self.overwrite, self.suffix, self.encode, self.job = path, overwrite, suffix, encode, uuid.uuid4().hex

    def _root(self) -> tuple[fs.FileSystem, str]:
        system, root = _open(self.path)
        return system, root.rstrip("/")

    def write(self, rows: Iterator) -> Written:
        system, root = self._root()
        folder, name, n = f"{root}/_temporary/{self.job}", f"part-{uuid.uuid4().hex}.{self.suffix}", 0
        stream = None
        try:
            for row in rows:
                if stream is None:  # tasks without rows leave no file
                    system.create_dir(folder, recursive=True)
                    stream = system.open_output_stream(f"{folder}/{name}")
                stream.write(self.encode(row.asDict(recursive=True)))
                n += 1
        finally:
            if stream is not None:
                stream.close()
        return Written(name if n else None, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = self._root()
        old = files(self.path) if self.overwrite and system.get_file_info(root).type == fs.FileType.Directory else []
        system.create_dir(root, recursive=True)
        for m in messages:
            if m is not None and m.name:
                system.move(f"{root}/_temporary/{self.job}/{m.name}", f"{root}/{m.name}")
        for file, _ in old:
            system.delete_file(file)
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        system, root = self._root()
        with contextlib.suppress(FileNotFoundError):
            system.delete_dir(f"{root}/_temporary/{self.job}")
        with contextlib.suppress(OSError):
            if not system.get_file_info(fs.FileSelector(f"{root}/_temporary")):
                system.delete_dir(f"{root}/_temporary")


class JsonDocs(DataSource):
    """Reads ``value string``, one document a row; writes each row as an object."""

    @classmethod
    def name(cls) -> str:
        return "jsondocs"

    def schema(self) -> StructType:
        return StructType().add("value", "string")

    def reader(self, schema: StructType) -> JsonReader:
        return JsonReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], overwrite, "json", _json_bytes)


def register(spark: SparkSession) -> None:
    """Make both formats known to the session, and let it push filters to them."""
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Uim, JsonDocs):
        spark.dataSource.register(source)
