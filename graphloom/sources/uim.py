"""Reader of length-delimited protobuf files in the language-neutral interchange format.

``decode`` works on any DataFrame with a ``content`` column, one task a file;
``sources.formats`` has the data source ``uim``, which cuts files at records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from graphloom.schema import INDEX_ITEM, ITEM_KINDS, NODE, NODE_KINDS, TOKEN_TYPES


def varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value; lengths give bytes, everything else an integer."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = int.from_bytes(data[at : at + size], "little"), at + size
        yield tag >> 3, value


def messages(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """Body, byte offset of the record, and its size with the length prefix."""
    at = 0
    while at < len(data):
        size, body = varint(data, at)
        yield data[body : body + size], at, body + size - at
        at = body + size


def _location(data: bytes) -> dict:
    f = dict(fields(data))
    return {"line": f.get(1, 0), "column": f.get(2, 0), "offset": f.get(3, 0)}


def _href(kind: str, **given) -> dict:
    return {"kind": kind, "node_id": None, "sym_id": None, "path": None, "offset": None, "blob_id": None, "end": None} | given


def _pair(data: bytes, first: str) -> dict:
    f = dict(fields(data))
    return {first: f[1].decode() if isinstance(f.get(1), bytes) else f.get(1, 0 if first != "path" else ""), "offset": f.get(2, 0)}


def token(data: bytes) -> dict:
    t = {"offset": 0, "type": TOKEN_TYPES[0], "href": None, "has_references": False, "sym_id": None, "real_offset": None, "real_line": None, "uim_location": None, "uim_elided": None}
    for n, v in fields(data):
        if n == 1:
            t["offset"] = v
        elif n == 2:
            t["type"] = TOKEN_TYPES[v]
        elif n == 3:
            t["href"] = _href("direct", node_id=v)
        elif n == 6:
            t["href"] = _href("id", node_id=v)
        elif n == 7:
            t["href"] = _href("sym", sym_id=v)
        elif n == 11:
            t["href"] = _href("uni", **_pair(v, "path"))
        elif n == 13:
            t["href"] = _href("token", **_pair(v, "node_id"))
        elif n == 5:
            t["has_references"] = bool(v)
        elif n in (8, 9, 10):
            t[{8: "sym_id", 9: "real_offset", 10: "real_line"}[n]] = v
        elif n == 12:
            t["uim_location"] = _location(v)
        elif n == 14:
            t["uim_elided"] = bool(v)
    return t


def node(data: bytes, with_tokens: bool = True) -> dict:
    d = {"id": 0, "kind": NODE_KINDS[0], "path": "", "container": None, "start": None, "text": "", "tokens": [], "member_of": None, "path_id": 0, "uim_reference_context": None, "uim_nest_level": None}
    names = {1: "id", 4: "container", 9: "path_id", 11: "uim_nest_level"}
    texts = {3: "path", 6: "text", 8: "member_of", 10: "uim_reference_context"}
    for n, v in fields(data):
        if n in names:
            d[names[n]] = v
        elif n in texts:
            d[texts[n]] = v.decode()
        elif n == 2:
            d["kind"] = NODE_KINDS[v]
        elif n == 5:
            d["start"] = _location(v)
        elif n == 7 and with_tokens:
            d["tokens"].append(token(v))
    return d


def item(data: bytes) -> dict:
    d = {"key": "", "href": None, "kind": ITEM_KINDS[0], "path": None, "type": None}
    for n, v in fields(data):
        if n in (1, 4, 5):
            d[{1: "key", 4: "path", 5: "type"}[n]] = v.decode()
        elif n == 2:
            d["href"] = _href("direct", node_id=v)
        elif n == 7:
            d["href"] = _href("id", node_id=v)
        elif n == 8:
            d["href"] = _href("uni", **_pair(v, "path"))
        elif n == 6:
            f = dict(fields(v))
            d["href"] = _href("slice", blob_id=f.get(1, 0), offset=f.get(2, 0), end=f.get(3, 0))
        elif n == 3:
            d["kind"] = ITEM_KINDS[v]
    return d


#: Plain fields by number that a filter may look at before a record is decoded.
EARLY = {"nodes": {"id": 1, "kind": 2, "path": 3}, "items": {"key": 1, "kind": 3}}
_NAMES = {"nodes": NODE_KINDS, "items": ITEM_KINDS}


def full_schema(kind: str) -> StructType:
    return StructType([*KINDS[kind][1].fields]).add("record_offset", LongType()).add("record_size", LongType())


def record(data: bytes, kind: str, names: set[str], wanted: dict[str, set], at: int, size: int) -> list[dict]:
    """The record with the fields of ``names``, or nothing if a plain field has none of its ``wanted`` values.

    Tokens are decoded only where they are asked for.
    """
    if wanted:
        plain = {n: v for n, v in fields(data) if n in EARLY[kind].values()}
        for name, values in wanted.items():
            raw = plain.get(EARLY[kind][name], b"" if name in ("path", "key") else 0)
            value = _NAMES[kind][raw] if name == "kind" else raw.decode() if isinstance(raw, bytes) else raw
            if value not in values:
                return []
    made = node(data, "tokens" in names) if kind == "nodes" else item(data)
    made |= {"record_offset": at, "record_size": size}
    return [{n: made[n] for n in made if n in names}]


KINDS = {"nodes": (node, NODE), "items": (item, INDEX_ITEM)}


def decode(files: DataFrame, kind: str) -> DataFrame:
    """Records of ``files`` (``content``) with ``record_offset`` and ``record_size``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    read, _ = KINDS[kind]
    full = full_schema(kind)
    arrow = to_arrow_schema(full)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out = [read(body) | {"record_offset": at, "record_size": size} for body, at, size in messages(content.as_py() or b"")]
                for k in range(0, len(out), 4096):
                    yield pa.RecordBatch.from_pylist(out[k : k + 4096], schema=arrow)

    return files.select("content").mapInArrow(rows, full)


def read(spark: SparkSession, path: str, kind: str = "nodes") -> DataFrame:
    """``nodes`` or ``items`` files under a path that Spark can read."""
    return decode(spark.read.format("binaryFile").load(path), kind)


def link_items(items: DataFrame, paths: DataFrame, spans: DataFrame, file_nodes: DataFrame) -> DataFrame:
    """Items whose link is a place (``uni``) get the node there; those of unknown paths drop out, others pass."""
    from graphloom.operators.spans import resolve_definitions

    place = items.where("href.kind = 'uni'").select("*", F.col("href.path").alias("_p"), F.col("href.offset").alias("_o"))
    links = place.select(F.col("_p").alias("path"), F.col("_o").alias("off")).distinct()
    found = resolve_definitions(links, paths, spans, file_nodes, repo_only=False).where("status = 'ok'").select(F.col("path").alias("_p"), F.col("off").alias("_o"), F.col("node_id").alias("_n"))
    moved = place.join(found, ["_p", "_o"]).withColumn("href", F.col("href").withField("kind", F.lit("id")).withField("node_id", F.col("_n")).withField("path", F.lit(None).cast("string")).withField("offset", F.lit(None).cast("long")))
    return items.where("href is null or href.kind <> 'uni'").unionByName(moved.select(items.columns))


def encode_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def encode_node(d: dict) -> bytes:
    """A node with its plain fields and token offsets and types, with length prefix (exporter and tests)."""
    number = lambda f, v: encode_varint(f << 3) + encode_varint(v) if v else b""
    text = lambda f, v: encode_varint(f << 3 | 2) + encode_varint(len(v)) + v if v else b""
    tokens = b"".join(text(7, number(1, t["offset"]) + number(2, TOKEN_TYPES.index(t["type"]))) or b"\x3a\x00" for t in d.get("tokens", []))
    body = number(1, d["id"]) + number(2, NODE_KINDS.index(d["kind"])) + text(3, d["path"].encode()) + number(4, d.get("container")) + text(6, d["text"].encode()) + tokens
    return encode_varint(len(body)) + body
