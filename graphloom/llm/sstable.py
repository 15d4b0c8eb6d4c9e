"""Sorted-string-table shards of token ids.

File, little-endian throughout: blocks, then index, Bloom filter and footer.

* block: zstd of its entries.
* entry: varint bytes shared with the previous key, varint other key bytes,
  varint token count, the other key bytes, token ids (unsigned, of the file's
  width: 2 bytes where the vocabulary allows, else 4). Keys are document
  identifiers in an order-preserving form; the first entry of a block shares
  nothing.
* index: one line for each block: varint key length, first key, and 64-bit
  offset, stored length, and tokens in the file before the block.
* filter: bits for every key, ``FILTER_HASHES`` of them each.
* footer: offsets of index and filter, entries, blocks, tokens, width, magic (64-bit each).

A lookup reads the footer, tests the filter, searches the index by halves and
decodes one block.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from graphloom.llm import blocks as B
from graphloom.runtime import prepare, scratch

MAGIC = 0x31454C4241545353
FOOTER = struct.Struct("<7Q")
INDEX_TAIL = struct.Struct("<3Q")
BLOCK_TARGET = 64 << 10
FILTER_BITS = 10
FILTER_HASHES = 7
#: Documents in a shard, about; shards are ranges of identifiers.
SHARD_ROWS = 20_000
#: Distinct units that a worker remembers, and their bytes.
CACHE_UNITS = 1_000_000
CACHE_BYTES = 64 << 20
ENCODE_BYTES = 4 << 20


def key_of(doc_id: int | None) -> bytes:
    """Order-preserving key: nulls first, then signed order."""
    return b"\x00" if doc_id is None else b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at += 1
        if b < 128:
            return n, at
        shift += 7


def _filter_places(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<2Q", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + k * b) % bits for k in range(FILTER_HASHES)]


class Writer:
    """Writes entries, given in key order, to a binary stream."""

    def __init__(self, out, width: int) -> None:
        self.width, self.pack = width, zstandard.ZstdCompressor(level=1).compress
        self.out, self.at, self.tokens, self.entries = out, 0, 0, 0
        self.block, self.first, self.before, self.last = bytearray(), b"", 0, b""
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []

    def add(self, key: bytes, ids: bytes) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first, self.before = key, self.tokens
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids) // self.width) + key[shared:] + ids
        self.last = key
        self.keys.append(key)
        self.entries += 1
        self.tokens += len(ids) // self.width
        if len(self.block) >= BLOCK_TARGET:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            stored = self.pack(bytes(self.block))
            self.out.write(stored)
            self.index.append((self.first, self.at, len(stored), self.before))
            self.at += len(stored)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + INDEX_TAIL.pack(a, n, t) for k, a, n, t in self.index)
        bits = max(64, len(self.keys) * FILTER_BITS)
        held = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _filter_places(key, bits):
                held[p >> 3] |= 1 << (p & 7)
        self.out.write(index + struct.pack("<Q", bits) + bytes(held))
        self.out.write(FOOTER.pack(self.at, self.at + len(index), self.entries, len(self.index), self.tokens, self.width, MAGIC))


class Reader:
    """Reads a shard from a random-access binary stream."""

    def __init__(self, stream) -> None:
        self.stream = stream
        size = stream.size() if callable(getattr(stream, "size", None)) else stream.seek(0, 2)
        stream.seek(size - FOOTER.size)
        index_at, filter_at, self.entries, self.blocks, self.tokens, self.width, magic = FOOTER.unpack(stream.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        stream.seek(index_at)
        tail = stream.read(size - FOOTER.size - index_at)
        self.filter_bits = struct.unpack_from("<Q", tail, filter_at - index_at)[0]
        self.filter = tail[filter_at - index_at + 8 :]
        self.index, at = [], 0
        for _ in range(self.blocks):
            n, at = _read_varint(tail, at)
            self.index.append((tail[at : at + n], *INDEX_TAIL.unpack_from(tail, at + n)))
            at += n + INDEX_TAIL.size

    def block(self, number: int) -> Iterator[tuple[bytes, int, bytes]]:
        """Key, tokens of the file before the entry, and ids."""
        _, at, length, before = self.index[number]
        self.stream.seek(at)
        data = zstandard.ZstdDecompressor().decompress(self.stream.read(length))
        place, key = 0, b""
        while place < len(data):
            shared, place = _read_varint(data, place)
            more, place = _read_varint(data, place)
            n, place = _read_varint(data, place)
            key = key[:shared] + data[place : place + more]
            place += more
            yield key, before, data[place : place + self.width * n]
            place += self.width * n
            before += n

    def __iter__(self) -> Iterator[tuple[bytes, int, bytes]]:
        for k in range(self.blocks):
            yield from self.block(k)

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """Token ids of the entries with this identifier; mostly one, none if absent."""
        key = key_of(doc_id)
        if not all(self.filter[p >> 3] >> (p & 7) & 1 for p in _filter_places(key, self.filter_bits)):
            return []
        k = bisect_right([i[0] for i in self.index], key) - 1
        while k > 0 and self.index[k][0] == key:  # entries of a repeated identifier may begin earlier
            k -= 1
        out = []
        for n in range(max(k, 0), self.blocks):
            if self.index[n][0] > key:
                break
            out += [np.frombuffer(ids, f"<u{self.width}") for own, _, ids in self.block(n) if own == key]
        return out


class Encoder:
    """The tokenizers library over units that its own splitting never joins.

    Byte-level BPE encodes each piece of its splitting pattern by itself, and a
    piece never spans the places at which a text is cut here, so encoding the
    distinct units of a block once and putting ids together gives the library's
    ids for whole texts. Within a block equal units are found by a 64-bit hash
    that is not polynomial; units are remembered by their bytes.
    """

    _OK = B.lut(range(0x21, 0x7F)) | B.lut(range(0xC3, 0xC4))
    _LETTER = B.lut(range(65, 91)) | B.lut(range(97, 123))
    _STOP = B.lut(b".,;:!?|")

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        self.tokenizer = Tokenizer.from_file(path)
        known = json.loads(self.tokenizer.to_str())
        split = known["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        #: Only for this way of splitting are the cuts known to be safe; other tokenizers get whole texts.
        self.cuttable = plain and not known["normalizer"]
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end_id) <= 1 << 16 else 4
        self.type = np.dtype(f"<u{self.width}")
        self.end = end_id
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool = np.zeros(1 << 16, self.type)
        self.begin = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.used = self.held = 0

    def _learn(self, keys: list[bytes]) -> None:
        flat: list[int] = []
        first = len(self.known)
        need = first + len(keys)
        if need > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros(need, np.int64)]) for x in (self.begin, self.size))
        for k, e in enumerate(self.tokenizer.encode_batch_fast([k.decode() for k in keys], add_special_tokens=False)):
            ids = e.ids
            self.begin[first + k] = self.used + len(flat)
            self.size[first + k] = len(ids)
            flat += ids
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) + len(flat), self.type)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.held += sum(map(len, keys))
        self.known.update(zip(keys, range(first, need), strict=True))

    def cuts(self, block: B.Block) -> np.ndarray:
        """Offsets at which units begin."""
        d = block.data
        n = len(d)
        begins = np.zeros(n + 1, bool)
        if n > 2:
            solid = self._OK[d]
            solid[1:] |= (d[:-1] == 0xC3)  # second byte of a Latin-1 letter or sign
            before, here, after = d[:-2], d[1:-1], d[2:]
            space = (here == 0x20) & solid[:-2] & solid[2:]
            line = (here == 0x0A) & solid[:-2] & solid[2:]
            begins[1 : n - 1] |= space | line
            begins[2:n] |= line
            # a letter, then a stop: the run of letters ends there
            begins[1:n] |= self._LETTER[d[:-1]] & self._STOP[d[1:]]
        begins[block.offs] = True
        return np.flatnonzero(begins[:n])

    def encode(self, block: B.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's texts, each followed by the end id, and where each text's ids begin."""
        raw = block.data.tobytes()
        if not self.cuttable or any(s in raw for s in self.special):
            return self._whole(block, raw)
        d, start = block.data, self.cuts(block)
        end = np.append(start[1:], len(d))
        _, first, inverse = np.unique(B.range_hash(d, start, end), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_UNITS or self.held > CACHE_BYTES:
            self.reset()
        keys = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        new = [k for k in keys if k not in self.known]
        if new:
            self._learn(new)
        place = np.fromiter((self.known[k] for k in keys), np.int64, len(keys))[inverse]
        n = self.size[place]
        # every text gets one more unit, the end id
        text_of_unit = np.searchsorted(start, block.offs)
        total = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        at_text = total[text_of_unit] + np.arange(block.n + 1)
        out = np.full(int(total[-1]) + block.n, self.end, self.type)
        inside = np.ones(len(out), bool)
        inside[at_text[1:] - 1] = False
        source = np.repeat(self.begin[place] - total[:-1], n)
        source += np.arange(len(source))
        out[inside] = self.pool[source]
        return out, at_text

    def _whole(self, block: B.Block, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Whole texts are left to the library: those with the string of a special token, and those of other tokenizers."""
        texts = [raw[a:b].decode() for a, b in zip(block.offs[:-1], block.offs[1:], strict=True)]
        parts = [[*e.ids, self.end] for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        at = np.zeros(block.n + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=at[1:])
        return np.array([x for p in parts for x in p], self.type), at


_encoders: dict[tuple[str, int], Encoder] = {}


def _encoder(tokenizer: str, end_id: int) -> Encoder:
    if (tokenizer, end_id) not in _encoders:
        _encoders[tokenizer, end_id] = Encoder(tokenizer, end_id)
    return _encoders[tokenizer, end_id]


def encoded(docs: DataFrame, tokenizer: str, end_id: int, cut: list[int]) -> DataFrame:
    """``shard, doc_id, ids``: little-endian ids of each whole text and the end id; null texts have that alone.

    The shard is the number of bounds at or under the identifier, 0 for nulls.
    Identifiers must be integers; others raise a TypeError.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError(f"doc_id must be an integer, not {docs.schema['doc_id'].dataType.simpleString()}")
    prepare(docs.sparkSession)
    limits = np.array(cut, np.int64)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, end_id)
        for batch in batches:
            for block in B.blocks(batch.column(1), ENCODE_BYTES):
                flat, at = encoder.encode(block)
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), block.n, [None, pa.py_buffer(at * encoder.width), pa.py_buffer(flat)])
                own = batch.column(0).slice(block.row, block.n)
                place = np.searchsorted(limits, own.fill_null(0).to_numpy(zero_copy_only=False), side="right")
                shard = np.where(own.is_null().to_numpy(zero_copy_only=False), 0, place).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), own, ids.cast(pa.binary())], ["shard", "doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, "shard int, doc_id long, ids binary")


def bounds(docs: DataFrame, shards: int) -> list[int]:
    """Identifiers at which the shards after the first begin; fewer if identifiers repeat."""
    if shards < 2:
        return []
    cut = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [k / shards for k in range(1, shards)], 100_000).alias("q")).collect()[0]["q"]
    return sorted(set(cut or []))


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Write shards in ascending identifier order; ``shard, path, entries, tokens`` of each.

    Ids travel to the shard that holds their identifier's range; each task
    sorts and writes one file. A file is written under another name and then
    moved, and its content depends on the data alone, so a task that runs again
    leaves the same file.
    """
    spark = docs.sparkSession
    rows = docs.count()
    shards = max(1, -(-rows // shard_rows))
    cut = bounds(docs, shards)
    dealt = encoded(docs, tokenizer, end_id, cut).repartitionById(len(cut) + 1, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "ids")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        width = _encoder(tokenizer, end_id).width
        done = []
        number, writer, stream, name = None, None, None, ""

        def finish() -> None:
            writer.close()
            stream.close()
            where.move(name, f"{root}/{number:08d}.sst")
            done.append((number, f"{folder}/{number:08d}.sst", writer.entries, writer.tokens))

        for batch in batches:
            for shard, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if shard != number:
                    if writer is not None:
                        finish()
                    number, name = shard, f"{root}/.{shard:08d}.{uuid.uuid4().hex}"
                    stream = where.open_output_stream(name)
                    writer = Writer(stream, width)
                writer.add(key_of(doc_id), ids.as_buffer().to_pybytes())
        if writer is not None:
            finish()
        columns = list(zip(*done, strict=True)) or [(), (), (), ()]
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "path", "entries", "tokens"])

    manifest = f"{folder}/manifest.parquet"
    dealt.mapInArrow(store, "shard int, path string, entries long, tokens long").write.parquet(manifest)
    return spark.read.parquet(manifest)


def read(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every entry, from the files.

    ``start`` counts the tokens of all entries before, in file order. The
    driver holds one row for each file.
    """
    files = manifest.select("shard", "path", "tokens").orderBy("shard").collect()
    before, rows = 0, []
    for f in files:
        rows.append((f["path"], before))
        before += f["tokens"]
    spark = manifest.sparkSession
    listed = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_file(name) as stream:
                    reader = Reader(stream)
                    for k in range(reader.blocks):
                        got = [
                            (id_of(key), start + at, len(ids) // reader.width, zlib.crc32(np.frombuffer(ids, f"<u{reader.width}").astype("<u4")))
                            for key, at, ids in reader.block(k)
                        ]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Write the shards of ``docs`` and read them back.

    Null identifiers come first. Rows that repeat an identifier are entries of
    their own, ordered by their ids. Without rows there are no files. ``folder``
    is any URI that pyarrow opens; by default one under the shared folder.
    """
    return read(write(docs, tokenizer, folder or _uri(scratch(docs.sparkSession, "tokens")), end_id, shard_rows))


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


def open_shard(path: str) -> Reader:
    where, name = fs.FileSystem.from_uri(path)
    return Reader(where.open_input_file(name))


def session_folder(spark: SparkSession) -> str:
    return _uri(scratch(spark, "tokens"))
