"""Whole texts as numpy arrays: word boundaries, word hashes and window hashes.

A batch of texts is cut, between documents, into blocks of about
``BLOCK_BYTES`` so that the working arrays of a task stay small whatever the
batch size is; one very long text is a block of its own. All hashes are 64-bit
and depend on the content alone, so they agree between tasks and runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 512 << 10
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def lut(chars: bytes | range) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


SPACES = lut(b"\x20\x09\x0a\x0b\x0c\x0d")
NOT_SPACE = ~SPACES
IDENTITY = np.arange(256, dtype=np.uint8)
FOLD = IDENTITY.copy()
FOLD[65:91] += 32
#: Bytes of normalised words: ASCII letters and digits and everything beyond ASCII.
ALNUM = lut(range(128, 256)) | lut(range(48, 58)) | lut(range(65, 91)) | lut(range(97, 123))


@dataclass
class Block:
    """Texts ``row`` to ``row + n`` of a batch: UTF-8 bytes, and where each text begins."""

    row: int
    n: int
    data: np.ndarray
    offs: np.ndarray


def blocks(texts: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Null texts count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, values = texts.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offs, offs[row] + size, side="right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield Block(row, end - row, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row])
        row = end


@dataclass
class Words:
    """Words of a block in order: byte range, text index and hash; ``first`` has each text's first word."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray


#: Ranges of more bytes are hashed by blake2b, one by one.
_LANES = 8
_LANE_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U)


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte range of ``data``.

    Eight bytes at a time are mixed into a state that begins with the length.
    The mixing is bijective and not linear, so ranges of one length that differ
    within one such step never have equal hashes, and no structure of a text
    makes equal ones likelier. Ranges of over ``8 * _LANES`` bytes take the
    first 64 bits of blake2b.
    """
    size = end - start
    state = mix(size.astype(U) * U(0x9E3779B97F4A7C15) + U(0x5851F42D4C957F2D))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    rest = np.flatnonzero((size > 0) & (size <= 8 * _LANES))
    for k in range(_LANES):
        if not len(rest):
            break
        left = size[rest] - 8 * k
        lane = lanes[start[rest] + 8 * k] & _LANE_MASK[np.minimum(left, 8)]
        state[rest] = mix(state[rest] ^ lane)
        rest = rest[left > 8]
    for i in np.flatnonzero(size > 8 * _LANES).tolist():
        state[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return state


def words(block: Block, inside: np.ndarray = NOT_SPACE, fold: np.ndarray = IDENTITY) -> Words:
    """Maximal runs of ``inside`` bytes; texts bound them."""
    n = len(block.data)
    flag = np.zeros(n + 2, dtype=np.int8)
    flag[1:-1] = inside[block.data]
    step = np.diff(flag)
    begins, ends = step[: n + 1] == 1, step[: n + 1] == -1
    cuts = block.offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    both = cuts[(flag[cuts] == 1) & (flag[cuts + 1] == 1)]
    begins[both] = True
    ends[both] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    first = np.searchsorted(start, block.offs)
    doc = np.repeat(np.arange(block.n), np.diff(first))
    data = block.data if fold is IDENTITY else fold[block.data]
    return Words(start, end, doc, range_hash(data, start, end), first)


_MULT = [U(pow(0x9FB21C651E98DF25, k, 1 << 64)) for k in range(64)]


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the words that begin a window of ``k`` words of one text, and the windows' hashes."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.flatnonzero(w.doc[:n] == w.doc[k - 1 :])
    total = w.hash[:n] * _MULT[0]
    for j in range(1, k):
        total += w.hash[j : n + j] * _MULT[j]
    return at, mix(total[at])


def repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: does it equal an earlier one; does it equal any other."""
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, dtype=bool)
    ordered = key[order]
    same[1:-1] = ordered[1:] == ordered[:-1]
    later, shared = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order] = same[:-1]
    shared[order] = same[:-1] | same[1:]
    return later, shared


def in_doc(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that differ between texts of a block."""
    return mix(key + (doc.astype(U) + U(1)) * U(0x9E3779B97F4A7C15))


def hash_words(items: list[str], fold: np.ndarray = FOLD) -> np.ndarray:
    """The hashes that ``words`` gives these words."""
    block = next(blocks(pa.array([" ".join(items)], pa.string())), None)
    return words(block, fold=fold).hash if block else np.zeros(0, U)
