"""Vector codes: product quantisation whose nearest entries come through a vector-approximation file.

Vectors are cut into equal consecutive parts; each part position has a codebook
of entries, and a vector's code is the index of the nearest entry at each
position. The entries' coordinates are quantised to a few bits: along each
dimension, sorted coordinates are cut into cells of about equal counts, and a
cell keeps the least and the greatest coordinate in it. For a query part, one
lookup table a dimension gives the least and the greatest squared difference to
each cell; their sums over an entry's cells bound its distance from below and
above. Only entries whose lower bound reaches the least upper bound are refined
with exact integer distances. Bounds decide the cost, never the result.

Codebooks are small and go to the tasks; sums of parts by entry are formed in
the tasks, so only (tasks x entries) rows are shuffled, whatever vectors repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import vectors as V
from graphloom.runtime import Tables

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Bits of a cell number.
BITS = 4
#: Query parts whose bounds are held at once.
QUERIES = 2048


@dataclass
class Cells:
    """The approximation of one codebook: each entry's cell by dimension, and the cells' least and greatest coordinates."""

    entries: np.ndarray
    code: np.ndarray
    low: np.ndarray
    high: np.ndarray


def approximate(entries: np.ndarray, bits: int = BITS) -> Cells:
    """Quantise the coordinates of ``entries`` (rows): equal coordinates share a cell."""
    n, dims = entries.shape
    cells = 1 << bits
    code = np.zeros((n, dims), np.int64)
    low, high = np.zeros((dims, cells), np.int64), np.zeros((dims, cells), np.int64)
    for d in range(dims):
        column = entries[:, d]
        rank = np.searchsorted(np.sort(column), column)
        code[:, d] = rank * cells // n
        for c in np.unique(code[:, d]).tolist():
            inside = column[code[:, d] == c]
            low[d, c], high[d, c] = inside.min(), inside.max()
    return Cells(entries, code, low, high)


def nearest(queries: np.ndarray, cells: Cells) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest entry (the lower index of equals), its squared distance, and how many distances were refined."""
    index, best, refined = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64), 0
    reach = max(np.abs(queries).max(initial=0), np.abs(cells.entries).max(initial=0))
    kind = np.int32 if cells.entries.shape[1] * (2 * int(reach)) ** 2 < 1 << 31 else np.int64
    for at in range(0, len(queries), QUERIES):
        q = queries[at : at + QUERIES]
        lower = np.zeros((len(q), len(cells.entries)), kind)
        upper = np.zeros_like(lower)
        for d in range(q.shape[1]):
            x = q[:, d, None]
            below, above = cells.low[d] - x, x - cells.high[d]
            near = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(np.abs(below), np.abs(above))
            lower += np.take((near * near).astype(kind), cells.code[:, d], axis=1)
            upper += np.take((far * far).astype(kind), cells.code[:, d], axis=1)
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
        gap = q[row] - cells.entries[entry]
        exact = np.einsum("ij,ij->i", gap, gap)
        first = np.searchsorted(row, np.arange(len(q)))
        least = np.minimum.reduceat(exact, first)
        hits = np.flatnonzero(exact == least[row])
        own, where = np.unique(row[hits], return_index=True)
        index[at + own], best[at + own] = entry[hits[where]], least
        refined += len(row)
    return index, best, refined


def assign(v: np.ndarray, books: list[Cells]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (one column a part) and squared distances summed over the parts."""
    width = v.shape[1] // len(books)
    codes, error = np.zeros((len(v), len(books)), np.int64), np.zeros(len(v), np.int64)
    for p, cells in enumerate(books):
        codes[:, p], distance, _ = nearest(v[:, p * width : (p + 1) * width], cells)
        error += distance
    return codes, error


def _sums(kept: DataFrame, books: np.ndarray, bits: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and component sums of the parts of every used (part, entry); the result has at most one row an entry."""
    parts, entries, width = books.shape

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [approximate(b, bits) for b in books]
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            v = V.matrix(batch.column(0), parts * width)
            codes, _ = assign(v, cells)
            for p in range(parts):
                np.add.at(count[p], codes[:, p], 1)
                np.add.at(total[p], codes[:, p], v[:, p * width : (p + 1) * width])
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), V.lists(total[part, entry], pa.int64())], ["part", "entry", "n", "total"])

    found = kept.select("v").mapInArrow(apply, "part int, entry int, n long, total array<long>")
    summed = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"))
    return {(r["part"], r["entry"]): (r["n"], r["total"]) for r in summed.collect()}


@dataclass
class Codes:
    """``rows``: the kept columns, ``codes array<int>`` and ``error long``; ``books``: final entries by part, entry and position."""

    rows: DataFrame
    books: np.ndarray


def encode(
    table: DataFrame, keep: list[str], id_column: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, bits: int = BITS
) -> Codes:
    """Fit codebooks in ``rounds`` rounds over all vectors and code each of them.

    Codebooks start as the parts of the vectors with the ``entries`` smallest
    ids (null ids last, ties by vector; fewer vectors, fewer entries). A round
    replaces each used entry by its parts' componentwise floor of the mean.
    Rows take part as ``vectors`` states, if their length is the commonest one
    that ``parts`` divides (the shorter of equally common ones); all others
    have no row in the result. Repeated rows are coded and counted each. Tables
    without such vectors give an empty result and books of no entries. Only the
    id, ``keep`` and the vector are read, so other columns may have any names;
    ``keep`` must not name ``v``, ``codes`` or ``error``.
    """
    spark = table.sparkSession
    tables = Tables(spark, "va_file")
    vectors = tables.put("vectors", V.decoded(table, scale, list(dict.fromkeys([id_column, *keep])), vector))
    dim = V.commonest_length(vectors, parts)
    kept = vectors.where(F.size("v") == dim) if dim else vectors.limit(0)
    first = kept.orderBy(F.col(id_column).asc_nulls_last(), "v").limit(entries).select("v").collect() if dim else []
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds if dim else 0):
        for (p, e), (n, total) in _sums(kept, books, bits).items():
            books[p, e] = [t // n for t in total]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [approximate(b, bits) for b in books]
        for batch in batches:
            codes, error = assign(V.matrix(batch.column(len(keep)), dim), cells)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], V.lists(codes, pa.int32()), pa.array(error)], [*keep, "codes", "error"])

    picked = kept.select(*keep, "v")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema[: len(keep)])
    rows = tables.put("codes", picked.mapInArrow(apply, f"{kinds}, codes array<int>, error long"))
    tables.drop("vectors")
    return Codes(rows, books)
