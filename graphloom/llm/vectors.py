"""Vectors as integers: decoding Arrow lists into numpy matrices, and which rows take part.

A component ``x`` becomes ``floor(scale * x)``. Rows whose vector is null, or
holds a null, NaN or infinite component, take no part. Neither do those with an
integer of ``LIMIT`` or more in size: their squared distances and products
would not fit the 64-bit results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import prepare

LIMIT = 1 << 26


def integers(column: pa.ListArray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which rows take part, each row's first position and length, and all components as int64 (0 where they do not count)."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size)
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * scale)
    bad = ~(np.abs(flat) < LIMIT)
    total = np.concatenate([[0], np.cumsum(bad)])
    keep = column.is_valid().to_numpy(zero_copy_only=False) & (total[end] == total[end - size])
    return keep, end - size, size, np.where(bad, 0, flat).astype(np.int64)


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """A column of integer lists, all of length ``dim``, as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The rows of a matrix as Arrow lists."""
    n, dim = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(rows.ravel(), kind))


def decoded(table: DataFrame, scale: float, keep: list[str], vector: str = "embedding") -> DataFrame:
    """``keep`` columns and ``v array<int>`` of the rows that take part, whatever their length."""
    prepare(table.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            use, _, size, flat = integers(column, scale)
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            v = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
            out = pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], v], [*keep, "v"])
            yield out.filter(pa.array(use))

    picked = table.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{vector}`").alias("v"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema[: len(keep)])
    return picked.mapInArrow(apply, f"{kinds}, v array<int>")


def commonest_length(vectors: DataFrame, multiple: int = 1) -> int:
    """The length, a positive multiple of ``multiple``, that most rows of ``v`` have; the shorter of equals; 0 if none has one."""
    n = F.size("v")
    row = vectors.where((n > 0) & (n % multiple == 0)).groupBy(n.alias("n")).count().orderBy(F.desc("count"), "n").first()
    return row["n"] if row else 0
