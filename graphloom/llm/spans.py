"""Span tables: running a finder over whole texts, and digests of what it found."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import prepare

#: kind, start and end in code points, and whether a base rule found it.
Span = tuple[str, int, int, bool]
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def find(docs: DataFrame, finder: Callable[[pa.Array], list[list[Span]]]) -> DataFrame:
    """``doc_id, spans`` for every row; ``finder`` gets a batch of texts, nulls as empty strings."""
    prepare(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = finder(batch.column(1))
            offsets, flat = [0], []
            for own in found:
                flat.extend(own)
                offsets.append(len(flat))
            columns = list(zip(*flat, strict=True)) if flat else [(), (), (), ()]
            struct = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SPAN, strict=True)], fields=list(SPAN))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).mapInArrow(apply, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def count(kind: str) -> Column:
    """Base spans of a kind."""
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def listed(base_only: bool = False) -> Column:
    """Spans as ``kind:start:end``, comma-joined, in the order they are in."""
    some = F.filter("spans", lambda s: s["base"]) if base_only else F.col("spans")
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(kinds: list[str]) -> list[Column]:
    return [*[count(k).alias(f"n_{k}") for k in kinds], F.sha2(listed(True).cast("binary"), 256).alias("base_sha256"), listed().alias("spans")]
