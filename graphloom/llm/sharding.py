"""Sharding by longest-processing-time scheduling.

Documents of equal text are a group and stay together. Groups, largest first,
go to the least-loaded of the shards, ties to the lowest shard. Groups of one
size are interchangeable, so the schedule is computed on the histogram of group
sizes: for each size the heap's choices are found together by their water
level, which gives the same loads as one pop for each group. What the driver
holds is one row for each distinct size (at most the square root of twice the
corpus' bytes), never groups or documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.runtime import scratch, stash

SHARDS = 16
#: Sub-ranges of a shard or size class that are numbered apart, so that no task orders a whole one:
#: at least so many, and one for so many rows.
SALTS = 64
SALT_ROWS = 1_000_000
#: Rows of the schedule that the driver holds.
PIECE = 200_000
OWN = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def fill(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` equal groups each shard gets when each goes to the least load (then lowest shard)."""
    n = len(loads)
    if count < 4 * n:
        heap = [(load, s) for s, load in enumerate(loads)]
        heapq.heapify(heap)
        got = [0] * n
        for _ in range(count):
            load, s = heap[0]
            got[s] += 1
            heapq.heapreplace(heap, (load + size, s))
        return got
    below = lambda level: [max(0, -(-(level - load) // size)) for load in loads]  # noqa: E731  steps that begin under the level
    low, high = min(loads), max(loads) + size * (count + 1)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if sum(below(mid)) <= count else (low, mid)
    got = below(low)
    for s in range(n):  # steps that begin at the level, lowest shard first
        if sum(got) < count and loads[s] <= low and (low - loads[s]) % size == 0:
            got[s] += 1
    return got


def schedule(histogram: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, int, int]]:
    """``(size, shard, first, last)``: ranks of the groups of a size that each shard gets; sizes come largest first."""
    loads = [0] * shards
    for size, count in histogram:
        at = 0
        for s, k in enumerate(fill(loads, size, count)):
            if k:
                yield size, s, at, at + k - 1
                loads[s] += k * size
                at += k


def _numbered(df: DataFrame, key: str, order: list[str], salt: Column, name: str) -> DataFrame:
    """Gapless numbers from 0 within ``key``: a count before each of its salted parts, plus a row number inside."""
    salted = df.withColumn("_salt", salt)
    counts = salted.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(W.partitionBy(key).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    inner = F.row_number().over(W.partitionBy(key, "_salt").orderBy(*order)) - 1
    return salted.withColumn("_rn", inner).join(before, [key, "_salt"]).withColumn(name, (F.col("_before") + F.col("_rn")).cast("long")).drop("_salt", "_rn", "_before")


def _salts(rows: DataFrame) -> int:
    return max(SALTS, -(-rows.count() // SALT_ROWS))


def measured(docs: DataFrame, text: Column) -> list[Column]:
    """Size, checksum and 128-bit identity of a text."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    return [(F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("text_key")]


def assign(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``text_key, shard`` for every distinct text of ``rows`` (``text_key, size``)."""
    spark = rows.sparkSession
    groups = stash(rows.groupBy("text_key").agg(F.sum("size").alias("load")), "groups")
    sizes = stash(groups.groupBy("load").agg(F.count(F.lit(1)).alias("k")), "histogram").orderBy(F.desc("load"))
    pieces = schedule(((r["load"], r["k"]) for r in sizes.toLocalIterator()), shards)
    path, kind = scratch(spark, "schedule"), "load long, shard int, first long, last long"
    spark.createDataFrame([], kind).write.parquet(path)
    while piece := list(islice(pieces, PIECE)):
        columns = [pa.array(c, t) for c, t in zip(zip(*piece, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
        spark.createDataFrame(pa.table(columns, ["load", "shard", "first", "last"])).write.mode("append").parquet(path)
    plan = spark.read.schema(kind).parquet(path)
    ranked = _numbered(groups, "load", ["text_key"], F.pmod(F.xxhash64("text_key"), F.lit(_salts(groups))), "rank")
    held = (ranked["load"] == plan["load"]) & F.col("rank").between(F.col("first"), F.col("last"))
    return ranked.join(plan, held).select("text_key", "shard")


def shard(docs: DataFrame, shards: int = SHARDS, keep: list[str] | None = None) -> DataFrame:
    """Shard and slot of every row of ``docs``.

    Returns ``doc_id``, the columns of ``docs`` named in ``keep``, then ``size,
    text_crc32, law, shard, slot, grown_shard``; a kept column of one of these
    names returns as ``given_`` and its name. ``size`` is the UTF-8 length plus
    1; null texts count as empty and are one group with empty ones. Slots number
    a shard's rows from 0 without gaps. A group larger than a fair share stays
    whole, and its shard takes little else. Groups of one size go by a hash of
    their text, loads that tie by shard; equal rows get slots of their own. Null
    ids are rows like others, texts are measured whole, and an empty table gives
    no row.
    """
    keep = [c for c in keep or [] if c != "doc_id"]
    names = {c: f"_k{i}" for i, c in enumerate(keep)}  # apart from this operator's own columns
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    base = docs.select("doc_id", *[F.col(quoted(c)).alias(a) for c, a in names.items()], *measured(docs, F.col("text")))
    if not keep:
        base = stash(base, "sizes")
    placed = assign(base.select("text_key", "size"), shards)
    joined = base.join(placed, "text_key")
    salt = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(_salts(docs)))
    out = _numbered(joined, "shard", ["doc_id", "text_key"], salt, "slot")
    taken = {*OWN, *keep}
    extra = []
    for c, a in names.items():
        shown = c
        while shown in OWN or (shown != c and shown in taken):
            shown = "given_" + shown
        taken.add(shown)
        extra.append(F.col(a).alias(shown))
    return out.select("doc_id", *extra, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
