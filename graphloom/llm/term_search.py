"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row: its terms are the positions of components other than
0, its weights their integers. A chunk of candidate rows is turned into
postings, for each term the rows that have it and their weights. A query takes
its terms one at a time and adds its weight times the posting's weights to a
dense array of scores, one for each row of the chunk. Then a partition selects
the highest scores, and they are merged with those of the chunks before.

Queries pass in blocks of bounded size, one broadcast each; a block scans the
candidates once, every task returns at most ``k + 1`` rows a query, and a window
with a pushed-down limit merges the tasks' lists. No pair of rows is ever
shuffled before selection.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import vectors as V
from graphloom.runtime import prepare, scratch, stash

K, SCALE, EVERY = 10, 1024, 100
#: Queries of a block: 16 MB of vectors of 64 components.
BLOCK = 32768
#: Rows of a chunk: an array of scores stays in the processor's cache.
CHUNK = 4096
#: Doubles hold whole numbers up to here.
EXACT = 1 << 53

#: Positions and weights of a row.
Row = tuple[np.ndarray, np.ndarray]


def postings(rows: list[Row], kind: type = np.float64) -> dict[int, tuple[np.ndarray | slice, np.ndarray]]:
    """Term -> the rows that have it (a full slice if all do, in order) and their weights."""
    if not rows:
        return {}
    terms = np.concatenate([t for t, _ in rows])
    weights = np.concatenate([w for _, w in rows])
    owner = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
    order = np.argsort(terms, kind="stable")
    terms, weights, owner = terms[order], weights[order].astype(kind), owner[order]
    cut = np.flatnonzero(np.diff(terms)) + 1
    out = {}
    for term, own, w in zip(terms[np.concatenate([[0], cut])].tolist() if len(terms) else [], np.split(owner, cut), np.split(weights, cut), strict=False):
        out[term] = (slice(None) if len(own) == len(rows) else own, w)
    return out


def accumulate(query: Row, posted: dict[int, tuple[np.ndarray | slice, np.ndarray]], scores: np.ndarray, work: np.ndarray) -> None:
    """Scatter the query's weighted postings into ``scores``, which is cleared first."""
    scores.fill(0)
    for term, weight in zip(query[0].tolist(), query[1].tolist(), strict=True):
        if (found := posted.get(term)) is not None:
            rows, weights = found
            part = np.multiply(weights, weight, out=work[: len(weights)])
            scores[rows] += part


def select(scores: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` highest scores; of equal ones at the border the first. All, if there are no more."""
    if len(scores) <= k:
        return np.arange(len(scores))
    border = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > border)
    return np.concatenate([above, np.flatnonzero(scores == border)[: k - len(above)]])


class Best:
    """The best candidates of every query of a block so far: score, whether the id is null, id, same row as the query."""

    def __init__(self, queries: list[Row], ids: list[int | None], k: int) -> None:
        self.queries, self.k = queries, k
        self.null, self.ids = np.array([x is None for x in ids], bool), np.array([x or 0 for x in ids], np.int64)
        self.reach = max((int(np.abs(w).max(initial=0)) for _, w in queries), default=0)
        self.found: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, t) for t in (np.int64, bool, np.int64, bool))] * len(queries)

    def add(self, rows: list[Row], ids: np.ndarray, null: np.ndarray) -> None:
        """Merge a chunk of candidates, one more than ``k`` kept, as one may be the query's own row."""
        order = np.lexsort((ids, null))
        rows, ids, null = [rows[i] for i in order.tolist()], ids[order], null[order]
        width = max((len(t) for t, _ in rows), default=0)
        reach = max((int(np.abs(w).max(initial=0)) for _, w in rows), default=0)
        kind = np.float64 if width * reach * self.reach < EXACT else np.int64
        posted = postings(rows, kind)
        scores, work = np.zeros(len(rows), kind), np.zeros(len(rows), kind)
        for q, query in enumerate(self.queries):
            accumulate(query, posted, scores, work)
            before = self.found[q][0]
            # Once the list is full, only scores that reach its last one can enter it.
            reaching = np.flatnonzero(scores >= before[-1]) if len(before) > self.k else np.arange(len(rows))
            if not len(reaching):
                continue
            top = reaching[select(scores[reaching], self.k + 1)]
            own = (ids[top] == self.ids[q]) & (null[top] == self.null[q])
            for i in np.flatnonzero(own).tolist():
                own[i] = all(np.array_equal(a, b) for a, b in zip(rows[top[i]], query, strict=True))
            fresh = (scores[top].astype(np.int64), null[top], ids[top], own)
            both = [np.concatenate(pair) for pair in zip(self.found[q], fresh, strict=True)]
            best = np.lexsort((both[2], both[1], -both[0]))[: self.k + 1]
            self.found[q] = tuple(x[best] for x in both)


def sparse(batch: pa.RecordBatch, column: int) -> list[Row]:
    """Rows of a column of integer lists."""
    lists = batch.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1]
    out = []
    for v in np.split(flat, cuts) if len(lists) else []:
        at = np.flatnonzero(v)
        out.append((at, v[at]))
    return out


def top(
    table: DataFrame, queries: DataFrame | None = None, id_column: str = "vec_id", vector: str = "embedding", k: int = K, scale: float = SCALE, every: int = EVERY, block: int = BLOCK
) -> DataFrame:
    """``query_id, rank, <id>, score``: the ``k`` rows with the highest inner products for each query.

    Queries are the rows of ``queries`` (same columns), or without it the rows
    whose id ``every`` divides, negative ids and 0 included. A query's own row
    is no candidate: one row of its id and vector. Further rows of that id or
    vector are candidates. A repeated query row is a query each time; its lists
    then stand under one ``query_id``. Ties go to the smaller id, null ids last;
    null ids are never queries by divisibility. Rows take part as ``vectors``
    states; missing components count as 0, so lengths may differ. Without
    queries or candidates the result is empty. Ids are integers. Only the id and
    the vector are read, so other columns may have any names.
    """
    spark = table.sparkSession
    prepare(spark)
    asked = table.where(F.col(f"`{id_column}`") % every == 0) if queries is None else queries
    candidates = stash(V.decoded(table, scale, [id_column], vector).select(F.col(f"`{id_column}`").cast("long").alias("id"), "v"), "candidates")
    wanted = stash(V.decoded(asked, scale, [id_column], vector).select(F.col(f"`{id_column}`").cast("long").alias("id"), "v"), "queries")
    kind = "query long, query_id long, score long, id long, own boolean"
    path = scratch(spark, "top")
    spark.createDataFrame([], kind).write.parquet(path)
    done = 0
    for rows in batched(wanted.toLocalIterator(prefetchPartitions=True), block):
        vectors = [np.array(r["v"], np.int64) for r in rows]
        sent = spark.sparkContext.broadcast(([(np.flatnonzero(v), v[v != 0]) for v in vectors], [r["id"] for r in rows], done))

        def apply(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            given, names, base = sent.value
            best = Best(given, names, k)
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(at, CHUNK)
                    best.add(sparse(part, 1), part.column(0).fill_null(0).to_numpy(), part.column(0).is_null().to_numpy(zero_copy_only=False))
            score, null, found, own = (np.concatenate(x) for x in zip(*best.found, strict=True))
            of = np.repeat(np.arange(len(given)), [len(x[0]) for x in best.found])
            query_id = pa.array(best.ids[of], mask=best.null[of])
            yield pa.RecordBatch.from_arrays([pa.array(base + of), query_id, pa.array(score), pa.array(found, mask=null), pa.array(own)], ["query", "query_id", "score", "id", "own"])

        candidates.mapInArrow(apply, kind).write.mode("append").parquet(path)
        sent.unpersist()
        done += len(rows)
    found = spark.read.schema(T.StructType.fromDDL(kind)).parquet(path)
    order = [F.desc("score"), F.asc_nulls_last("id")]
    merged = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("place") <= k + 1)
    # One row of the query's id and vector among the first k + 1 is the query itself.
    own = F.min(F.when(F.col("own"), F.col("place"))).over(Window.partitionBy("query"))
    ranked = merged.withColumn("at", own).where(F.col("at").isNull() | (F.col("place") != F.col("at"))).withColumn("rank", (F.col("place") - F.when(F.col("place") > F.col("at"), 1).otherwise(0)).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")
