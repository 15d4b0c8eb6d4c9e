"""Ball k-means: exact Lloyd rounds in which a vector is compared only with the centroids near its cluster's ball.

A cluster is a ball: its centroid and a radius that covers its members. When
centroids move, the radius grows by the way its own centroid went. Centroid
``j`` is a neighbour of ball ``i`` if half their distance is within the radius;
no member of ``i`` can be nearer to any other. Neighbours are sorted by
distance: members nearer to their centroid than half the way to the first
neighbour are the stable core and stay; the rest lie in annuli, and those in the
k-th are compared with the first k neighbours only. All comparisons are of
squared integers, and a vector halfway between two centroids is compared, so
results are those of plain rounds, ties to the smaller number included.

Each round writes the vectors with their cluster to the shared folder; sums,
counts and radii are formed in the tasks, so a cluster with most of the rows
costs no more than any other. Centroids, sums and radii are all that the driver
sees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import vectors as V
from graphloom.runtime import Tables

K, ROUNDS, SCALE, DIM = 16, 3, 64, 64
SEED = "1"


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` to ``b`` (one row, or one for each)."""
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


@dataclass
class Balls:
    """Centroids, and for each its neighbours in order of distance with the squared distances to them."""

    centroids: np.ndarray
    near: list[np.ndarray]
    gaps: list[np.ndarray]


def balls(centroids: np.ndarray, radius: list[int] | None = None) -> Balls:
    """Neighbours by squared ``radius`` (None: any centroid is one)."""
    near, gaps = [], []
    for i, c in enumerate(centroids):
        gap = squared(centroids, c)
        order = np.argsort(gap, kind="stable")
        order = order[order != i]
        if radius is not None:
            order = order[gap[order] <= 4 * radius[i]]
        near.append(order)
        gaps.append(gap[order])
    return Balls(centroids, near, gaps)


def grown(radius: int, way: int) -> int:
    """The square of a ball's radius after its centroid went a way; all given and returned as squares, rounded up."""
    return radius + way + 2 * (isqrt(radius * way) + 1) if way else radius


def reassign(v: np.ndarray, cluster: np.ndarray, b: Balls) -> tuple[np.ndarray, np.ndarray, int]:
    """New clusters, squared distances to them, and how many distances to other centroids were taken."""
    best, out, compared = squared(v, b.centroids[cluster]), cluster.copy(), 0
    for i in np.unique(cluster).tolist():
        if not len(b.near[i]):
            continue
        own = np.flatnonzero(cluster == i)
        distance = best[own]
        # The annulus of a member: how many neighbours are at most twice as far from the centroid as the member is.
        annulus = np.searchsorted(b.gaps[i], 4 * distance, side="right")
        for k, j in enumerate(b.near[i].tolist()):
            at = own[annulus > k]
            if not len(at):
                break
            other = squared(v[at], b.centroids[j])
            compared += len(at)
            closer = (other < best[at]) | ((other == best[at]) & (j < out[at]))
            best[at[closer]], out[at[closer]] = other[closer], j
    return out, best, compared


def _assigned(rows: DataFrame, keep: list[str], b: Balls, dim: int) -> DataFrame:
    """``keep``, ``v``, ``cluster`` and ``distance``; rows without a cluster yet start in the first one, with all others near."""
    n = len(keep)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = V.matrix(batch.column(n), dim)
            cluster, distance, _ = reassign(v, batch.column(n + 1).to_numpy(zero_copy_only=False).astype(np.int64), b)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], pa.array(cluster, pa.int32()), pa.array(distance)], [*keep, "v", "cluster", "distance"])

    had = F.col("cluster") if "cluster" in rows.columns else F.lit(0)
    picked = rows.select(*keep, "v", had.cast("int").alias("cluster"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema[:n])
    return picked.mapInArrow(apply, f"{kinds}, v array<int>, cluster int, distance long")


def _totals(state: DataFrame, k: int, dim: int) -> dict[int, tuple[int, int, list[int]]]:
    """Count, greatest distance and component sums of each cluster that has members."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, far, total = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            cluster = batch.column(1).to_numpy(zero_copy_only=False)
            count += np.bincount(cluster, minlength=k)
            np.maximum.at(far, cluster, batch.column(2).to_numpy(zero_copy_only=False))
            v = V.matrix(batch.column(0), dim)
            for i in np.unique(cluster).tolist():
                total[i] += v[cluster == i].sum(axis=0)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), pa.array(far[used]), V.lists(total[used], pa.int64())], ["cluster", "n", "far", "total"])

    found = state.select("v", "cluster", "distance").mapInArrow(apply, "cluster int, n long, far long, total array<long>")
    summed = found.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.array(*[F.sum(F.col("total")[i]) for i in range(dim)]).alias("total"))
    return {r["cluster"]: (r["n"], r["far"], r["total"]) for r in summed.collect()}


@dataclass
class Clusters:
    """``rows``: the kept columns, ``cluster int`` and ``distance long`` (squared); ``centroids``: final ones, by number."""

    rows: DataFrame
    centroids: np.ndarray


def cluster(table: DataFrame, keep: list[str], id_column: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, scale: float = SCALE, dim: int = DIM, seed: str = SEED) -> Clusters:
    """Cluster the vectors of ``dim`` components.

    Centroids start as the ``k`` vectors with the smallest hexadecimal sha256 of
    ``<seed>:<id>`` (null ids last, ties by vector; fewer vectors, fewer
    centroids). A round replaces each centroid that has members by their
    componentwise floor of the mean; others stay. Rows take part as ``vectors``
    states; rows of other lengths, null or non-finite vectors have no row in
    the result. Repeated rows count each. A table without such vectors gives an
    empty result and no centroids. Only the id, ``keep`` and the vector are
    read, so other columns may have any names; ``keep`` must not name ``v``,
    ``cluster`` or ``distance``.
    """
    spark = table.sparkSession
    tables = Tables(spark, "ball_kmeans")
    columns = list(dict.fromkeys([id_column, *keep]))
    state = tables.put("vectors", V.decoded(table, scale, columns, vector).where(F.size("v") == dim))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")).cast("binary"), 256)
    first = state.orderBy(draw.asc_nulls_last(), "v").limit(k).select("v").collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), dim)
    if not len(first):
        return Clusters(state.select(*keep, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids)
    now = balls(centroids)
    for _ in range(rounds):
        state = tables.put("state", _assigned(state, keep, now, dim))
        tables.drop("vectors")
        totals = _totals(state, len(centroids), dim)
        moved = centroids.copy()
        radius = [0] * len(centroids)
        for i, (n, far, total) in totals.items():
            moved[i] = [t // n for t in total]
            radius[i] = grown(far, int(squared(moved[i : i + 1], centroids[i])[0]))
        centroids, now = moved, balls(moved, radius)
    rows = tables.put("clusters", _assigned(state, keep, now, dim).drop("v"))
    tables.drop("state", "vectors")
    return Clusters(rows, centroids)


def digest(centroids: np.ndarray) -> list[str]:
    """Lowercase sha256 of each centroid's comma-joined decimal components."""
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
