"""Operators on vectors against brute force in plain Python, on small tables with awkward rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from graphloom.llm import ball_kmeans, term_search, va_file, vectors

CLASH = "v long, `a.b` long, codes string, error long, cluster string, distance long, id long, own boolean, query long, rank string, score string, n long, label int"


def _vectors(dim):
    """Ids and vectors: random, repeated, tied, of other lengths, null, non-finite and huge ones, null ids."""
    rng = random.Random(3)
    common = [rng.gauss(0, 0.2) for _ in range(dim)]
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(dim)]) for i in range(-20, 180)]
    rows += [(200 + i, list(common)) for i in range(60)]
    rows += [(500, [0.0] * dim), (501, [-0.0] * dim), (502, None), (503, []), (504, [None] + [0.1] * (dim - 1)), (505, [math.nan] * dim), (506, [0.1] * (dim - 1) + [math.inf])]
    rows += [(507, [1e30] * dim), (508, [0.5] * (dim + 1)), (509, [0.5] * (dim - 1)), (None, list(common)), (None, None), (3, rows[23][1]), (3, list(common)), (100, rows[120][1])]
    return [(a, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for a, v in rows]


def _table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    for field in CLASH.split(", "):
        name, kind = field.split()
        df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
    return df


def _whole(v, scale):
    """The integers of a vector that takes part, else None."""
    if v is None or any(x is None or not math.isfinite(x) or abs(math.floor(scale * x)) >= vectors.LIMIT for x in v):
        return None
    return [math.floor(scale * x) for x in v]


def _first(x):
    return (x[0] is None, x[0] or 0, x[1])


def _gap(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def _means(groups, old):
    return [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else o for g, o in zip(groups, old, strict=True)]


def test_va_file_bounds_hold_and_skip():
    rng = np.random.default_rng(1)
    entries = np.concatenate([rng.integers(-90, 90, (50, 4)), np.zeros((14, 4), np.int64)])
    queries = np.concatenate([rng.integers(-120, 120, (5000, 4)), entries])
    counts = []
    for bits in (0, 1, 3, 6):
        index, best, refined = va_file.nearest(queries, va_file.approximate(entries, bits))
        exact = ((queries[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert index.tolist() == exact.argmin(axis=1).tolist()  # the first of equals
        assert best.tolist() == exact.min(axis=1).tolist()
        counts.append(refined)
    assert counts == sorted(counts, reverse=True) and counts[3] < exact.size / 10


def test_va_file_large_numbers():
    entries = np.array([[vectors.LIMIT - 1] * 4, [1 - vectors.LIMIT] * 4, [0] * 4])
    index, best, _ = va_file.nearest(entries[[1, 0, 2]], va_file.approximate(entries))
    assert index.tolist() == [1, 0, 2] and best.tolist() == [0, 0, 0]


@pytest.mark.parametrize("entries", [5, 64, 1000])
def test_codes_brute_force(spark, entries):
    rows, parts, width = _vectors(16), 4, 4
    found = va_file.encode(_table(spark, rows), ["vec_id"], parts=parts, entries=entries, bits=2)
    kept = sorted(((i, w) for i, v in rows if (w := _whole(v, 256)) is not None and len(w) == 16), key=_first)
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for _, w in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def codes():
        return [[min(range(len(books[p])), key=lambda e: (_gap(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]

    for _ in range(2):
        now = codes()
        books = [_means([[c[p] for c, code in zip(cut, now, strict=True) if code[p] == e] for e in range(len(books[p]))], books[p]) for p in range(parts)]
    expected = [(i, code, sum(_gap(c[p], books[p][code[p]]) for p in range(parts))) for (i, _), c, code in zip(kept, cut, codes(), strict=True)]
    got = [(r["vec_id"], r["codes"], r["error"]) for r in found.rows.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert found.books.tolist() == books


def test_codes_empty(spark):
    none = _table(spark, [(1, None), (2, [math.nan] * 16), (3, [0.1] * 7)])
    for df in (none, none.limit(0)):
        found = va_file.encode(df, ["vec_id", "label"], parts=4)
        assert found.rows.count() == 0 and found.rows.columns == ["vec_id", "label", "codes", "error"] and found.books.size == 0


def _brute_top(rows, k, asked):
    kept = [(i, w) for i, v in rows if (w := _whole(v, 1024)) is not None]
    out = []
    for q, (qid, qv) in enumerate(kept):
        if not asked(qid):
            continue
        scored = [(-sum(a * b for a, b in zip(qv, v, strict=False)), i is None, i or 0) for n, (i, v) in enumerate(kept) if n != q]
        out += [(qid, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "block", "chunk"), [(10, 3, 4096), (3, 1000, 7), (500, 4, 64)])
def test_search_brute_force(spark, monkeypatch, k, block, chunk):
    monkeypatch.setattr(term_search, "CHUNK", chunk)
    rows = _vectors(12)
    got = term_search.top(_table(spark, rows), k=k, every=50, block=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == _brute_top(rows, k, lambda i: i is not None and i % 50 == 0)


def test_search_given_queries_and_empty_tables(spark):
    rows = _vectors(12)
    df = _table(spark, rows)
    own = [(None, rows[5][1]), (-15, rows[5][1]), (77777, rows[5][1])]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in term_search.top(df, spark.createDataFrame(own, "vec_id long, embedding array<float>"), k=2).collect()}
    best = _brute_top([*rows, own[2]], 2, lambda i: i == 77777)
    assert [got[77777, 1], got[77777, 2]] == [tuple(x[2:]) for x in best]
    assert got[None, 1] == got[77777, 1] and got[-15, 1] != got[77777, 1]  # only the row of its id is left out
    assert term_search.top(df.limit(0)).count() == 0
    assert term_search.top(df, df.limit(0)).count() == 0


def test_terms_that_few_rows_have():
    rows = [(np.array([1]), np.array([5])), (np.array([], np.int64), np.array([], np.int64)), (np.array([0, 1]), np.array([2, -3]))]
    posted = term_search.postings(rows)
    scores, work = np.zeros(3), np.zeros(3)
    term_search.accumulate((np.array([1, 7]), np.array([4, 9])), posted, scores, work)
    assert scores.tolist() == [20, 0, -12]
    assert term_search.select(np.array([3.0, 9, 3, 3, 1]), 3).tolist() == [1, 0, 2]


@pytest.mark.parametrize("k", [1, 7, 16, 1000])
def test_clusters_brute_force(spark, k):
    rows = _vectors(12)
    found = ball_kmeans.cluster(_table(spark, rows), ["vec_id"], k=k, dim=12)
    kept = [(i, w) for i, v in rows if (w := _whole(v, 64)) is not None and len(w) == 12]
    drawn = sorted(kept, key=lambda x: (x[0] is None, hashlib.sha256(f"1:{x[0]}".encode()).hexdigest(), x[1]))
    centroids = [v for _, v in drawn[:k]]

    def nearest(v):
        return min((_gap(v, c), j) for j, c in enumerate(centroids))

    for _ in range(3):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = _means(groups, centroids)
    expected = [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept]
    got = [(r["vec_id"], r["cluster"], r["distance"]) for r in found.rows.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert found.centroids.tolist() == centroids


def test_balls_compare_less_and_equal_plain_rounds():
    rng = np.random.default_rng(2)
    centres = rng.integers(-400, 400, (16, 8))
    v = np.concatenate([c + rng.integers(-60, 60, (300, 8)) for c in centres] + [centres[:4] // 2 + centres[4:8] // 2])
    centroids = np.concatenate([centres[:15], centres[:1]])  # two equal ones
    cluster, _, _ = ball_kmeans.reassign(v, np.zeros(len(v), np.int64), ball_kmeans.balls(centroids))
    total = 0
    for _ in range(4):
        exact = ((v[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        assert cluster.tolist() == exact.argmin(axis=1).tolist()
        far = [int(exact[cluster == i, i].max(initial=0)) for i in range(16)]
        moved = np.array([v[cluster == i].sum(axis=0) // max((cluster == i).sum(), 1) if (cluster == i).any() else centroids[i] for i in range(16)])
        radius = [ball_kmeans.grown(f, int(((m - c) ** 2).sum())) for f, m, c in zip(far, moved, centroids, strict=True)]
        for i in range(16):
            own = ((v[cluster == i] - moved[i]) ** 2).sum(axis=1)
            assert own.max(initial=0) <= radius[i]
        centroids = moved
        cluster, _, compared = ball_kmeans.reassign(v, cluster, ball_kmeans.balls(centroids, radius))
        total += compared
    assert total < 4 * len(v) * 15 / 4


def test_clusters_empty(spark):
    none = _table(spark, [(1, None), (2, [math.nan] * 12), (3, [0.1] * 7)])
    for df in (none, none.limit(0)):
        found = ball_kmeans.cluster(df, ["vec_id", "label"], dim=12)
        assert found.rows.collect() == [] and found.rows.columns == ["vec_id", "label", "cluster", "distance"] and len(found.centroids) == 0


def test_queries_on_awkward_and_empty_tables(spark, tmp_path):
    from graphloom.llm import registry

    wide = [(i, None if v is None else [x for x in v], 1 if i else None) for i, v in _vectors(64)]
    df = spark.createDataFrame(wide, "vec_id long, embedding array<float>, label int")
    for name, part in (("awkward", df), ("empty", df.limit(0))):
        part.write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        kept = sum(1 for _, v, _ in wide if (w := _whole(v, 64)) is not None and len(w) == 64) if name == "awkward" else 0
        assert registry.op11_va_codes(spark, f"{tmp_path}/{name}").count() == kept
        assert registry.op13_ball_kmeans(spark, f"{tmp_path}/{name}").count() == kept
        assert (registry.op12_term_search(spark, f"{tmp_path}/{name}").count() > 0) == (name == "awkward")
