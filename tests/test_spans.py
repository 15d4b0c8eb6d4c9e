"""Innermost spans: the sorted and the joined form against a count by hand, on odd spans, and what their plans group."""

import random

import pytest

from graphloom.operators import cutting, spans


def _tables(spark, seed):
    rng = random.Random(seed)
    rows = [(1, 100 + i, a, a + w, 1, True) for i, (a, w) in enumerate([(0, 20), (20, 0), (20, 40), (70, 130_000)])]
    rows += [(1, 200 + i, a, a + w, 2, True) for i, (a, w) in enumerate([(5, 0), (5, 5), (10, 4), (30, 30), (65_530, 20)])]
    rows += [(2, 300, 0, 9, 1, True), (2, 301, 0, 0, 2, True), (2, 302, 0, 9, 3, False), (3, 400, 5, 4, 1, True)]
    rng.shuffle(rows)
    points = [(1, o) for o in (*range(0, 80), 65_529, 65_530, 65_549, 65_550, 130_069, 130_070)] + [(2, o) for o in (0, 8, 9)] + [(3, 4), (4, 0), (None, 1)]
    points += points[:30]
    return rows, points


def _want(rows, points):
    out = {}
    for path, off in points:
        hits = [(level, start, node) for p, node, start, end, level, fresh in rows if fresh and p == path and start <= off < end]
        out[path, off] = (max(hits)[2], max(hits)[0]) if hits else (None, None)
    return out


@pytest.mark.parametrize("bucket", [None, 16, spans.BUCKET])
def test_every_form_finds_the_innermost(spark, bucket):
    rows, points = _tables(spark, 3)
    s = spark.createDataFrame(rows, "path_id long, node_id long, start long, end long, nest_level int, fresh boolean").repartition(3)
    p = spark.createDataFrame(points, "path_id long, off long").repartition(3)
    want = _want(rows, points)
    for got in [spans.stab(p, s, bucket=bucket).collect()] + ([spans.stab_sorted(p, s).collect()] if bucket is None else []):
        assert len(got) == len(want) and {(r.path_id, r.off): (r.node_id, r.nest_level) for r in got} == want
    kept = spans.place(p.selectExpr("*", "'t' AS end"), s, bucket=bucket)
    assert kept.columns == ["path_id", "off", "end", "node_id", "nest_level"] and kept.count() == len(points)


def _grouping(df, column):
    """Lines of the plan that group by the column."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Aggregate [" in line and column in line]


def test_points_are_not_grouped(spark):
    rows, points = _tables(spark, 3)
    s = spark.createDataFrame(rows, "path_id long, node_id long, start long, end long, nest_level int, fresh boolean")
    p = spark.createDataFrame(points, "path_id long, off long")
    tokens = p.selectExpr("path_id", "off", "off + 1 AS end", "'x' AS tok", "'Identifier' AS type", "1L AS cursor")
    cut = s.selectExpr("node_id", "path_id", "nest_level", "start", "end", "1L AS cursor", "'Class' AS kind", "'' AS member_of", "NULL::bigint AS outer_id")
    for df in (spans.place(p, s), spans.stab_sorted(p, s), cutting.block_tokens(tokens, cut)):
        seen = str(p._jdf.queryExecution().optimizedPlan().output().apply(1))  # the points' own offset
        assert not _grouping(df, seen), df
