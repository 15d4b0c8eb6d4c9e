"""Reference sets in pages: the pages, joined, are the sets, also where one definition has nearly all uses."""

from pyspark.sql import functions as F

from graphloom import runtime
from graphloom.operators import search, symbols


def test_pages_are_the_sets_in_order(spark):
    uses = spark.range(6000).select(
        F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(3).alias("node_id"), (F.col("id") % 2).alias("offset"), (F.col("id") * 7919 % 5000).alias("href"), F.when(F.col("id") % 3 != 0, "f").alias("context"),
        F.lit(False).alias("linked_via_sym"), (F.col("id") % 5).alias("use_path_id"), (F.col("id") % 11).alias("use_off"),
    )
    uses = uses.unionByName(uses.where("href < 100")).repartition(8)
    paths = spark.createDataFrame([(i, f"p{i}") for i in range(4)], "path_id long, path string")  # uses in path 4 drop out
    spans = spark.createDataFrame([(i, None if i == 5 else i * 10) for i in range(7)], "node_id long, path_id long")
    want = {(r.path_id, r.node_id, r.offset): r.refs for r in symbols.references(uses, paths, spans).collect()}
    pages = symbols.reference_pages(uses, paths, spans, 64)
    got = {}
    for r in sorted(pages.collect(), key=lambda r: (str(r[:3]), r.page)):
        before = got.setdefault((r.path_id, r.node_id, r.offset), [])
        assert len(before) == r.page * 64 and 0 < len(r.refs) <= 64
        before += r.refs
    assert got == want and max(map(len, want.values())) > 1000
    rows = symbols.page_directory(pages).collect()
    assert sum(r.n for r in rows) == sum(map(len, want.values())) and all(r.first in want[r.path_id, r.node_id, r.offset] for r in rows)
    assert symbols.reference_pages(uses.limit(0), paths, spans).count() == 0


def test_a_job_leaves_no_tables(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(runtime, "shared_dir", lambda _: f"file://{tmp_path}")
    left = lambda: len(os.listdir(tmp_path / "graphloom"))
    kept = search.dense_ids(spark.range(10).toDF("k"), ["k"], "n")
    assert left() == 1
    with runtime.job(spark):
        search.dense_ids(spark.range(10).toDF("k"), ["k"], "n").count()
        with runtime.job(spark):
            runtime.Tables(spark, "t").put("a", spark.range(3))
            assert left() == 3
        assert left() == 2
    assert left() == 1 and kept.count() == 10
    try:
        with runtime.job(spark):
            runtime.stash(spark.range(1), "x")
            raise KeyError
    except KeyError:
        assert left() == 1
