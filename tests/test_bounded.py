"""Steps whose tasks and shuffles must stay small: the same rows as before, by plans without the large step."""

from pyspark.sql import functions as F

from graphloom.operators import resolve, segments, symbols, tokens
from graphloom.sources import csource


def test_places_of_hot_definitions_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(symbols, "HOT_USES", 100)
    uses = spark.range(2000).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 70).when(F.col("id") % 7 > 0, F.lit(3)).alias("node_id"), F.lit(0).cast("long").alias("offset"), F.col("id").alias("href"), F.lit("f").alias("context"),
        F.lit(False).alias("linked_via_sym"), (F.col("id") % 5).alias("use_path_id"), F.col("id").alias("use_off"),
    )
    paths = spark.createDataFrame([(i, f"p{i}") for i in range(4)], "path_id long, path string")
    spans = spark.createDataFrame([(i, i % 4) for i in range(40)] * 2, "node_id long, path_id long")
    placed = symbols._placed_uses(uses, paths, spans)
    want = [(r.node_id, r.node_id % 4, r.href) for r in uses.collect() if r.node_id is not None and r.node_id < 40 and r.use_path_id < 4]
    assert sorted((r.node_id, r.path_id, r.href) for r in placed.collect()) == sorted(want)
    assert "BroadcastHashJoin [node_id" in placed._jdf.queryExecution().executedPlan().toString()


def test_segments_look_up_cursors_not_tokens(spark):
    texts = spark.createDataFrame([(1, "int a,\nb  c ,\n\n  é, \nd,"), (2, None), (3, ""), (4, " \n x,\n"), (5, "a,\nb,\nc,\nd")], "path_id long, text string").repartition(2)
    words, cursors = segments.lines_as_declarations(texts)
    assert sorted(tuple(r)[:3] for r in words.collect()) == [(1, 0, 3), (1, 4, 6), (1, 7, 8), (1, 10, 11), (1, 12, 13), (1, 17, 20), (1, 22, 24), (4, 3, 5), (5, 0, 2), (5, 3, 5), (5, 6, 8), (5, 9, 10)]
    assert sorted((r.path_id, r.start, r.end) for r in cursors.collect()) == [(1, 0, 13), (1, 7, 20), (1, 17, 20), (1, 22, 24), (4, 3, 5), (5, 0, 5), (5, 3, 8), (5, 6, 10), (5, 9, 10)]
    cut = segments.segments(words, cursors)
    assert sorted((r.path_id, r.start, r.end) for r in cut.collect()) == [(1, 0, 13), (1, 17, 20), (1, 22, 24), (4, 3, 5), (5, 0, 5), (5, 6, 10)]
    # files that Arrow batches cut in two stay whole, also by shuffled joins, and no file is a group of its own in Python
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for c, v in zip(before, ("-1", "3")):
            spark.conf.set(c, v)
        cut = segments.segments(words, cursors)
        assert sorted((r.path_id, r.start, r.end) for r in cut.collect()) == [(1, 0, 13), (1, 17, 20), (1, 22, 24), (4, 3, 5), (5, 0, 5), (5, 6, 10)]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert "FlatMapGroupsInPandas" not in cut._jdf.queryExecution().executedPlan().toString()


def test_c_tokens_by_type_in_runs(spark, monkeypatch):
    monkeypatch.setattr(csource, "RUN_TOKENS", 3)
    texts = [(1, 'int a = "x"; // é\n#include <b.h>\nf(a, 1.5);'), (2, None), (3, ""), (4, "\\")]
    files = spark.createDataFrame(texts, "path long, text string")
    runs = csource.type_runs(files).collect()
    assert max(r.n for r in runs) <= 3 and len(runs) > 8
    want, got = {}, {}
    for t in sorted(csource.c_tokens(files).collect(), key=lambda t: (t.path, t.pos)):
        n, total, _, text = want.get((t.path, t.type), (0, 0, 0, ""))
        want[t.path, t.type] = (n + 1, total + t.off, t.off, text + t.tok)
    for r in sorted(runs, key=lambda r: (r.path, r.first)):
        n, total, _, text = got.get((r.path, r.type), (0, 0, 0, ""))
        got[r.path, r.type] = (n + r.n, total + r.offsets, r.last_off, text + r.text)
    assert got == want


def test_include_lines_are_joined_where_they_are_lexed(spark):
    files = spark.createDataFrame([("a.c", '#include <x/y.h> // no\n  # import "z.h"\n"#include <n.h>"\n/*\n#include <m.h>*/\n#include MACRO\n#include<w.h>'), ("b.c", None)], "path string, text string")
    lines = csource.include_lines(files)
    assert sorted((r.path, r.off, r.name, r.quoted) for r in lines.collect()) == [("a.c", 0, "x/y.h", False), ("a.c", 25, "z.h", True), ("a.c", 92, "w.h", False)]
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_packed_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(tokens, "RUN_BYTES", 8)
    texts = spark.createDataFrame([(1, "é a longer_word x, y"), (2, "b"), (3, "")], "node_id long, text string")
    lexed = tokens.lexed(texts, "node_id").select("node_id", "pos", "offset", F.when(F.col("pos") > 0, "t").alias("type")).repartition(3)
    want = sorted((r.node_id, r.pos, r.tok) for r in tokens.lexed(texts, "node_id").collect())
    got = tokens.reconstruct(lexed, texts).collect()
    assert sorted((r.node_id, r.pos, r.tok) for r in got) == want and all((r.type is None) == (r.pos == 0) for r in got)
    rows = spark.createDataFrame([(i // 50, i % 50, 2 * (i % 50)) for i in range(100)], "node_id long, pos int, offset long").coalesce(1)
    assert tokens._packed(rows).count() == 26


def test_heads_are_the_first_solid_tokens(spark):
    texts = spark.createDataFrame([(1, "  a b, c"), (2, "x"), (3, " \n"), (4, ""), (5, None)], "doc_id long, text string")
    long = tokens.lex(texts, "doc_id").withColumn("type", tokens.token_type(F.col("tok")))
    heads = tokens.heads(texts, "doc_id")
    assert sorted(map(tuple, heads.collect())) == sorted(map(tuple, tokens.first_solid(long).collect())) == [(1, ["a", "b", ","]), (2, ["x"])]
    assert "Exchange" not in heads._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_hot_root_are_dealt_in_cells(spark, monkeypatch):
    monkeypatch.setattr(resolve, "CELL_ROWS", 4, raising=False)
    ks = [None, None, 7, 7, 5, -1] + [3 + 16 * i for i in range(-20, 20)]
    vs = [(None, "n"), (7 + 16, "a"), (7, "b"), (7, "b"), (15, "c")] + [(3 + 16 * i, f"v{i}") for i in range(30)]
    keys = spark.createDataFrame([(k, i) for i, k in enumerate(ks)], "k long, i long").coalesce(1)
    index = spark.createDataFrame(vs, "k long, v string").coalesce(1)
    met = resolve.radix_lookup(keys, index, "k", root_bits=4)
    assert met.columns == ["k", "i", "v"]
    want = [(k, i, v) for i, k in enumerate(ks) for v in [v for e, v in vs if k is not None and e is not None and e & 15 == k & 15] or [None]]
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in met.collect()), key=order) == sorted(want, key=order)
    # the 1,200 pairs of one value come from many tasks, though either side is tiny
    dealt = met.where("k % 16 = 3 or k % 16 = -13").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) >= 6 and max(r["count"] for r in dealt) < 600
    assert resolve.radix_lookup(keys, index.limit(0), "k", root_bits=4).where("v is null").count() == len(ks)
    assert resolve.radix_lookup(keys.limit(0), index, "k", root_bits=4).count() == 0


def test_reconstruction_shuffles_tokens_once_and_packed(spark, monkeypatch):
    monkeypatch.setattr(tokens, "RUN_BYTES", 64)
    text = "".join(f"wörd{i} \n" if i % 3 else f"(x{i})" for i in range(300))
    texts = spark.createDataFrame([(1, text), (2, "a b"), (3, "é"), (4, "gone, not here")], "node_id long, text string")
    lexed = tokens.lexed(texts, "node_id")
    whole = sorted((r.node_id, r.pos, r.offset, r.tok) for r in lexed.collect())
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.enabled")}
    try:
        for c, v in zip(before, ("-1", "7", "false")):
            spark.conf.set(c, v)
        # in order, dealt anew, and with places that do not count on by one, beyond shorts and null
        mixed = lexed.where("node_id < 4").repartition(5, "tok")
        odd = lexed.withColumn("kind", F.struct("pos")).withColumn("pos", F.when(F.col("pos") != 2, F.col("pos").cast("long") * 100_000 - 7))
        for given in (lexed, mixed):
            got = tokens.reconstruct(given.select("node_id", "pos", "offset"), texts)
            assert got.dtypes == [("node_id", "bigint"), ("pos", "int"), ("offset", "bigint"), ("tok", "string")]
            assert sorted((r.node_id, r.pos, r.offset, r.tok) for r in got.collect()) == [w for w in whole if w[0] < 4 or given is lexed]
        got = tokens.reconstruct(odd.where("node_id = 1 and pos is not null").select("node_id", "pos", "offset", "kind"), texts).collect()
        assert sorted((r.pos // 100_000 + 1, r.kind.pos) for r in got) == [(w[1], w[1]) for w in whole if w[0] == 1 and w[1] != 2]
        assert {(r.pos, r.offset) for r in tokens.reconstruct(odd.select("node_id", "pos", "offset"), texts).collect()} == {(None if w[1] == 2 else w[1] * 100_000 - 7, w[2]) for w in whole}
        plan = tokens.reconstruct_runs(lexed.select("node_id", "pos", "offset"), texts)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(node_id") == 2  # one of tokens, one of texts
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    packed = tokens._packed(lexed.coalesce(1).select("node_id", "pos", "offset"))
    assert {r.pos is not None and len(r.pos) for r in packed.collect()} == {0}
    assert dict(packed.dtypes)["offset"] == "array<smallint>"
