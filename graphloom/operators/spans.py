"""Places in files: which span holds an offset, and which tokens a nested span hides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of a run of a file that is one join key.
BUCKET = 1 << 16


def _live(spans: DataFrame, level: int | None = None) -> DataFrame:
    """Spans that can hold a point."""
    s = spans.where(F.col("fresh") & (F.col("end") > F.col("start")) & F.col("path_id").isNotNull() & F.col("node_id").isNotNull())
    if level is not None:
        s = s.where(F.col("nest_level") == level)
    return s.select("path_id", "node_id", "start", "end", "nest_level")


def _held(points: DataFrame, spans: DataFrame, bucket: int | None) -> DataFrame:
    """Rows of points, each with the columns ``s.*`` of every span that holds it, or nulls: a join on the path and the run of ``bucket`` bytes."""
    keys = ["path_id"]
    if bucket:
        points = points.withColumn("_b", F.expr(f"off div {bucket}"))
        spans = spans.withColumn("_b", F.explode(F.sequence(F.expr(f"start div {bucket}"), F.expr(f"(end - 1) div {bucket}"))))
        keys.append("_b")
    on = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in keys] + [F.col("s.start") <= F.col("p.off"), F.col("p.off") < F.col("s.end")]
    return points.alias("p").join(spans.alias("s"), on, "left")


def _ends(spans: DataFrame) -> DataFrame:
    """``path_id, off`` where spans start or end: between two of them the innermost span is one."""
    return spans.select("path_id", F.explode(F.array("start", "end")).alias("off")).distinct()


def place(points: DataFrame, spans: DataFrame, level: int | None = None, bucket: int | None = BUCKET) -> DataFrame:
    """Rows of ``points`` (``path_id, off`` and others) with ``node_id`` and ``nest_level`` of the innermost live span that holds them, or nulls.

    Spans, of which there are fewer, are first cut into stretches with one
    innermost span each; of these a point meets at most one, so points are
    neither multiplied nor grouped. Stretches are listed once for each run of
    ``bucket`` bytes that they touch, which spreads a huge file over keys (path,
    run); without ``bucket`` the key is the path. The answer is the same. Ties
    in depth go to the later start, then the larger id.
    """
    s = _live(spans, level)
    best = F.max(F.when(F.col("s.node_id").isNotNull(), F.struct("s.nest_level", "s.start", "s.node_id"))).alias("_best")
    inner = _held(_ends(s), s, bucket).groupBy(*[f"p.{c}" for c in (["path_id", "_b", "off"] if bucket else ["path_id", "off"])]).agg(best)
    until = F.lead("off").over(W.partitionBy("path_id").orderBy("off"))
    stretches = inner.select("path_id", F.col("off").alias("start"), until.alias("end"), F.col("_best.node_id").alias("node_id"), F.col("_best.nest_level").alias("nest_level")).where("node_id is not null")
    return _held(points, stretches, bucket).select(*[F.col(f"p.{c}") for c in points.columns], "s.node_id", "s.nest_level")


def stab(points: DataFrame, spans: DataFrame, level: int | None = None, bucket: int | None = BUCKET) -> DataFrame:
    """``place`` of each different point once: ``path_id, off, node_id, nest_level``."""
    return place(points.select("path_id", "off").distinct(), spans, level, bucket)


def stab_sorted(points: DataFrame, spans: DataFrame) -> DataFrame:
    """``stab`` for spans that do not overlap within a level, by sorting instead of range joins.

    Where spans start or end, the innermost is the predecessor on the deepest
    level that has one; a point has that of the last such place before it.
    """
    s = _live(spans)
    levels = s.select("path_id", "nest_level").distinct()
    asked = _ends(s).join(levels, "path_id").select("path_id", "nest_level", F.col("off").alias("at"), F.lit(1).alias("ask"), F.lit(None).cast("long").alias("node_id"), F.lit(None).cast("long").alias("end"))
    given = s.select("path_id", "nest_level", F.col("start").alias("at"), F.lit(0).alias("ask"), "node_id", "end")
    w = W.partitionBy("path_id", "nest_level").orderBy("at", "ask")
    both = asked.unionByName(given)
    for c in ("node_id", "end"):
        both = both.withColumn(f"_{c}", F.last(c, ignorenulls=True).over(w))
    hit = F.when(F.col("_end") > F.col("at"), F.struct("nest_level", F.col("_node_id").alias("node_id")))
    ends = both.where("ask = 1").groupBy("path_id", "at").agg(F.max(hit).alias("_b")).select("path_id", F.col("at").alias("off"), F.lit(0).alias("ask"), F.col("_b.node_id").alias("node_id"), F.col("_b.nest_level").alias("nest_level"))
    lone = {"ask": F.lit(1), "node_id": F.lit(None).cast(dict(ends.dtypes)["node_id"]), "nest_level": F.lit(None).cast(dict(ends.dtypes)["nest_level"])}
    w = W.partitionBy("path_id").orderBy("off", "ask")
    # a point that stands more than once follows itself
    again = F.lag("off").over(w).eqNullSafe(F.col("off")) & (F.lag("ask").over(w) == 1)
    last = F.last(F.when(F.col("ask") == 0, F.struct("node_id", "nest_level")), ignorenulls=True).over(w)
    found = points.select("path_id", "off").withColumns(lone).unionByName(ends).select("path_id", "off", "ask", again.alias("_again"), last.alias("_b"))
    return found.where((F.col("ask") == 1) & ~F.coalesce("_again", F.lit(False))).select("path_id", "off", "_b.node_id", "_b.nest_level")


def resolve_definitions(links: DataFrame, paths: DataFrame, spans: DataFrame, file_nodes: DataFrame, repo_only: bool = True, bucket: int | None = BUCKET) -> DataFrame:
    """Places (``path, off``) to nodes; ``status`` is ok, outside, unknown path or no node.

    The innermost span wins; without one the file's own node stands in.
    """
    from graphloom.functions.paths import in_repo

    known = links.join(paths.select("path", "path_id"), "path", "left")
    held = stab(known.where("path_id is not null"), spans, bucket=bucket)
    found = known.join(held, ["path_id", "off"], "left").join(file_nodes.select("path_id", F.col("node_id").alias("file_node")), "path_id", "left")
    inside = in_repo(F.col("path")) if repo_only else F.lit(True)
    node = F.coalesce("node_id", "file_node")
    status = F.when(~inside, "outside").when(F.col("path_id").isNull(), "unknown path").when(node.isNull(), "no node").otherwise("ok")
    return found.withColumn("status", status).withColumn("node_id", F.when(status == "ok", node)).drop("file_node", "nest_level")


def elide(tokens: DataFrame, nested: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Tokens that no nested span covers: an anti range join on the path and runs of ``bucket`` bytes."""
    runs = F.explode(F.sequence(F.expr(f"start div {bucket}"), F.expr(f"(end - 1) div {bucket}")))
    t, n = tokens.alias("t"), nested.where(F.col("end") > F.col("start")).select("path_id", "start", "end", runs.alias("_b")).alias("n")
    covered = (F.col("t.path_id") == F.col("n.path_id")) & (F.expr(f"t.off div {bucket}") == F.col("n._b")) & (F.col("n.start") <= F.col("t.off")) & (F.col("t.off") < F.col("n.end"))
    return t.join(n, covered, "left_anti")


def merge_islands(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of a path as one."""
    w = W.partitionBy("path_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    return spans.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(w)).groupBy("path_id", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")
