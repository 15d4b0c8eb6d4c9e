"""Indexing of interchange files in one run: ids, containers, links, uses, references, search items, and the stored build.

``index`` takes the decoded nodes and items of a repository and returns its
tables; ``builds.write`` stores them with a manifest row. Everything is joins
and aggregations keyed by path, node or place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions.paths import ancestors, parent, relative_to
from graphloom.operators import search, spans, store
from graphloom.runtime import Tables

PATH_KINDS = ("Directory", "File", "SourceFile")


def _at() -> Column:
    """A node's place in its path: -1 for the path's own node, else its offset."""
    return F.when(F.col("kind").isin(*PATH_KINDS), F.lit(-1)).otherwise(F.col("start.offset")).cast("long")


def with_text(bare: DataFrame, texts: DataFrame) -> DataFrame:
    """Nodes (``bare``) with the ``text`` of their place and hash, dealt and sorted by path and place.

    Both sides are dealt by range together and matched where they meet, so a
    text is moved once, and lies where sorting by key wants it.
    """
    columns = [c for c in schema.NODE.names if c in bare.columns or c == "text"]
    key = ["path", "_at", "text_sha256"]
    own = [c for c in columns if c not in ("path", "text")]
    given = bare.select("path", _at().alias("_at"), "text_sha256", F.struct(*own).alias("_own"))
    both = given.withColumns({"text": F.lit(None).cast("string"), "_text": F.lit(0)}).unionByName(texts.withColumns({"_own": F.lit(None).cast(given.schema["_own"].dataType), "_text": F.lit(1)}))
    near = both.repartitionByRange("path", "_at").withColumn("_own", F.first("_own").over(W.partitionBy(*key).orderBy("_text")))
    return near.where((F.col("_text") == 1) & F.col("_own").isNotNull()).select(*[F.col(c) if c in ("path", "text") else F.col(f"_own.{c}") for c in columns])


def _numbered(before: DataFrame | None, wanted: DataFrame, key: list[str], id_: str) -> DataFrame:
    """Every key ever seen with its id: known keys keep theirs, new ones follow in the order of the key."""
    return search.dense_ids(wanted.select(*key).distinct(), key, id_, 1) if before is None else store.get_or_create(before, wanted, key, id_)


def _identified(nodes: DataFrame, tables: Tables, before: dict[str, DataFrame] | None) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, DataFrame]]:
    """Nodes (with ``text_size`` for a text) with ``id``; path nodes ``path, path_id, node_id``; spans of the other nodes; keys and ids of this and earlier builds."""
    known = before or {}
    whole = nodes.where(F.col("kind").isin(*PATH_KINDS)).select("path", "kind").groupBy("path").agg(F.min("kind").alias("kind"))
    held = nodes.where("path <> ''").select("path").distinct()
    above = held.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().withColumn("kind", F.lit("Directory"))
    files = held.join(above.select("path"), "path", "left_anti").withColumn("kind", F.lit("SourceFile"))
    named = above.unionByName(files).unionByName(whole).groupBy("path").agg(F.max(F.struct(F.col("kind") != "Directory", "kind")).alias("k")).select("path", "k.kind")
    named = tables.put("named", named)
    every_path = tables.put("path_ids", _numbered(known.get("path_ids"), named, ["path"], "path_id"))
    path_ids = every_path.join(named, "path")
    places = nodes.where(~F.col("kind").isin(*PATH_KINDS)).select("path", F.col("start.offset").alias("at")).distinct()
    wanted = path_ids.select("path", F.lit(-1).cast("long").alias("at")).unionByName(places)
    ids = tables.put("ids", _numbered(known.get("ids"), wanted, ["path", "at"], "id")).withColumnRenamed("id", "new_id")
    own = nodes.drop("id", "path_id").withColumn("at", _at()).join(ids.withColumnRenamed("new_id", "id"), ["path", "at"]).join(path_ids.select("path", "path_id"), "path")
    path_nodes = path_ids.join(ids.where("at = -1").select("path", F.col("new_id").alias("node_id")), "path").select("path", "path_id", "node_id", "kind")
    held_spans = own.where("at >= 0").groupBy("path_id", F.col("at").alias("start")).agg(
        F.max("id").alias("node_id"), F.max(F.col("at") + F.col("text_size")).alias("end"), F.max(F.coalesce("uim_nest_level", F.lit(1))).alias("nest_level")
    )
    state = {"ids": ids.withColumnRenamed("new_id", "id"), "path_ids": every_path}
    return tables.put("identified", own), tables.put("path_nodes", path_nodes), tables.put("spans", held_spans.withColumn("fresh", F.lit(True))), state


def _containers(nodes: DataFrame, path_nodes: DataFrame, held: DataFrame) -> DataFrame:
    """``id, container``: given ones stay; nested nodes lie in the span a level up, others in their file or directory."""
    level = F.coalesce("uim_nest_level", F.lit(1))
    nested = nodes.where((level > 1) & (F.col("at") >= 0)).select("id", "path_id", F.col("at").alias("off"), (level - 1).alias("outer"))
    p, s = nested.alias("p"), held.alias("s")
    inside = (F.col("p.path_id") == F.col("s.path_id")) & (F.col("p.outer") == F.col("s.nest_level")) & (F.col("s.start") <= F.col("p.off")) & (F.col("p.off") < F.col("s.end"))
    outer = p.join(s, inside).groupBy("p.id").agg(F.max_by("s.node_id", "s.start").alias("outer_id"))
    by_path = path_nodes.select("path", F.col("node_id").alias("path_node"))
    at_path = F.when(F.col("at") >= 0, F.col("path")).otherwise(parent(F.col("path")))
    up = nodes.select("id", "container", level.alias("level"), "at", at_path.alias("path")).join(by_path, "path", "left").join(outer, "id", "left")
    is_nested = (F.col("level") > 1) & (F.col("at") >= 0)
    return up.select("id", F.when(is_nested, F.col("outer_id")).otherwise(F.coalesce("container", "path_node")).alias("container"))


def index(nodes: DataFrame, items: DataFrame, prefix: str, before: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """``nodes, bare, texts, paths, spans, uses, references, items, ids, path_ids`` of a repository below ``prefix``.

    Texts take no part in the joins: ``bare`` are the nodes with ``text_sha256``
    in their stead, ``texts`` those of the places, read from the input again,
    and ``nodes`` is ``with_text`` of the two.

    ``before`` holds the ``ids`` and ``path_ids`` of the last build: paths and
    nodes it knows, by path and offset, keep their ids, also after builds
    without them; new ones follow its largest.

    Links to places (``uni``) become links to the innermost node there, or to
    the file's node; a link to an unknown path is dropped. A use is recorded for
    each linked token with a location that is not elided and lies in another
    node. ``has_references`` marks tokens whose place has uses.
    """
    tables = Tables(nodes.sparkSession, "interchange")
    placed = nodes.withColumn("path", relative_to(F.col("path"), prefix))
    sha256 = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    texts = placed.select("path", _at().alias("_at"), sha256, "text")
    own, path_nodes, held, state = _identified(placed.select("*", F.octet_length("text").alias("text_size"), sha256).drop("text"), tables, before)
    each = own.select("id", "at", "path", F.coalesce("uim_reference_context", F.lit("")).alias("context"), F.posexplode("tokens").alias("pos", "t"))
    links = each.where("t.href.kind = 'uni'").select(relative_to(F.col("t.href.path"), prefix).alias("to"), F.col("t.href.offset").alias("off"), F.col("id").alias("_id"), "pos")
    asked = links.select(F.col("to").alias("path"), "off").distinct()
    found = spans.resolve_definitions(asked, path_nodes.select("path", "path_id"), held, path_nodes.select("path_id", "node_id"), repo_only=False)
    found = tables.put("found", found.where("status = 'ok'").select(F.col("path").alias("to"), "off", F.col("node_id").alias("target")))
    linked = links.join(found, ["to", "off"], "left").select(F.col("_id").alias("id"), "pos", "target", F.col("off").alias("target_off"))
    tokens = tables.put("tokens", each.join(linked, ["id", "pos"], "left"))
    seen = (F.col("target") != F.col("id")) & F.col("t.uim_location").isNotNull() & ~F.coalesce("t.uim_elided", F.lit(False))
    recorded = tokens.where(seen).select(
        F.col("target").alias("node_id"), F.col("target_off").alias("offset"), F.col("id").alias("href"), "context", F.col("t.uim_location.offset").alias("use_off"), F.col("path").alias("use_path"), F.lit(False).alias("linked_via_sym")
    )
    uses = tables.put("uses", recorded.distinct())
    referred = uses.select(F.col("node_id").alias("id"), F.col("offset").alias("place")).distinct().withColumn("_has", F.lit(True))
    empty = F.lit(None)
    href = F.when(F.col("t.href.kind") != "uni", F.col("t.href")).when(
        F.col("target").isNotNull(), F.col("t.href").withField("kind", F.lit("token")).withField("node_id", F.col("target")).withField("path", empty.cast("string"))
    )
    flagged = tokens.withColumn("place", F.greatest("at", F.lit(0)) + F.col("t.offset")).join(referred, ["id", "place"], "left")
    new = F.col("t").withField("href", href).withField("has_references", F.coalesce("_has", F.lit(False))).withField("uim_location", empty.cast("struct<line:int,column:int,offset:bigint>"))
    arrays = flagged.select("id", F.struct("pos", new.alias("t")).alias("t")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["t"]).alias("tokens"))
    plain = own.drop("tokens", "container", "at", "text_size", "uim_reference_context", "uim_nest_level")
    bare = tables.put("bare", plain.join(_containers(own, path_nodes, held), "id").join(arrays, "id", "left"))
    refs = uses.groupBy("node_id", "offset").agg(F.array_sort(F.collect_set(F.struct("href", "context", "linked_via_sym", "use_path", "use_off"))).alias("refs"))
    return {"nodes": with_text(bare, texts), "bare": bare, "texts": texts, "paths": path_nodes, "spans": held, "uses": uses, "references": refs, "items": _items(items, path_nodes, held, prefix)} | state


def _items(items: DataFrame, path_nodes: DataFrame, held: DataFrame, prefix: str) -> DataFrame:
    """Given items with their places resolved, and one for each path."""
    from graphloom.sources.uim import link_items

    kind = dict(items.dtypes)["href"]
    path = F.when(F.col("href.path").isNotNull(), relative_to(F.col("href.path"), prefix))
    below = items.withColumn("path", relative_to(F.col("path"), prefix)).withColumn("href", F.when(F.col("href").isNotNull(), F.col("href").withField("path", path)))
    given = link_items(below, path_nodes.select("path", "path_id"), held, path_nodes.select("path_id", "node_id"))
    fields = F.struct(F.lit("id").alias("kind"), F.col("node_id"), *[F.lit(None).cast(t).alias(n) for n, t in (("sym_id", "long"), ("path", "string"), ("offset", "long"), ("blob_id", "long"), ("end", "long"))]).cast(kind)
    item = F.when(F.col("kind") == "Directory", "Directory").otherwise("File")
    files = path_nodes.where("path <> ''").select(F.col("path").alias("key"), fields.alias("href"), item.alias("kind"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("type"))
    return given.select(files.columns).unionByName(files).distinct()
