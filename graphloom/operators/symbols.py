"""Symbols, uses and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """The last row of each key by ``seq``: an aggregation with map-side combine, no window."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max(F.struct(*seq, *[c for c in rest if c not in seq])).alias("_r")).select(*key, *[F.col(f"_r.{c}") for c in rest])


def first(rows: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """The first row of each key by ``seq``."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min(F.struct(*seq, *[c for c in rest if c not in seq])).alias("_r")).select(*key, *[F.col(f"_r.{c}") for c in rest])


def upsert_symbols(existing: DataFrame, found: DataFrame) -> DataFrame:
    """``sym_id, usr, node_id, offset``: last writer wins, known symbols keep their id, new ones follow in usr order."""
    from graphloom.operators.search import dense_ids

    new = latest(found, ["usr"], ["seq"]).select("usr", "node_id", "offset")
    kept = existing.join(new.select("usr", F.col("node_id").alias("_n"), F.col("offset").alias("_o")), "usr", "left")
    kept = kept.select("sym_id", "usr", F.coalesce("_n", "node_id").alias("node_id"), F.coalesce("_o", "offset").alias("offset"))
    top = existing.agg(F.max("sym_id")).collect()[0][0] or 0
    added = dense_ids(new.join(existing.select("usr"), "usr", "left_anti"), ["usr"], "sym_id", top + 1)
    return kept.unionByName(added.select("sym_id", "usr", "node_id", "offset"))


def with_symbols(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    """Left join on the symbol's name; unknown symbols stay with nulls. Catalyst picks the strategy by size."""
    return tokens.join(symbols.select("usr", "sym_id", F.col("node_id").alias("def_node"), F.col("offset").alias("def_offset")), "usr", "left")


def missing_symbols(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    return tokens.join(symbols.select("usr"), "usr", "left_anti")


def symbol_locations(symbols: DataFrame, nodemap: DataFrame, fresh_only: bool = True) -> DataFrame:
    """Where each symbol's node is stored."""
    m = nodemap.where("fresh") if fresh_only else nodemap
    return symbols.select("sym_id", "node_id").join(m.select("node_id", "blob_id", "start", "end"), "node_id")


def uses(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    """Uses of other nodes: by a token's own local definition, else through its symbol.

    Only identifiers count, and a node's uses of itself do not.
    """
    names = tokens.where("type = 'Identifier'")
    local = names.where("local_node is not null").select(F.col("local_node").alias("node_id"), F.col("local_offset").alias("offset"), F.col("in_node").alias("href"), "context", "use_off", "use_path_id", F.lit(False).alias("linked_via_sym"))
    refs = names.where("local_node is null and cursor = 'DeclRefExpr' and usr is not null")
    through = refs.join(symbols.select("usr", "node_id", "offset"), "usr").select("node_id", "offset", F.col("in_node").alias("href"), "context", "use_off", "use_path_id", F.lit(True).alias("linked_via_sym"))
    both = local.unionByName(through).where("node_id <> href")
    return first(both, ["node_id", "offset", "href", "use_off"], ["linked_via_sym", "context", "use_path_id"])


_PLACE = ["path_id", "node_id", "offset"]
_REF = ["href", "context", "linked_via_sym", "use_path", "use_off"]


#: Uses from which on a definition's are not gathered to find its place.
HOT_USES = 100_000


def _placed_uses(uses_: DataFrame, paths: DataFrame, spans: DataFrame) -> DataFrame:
    """Uses with the path id of their definition and the path they stand in; those without a path drop out.

    The places of definitions with more than ``HOT_USES`` uses, of which there
    can be few, are broadcast, so that no task meets all uses of one.
    """
    where = spans.select("node_id", "path_id").distinct()
    hot = uses_.groupBy("node_id").count().where(F.col("count") > HOT_USES).select("node_id")
    often = uses_.join(F.broadcast(where.join(F.broadcast(hot), "node_id")), "node_id")
    rest = uses_.join(F.broadcast(hot), "node_id", "left_anti").join(where, "node_id")
    return often.unionByName(rest).join(paths.select(F.col("path_id").alias("use_path_id"), F.col("path").alias("use_path")), "use_path_id")


def references(uses_: DataFrame, paths: DataFrame, spans: DataFrame) -> DataFrame:
    """Per definition place the sorted set of its uses, one row each; uses without a path drop out."""
    return _placed_uses(uses_, paths, spans).groupBy(*_PLACE).agg(F.array_sort(F.collect_set(F.struct(*_REF))).alias("refs"))


def reference_pages(uses_: DataFrame, paths: DataFrame, spans: DataFrame, size: int = 1000) -> DataFrame:
    """``path_id, node_id, offset, page, refs``: the sets of ``references`` in pages of ``size``, numbered from 0 in order.

    Uses are dealt by range over place and use together, so those of one hot
    definition lie in as many partitions as they fill. A use's number is its
    number there plus the definition's uses in the partitions before, and no
    row or task ever holds more of a definition than a partition or a page.
    """
    from pyspark.sql import Window as W

    from graphloom.runtime import stash

    each = _placed_uses(uses_, paths, spans).select(*_PLACE, *_REF).distinct()
    ranged = stash(each.repartitionByRange(*_PLACE, *_REF).withColumn("_part", F.spark_partition_id()), "uses")
    inside = F.row_number().over(W.partitionBy(*_PLACE, "_part").orderBy(*_REF)) - 1
    before = F.sum("count").over(W.partitionBy(*_PLACE).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))  # a row a partition
    counts = ranged.groupBy(*_PLACE, "_part").count().select(*_PLACE, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*_PLACE, "_part"]]
    numbered = ranged.withColumn("_at", inside).alias("a").join(counts.alias("b"), same).select(*[F.col(f"a.{c}") for c in [*_PLACE, *_REF]], F.floor((F.col("_at") + F.col("_before")) / size).alias("page"))
    return numbered.groupBy(*_PLACE, "page").agg(F.array_sort(F.collect_list(F.struct(*_REF))).alias("refs"))


def page_directory(pages: DataFrame) -> DataFrame:
    """``path_id, node_id, offset, page, n, first``: each page with its number of uses and the first of them, to find the page of a use."""
    return pages.select(*_PLACE, "page", F.size("refs").alias("n"), F.col("refs")[0].alias("first"))


def flag_references(tokens: DataFrame, uses_: DataFrame) -> DataFrame:
    """``has_references`` for every token place."""
    seen = uses_.select("node_id", "offset").distinct().withColumn("has_references", F.lit(True))
    return tokens.join(seen, ["node_id", "offset"], "left").withColumn("has_references", F.coalesce("has_references", F.lit(False)))


def qualified_name(context: Column) -> Column:
    """Innermost-first names of a definition's scopes, joined outermost first."""
    return F.array_join(F.reverse(context), "::")


def index_entries(nodes: DataFrame) -> DataFrame:
    """Search keys of definitions by cursor kind; keys of 200 bytes or more drop out.

    Wants ``id, path, kind, sem_type, sem_name, is_definition, context`` and
    ``tokens`` (``type, text, sem_kind, sem_name, sem_type``).
    """
    t = F.col("tokens")
    type_ = F.when(~F.coalesce(F.col("sem_type").startswith("enum (unnamed at"), F.lit(False)), F.col("sem_type"))
    entry = lambda key, ty: F.struct(key.alias("key"), ty.cast("string").alias("type"))
    name = qualified_name(F.col("context"))
    # enum heads: words up to the brace or the first constant; scoped enums go by their qualified name
    stop = lambda x: (x["text"] == "{") | F.coalesce(x["sem_kind"] == "EnumConstantDecl", F.lit(False))
    start = F.struct(F.lit(False).alias("done"), F.lit(False).alias("scoped"), F.array().cast("array<string>").alias("words"))
    head = F.aggregate(
        F.slice(t, F.lit(2), F.size(t)),
        start,
        lambda a, x: F.when(a["done"], a)
        .when((x["text"] == "class") & (x["type"] == "Keyword"), F.struct(F.lit(True).alias("done"), F.lit(True).alias("scoped"), F.array().cast("array<string>").alias("words")))
        .when(x["type"] == "WS", a)
        .when(stop(x), F.struct(F.lit(True).alias("done"), a["scoped"].alias("scoped"), a["words"].alias("words")))
        .otherwise(F.struct(F.lit(False).alias("done"), a["scoped"].alias("scoped"), F.concat(a["words"], F.array(x["text"])).alias("words"))),
    )
    constants = F.array_distinct(F.transform(F.filter(t, lambda x: (x["sem_kind"] == "EnumConstantDecl") & x["sem_name"].isNotNull()), lambda x: entry(x["sem_name"], type_)))
    none = F.array().cast("array<struct<key:string,type:string>>")
    enum = F.concat(
        F.when(head["scoped"], F.array(entry(name, type_))).otherwise(none),
        constants,
        F.when(F.size(head["words"]) > 0, F.array(entry(F.array_join(head["words"], " "), type_))).otherwise(none),
    )
    variables = F.array_distinct(F.transform(F.filter(t, lambda x: (x["sem_kind"] == "VarDecl") & x["sem_name"].isNotNull()), lambda x: entry(x["sem_name"], x["sem_type"])))
    solid = F.filter(t, lambda x: x["type"] != "WS")
    macro = F.when((F.size(solid) >= 3) & (F.try_element_at(solid, F.lit(2))["text"] == "define"), F.array(entry(F.try_element_at(solid, F.lit(3))["text"], type_))).otherwise(none)
    found = (
        F.when(F.col("kind") == "EnumDecl", enum)
        .when(F.col("kind") == "VarDecl", variables)
        .when(F.col("sem_name").isNotNull() & F.col("is_definition"), F.array(entry(name, type_)))
        .when(F.col("kind") == "PreprocessingDirective", macro)
        .otherwise(none)
    )
    item = F.when(F.col("kind") == "PreprocessingDirective", "Macro").otherwise("Symbol")
    return nodes.select("id", "path", item.alias("item_kind"), F.explode(found).alias("e")).where(F.octet_length("e.key") < 200).select("id", "path", "item_kind", "e.key", "e.type")


def callers(node_refs: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Nodes reached by following forward edges (``src, dst``) at most ``depth`` times, with the least distance."""
    from graphloom.runtime import stash

    seen = stash(start.select(F.col("node_id"), F.lit(0).alias("distance")).distinct(), "reached")
    edge = node_refs.select(F.col("src").alias("node_id"), "dst").distinct()
    front = seen
    for d in range(1, depth + 1):
        step = front.join(edge, "node_id").select(F.col("dst").alias("node_id")).distinct().join(seen.select("node_id"), "node_id", "left_anti")
        front = stash(step.withColumn("distance", F.lit(d)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def cursor_identity(*parts: Column) -> Column:
    """A hash that stands for a cursor, for grouping; rows are told apart by the parts themselves."""
    return F.xxhash64(*parts)
