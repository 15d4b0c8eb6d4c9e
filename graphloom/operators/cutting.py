"""Cutting of annotated files into nodes: a file, its declarations, and the methods of its classes.

``tokens`` are ``path_id, off, end, tok, type, cursor``, where ``cursor`` may be
null; ``cursors`` are ``id, path_id, parent, kind, name, is_definition, start,
end``. The unit itself has no row, so cursors at its top have a null parent.
Everything goes by cursors, of which a file has far fewer than tokens; tokens
are only grouped by cursor and placed by one stabbing join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators import search, spans, tree
from graphloom.operators import tokens as token_ops
from graphloom.runtime import Tables

# Cursor kinds that never start a block, that have methods, and that are methods; the text of an elision.
CONTAINERS = ("Namespace", "LinkageSpec")
CLASSES = ("ClassDecl", "ClassTemplate")
METHODS = ("Method", "Constructor", "Destructor", "FunctionTemplate")
ELISION = " … "
ASSEMBLY = r"\.(S|s|asm)$"


def is_assembly(path: Column) -> Column:
    """Files that stay whole."""
    return path.rlike(ASSEMBLY)


def starts_block(kind: Column, top_kind: Column | None = None, top_is_definition: Column | None = None) -> Column:
    """Whether a token's cursor starts a block; within a class (``top_*``: the member that holds it) only defined methods do."""
    starts = ~kind.isin(*CONTAINERS)
    return starts if top_kind is None else starts & top_kind.isin(*METHODS) & top_is_definition


def islands(extents: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping extents of a key as one: ``start, end`` and the ``cursor`` of the first and longest; touching ones stay apart."""
    w = W.partitionBy(*keys).orderBy("start", F.desc("end"), "cursor")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    numbered = extents.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(w))
    first = F.min_by("cursor", F.struct("start", -F.col("end"), "cursor"))
    return numbered.groupBy(*keys, "_island").agg(first.alias("cursor"), F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def _extents(used: DataFrame, tops: DataFrame, cursors: DataFrame) -> DataFrame:
    """Extents of the cursors' ``top`` in the file of their tokens; of the tokens themselves where it lies in another."""
    top = cursors.select(F.col("id").alias("top"), F.col("path_id").alias("_path"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("kind").alias("top_kind"), F.col("is_definition").alias("top_defined"), F.col("name").alias("top_name"))
    here = F.col("_path") == F.col("path_id")
    return used.join(tops, "cursor").join(top, "top").withColumns({"start": F.when(here, F.col("_start")).otherwise(F.col("first_off")), "end": F.when(here, F.col("_end")).otherwise(F.col("last_end"))})


def blocks(tokens: DataFrame, cursors: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """``node_id, path_id, nest_level, start, end, cursor, kind, member_of, outer_id`` of every node that the files are cut into.

    Level 0 is the file, level 1 the outermost declarations in it, overlapping
    ones as one, level 2 the defined methods of a class of level 1. Methods have
    no methods, so there is no deeper level. Files of ``whole`` (``path_id``)
    have level 0 only. Ids are gapless in the order of path, level and start.
    """
    tables = Tables(tokens.sparkSession, "cutting")
    none = F.lit(None)
    cut = tokens if whole is None else tokens.join(whole.select("path_id").distinct(), "path_id", "left_anti")
    seen = cut.where("cursor is not null").groupBy("path_id", "cursor").agg(F.min("off").alias("first_off"), F.max("end").alias("last_end"))
    own = cursors.select(F.col("id").alias("cursor"), "kind", "parent")
    used = tables.put("used", seen.join(own.drop("parent"), "cursor").where(starts_block(F.col("kind"))).drop("kind"))
    tops = tables.put("tops", tree.outermost(cursors.select("id", "parent", "kind")).withColumnRenamed("id", "cursor"))
    outer = islands(_extents(used, tops, cursors).select("path_id", F.col("top").alias("cursor"), "start", "end").distinct(), ["path_id"])
    named = cursors.select(F.col("id").alias("cursor"), F.col("kind").alias("cursor_kind"), "name")
    outer = tables.put("outer", outer.join(named, "cursor"))

    # members of classes: the walk ends below the class
    classes = outer.where(F.col("cursor_kind").isin(*CLASSES)).select(F.col("cursor").alias("top"), F.col("name").alias("class"), "path_id", F.col("start").alias("class_start"))
    inside = tops.join(classes.select("top").distinct(), "top").where("cursor <> top").join(own, "cursor")
    below = inside.select(F.col("cursor").alias("id"), F.when(F.col("parent") != F.col("top"), F.col("parent")).alias("parent"), "kind")
    members = tables.put("members", tree.outermost(below).join(tops.select(F.col("cursor").alias("id"), F.col("top").alias("class_cursor")), "id").withColumnRenamed("id", "cursor"))
    held = _extents(used, members, cursors).where(F.col("top_kind").isin(*METHODS) & F.col("top_defined"))
    held = held.join(classes.withColumnRenamed("top", "class_cursor"), ["class_cursor", "path_id"])
    methods = islands(held.select("path_id", "class_start", "class", F.col("top").alias("cursor"), "start", "end").distinct(), ["path_id", "class_start", "class"])

    kind = F.when(F.col("cursor_kind").isin(*CLASSES), "Class").otherwise("Definition")
    columns = ["path_id", "nest_level", "start", "end", "cursor", "kind", "member_of", "outer_start"]
    id_type = dict(cursors.dtypes)["id"]
    files = tokens.groupBy("path_id").agg(F.max("end").alias("end")).select("path_id", F.lit(0).alias("nest_level"), F.lit(0).cast("long").alias("start"), "end", none.cast(id_type).alias("cursor"), F.lit("SourceFile").alias("kind"), none.cast("string").alias("member_of"), none.cast("long").alias("outer_start"))
    one = outer.select("path_id", F.lit(1).alias("nest_level"), "start", "end", "cursor", kind.alias("kind"), none.cast("string").alias("member_of"), F.lit(0).cast("long").alias("outer_start"))
    two = methods.select("path_id", F.lit(2).alias("nest_level"), "start", "end", "cursor", F.lit("Definition").alias("kind"), F.col("class").alias("member_of"), F.col("class_start").alias("outer_start"))
    every = tables.put("blocks", search.dense_ids(files.unionByName(one).unionByName(two).select(columns), ["path_id", "nest_level", "start"], "node_id", 1))
    around = every.select("path_id", (F.col("nest_level") + 1).alias("nest_level"), F.col("start").alias("outer_start"), F.col("node_id").alias("outer_id"))
    return every.join(around, ["path_id", "nest_level", "outer_start"], "left").select("node_id", "path_id", "nest_level", "start", "end", "cursor", "kind", "member_of", "outer_id")


def block_tokens(tokens: DataFrame, cut: DataFrame, most: int = 100_000) -> DataFrame:
    """``node_id, pos, off, end, tok, type, cursor, elides`` of each node of ``blocks``, in order of offset.

    A token is shown in the innermost block that holds it; in the block around,
    one elision stands for it, whose ``elides`` is the inner node. Longer nodes
    end in a mark after ``most`` tokens.
    """
    own = spans.place(tokens, cut.withColumn("fresh", F.lit(True))).where("node_id is not null")
    shown = own.select("node_id", "off", "end", "tok", "type", "cursor", F.lit(None).cast("long").alias("elides"))
    gone = cut.where("outer_id is not null").select(F.col("outer_id").alias("node_id"), F.col("start").alias("off"), "end", F.lit(ELISION).alias("tok"), F.lit("Identifier").alias("type"), F.lit(None).cast(dict(tokens.dtypes)["cursor"]).alias("cursor"), F.col("node_id").alias("elides"))
    order = W.partitionBy("node_id").orderBy("off", F.col("elides").isNotNull(), "end")
    return token_ops.truncate(shown.unionByName(gone).withColumn("pos", F.row_number().over(order) - 1), most)


def definition_context(cursors: DataFrame) -> DataFrame:
    """``id, context``: names from a cursor outwards along ``semantic_parent``, of those declared or defined and named.

    Walks double in length each round. A parent without a row ends the walk; a
    cycle of parents raises a ValueError.
    """
    tables = Tables(cursors.sparkSession, "context")
    own = F.when((F.col("is_definition") | F.col("is_declaration")) & F.col("name").isNotNull(), F.array("name")).otherwise(F.array().cast("array<string>"))
    known = cursors.select(F.col("id").alias("at"))
    start = cursors.select("id", F.col("semantic_parent").alias("at"), own.alias("context"))
    ended = start.join(known, "at", "left_anti").withColumn("at", F.lit(None).cast(dict(cursors.dtypes)["id"]))
    walks = tables.put("walks", start.join(known, "at", "left_semi").unionByName(ended))
    most, steps = walks.count(), 1
    while not walks.where("at is not null").isEmpty():
        if steps > most:
            raise ValueError("the cursors' parents form a cycle")
        further = walks.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("context").alias("later"))
        open_ = walks.where("at is not null").join(further, "at").select("id", F.col("next").alias("at"), F.concat("context", "later").alias("context"))
        walks = tables.put("walks", open_.unionByName(walks.where("at is null")))
        steps *= 2
    return walks.select("id", "context")


def facts(cursors: DataFrame) -> DataFrame:
    """Cursors with the ``usr`` of their own or their reference's, and the place of a local definition they lead to.

    Wants ``id, kind, usr, is_definition, reference, definition, path, start``.
    Methods and uses of types lead to their definition, others to what they
    refer to; only definitions, variables and macros count, and no namespace.
    """
    through = F.col("kind").isin("Method", "Constructor", "Destructor", "TemplateRef", "TypeRef")
    to = F.when(through, F.col("definition")).otherwise(F.col("reference"))
    other = cursors.select(F.col("id").alias("_to"), F.col("path").alias("_path"), F.col("start").alias("_start"), (F.col("kind").isin("VarDecl", "MacroDefinition") | F.col("is_definition")).alias("_counts"), (F.col("kind") == "Namespace").alias("_space"))
    refs = cursors.select(F.col("id").alias("reference"), F.col("usr").alias("_usr"))
    asked = cursors.withColumn("_to", to)
    # apart, so that the many cursors that lead nowhere are no hot null key
    led = asked.where("_to is not null").join(other, "_to", "left")
    none = {c: F.lit(None).cast(t) for c, t in other.dtypes if c != "_to"}
    both = led.unionByName(asked.where("_to is null").withColumns(none))
    local = F.coalesce(F.col("_counts") & ~F.col("_space"), F.lit(False))
    placed = both.withColumns({"local_path": F.when(local, F.col("_path")), "local_offset": F.when(local, F.col("_start"))})
    lacking = F.col("usr").isNull() & F.col("reference").isNotNull()
    filled = placed.where(lacking).join(refs, "reference", "left").withColumn("usr", F.col("_usr")).drop("_usr")
    return placed.where(~lacking).unionByName(filled).select(*[c for c in cursors.columns if c not in ("reference", "definition")], "local_path", "local_offset")


def with_facts(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """Tokens with the struct ``sem`` of their cursor; one that names a cursor without a row is an error."""
    sem = known.select(F.col("id").alias("cursor"), F.struct(*known.columns).alias("sem"))
    bare = tokens.where("cursor is null").withColumn("sem", F.lit(None).cast(sem.schema["sem"].dataType))
    checked = F.when(F.col("sem").isNull(), F.raise_error(F.concat(F.lit("no facts of cursor "), F.col("cursor").cast("string"))).cast(sem.schema["sem"].dataType)).otherwise(F.col("sem"))
    return tokens.where("cursor is not null").join(sem, "cursor", "left").withColumn("sem", checked).select(bare.columns).unionByName(bare)
