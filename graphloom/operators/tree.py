"""Containment: directory trees, listings, paths to the root, include closures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.paths import ancestors
from graphloom.runtime import Tables


def dir_children(files: DataFrame, path: str = "path") -> DataFrame:
    """``dir, child, is_dir`` of the tree that files span; each pair once.

    A file's own chain is exploded where the file is; the distinct combines
    before the shuffle, so shared upper directories cost one row a task.
    """
    p = F.col(path)
    parts = F.split(p, "/")
    last = F.size(parts) - 1
    each = files.where(p.isNotNull() & (p != "")).select(F.posexplode(ancestors(p)).alias("i", "dir"), parts.alias("parts"), last.alias("last"))
    return each.select("dir", F.col("parts")[F.col("i")].alias("child"), (F.col("i") < F.col("last")).alias("is_dir")).distinct()


def listing(children: DataFrame) -> DataFrame:
    """Directory nodes' tokens: directories first, then by text; with byte offset and line.

    The text of an entry has a slash after directories and a line end.
    """
    text = F.concat("child", F.when(F.col("is_dir"), "/").otherwise(""), F.lit("\n"))
    order = W.partitionBy("dir").orderBy(F.when(F.col("is_dir"), 0).otherwise(1), "text")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    t = children.withColumn("text", text)
    return t.select(
        "dir",
        "text",
        "is_dir",
        F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)).cast("long").alias("offset"),
        (F.row_number().over(order) - 1).cast("long").alias("line"),
    )


def containers(definitions: DataFrame, nested_in: DataFrame, file_nodes: DataFrame, dir_nodes: DataFrame) -> DataFrame:
    """``id, container``: nested nodes in the node around them, definitions in their file, files and directories in the directory above."""
    from graphloom.functions.paths import parent

    inside = definitions.join(nested_in, "id", "left").join(file_nodes.select("path", F.col("id").alias("file_id")), "path", "left")
    own = inside.select("id", F.coalesce("outer_id", "file_id").alias("container"))
    up = file_nodes.unionByName(dir_nodes.where("path <> ''")).withColumn("dir", parent(F.col("path")))
    above = up.join(dir_nodes.select(F.col("path").alias("dir"), F.col("id").alias("container")), "dir", "left").select("id", "container")
    return own.unionByName(above).unionByName(dir_nodes.where("path = ''").select("id", F.lit(None).cast(dict(dir_nodes.dtypes)["id"]).alias("container")))


def depths(edges: DataFrame) -> DataFrame:
    """``id, depth, root`` of a forest given as ``id, parent``; roots have a null parent.

    Pairs of a node and its ancestor 2^k levels up double their reach each
    round, so a chain of n takes log n rounds. An id that stands under several
    parents has the least depth below each root; what no root leads to, such as
    a cycle, has no row.
    """
    tables = Tables(edges.sparkSession, "depths")
    found = tables.put("found-0", edges.where("parent is null").select("id", F.lit(0).alias("depth"), F.col("id").alias("root")).distinct())
    jumps = tables.put("jumps", edges.where("parent is not null").select("id", F.col("parent").alias("up")).distinct())
    reach = 1  # depths below this are found, and a jump goes up by as much
    while True:
        above = found.select(F.col("id").alias("up"), "depth", "root")
        step = jumps.join(above, "up").groupBy("id", "root").agg((F.min("depth") + reach).alias("depth"))
        new = tables.put(f"found-{reach}", step.join(found.select("id", "root"), ["id", "root"], "left_anti").select("id", "depth", "root"))
        if new.isEmpty():
            return found
        found = found.unionByName(new)
        jumps = tables.put("jumps", jumps.join(jumps.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")).distinct())
        reach *= 2


def distances(edges: DataFrame) -> DataFrame:
    """``src, dst, distance`` for everything reachable, the least number of edges; cycles allowed, so ``src`` may reach itself.

    Rounds double the reach: a pair at a distance between n and 2n is a pair at
    n, joined with one at up to n. So each is derived once for every node in
    the middle of a shortest way, and a way of n edges takes log n rounds.
    """
    tables = Tables(edges.sparkSession, "distances")
    found = tables.put("pairs-1", edges.select("src", "dst").where("src is not null and dst is not null").distinct().withColumn("distance", F.lit(1)))
    reach = 1
    while True:
        first = found.where(F.col("distance") == reach).select("src", F.col("dst").alias("via"))
        rest = found.select(F.col("src").alias("via"), "dst", "distance")
        step = first.join(rest, "via").groupBy("src", "dst").agg((F.min("distance") + reach).alias("distance"))
        new = tables.put(f"pairs-{2 * reach}", step.join(found.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "distance"))
        if new.isEmpty():
            return found
        found = found.unionByName(new)
        reach *= 2


def closure(edges: DataFrame) -> DataFrame:
    """``src, dst`` for everything reachable, cycles allowed."""
    return distances(edges).select("src", "dst")


def outermost(cursors: DataFrame, ignored: tuple[str, ...] = ("NotImplemented", "Namespace", "LinkageSpec")) -> DataFrame:
    """``id, top``: the last ancestor that is no ignored kind, walking ``parent`` to the root; the cursor itself if there is none.

    Walks double in length each round, so a chain of n takes log n of them. A
    parent without a row ends the walk. No walk is longer than the table, so one
    that is comes from a cycle of parents and raises a ValueError.
    """
    tables = Tables(cursors.sparkSession, "outermost")
    known = cursors.select(F.col("id").alias("at"), F.col("kind").alias("at_kind"))
    first = cursors.select("id", F.col("parent").alias("at")).join(known, "at", "left")
    counts = F.col("at_kind").isNotNull() & ~F.col("at_kind").isin(*ignored)
    walks = tables.put("walks", first.select("id", F.when(F.col("at_kind").isNotNull(), F.col("at")).alias("at"), F.when(counts, F.col("at")).alias("top")))
    most, steps = walks.count(), 1
    while not walks.where("at is not null").isEmpty():
        if steps > most:
            raise ValueError("the cursors' parents form a cycle")
        further = walks.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("top").alias("later"))
        open_ = walks.where("at is not null").join(further, "at").select("id", F.col("next").alias("at"), F.coalesce("later", "top").alias("top"))
        walks = tables.put("walks", open_.unionByName(walks.where("at is null")))
        steps *= 2
    return walks.select("id", F.coalesce("top", "id").alias("top"))


def truncate_entries(tokens: DataFrame, most: int) -> DataFrame:
    """File entries stop silently at ``most`` tokens."""
    return tokens.withColumn("_r", F.row_number().over(W.partitionBy("node_id").orderBy("pos"))).where(F.col("_r") <= most).drop("_r")
