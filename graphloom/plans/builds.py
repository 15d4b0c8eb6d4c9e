"""Builds in a store: each keeps its ids, and writes only what changed since the last one.

Layout below ``folder``:

- ``<repo>/nodes/written=<build>``: nodes that this build was the first to hold, sorted by id;
- ``<repo>/slices/written=<build>``: reference sets likewise, one row a content, sorted by hash;
- ``<repo>/<build>/nodemap``, ``refmap``, ``symmap``: what the build holds, and which build wrote it;
- ``<repo>/<build>/paths``, ``spans``, ``items``, ``ids``, ``path_ids``: its other tables; the last two keep every key ever seen;
- ``builds``: the catalog. A build's row comes last, so one that broke off is never listed and can be written again.

A node is unchanged if the JSON of all its columns, with its text's hash for the
text, has the hash it had; then its location, the build that wrote it, stays. Readers join a build's map with the
partitions that its catalog row names, and no others are listed or read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from graphloom.operators import store
from graphloom.plans import interchange
from graphloom.runtime import Tables

KEYS = {"paths": ["path"], "spans": ["path_id", "start"], "items": ["key"], "ids": ["path", "at"], "path_ids": ["path"]}


def content_hash(columns: list[str]):
    """sha256 of the row as JSON, columns by name; nulls and missing fields are one."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])).cast("binary"), 256)


def located(new: DataFrame, before: DataFrame | None, key: list[str], build: str) -> DataFrame:
    """``key, sha256, written`` of new rows: the place of the row of equal key and hash, else this build."""
    if before is None:
        return new.select(*key, "sha256", F.lit(build).alias("written"))
    old = before.select(*key, F.col("sha256").alias("_old"), F.col("written").alias("_at"))
    same = F.col("_old") == F.col("sha256")
    return new.join(old, key, "left").select(*key, "sha256", F.when(same, F.col("_at")).otherwise(F.lit(build)).alias("written"))


def symbol_map(nodes: DataFrame) -> DataFrame:
    """``sym_id, node_id, offset``: the least node and place with a token of that symbol and no link, or with any."""
    each = nodes.select(F.col("id").alias("node_id"), F.explode("tokens").alias("t")).where("t.sym_id is not null")
    place = F.struct(F.col("t.href").isNotNull().alias("linked"), "node_id", F.col("t.offset").alias("offset"))
    return each.groupBy(F.col("t.sym_id").alias("sym_id")).agg(F.min(place).alias("p")).select("sym_id", "p.node_id", "p.offset")


def write(tables: dict[str, DataFrame], folder: str, repo: str, branch: str, build: str, before: str | None = None) -> DataFrame:
    """Store a build and return the catalog; ``before`` is the build whose places unchanged rows keep.

    ``tables`` are those of ``interchange.index``, which must have been given
    ``ids(..., before)`` for nodes to keep their ids.
    """
    bare = tables["bare"]
    spark = bare.sparkSession
    if before == build or exists(spark, folder, repo, build):
        raise ValueError(f"build {build!r} of {repo!r} is there already")
    at, own = f"{folder}/{repo}/{build}", Tables(spark, "build")

    def put(df: DataFrame, path: str, sort: list[str]) -> DataFrame:
        store.write_table(df, path, sort=sort, replace=True)
        return spark.read.schema(df.schema).parquet(path)

    hashed = own.put("hashed", bare.select(F.col("id").alias("node_id"), content_hash(bare.columns).alias("sha256")))
    nodemap = put(located(hashed, read_map(spark, folder, repo, before, "nodemap"), ["node_id"], build), f"{at}/nodemap", ["node_id"])
    fresh = nodemap.where(F.col("written") == build).select(F.col("node_id").alias("id"))
    # Ids that one build gave rise with path and place, so nodes dealt by these are not dealt by id again.
    written = interchange.with_text(bare.join(fresh, "id", "left_semi"), tables["texts"])
    put(written.sortWithinPartitions("id"), f"{folder}/{repo}/nodes/written={build}", [])

    refs = own.put("refs", tables["references"].withColumn("sha256", content_hash(["refs"])))
    last = read_map(spark, folder, repo, before, "refmap")
    known = refs.select("sha256").distinct()
    # A set is found by its hash alone, whatever node it belonged to.
    places = known.withColumn("written", F.lit(build)) if last is None else known.join(last.groupBy("sha256").agg(F.min("written").alias("_at")), "sha256", "left").select("sha256", F.coalesce("_at", F.lit(build)).alias("written"))
    refmap = put(refs.select("node_id", "offset", "sha256").join(places, "sha256"), f"{at}/refmap", ["node_id", "offset"])
    new_slices = refmap.where(F.col("written") == build).select("sha256").distinct()
    put(refs.groupBy("sha256").agg(F.first("refs").alias("refs")).join(new_slices, "sha256", "left_semi"), f"{folder}/{repo}/slices/written={build}", ["sha256"])

    put(symbol_map(bare), f"{at}/symmap", ["sym_id"])
    for name, key in KEYS.items():
        put(tables[name], f"{at}/{name}", key)
    held = [sorted(r["written"] for r in m.select("written").distinct().collect()) for m in (nodemap, refmap)]  # one row a build
    root = tables["paths"].where("path = ''").agg(F.max("node_id").alias("repo_root_node_id"))
    text = lambda v: F.lit(v).cast("string")
    row = root.select(
        text(build).alias("build_id"), text(repo).alias("repo_id"), text(branch).alias("branch"), text(f"{at}/nodemap").alias("nodemap"), text(f"{at}/symmap").alias("symmap"), text(f"{at}/refmap").alias("refmap"),
        "repo_root_node_id", F.current_timestamp().alias("ended"), F.lit(True).alias("ready"), text(before).alias("before"), F.array(*map(text, held[0])).cast("array<string>").alias("node_parts"), F.array(*map(text, held[1])).cast("array<string>").alias("slice_parts"),
    )
    row.coalesce(1).write.mode("append").parquet(f"{folder}/builds")
    own.drop("hashed", "refs")
    return catalog(spark, folder)


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/builds")


def exists(spark: SparkSession, folder: str, repo: str, build: str) -> bool:
    try:
        return not catalog(spark, folder).where((F.col("repo_id") == repo) & (F.col("build_id") == build)).isEmpty()
    except AnalysisException:  # no catalog yet
        return False


def latest(spark: SparkSession, folder: str, repo: str, branch: str | None = None) -> str | None:
    """The newest ready build of a repository, of a branch if one is given; None if there is none yet."""
    try:
        rows = catalog(spark, folder).where((F.col("repo_id") == repo) & F.col("ready"))
    except AnalysisException:  # no catalog yet
        return None
    newest = (rows if branch is None else rows.where(F.col("branch") == branch)).orderBy(F.desc("ended"), F.desc("build_id")).first()
    return newest["build_id"] if newest else None


def read_map(spark: SparkSession, folder: str, repo: str, build: str | None, name: str) -> DataFrame | None:
    return None if build is None else spark.read.parquet(f"{folder}/{repo}/{build}/{name}")


def ids(spark: SparkSession, folder: str, repo: str, build: str | None) -> dict[str, DataFrame] | None:
    """The keys and ids that ``interchange.index`` continues from."""
    return None if build is None else {n: spark.read.parquet(f"{folder}/{repo}/{build}/{n}") for n in ("ids", "path_ids")}


def _row(spark: SparkSession, folder: str, repo: str, build: str):
    row = catalog(spark, folder).where((F.col("repo_id") == repo) & (F.col("build_id") == build) & F.col("ready")).orderBy(F.desc("ended")).first()
    if row is None:
        raise ValueError(f"no build {build!r} of {repo!r}")
    return row


def _parts(spark: SparkSession, folder: str, repo: str, name: str, parts: list[str]) -> DataFrame | None:
    """The rows that the given builds wrote, with ``written``."""
    base = f"{folder}/{repo}/{name}"
    if not parts:
        return None
    each = [spark.read.parquet(f"{base}/written={p}").withColumn("written", F.lit(p)) for p in parts]
    out = each[0]
    for df in each[1:]:
        out = out.unionByName(df)
    return out


def nodes(spark: SparkSession, folder: str, repo: str, build: str) -> DataFrame:
    """All nodes of a build, with ``written`` and ``sha256``."""
    row = _row(spark, folder, repo, build)
    held = read_map(spark, folder, repo, build, "nodemap").withColumnRenamed("node_id", "id")
    parts = _parts(spark, folder, repo, "nodes", row["node_parts"] or [build])
    return parts.join(held, ["id", "written"])


def lookup(spark: SparkSession, folder: str, repo: str, build: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (``node_id`` and others) with the columns of their node; ``id`` is null where the build has none."""
    row = _row(spark, folder, repo, build)
    held = wanted.join(read_map(spark, folder, repo, build, "nodemap").select("node_id", "written"), "node_id", "left")
    parts = _parts(spark, folder, repo, "nodes", row["node_parts"] or [build])
    return held.join(parts.withColumn("node_id", F.col("id")), ["node_id", "written"], "left").drop("written")


def references(spark: SparkSession, folder: str, repo: str, build: str) -> DataFrame:
    """``node_id, offset, refs, sha256, written`` of a build."""
    row = _row(spark, folder, repo, build)
    held = read_map(spark, folder, repo, build, "refmap")
    return held.join(_parts(spark, folder, repo, "slices", row["slice_parts"] or [build]), ["sha256", "written"])


def changes(spark: SparkSession, folder: str, repo: str, before: str, build: str) -> DataFrame:
    """``node_id, status, written`` between two builds: added, expired, reused or rewritten."""
    old, new = (read_map(spark, folder, repo, b, "nodemap") for b in (before, build))
    status = store.build_status(old, new, "node_id")
    return status.join(new.select("node_id", "written"), "node_id", "left")


def unused(spark: SparkSession, folder: str, repo: str, keep: list[str]) -> list[str]:
    """Builds whose written nodes and slices none of the builds to ``keep`` holds: their partitions may be deleted."""
    rows = catalog(spark, folder).where(F.col("repo_id") == repo)
    held = rows.where(F.col("build_id").isin(*keep)).select(F.explode(F.concat("node_parts", "slice_parts")).alias("build_id")).distinct()
    return sorted(r["build_id"] for r in rows.select("build_id").distinct().join(held, "build_id", "left_anti").collect())
