"""Content-addressed snapshots: stable ids, reuse by hash, and what changed between builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.operators.search import dense_ids


def content_groups(rows: DataFrame, id_: str, text: str) -> DataFrame:
    """Each distinct content by hash, with the smallest id that has it and how many do."""
    return rows.groupBy(F.sha2(F.col(text).cast("binary"), 256).alias("sha256")).agg(F.min(id_).alias("first_id"), F.count(F.lit(1)).alias("copies"))


def slices(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Location of every new slice: the stored one of equal hash, else the least new one; ``reused`` says which."""
    loc = F.struct("blob_id", "start", "end")
    own = new.groupBy("sha256").agg(F.min(loc).alias("new_loc"))
    old = stored.select("sha256", loc.alias("old_loc"))
    return own.join(old, "sha256", "left").select("sha256", F.coalesce("old_loc", "new_loc").alias("loc"), F.col("old_loc").isNotNull().alias("reused"))


def build_status(before: DataFrame, after: DataFrame, id_: str = "id", hash_: str = "sha256") -> DataFrame:
    """Per id: added, expired, reused (equal hash) or rewritten."""
    a = before.select(F.col(id_), F.col(hash_).alias("_old"))
    b = after.select(F.col(id_), F.col(hash_).alias("_new"))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "expired").when(F.col("_old") == F.col("_new"), "reused").otherwise("rewritten")
    return a.join(b, id_, "full").select(id_, status.alias("status"))


def get_or_create(existing: DataFrame, wanted: DataFrame, key: list[str], id_: str) -> DataFrame:
    """Ids by natural key: known keys keep theirs, new ones continue after the largest."""
    top = existing.agg(F.max(id_)).collect()[0][0] or 0
    fresh = wanted.select(*key).distinct().join(existing.select(*key), key, "left_anti")
    return existing.select(*key, id_).unionByName(dense_ids(fresh, key, id_, top + 1).select(*key, id_))


def upsert_spans(existing: DataFrame, found: DataFrame, build: int) -> DataFrame:
    """Spans by (path, kind, start): end, depth and build are refreshed, ids stay."""
    key = ["path_id", "node_kind", "start"]
    ids = get_or_create(existing.withColumnRenamed("node_id", "id"), found, key, "id").withColumnRenamed("id", "node_id")
    new = found.groupBy(*key).agg(F.max(F.struct("end", "nest_level")).alias("_n"))
    old = existing.select(*key, F.col("end").alias("_end"), F.col("nest_level").alias("_level"), F.col("last_build").alias("_build"))
    merged = ids.join(old, key, "left").join(new, key, "left")
    seen = F.col("_n").isNotNull()
    return merged.select(
        "node_id",
        *key,
        F.coalesce("_n.end", "_end").alias("end"),
        F.coalesce("_n.nest_level", "_level").alias("nest_level"),
        F.when(seen, F.lit(build)).otherwise(F.col("_build")).alias("last_build"),
    )


def fresh(rows: DataFrame, build: int) -> DataFrame:
    """Rows that the build has touched."""
    return rows.where(F.col("last_build") == build)


def vacuum(rows: DataFrame, build: int, keep: int = 1) -> DataFrame:
    """Without rows that the last ``keep`` builds did not touch (an addition of this engine)."""
    return rows.where(F.col("last_build") > build - keep)


def write_statistics(status: DataFrame, sizes: DataFrame) -> DataFrame:
    """Nodes and bytes by status."""
    return status.join(sizes, "id", "left").groupBy("status").agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def write_table(df: DataFrame, path: str, mode: str = "file", codec: str = "gzip", by: list[str] | None = None, sort: list[str] | None = None, replace: bool = False) -> None:
    """Sinks: ``file`` (Parquet on any Hadoop file system), ``json`` (lines), ``memory`` (a cached view of that name), ``none``.

    ``sort`` orders rows inside files, so that readers skip row groups by key.
    With ``replace`` what the path holds goes first, so that a job can be run again.
    """
    if mode == "none":
        df.write.format("noop").mode("overwrite").save()
        return
    if mode == "memory":
        df.cache().createOrReplaceTempView(path)
        return
    if sort:
        df = df.repartitionByRange(*[F.col(c) for c in sort]).sortWithinPartitions(*sort)
    w = df.write.mode("overwrite" if replace else "append").option("compression", codec)
    w = w.partitionBy(*by) if by else w
    w.json(path) if mode == "json" else w.parquet(path)


def read_table(spark: SparkSession, path: str, mode: str = "file", schema: StructType | None = None) -> DataFrame:
    """What ``write_table`` wrote; JSON lines want their schema, or are scanned once more to find it."""
    if mode == "memory":
        return spark.table(path)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path) if mode == "json" else reader.parquet(path)


def with_path_ids(rows: DataFrame, paths: DataFrame, path: str = "path") -> DataFrame:
    """Rows with the ``path_id`` of their path, null where it is unknown or null."""
    named = rows.where(F.col(path).isNotNull()).join(paths.select(F.col("path").alias(path), "path_id"), path, "left")
    return named.unionByName(rows.where(F.col(path).isNull()).withColumn("path_id", F.lit(None).cast(dict(paths.dtypes)["path_id"])))


def split_processed(paths: DataFrame, processed: DataFrame) -> DataFrame:
    """Each path once, with ``already_processed``."""
    done = processed.select("path").distinct().withColumn("_done", F.lit(True))
    return paths.select("path").distinct().join(done, "path", "left").select("path", F.coalesce("_done", F.lit(False)).alias("already_processed"))


def file_runs(nodes: DataFrame, unit: str, order: str, key: str = "path_id") -> DataFrame:
    """Nodes with ``run``: the number, within their unit, of the run of consecutive nodes of one file that they are in."""
    w = W.partitionBy(unit).orderBy(order)
    changed = F.coalesce((~F.col(key).eqNullSafe(F.lag(key).over(w))).cast("long"), F.lit(0))
    first = F.row_number().over(w) == 1
    return nodes.withColumn("_new", F.when(first, 0).otherwise(changed)).withColumn("run", F.sum("_new").over(w)).drop("_new")


def builds_latest(builds: DataFrame) -> DataFrame:
    """The newest ready build of each repository and branch."""
    done = builds.where("ready")
    return done.groupBy("repo_id", "branch").agg(F.max_by("build_id", F.struct("ended", "build_id")).alias("build_id"), F.max("ended").alias("ended"))
