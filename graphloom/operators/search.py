"""Symbol search over index-item tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import search as fs


def fuzzy(items: DataFrame, query: str, limit: int, key: str = "key", ordinal: str = "ordinal", with_positions: bool = True) -> DataFrame:
    """Top ``limit`` items whose key contains ``query`` as a subsequence.

    Ties in score break by key, then by ordinal. Empty keys are no candidates.
    The plan is a scan, a codegen filter and TakeOrderedAndProject: each task
    keeps ``limit`` rows, so nothing is shuffled but those.
    """
    k = F.col(key)
    hits = items.where((F.length(k) > 0) & fs.is_subsequence(k, query)).withColumn("score", fs.score(k, query))
    top = hits.orderBy(F.desc("score"), k, F.col(ordinal)).limit(limit)
    return top.withColumn("positions", fs.positions(k, query)) if with_positions else top


def substring(items: DataFrame, query: str, limit: int | None = None, by_length: bool = False, key: str = "key", ordinal: str = "ordinal") -> DataFrame:
    """Items whose key contains ``query``, case ignored in full Unicode, in input or length order."""
    hits = items.where(F.contains(F.lower(F.col(key)), F.lower(F.lit(query))))
    order = [F.octet_length(F.col(key)), F.col(ordinal)] if by_length else [F.col(ordinal)]
    hits = hits.orderBy(*order)
    return hits if limit is None else hits.limit(limit)


def index_table(items: DataFrame) -> DataFrame:
    """Search index rows from items: direct and node links only, keys normalised and under 200 bytes, no repeats."""
    return (
        items.where(F.col("href.kind").isin("id", "direct"))
        .withColumn("key", fs.search_key(F.col("key")))
        .where((F.length("key") > 0) & (F.octet_length("key") < 200))
        .dropDuplicates()
    )


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """Distinct sorted values with dense ids from 0.

    Range-partitioned: ids come from per-partition counts and a row number
    inside each, so no task sees the whole dictionary.
    """
    values = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    return dense_ids(values, ["value"], "id")


def decode_ids(df: DataFrame, dictionary_: DataFrame, id_: str, name: str) -> DataFrame:
    """``df`` with the value ``name`` of the dictionary at ``id_``, null where there is none."""
    values = dictionary_.select(F.col("id").alias(id_), F.col("value").alias(name))
    return df.join(values, id_, "left")


def prefixed(index: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """Keys with a prefix: on a table sorted by key the filter skips row groups, as a walk down a trie would."""
    return index.where(F.col(key).startswith(prefix))


def dense_ids(df: DataFrame, by: list[str], name: str, start: int = 0) -> DataFrame:
    """Gapless ids in the order of ``by`` without a single-partition window."""
    from pyspark.sql import Window as W

    from graphloom.runtime import stash

    ranged = stash(df.repartitionByRange(*[F.col(c) for c in by]).withColumn("_part", F.spark_partition_id()), "ids")
    counts = ranged.groupBy("_part").count()
    offsets = counts.select("_part", (F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).alias("_before"))
    inner = F.row_number().over(W.partitionBy("_part").orderBy(*by)) - 1
    return (
        ranged.withColumn("_rn", inner)
        .join(offsets, "_part")
        .withColumn(name, (F.coalesce("_before", F.lit(0)) + F.col("_rn") + start).cast("bigint"))
        .drop("_part", "_rn", "_before")
    )
