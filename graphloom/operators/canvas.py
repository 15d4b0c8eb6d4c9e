"""Map canvases: rectangles, relations between them, and catalog views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def arrows(relations: DataFrame, rects: DataFrame) -> DataFrame:
    """Relations with the rectangles of both ends; dangling ones drop out."""
    side = lambda p: rects.select(F.col("id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("top", "left", "width", "height")])
    return relations.join(side("src"), "src_id").join(side("dst"), "dst_id")


def touching(relations: DataFrame, node: int) -> DataFrame:
    return relations.where((F.col("src_id") == node) | (F.col("dst_id") == node))


def add_relations(existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """Accepted relations: no self links, no repeats; a ``reference`` runs from the user to what it uses."""
    flip = F.col("type") == "reference"
    turned = proposed.where("src_id <> dst_id").select(F.when(flip, F.col("dst_id")).otherwise(F.col("src_id")).alias("src_id"), F.when(flip, F.col("src_id")).otherwise(F.col("dst_id")).alias("dst_id"), "type")
    return existing.select("src_id", "dst_id", "type").unionByName(turned).dropDuplicates()


def bounding_box(rects: DataFrame, by: list[str]) -> DataFrame:
    return rects.groupBy(*by).agg(F.min("top").alias("top"), F.min("left").alias("left"), F.max(F.col("top") + F.col("height")).alias("bottom"), F.max(F.col("left") + F.col("width")).alias("right"))


def patch(values: Column, changes: Column) -> Column:
    """A map with changed keys replaced and null ones deleted."""
    kept = F.map_filter(values, lambda k, v: ~F.map_contains_key(changes, k))
    return F.map_concat(kept, F.map_filter(changes, lambda k, v: v.isNotNull()))


def catalog_section(owner: Column, shared_with: Column, public: Column, user: str) -> Column:
    """First match wins: my, shared, public, else hidden."""
    return F.when(owner == user, "my").when(F.array_contains(shared_with, user), "shared").when(public, "public").otherwise("hidden")


def highlighted(sym: Column, href: Column, text: Column, sym2, href2, text2) -> Column:
    """Same symbol, or same link and text."""
    return F.coalesce(sym == sym2, F.lit(False)) | F.coalesce((href == href2) & (text == text2), F.lit(False))


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``errors``: names of the rules that do not hold; null counts as not holding."""
    bad = [F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]
    return df.withColumn("errors", F.array_compact(F.array(*bad)))
