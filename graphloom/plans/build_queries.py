"""Registered queries over stored builds and their changes, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.plans import builds, interchange
from graphloom.plans.catalog import register
from graphloom.runtime import scratch, table
from graphloom.sources import formats


def _null(name: str, struct) -> F.Column:
    return F.lit(None).cast(struct[name].dataType).alias(name)


def _file_nodes(files: DataFrame) -> DataFrame:
    """``path, text`` as two nodes each: the whole file, and its first line as a definition that links to the file."""
    place = F.struct(*[F.lit(0).cast(f.dataType).alias(f.name) for f in schema.LOCATION])
    token, href = schema.TOKEN, schema.HREF
    link = F.struct(*[F.lit("uni").alias("kind") if n == "kind" else F.col("path") if n == "path" else F.lit(0).cast("long").alias(n) if n == "offset" else _null(n, href) for n in href.names])
    given = {"offset": F.lit(0).cast("long").alias("offset"), "type": F.lit("Identifier").alias("type"), "href": link.alias("href"), "has_references": F.lit(False).alias("has_references")}
    linked = F.array(F.struct(*[given.get(n, _null(n, token)) for n in token.names]))
    empty = F.array().cast(schema.NODE["tokens"].dataType)

    def node(kind: str, text: F.Column, tokens: F.Column) -> F.Column:
        own = {"id": F.lit(0).cast("long"), "kind": F.lit(kind), "path": F.col("path"), "start": place, "text": text, "tokens": tokens, "path_id": F.lit(0)}
        return F.struct(*[own[n].alias(n) if n in own else _null(n, schema.NODE) for n in schema.NODE.names])

    first = F.substring_index("text", "\n", 1)
    return files.select(F.inline(F.array(node("SourceFile", F.col("text"), empty), node("Definition", first, linked))))


_FILES = """
one AS (SELECT source || '/' || coalesce(lang, 'none') || '/' || doc_id AS path, text, source, lang FROM documents),
two AS (SELECT path, CASE WHEN lang = 'fr' THEN text || chr(10) || 'edited' ELSE text END AS text FROM one WHERE source <> (SELECT min(source) FROM documents)
  UNION ALL SELECT 'pages/' || page_id, html FROM pages)"""


@register(
    "incremental_build",
    f"""WITH {_FILES},
    up AS (SELECT path, 1 AS b FROM one UNION ALL SELECT path, 2 FROM two),
    dirs AS (SELECT DISTINCT b, list_aggregate(string_split(path, '/')[1:k], 'string_agg', '/') AS path FROM up, (SELECT unnest(range(0, 3)) AS k) WHERE k < len(string_split(path, '/'))),
    keys AS (SELECT b, coalesce(path, '') AS path, -1 AS place FROM dirs UNION SELECT b, path, -1 FROM up UNION SELECT b, path, 0 FROM up),
    a AS (SELECT path, place, row_number() OVER (ORDER BY path, place) AS id FROM keys WHERE b = 1),
    n AS (SELECT path, place, (SELECT max(id) FROM a) + row_number() OVER (ORDER BY path, place) AS id FROM keys k WHERE b = 2 AND NOT EXISTS (FROM a WHERE a.path = k.path AND a.place = k.place)),
    every AS (SELECT path, place, id, id AS id_before FROM a UNION ALL SELECT path, place, id, NULL FROM n)
    SELECT every.*, CASE WHEN one.path IS NULL AND two.path IS NULL THEN NULL WHEN one.path IS NULL THEN 'added' WHEN two.path IS NULL THEN 'expired'
      WHEN place < 0 AND one.text <> two.text OR split_part(one.text, chr(10), 1) <> split_part(two.text, chr(10), 1) THEN 'rewritten' ELSE 'reused' END AS status,
    CASE WHEN two.path IS NULL THEN NULL WHEN one.path IS NULL OR place < 0 AND one.text <> two.text OR split_part(one.text, chr(10), 1) <> split_part(two.text, chr(10), 1) THEN 'b2' ELSE 'b1' END AS written
    FROM every LEFT JOIN one USING (path) LEFT JOIN two USING (path)""",
)
def incremental_build(spark: SparkSession, sf: str) -> DataFrame:
    """Two builds: the second loses a source, has one language edited, and gains the pages."""
    d = table(spark, sf, "documents").withColumn("path", F.concat_ws("/", "source", F.coalesce("lang", F.lit("none")), "doc_id"))
    least = table(spark, sf, "documents").agg(F.min("source").alias("least"))
    edited = F.when(F.col("lang") == "fr", F.concat("text", F.lit("\nedited"))).otherwise(F.col("text"))
    later = d.join(F.broadcast(least), F.col("source") != F.col("least")).select("path", edited.alias("text"))  # one row
    pages = table(spark, sf, "pages").select(F.concat(F.lit("pages/"), "page_id").alias("path"), F.col("html").alias("text"))
    items = spark.createDataFrame([], schema.INDEX_ITEM)
    folder = scratch(spark, "builds")
    before = None
    for build, files in (("b1", d.select("path", "text")), ("b2", later.unionByName(pages))):
        rooted = files.withColumn("path", F.concat(F.lit("/r/"), "path"))
        found = interchange.index(_file_nodes(rooted), items, "/r", builds.ids(spark, folder, "r", before))
        builds.write(found, folder, "r", "main", build, before)
        before = build
    old, new = (builds.ids(spark, folder, "r", b)["ids"] for b in ("b1", "b2"))
    status = builds.changes(spark, folder, "r", "b1", "b2").withColumnRenamed("node_id", "id")
    return new.join(old.withColumnRenamed("id", "id_before"), ["path", "at"], "left").join(status, "id", "left").select("path", F.col("at").cast("int").alias("place"), "id", "id_before", "status", "written")


@register("json_documents", "SELECT doc_id, lang, source, sha256(text) AS sha256, n_chars FROM documents")
def json_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as JSON without delimiters, and read back."""
    formats.register(spark)
    d, path = table(spark, sf, "documents"), scratch(spark, "documents")
    d.write.format("jsondocs").mode("append").save(path)
    back = spark.read.format("jsondocs").load(path).select(F.from_json("value", d.schema).alias("d")).select("d.*")
    return back.select("doc_id", "lang", "source", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "n_chars")


@register("uim_source", "SELECT doc_id AS id, 'SourceFile' AS kind, source AS path, sha256(text) AS sha256, 2 AS n_tokens, n_chars // 2 AS last_offset FROM documents WHERE source <> (SELECT min(source) FROM documents)")
def uim_source(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as interchange nodes and read back in many tasks, without one source."""
    formats.register(spark)
    path = scratch(spark, "nodes")
    d = table(spark, sf, "documents")
    token = lambda at: F.struct(at.cast("long").alias("offset"), F.lit("Identifier").alias("type"))
    nodes = d.select(F.col("doc_id").alias("id"), F.lit("SourceFile").alias("kind"), F.col("source").alias("path"), F.lit(None).cast("long").alias("container"), "text", F.array(token(F.lit(0)), token(F.expr("n_chars div 2"))).alias("tokens"))
    nodes.write.format("uim").mode("append").save(path)
    least = d.agg(F.min("source")).first()[0]
    back = spark.read.format("uim").option("partitionBytes", str(4 << 20)).schema("id long, kind string, path string, text string, tokens array<struct<offset:long>>").load(path)
    back = back.where(F.col("path") != least)
    return back.select("id", "kind", "path", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.size("tokens").alias("n_tokens"), F.col("tokens")[1]["offset"].alias("last_offset"))
