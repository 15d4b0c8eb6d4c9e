"""Registered queries over cut files, stored tables, links and canvases, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import paths, urls
from graphloom.operators import canvas, cutting, nodejson, resolve, search, spans, store, symbols, tokens
from graphloom.plans import service
from graphloom.plans.catalog import register
from graphloom.runtime import table

#: Each document is cut as if it held, in eighths of its length: a namespace around a class with a field part,
#: a method, a declared and a constructing method, and two overlapping variables.
_CURSORS = [
    (0, None, "Namespace", "n", True, 0, None), (1, 0, "ClassDecl", "C", True, 0, 4), (2, 1, "Method", "m", True, 1, 2), (3, 1, "Method", "d", False, 2, 3),
    (4, 1, "Constructor", "C", True, 3, 4), (5, 2, "DeclRefExpr", None, False, 1, 2), (6, 0, "VarDecl", "v", True, 4, 6), (7, 0, "VarDecl", "w", True, 4, 7),
]

_CUT_SQL = """
t AS (SELECT doc_id AS path_id, off, off + 37 AS "end", q, CASE WHEN off < q THEN 1 WHEN off < 2 * q THEN 5 WHEN off < 3 * q THEN 3 WHEN off < 4 * q THEN 4 WHEN off < 6 * q THEN 6 WHEN off < 7 * q THEN 7 ELSE 0 END AS c
  FROM (SELECT doc_id, n_chars // 8 AS q, unnest(range(0, n_chars + 1, 37)) AS off FROM documents)),
u AS (SELECT path_id, any_value(q) AS q, max("end") AS total, bool_or(c IN (1, 3, 4, 5)) AS cls, bool_or(c IN (6, 7)) AS var, bool_or(c = 7) AS w, bool_or(c = 5) AS m, bool_or(c = 4) AS k FROM t GROUP BY 1),
b AS (SELECT path_id, 0 AS nest_level, 0::BIGINT AS "start", total AS "end", NULL::BIGINT AS cursor, 'SourceFile' AS kind, NULL AS member_of FROM u
  UNION ALL SELECT path_id, 1, 0, 4 * q, path_id * 10 + 1, 'Class', NULL FROM u WHERE cls
  UNION ALL SELECT path_id, 1, 4 * q, CASE WHEN w THEN 7 * q ELSE 6 * q END, path_id * 10 + CASE WHEN w THEN 7 ELSE 6 END, 'Definition', NULL FROM u WHERE var
  UNION ALL SELECT path_id, 2, q, 2 * q, path_id * 10 + 2, 'Definition', 'C' FROM u WHERE m
  UNION ALL SELECT path_id, 2, 3 * q, 4 * q, path_id * 10 + 4, 'Definition', 'C' FROM u WHERE k)"""


def _annotated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.expr("n_chars div 8").alias("q"))
    ends = [(F.lit(a) * F.col("q"), F.col("n_chars") if b is None else F.lit(b) * F.col("q")) for *_, a, b in _CURSORS]
    made = [
        F.struct((F.col("doc_id") * 10 + k).alias("id"), (F.lit(None).cast("long") if up is None else F.col("doc_id") * 10 + up).alias("parent"), F.lit(kind).alias("kind"), F.lit(name).cast("string").alias("name"), F.lit(defined).alias("is_definition"), start.cast("long").alias("start"), end.cast("long").alias("end"))
        for (k, up, kind, name, defined, _, _), (start, end) in zip(_CURSORS, ends)
    ]
    cursors = d.select(F.col("doc_id").alias("path_id"), F.explode(F.array(*made)).alias("c")).select("path_id", "c.*")
    at = d.select(F.col("doc_id").alias("path_id"), "q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chars").cast("long"), F.lit(37).cast("long"))).alias("off"))
    inner = F.when(F.col("off") < F.col("q"), 1).when(F.col("off") < 2 * F.col("q"), 5).when(F.col("off") < 3 * F.col("q"), 3).when(F.col("off") < 4 * F.col("q"), 4).when(F.col("off") < 6 * F.col("q"), 6).when(F.col("off") < 7 * F.col("q"), 7).otherwise(0)
    return at.select("path_id", "off", (F.col("off") + 37).alias("end"), F.col("off").cast("string").alias("tok"), F.lit("Identifier").alias("type"), (F.col("path_id") * 10 + inner).alias("cursor")), cursors


@register("cut_blocks", "WITH " + _CUT_SQL + """ SELECT b.*, o."start" AS outer_start FROM b LEFT JOIN b o ON o.path_id = b.path_id AND o.nest_level = b.nest_level - 1 AND o."start" <= b."start" AND b."start" < o."end" """)
def cut_blocks(spark: SparkSession, sf: str) -> DataFrame:
    cut = cutting.blocks(*_annotated(spark, sf))
    outer = cut.select(F.col("node_id").alias("outer_id"), F.col("start").alias("outer_start"))
    return cut.join(outer, "outer_id", "left").select("path_id", "nest_level", "start", "end", "cursor", "kind", "member_of", "outer_start")


@register(
    "cut_tokens",
    "WITH " + _CUT_SQL + """, i AS (SELECT t.path_id, t.off, max(b.nest_level) AS nest_level FROM t JOIN b ON b.path_id = t.path_id AND b."start" <= t.off AND t.off < b."end" GROUP BY ALL),
    x AS (SELECT b.path_id, b.nest_level, b."start", count(*) AS n_tokens, sum(i.off)::BIGINT AS offsets FROM i JOIN b ON b.path_id = i.path_id AND b.nest_level = i.nest_level AND b."start" <= i.off AND i.off < b."end" GROUP BY ALL),
    e AS (SELECT o.path_id, o.nest_level, o."start", count(*) AS n FROM b JOIN b o ON o.path_id = b.path_id AND o.nest_level = b.nest_level - 1 AND o."start" <= b."start" AND b."start" < o."end" GROUP BY ALL)
    SELECT b.path_id, b.nest_level, b."start", coalesce(x.n_tokens, 0) AS n_tokens, coalesce(x.offsets, 0) AS offsets, coalesce(e.n, 0) AS n_elisions FROM b
    LEFT JOIN x USING (path_id, nest_level, "start") LEFT JOIN e USING (path_id, nest_level, "start") WHERE x.n_tokens > 0 OR e.n > 0""",
)
def cut_tokens(spark: SparkSession, sf: str) -> DataFrame:
    toks, cursors = _annotated(spark, sf)
    cut = cutting.blocks(toks, cursors)
    shown = F.col("elides").isNull()
    each = cutting.block_tokens(toks, cut).groupBy("node_id").agg(F.count_if(shown).alias("n_tokens"), F.coalesce(F.sum(F.when(shown, F.col("off"))), F.lit(0)).alias("offsets"), F.count_if(~shown).alias("n_elisions"))
    return each.join(cut.select("node_id", "path_id", "nest_level", "start"), "node_id").drop("node_id")


@register("definition_context", "SELECT 'c' || c_custkey AS id, 'C' || c_custkey || '/' || n_name || CASE WHEN r_regionkey = 2 THEN '' ELSE '/' || r_name END AS context FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def definition_context(spark: SparkSession, sf: str) -> DataFrame:
    def level(name: str, own: str, key: str, up, called) -> DataFrame:
        return table(spark, sf, name).select(F.concat(F.lit(own), key).alias("id"), up.cast("string").alias("semantic_parent"), called.alias("name"), (F.col(key) != 2 if own == "r" else F.lit(True)).alias("is_definition"), F.lit(False).alias("is_declaration"))

    every = level("region", "r", "r_regionkey", F.lit(None), F.col("r_name")).unionByName(level("nation", "n", "n_nationkey", F.concat(F.lit("r"), "n_regionkey"), F.col("n_name")))
    every = every.unionByName(level("customer", "c", "c_custkey", F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("C"), "c_custkey")))
    return cutting.definition_context(every).where("id like 'c%'").select("id", F.array_join("context", "/").alias("context"))


@register(
    "symbol_facts",
    """WITH d AS (SELECT p_partkey, p_size FROM part) SELECT l_orderkey, l_linenumber, 'p' || l_partkey AS usr, CASE WHEN p_size % 2 = 0 THEN 'path' || p_partkey END AS local_path, CASE WHEN p_size % 2 = 0 THEN p_size END AS local_offset
    FROM lineitem LEFT JOIN d ON p_partkey = l_partkey WHERE p_partkey IS NOT NULL""",
)
def symbol_facts(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    defs = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("FunctionDecl").alias("kind"), F.concat(F.lit("p"), "p_partkey").alias("usr"), (F.col("p_size") % 2 == 0).alias("is_definition"), none.alias("reference"), none.alias("definition"), F.concat(F.lit("path"), "p_partkey").alias("path"), F.col("p_size").cast("long").alias("start"))
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    refs = li.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("id"), F.lit("DeclRefExpr").alias("kind"), none.alias("usr"), F.lit(False).alias("is_definition"), F.concat(F.lit("p"), "l_partkey").alias("reference"), none.alias("definition"), F.lit("use").alias("path"), F.col("l_linenumber").cast("long").alias("start"))
    both = cutting.facts(defs.unionByName(refs)).where("kind = 'DeclRefExpr'")
    key = F.split("id", "/")
    return both.select(key[0].cast("long").alias("l_orderkey"), key[1].cast("long").alias("l_linenumber"), "usr", "local_path", "local_offset")


def _doc_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as nodes of two tokens: the first eighth, which links to the next document, and the rest."""
    none = lambda t: F.lit(None).cast(t)
    link = F.struct(F.lit("id").alias("kind"), (F.col("doc_id") + 1).alias("node_id"), none("long").alias("sym_id"), none("string").alias("path"), none("long").alias("offset"), none("long").alias("blob_id"), none("long").alias("end"))
    cut = F.octet_length(F.substr("text", F.lit(1), F.expr("int(n_chars div 8)"))).cast("long")
    token = lambda off, href, refs: F.struct(off.cast("long").alias("offset"), F.lit("Identifier").alias("type"), href.alias("href"), F.lit(refs).alias("has_references"), none("long").alias("sym_id"), none("long").alias("real_offset"), none("int").alias("real_line"))
    start = F.struct(F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit(0).cast("long").alias("offset"))
    plain = F.when(F.lit(False), link)
    toks = F.array(token(F.lit(0), link, False), token(cut, plain, True))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("Definition").alias("kind"), F.col("source").alias("path"), none("long").alias("container"), start.alias("start"), "text", toks.alias("tokens"), none("string").alias("member_of"), F.lit(1).alias("path_id"))


@register(
    "node_json",
    """WITH h AS (SELECT doc_id, source, text, substr(text, 1, n_chars // 8) AS a, substr(text, n_chars // 8 + 1) AS b FROM documents)
    SELECT doc_id AS id, 'id:' || doc_id AS json_id, 'definition' AS kind, source AS path, sha256(a) AS first_text, sha256(b) AS last_text, 'id:' || (doc_id + 1) AS first_link,
    'tok-' || octet_length(encode(a)) AS last_id, (1 + length(a) - length(replace(a, chr(10), '')))::BIGINT AS last_line, 'refs:' || doc_id || '/' || octet_length(encode(a)) AS last_refs FROM h""",
)
def node_json(spark: SparkSession, sf: str) -> DataFrame:
    j = lambda path: F.get_json_object("json", path)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return nodejson.encode(_doc_nodes(spark, sf)).select(
        "id", j("$.id").alias("json_id"), j("$.kind").alias("kind"), j("$.path").alias("path"), sha(j("$.text[0].t")).alias("first_text"), sha(j("$.text[1].t")).alias("last_text"), j("$.text[0].h").alias("first_link"),
        j("$.text[1].id").alias("last_id"), j("$.text[1].N").cast("long").alias("last_line"), j("$.text[1].r").alias("last_refs"),
    )


@register("node_json_round_trip", "SELECT doc_id AS id, sha256(text) AS sha256, octet_length(encode(substr(text, 1, n_chars // 8)))::BIGINT AS last_offset, doc_id + 1 AS link FROM documents")
def node_json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    again = nodejson.decode(nodejson.encode(_doc_nodes(spark, sf)))
    return again.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.element_at("tokens", -1)["offset"].alias("last_offset"), F.col("tokens")[0]["href"]["node_id"].alias("link"))


@register("file_runs", "WITH x AS (SELECT conv_id, turn, role, lag(role) OVER w IS DISTINCT FROM role AND row_number() OVER w > 1 AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, sum(new::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run FROM x")
def file_runs(spark: SparkSession, sf: str) -> DataFrame:
    return store.file_runs(table(spark, sf, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "run")


@register("processed_paths", "SELECT DISTINCT url AS path, url IN (SELECT url FROM pages WHERE page_id % 3 = 0) AS already_processed FROM pages")
def processed_paths(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    return store.split_processed(p, p.where("page_id % 3 = 0"))


@register("path_ids_of_rows", "SELECT o_orderkey, p_partkey AS path_id FROM orders LEFT JOIN part ON o_orderkey % 5 <> 0 AND p_partkey = o_custkey AND p_partkey % 2 = 0")
def path_ids_of_rows(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("f"), "o_custkey")).alias("path"))
    known = table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("f"), "p_partkey").alias("path"), F.col("p_partkey").alias("path_id"))
    return store.with_path_ids(o, known).select("o_orderkey", "path_id")


@register("dictionary_decode", "WITH d AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS id FROM (SELECT DISTINCT p_brand AS value FROM part)) SELECT c_custkey, value AS brand FROM customer LEFT JOIN d ON id = c_nationkey")
def dictionary_decode(spark: SparkSession, sf: str) -> DataFrame:
    brands = search.dictionary(table(spark, sf, "part"), "p_brand")
    return search.decode_ids(table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("type_id")), brands, "type_id", "brand").select("c_custkey", "brand")


@register("prefix_search", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'b')")
def prefix_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.prefixed(table(spark, sf, "part").select("p_partkey", "p_name"), "b", "p_name")


@register("index_rows", "SELECT DISTINCT regexp_replace(c_name || chr(9) || 'é', '[^\\x20-\\x7F]', '', 'g') AS key FROM customer WHERE c_custkey % 4 < 2")
def index_rows(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("id"), F.lit("direct"), F.lit("slice"), F.lit("sym")), (F.col("c_custkey") % 4 + 1).cast("int"))
    items = table(spark, sf, "customer").select(F.concat("c_name", F.lit("\té")).alias("key"), F.struct(kind.alias("kind")).alias("href"))
    return search.index_table(items).select("key").distinct()


@register("owned_repositories", "SELECT c_custkey AS id FROM customer WHERE c_nationkey = 3 AND c_custkey IN (SELECT o_custkey FROM orders)")
def owned_repositories(spark: SparkSession, sf: str) -> DataFrame:
    repos = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("owner"))
    return service.select_repos(repos, table(spark, sf, "orders").select(F.col("o_custkey").alias("repo_id")), 3).select("id")


@register("tokens_in_range", "WITH " + _CUT_SQL + """ SELECT path_id, count(*) AS n, sum(off)::BIGINT AS offsets FROM t WHERE off >= 2 * q AND "end" <= 4 * q GROUP BY 1""")
def tokens_in_range(spark: SparkSession, sf: str) -> DataFrame:
    toks, _ = _annotated(spark, sf)
    eighths = table(spark, sf, "documents").select(F.col("doc_id").alias("path_id"), F.expr("n_chars div 8").alias("q"))
    held = tokens.in_range(toks.join(eighths, "path_id"), 2 * F.col("q"), 4 * F.col("q"))
    return held.groupBy("path_id").agg(F.count(F.lit(1)).alias("n"), F.sum("off").alias("offsets"))


@register(
    "token_links",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 = 0 THEN 'id:' || l_suppkey WHEN l_returnflag <> 'N' THEN NULL WHEN l_partkey % 3 = 0 THEN 'token:' || l_partkey || ':' || l_linenumber WHEN l_linestatus = 'O' AND l_suppkey % 2 = 0 THEN 'sym:' || l_suppkey END AS link FROM lineitem""",
)
def token_links(spark: SparkSession, sf: str) -> DataFrame:
    if_ = lambda c, v: F.when(c, v.cast("long"))
    third = F.col("l_partkey") % 3 == 0
    href = tokens.choose_href(
        F.when(F.col("l_returnflag") == "N", "Identifier").otherwise("Keyword"), if_(F.col("l_partkey") % 7 == 0, F.col("l_suppkey")), if_(third, F.col("l_partkey")), if_(third, F.col("l_linenumber")),
        F.when(F.col("l_linestatus") == "O", "TypeRef").otherwise("ParmDecl"), if_(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")),
    )
    shown = F.when(href["kind"] == "id", F.concat(F.lit("id:"), href["node_id"])).when(href["kind"] == "token", F.concat(F.lit("token:"), href["node_id"], F.lit(":"), href["offset"])).when(href["kind"] == "sym", F.concat(F.lit("sym:"), href["sym_id"]))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", shown.alias("link"))


@register(
    "definition_places",
    """WITH s AS (SELECT p_partkey AS path_id, p_partkey * 10 AS node_id, 0 AS a, 3 AS b, 1 AS level FROM part UNION ALL SELECT p_partkey, p_partkey * 10 + 1, 1, 2, 2 FROM part),
    l AS (SELECT DISTINCT l_partkey AS p, l_linenumber::BIGINT AS off FROM lineitem)
    SELECT p, l.off AS off, CASE WHEN p % 6 = 0 THEN 'outside' WHEN p % 5 = 0 OR part.p_partkey IS NULL THEN 'unknown path' WHEN i.node_id IS NULL AND p % 4 = 0 THEN 'no node' ELSE 'ok' END AS status,
    CASE WHEN p % 6 <> 0 AND p % 5 <> 0 AND part.p_partkey IS NOT NULL THEN coalesce(i.node_id, CASE WHEN p % 4 <> 0 THEN -p END) END AS node_id
    FROM l LEFT JOIN part ON p_partkey = p LEFT JOIN (SELECT path_id, off, arg_max(node_id, level) AS node_id FROM s JOIN (SELECT DISTINCT off FROM l) ON a <= off AND off < b GROUP BY ALL) i ON i.path_id = p AND i.off = l.off""",
)
def definition_places(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda c: F.concat(F.when(F.col(c) % 6 == 0, "../").otherwise("f"), F.col(c))
    part = table(spark, sf, "part")
    links = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p"), name("l_partkey").alias("path"), F.col("l_linenumber").cast("long").alias("off")).distinct()
    known = part.where("p_partkey % 5 <> 0").select(name("p_partkey").alias("path"), F.col("p_partkey").alias("path_id"))
    made = F.array(*[F.struct((F.col("p_partkey") * 10 + k).alias("node_id"), F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end"), F.lit(level).alias("nest_level")) for k, a, b, level in ((0, 0, 3, 1), (1, 1, 2, 2))])
    held = part.select(F.col("p_partkey").alias("path_id"), F.explode(made).alias("s")).select("path_id", "s.*", F.lit(True).alias("fresh"))
    files = part.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("path_id"), (-F.col("p_partkey")).alias("node_id"))
    return spans.resolve_definitions(links, known, held, files).select("p", "off", "status", "node_id")


@register("span_islands", """WITH s AS (SELECT o_custkey AS path_id, o_orderkey AS a, o_orderkey + o_custkey % 900 + 1 AS b FROM orders), r AS (SELECT *, max(b) OVER (PARTITION BY path_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY path_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM r) SELECT path_id, min(a) AS "start", max(b) AS "end" FROM i GROUP BY path_id, k""")
def span_islands(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return spans.merge_islands(o.select(F.col("o_custkey").alias("path_id"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + F.col("o_custkey") % 900 + 1).alias("end")))


@register("symbol_places", "SELECT o_orderkey AS sym_id, c_custkey AS node_id, c_nationkey AS blob_id FROM orders JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0")
def symbol_places(spark: SparkSession, sf: str) -> DataFrame:
    syms = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sym_id"), F.col("o_custkey").alias("node_id"))
    stored = table(spark, sf, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_nationkey").alias("blob_id"), F.lit(0).alias("start"), F.lit(1).alias("end"), (F.col("c_custkey") % 2 == 0).alias("fresh"))
    return symbols.symbol_locations(syms, stored).select("sym_id", "node_id", "blob_id")


@register("fetched_bytes", "SELECT doc_id AS blob_id, sha256(encode(text)[11:20]) AS sha256 FROM documents")
def fetched_bytes(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    located = d.select(F.col("doc_id").alias("blob_id"), F.lit(10).alias("start"), F.lit(20).alias("end"))
    return resolve.fetch(located, d.select(F.col("doc_id").alias("blob_id"), F.col("text").cast("binary").alias("content"))).select("blob_id", F.sha2("bytes", 256).alias("sha256"))


@register("url_dump", "SELECT 'id:' || p_partkey AS url, p_partkey AS node_id FROM part UNION ALL SELECT 'path:' || s_name, s_suppkey FROM supplier UNION ALL SELECT 'sym:' || c_custkey, c_nationkey::BIGINT FROM customer")
def url_dump(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node_id"))
    named = table(spark, sf, "supplier").select(F.col("s_name").alias("path"), F.col("s_suppkey").alias("node_id"))
    return resolve.dump(nodes, named, table(spark, sf, "customer").select(F.col("c_custkey").alias("sym_id"), F.col("c_nationkey").cast("long").alias("node_id")))


@register("write_statistics", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'reused' ELSE 'added' END AS status, count(*) AS nodes, sum(o_custkey)::BIGINT AS bytes FROM orders GROUP BY 1")
def write_statistics(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "reused").otherwise("added").alias("status"), F.col("o_custkey").alias("bytes"))
    return store.write_statistics(o.select("id", "status"), o.select("id", "bytes"))


@register("vacuumed", "SELECT o_orderkey FROM orders WHERE o_custkey % 10 > 9 - 3")
def vacuumed(spark: SparkSession, sf: str) -> DataFrame:
    return store.vacuum(table(spark, sf, "orders").withColumn("last_build", F.col("o_custkey") % 10), 9, 3).select("o_orderkey")


@register("fresh_rows", "SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 9")
def fresh_rows(spark: SparkSession, sf: str) -> DataFrame:
    return store.fresh(table(spark, sf, "orders").withColumn("last_build", F.col("o_custkey") % 10), 9).select("o_orderkey")


@register("span_upsert", """SELECT p_partkey AS path_id, CASE WHEN p_size > 25 THEN p_size::BIGINT + 100 ELSE 10 END AS "end", CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS last_build FROM part WHERE p_partkey % 3 <> 0 OR p_size > 25""")
def span_upsert(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    key = [F.col("p_partkey").alias("path_id"), F.lit("Definition").alias("node_kind"), F.lit(0).cast("long").alias("start")]
    had = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("node_id"), *key, F.lit(10).cast("long").alias("end"), F.lit(1).alias("nest_level"), F.lit(1).alias("last_build"))
    found = p.where("p_size > 25").select(*key, (F.col("p_size").cast("long") + 100).alias("end"), F.lit(1).alias("nest_level"))
    return store.upsert_spans(had, found, 2).select("path_id", "end", "last_build")


@register("canvas_touching", "SELECT l_orderkey AS src_id, l_partkey AS dst_id FROM lineitem WHERE l_orderkey = 7 OR l_partkey = 7")
def canvas_touching(spark: SparkSession, sf: str) -> DataFrame:
    return canvas.touching(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src_id"), F.col("l_partkey").alias("dst_id")), 7)


@register("canvas_relations", "SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE l_orderkey END AS src_id, CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey ELSE l_partkey END AS dst_id, CASE WHEN l_linenumber % 2 = 0 THEN 'reference' ELSE 'link' END AS type FROM lineitem WHERE l_orderkey <> l_partkey")
def canvas_relations(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src_id"), F.col("l_partkey").alias("dst_id"), F.when(F.col("l_linenumber") % 2 == 0, "reference").otherwise("link").alias("type"))
    return canvas.add_relations(new.limit(0), new)


@register("highlighted_tokens", "SELECT l_orderkey, l_linenumber, coalesce(NULLIF(l_suppkey, 3) = 5, FALSE) OR (l_partkey % 10 = 4 AND l_returnflag = 'N') AS highlighted FROM lineitem")
def highlighted_tokens(spark: SparkSession, sf: str) -> DataFrame:
    lit = F.lit
    shown = canvas.highlighted(F.nullif("l_suppkey", lit(3)), F.col("l_partkey") % 10, F.col("l_returnflag"), lit(5), lit(4), lit("N"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", shown.alias("highlighted"))


@register("field_errors", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN '' ELSE 'balance' END || CASE WHEN c_nationkey < 20 THEN '' WHEN c_acctbal > 0 THEN 'nation' ELSE ',nation' END AS errors FROM customer")
def field_errors(spark: SparkSession, sf: str) -> DataFrame:
    checked = canvas.validate(table(spark, sf, "customer"), {"balance": F.col("c_acctbal") > 0, "nation": F.col("c_nationkey") < 20})
    return checked.select("c_custkey", F.array_join("errors", ",").alias("errors"))


@register("build_refs", "SELECT doc_id, source AS repo_id, lang || '/x' AS branch, 'b' || doc_id AS build_id, NOT (source || 'b' || doc_id LIKE '%.%') AS safe, source || ':' || doc_id || ':' || n_chars AS location FROM documents")
def build_refs(spark: SparkSession, sf: str) -> DataFrame:
    ref = F.concat(F.lit("repos/"), "source", F.lit("/branches/"), "lang", F.lit("%2Fx/builds/b"), "doc_id")
    d = table(spark, sf, "documents").withColumn("r", urls.build_ref(ref))
    return d.select("doc_id", "r.repo_id", "r.branch", "r.build_id", paths.safe_argument(F.concat("r.repo_id", "r.build_id")).alias("safe"), paths.location(F.col("source"), F.col("doc_id"), F.col("n_chars")).alias("location"))


@register("reached_nodes", """WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation), w AS (SELECT 1 AS node_id, 0 AS distance UNION SELECT e.dst, w.distance + 1 FROM w JOIN e ON e.src = w.node_id WHERE w.distance < 3) SELECT node_id, min(distance) AS distance FROM w GROUP BY 1""")
def reached_nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    edges = n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("dst"))
    return symbols.callers(edges, n.where("n_nationkey = 1").select(F.col("n_nationkey").alias("node_id")), 3)
