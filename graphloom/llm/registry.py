"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.runtime import table

#: Components by a recursive walk over all linked pairs, and the number of each document's pairs.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS g FROM w),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * k >= 80 * (len(p.g) + len(q.g) - k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = s.doc_id) AS component_id,
  (SELECT count(*) FROM u WHERE u.a = s.doc_id) AS n_links FROM s
"""

#: The same template by string functions: backslashes doubled, control strings broken after their first character.
OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS place FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT *, replace(replace(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'),
    '### System:', '#\## System:'), '### User:', '#\## User:'), '### Assistant:', '#\## Assistant:') AS escaped,
  CASE coalesce(before, 'start') WHEN 'start' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
    WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END AS allowed FROM o)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || role || ': </turn>' || chr(10)) + length(escaped)) AS BIGINT) AS formatted_chars,
  bool_and(allowed) AND arg_max(role, place) = 'assistant' AS valid
FROM e GROUP BY conv_id
"""

#: Vectors that take part, with a row number, as whole numbers of 1 / {scale}.
_VECTORS = """
v AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS r FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true){where})),
x AS MATERIALIZED (SELECT r, unnest(range(len(v))) AS i, unnest(v) AS x FROM v)"""


def _op11_sql() -> str:
    """Two rounds of codebooks spelled out over (part, entry, position) rows; a distance and its entry are one number."""
    steps = [_VECTORS.format(scale=256, where="")]
    steps.append("b0 AS MATERIALIZED (SELECT i // 4 AS part, r - 1 AS entry, i % 4 AS pos, x AS y FROM x WHERE r <= 64)")
    for n in range(3):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, part, min(d * 64 + entry) AS de FROM (SELECT x.r, b.part, b.entry, sum((x.x - b.y) * (x.x - b.y)) AS d FROM x JOIN b{n} b ON b.part = x.i // 4 AND b.pos = x.i % 4 GROUP BY ALL) GROUP BY ALL)")
        if n < 2:
            steps.append(
                f"b{n + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(m.y, b.y) AS y FROM b{n} b LEFT JOIN (SELECT a.part, a.de % 64 AS entry, x.i % 4 AS pos, CAST(floor(sum(x.x) / count(*)) AS BIGINT) AS y FROM a{n} a JOIN x ON x.r = a.r AND x.i // 4 = a.part GROUP BY ALL) m USING (part, entry, pos))"
            )
    steps.append("c AS (SELECT r, string_agg(printf('%02x', CAST(de % 64 AS INT)), '' ORDER BY part) AS code, CAST(sum(de // 64) AS BIGINT) AS error FROM a2 GROUP BY r)")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b2) AS codebooks_sha256
FROM v JOIN c USING (r)"""


OP11_SQL = _op11_sql()

OP12_SQL = (
    "WITH "
    + _VECTORS.format(scale=1024, where="")
    + """,
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score FROM v q JOIN x a USING (r) JOIN x b ON a.i = b.i JOIN v c ON c.r = b.r
  WHERE q.vec_id % 100 = 0 AND q.r <> c.r GROUP BY q.r, q.vec_id, c.r, c.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
)


def _op13_sql() -> str:
    """Three plain rounds over (cluster, position) rows, every vector against every centroid."""
    steps = [_VECTORS.format(scale=64, where=" AND len(embedding) = 64")]
    steps.append("c0 AS MATERIALIZED (SELECT k - 1 AS cluster, i, x AS y FROM (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id)) AS k FROM v) JOIN x USING (r) WHERE k <= 16)")
    for n in range(4):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, min(d * 16 + cluster) AS dc FROM (SELECT r, cluster, sum((x - y) * (x - y)) AS d FROM x JOIN c{n} USING (i) GROUP BY ALL) GROUP BY r)")
        if n < 3:
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT cluster, i, coalesce(m.y, c.y) AS y FROM c{n} c LEFT JOIN (SELECT dc % 16 AS cluster, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS y FROM a{n} JOIN x USING (r) GROUP BY ALL) m USING (cluster, i))")
    steps.append("h AS (SELECT cluster, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY cluster)")
    steps.append("f AS (SELECT vec_id, CAST(dc % 16 AS INT) AS cluster, CAST(dc // 16 AS BIGINT) AS distance FROM a3 JOIN v USING (r))")
    return f"""WITH {", ".join(steps)}
SELECT f.*, CAST(sum(distance) OVER (PARTITION BY f.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM f JOIN h ON h.cluster = f.cluster"""


OP13_SQL = _op13_sql()

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.llm import ngram_join

    return ngram_join.near_copies(table(spark, sf, "documents"))


def op2_mixing_rates(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.llm import mixing
    from graphloom.llm.labels import TARGETS, labelled_domains

    return mixing.fitted_rates(table(spark, sf, "documents"), labelled_domains(table(spark, sf, "labels")), TARGETS)


def op3_quality_divergence(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.llm import quality

    return quality.quality(table(spark, sf, "documents"))


def op4_pii_anchors(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.llm import pii, spans

    return pii.personal_data(table(spark, sf, "documents")).select("doc_id", *spans.digest(pii.BASE))


def op5_lpt_shards(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.llm import sharding

    return sharding.shard(table(spark, sf, "documents"))


def op6_secret_trigrams(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.llm import secrets, spans

    return secrets.secrets(table(spark, sf, "documents")).select("doc_id", *spans.digest(["assign", "access", "hex"]))


def op7_token_sstables(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    from graphloom.llm import sstable

    return sstable.tokenize(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_chat_fsm(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.llm import chat

    conversations = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    own = spark.range(0, 2, 1, 1).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(text).alias("text"))
    own = own.select(*[F.col(f.name).cast(f.dataType) for f in conversations.schema])
    return chat.digest(chat.formatted(conversations.unionByName(own)))


def op9_toxicity_ftrl(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.llm import toxicity

    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op10_string_tiling(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.llm import decontaminate

    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def _whole(total: Column) -> Column:
    """A sum as long, null where it does not fit one."""
    return total.try_cast("long")


def op11_va_codes(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.llm import va_file
    from graphloom.runtime import stash

    found = va_file.encode(table(spark, sf, "embeddings"), ["vec_id", "label"])
    digest = hashlib.sha256(",".join(map(str, found.books.ravel().tolist())).encode()).hexdigest()
    # Written, so that its size is known: the join is a broadcast only where there are few labels.
    by_label = stash(found.rows.groupBy(F.col("label").alias("of_label")).agg(_whole(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error")), "labels")
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    return found.rows.join(by_label, F.col("label").eqNullSafe(F.col("of_label"))).select("vec_id", "label", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_term_search(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.llm import term_search

    return term_search.top(table(spark, sf, "embeddings"))


def op13_ball_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.llm import ball_kmeans

    found = ball_kmeans.cluster(table(spark, sf, "embeddings"), ["vec_id"])
    sums = {r["cluster"]: int(r["total"]) for r in found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    inertia, fits = sum(sums.values()), lambda n: n if n < 1 << 63 else None
    own = [(i, fits(sums.get(i, 0)), fits(inertia), d) for i, d in enumerate(ball_kmeans.digest(found.centroids))]
    facts = spark.createDataFrame(own, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most k facts


def queries() -> dict[str, Query]:
    ops = (op1_ngram_jaccard, op2_mixing_rates, op3_quality_divergence, op4_pii_anchors, op5_lpt_shards, op6_secret_trigrams, op7_token_sstables, op8_chat_fsm, op9_toxicity_ftrl, op10_string_tiling, op11_va_codes, op12_term_search, op13_ball_kmeans)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1_SQL, "op8_chat_fsm": OP8_SQL, "op11_va_codes": OP11_SQL, "op12_term_search": OP12_SQL, "op13_ball_kmeans": OP13_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
