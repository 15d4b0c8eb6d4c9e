"""The JSON form of nodes: ids as ``id:N``, places of tokens as ``tok-N``, links as URLs.

Python only cuts a node's text at its token offsets and joins it again, one pass
over a node; names, links and ids are column expressions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.urls import parse, render
from graphloom.runtime import prepare
from graphloom.schema import HREF, LOCATION, NODE_KIND_JSON

_TOKEN = "struct<id:string,t:string,T:string,N:int,h:string,ht:string,s:string,r:string>"
SCHEMA = f"id string, container string, kind string, path string, path_id int, member_of string, start struct<line:int,col:int,off:long>, text array<{_TOKEN}>, references string"
#: The same by names that do not differ in case alone.
_PLAIN = SCHEMA.replace("t:string,T:string", "t:string,type:string")
_KIND_OF = {v: k for k, v in NODE_KIND_JSON.items()}


def _choose(key: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key)


_CUT = T.ArrayType(T.StructType().add("tok", "string").add("off", "long").add("line", "integer"))
_JOINED = T.StructType().add("text", "string").add("offsets", T.ArrayType(T.LongType())).add("real_offsets", T.ArrayType(T.LongType())).add("real_lines", T.ArrayType(T.IntegerType()))


@F.pandas_udf(_CUT)
def _cut(text: pd.Series, off: pd.Series, line: pd.Series, offsets: pd.Series, real_offsets: pd.Series, real_lines: pd.Series) -> pd.Series:
    """Texts of tokens with real offset and line, which go on from the token before unless given."""

    def one(text, off, line, offsets, real_offsets, real_lines):
        raw, out = text.encode(), []
        ends = [*offsets[1:], len(raw)] if len(offsets) else []
        for begin, end, o, n in zip(offsets, ends, real_offsets, real_lines):
            off, line = off if pd.isna(o) else int(o), line if pd.isna(n) else int(n)
            tok = raw[int(begin) : int(end)].decode(errors="replace")
            out.append({"tok": tok, "off": off, "line": line})
            off, line = off + int(end) - int(begin), line + tok.count("\n")
        return out

    return pd.Series([one(*row) for row in zip(text, off, line, offsets, real_offsets, real_lines)], dtype=object)


@F.pandas_udf(_JOINED)
def _joined(off: pd.Series, line: pd.Series, toks: pd.Series, offs: pd.Series, lines: pd.Series) -> pd.DataFrame:
    """A node's text with the offsets of tokens in it; real ones only where they do not go on from the token before."""
    rows = []
    for o, n, words, at, on in zip(off, line, toks, offs, lines):
        begin, offsets, real_offsets, real_lines = 0, [], [], []
        for tok, own, own_line in zip(words, at, on):
            offsets.append(begin)
            real_offsets.append(None if own == o else int(own))
            real_lines.append(None if own_line == n else int(own_line))
            size = len(tok.encode())
            begin, o, n = begin + size, own + size, own_line + tok.count("\n")
        rows.append(("".join(words), offsets, real_offsets, real_lines))
    return pd.DataFrame(rows, columns=["text", "offsets", "real_offsets", "real_lines"])


def _id(node: Column) -> Column:
    return F.when(node.isNotNull(), F.concat(F.lit("id:"), node.cast("string")))


def encode(nodes: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """The columns ``keep`` and ``json`` of nodes (``schema.NODE``). A null text is an empty one, null tokens are none."""
    prepare(nodes.sparkSession)
    of = lambda field: F.transform("_tokens", lambda t: t[field])
    ready = nodes.withColumn("_tokens", F.coalesce("tokens", F.array().cast(nodes.schema["tokens"].dataType)))
    begin, line = F.coalesce("start.offset", F.lit(0)), F.coalesce("start.line", F.lit(1))
    ready = ready.withColumn("_cut", _cut(F.coalesce("text", F.lit("")), begin, line, of("offset"), of("real_offset"), of("real_line")))

    def token(t: Column, cut: Column) -> Column:
        href = F.when(t["href"]["kind"] == "token", _id(t["href"]["node_id"])).when(t["href"]["kind"] == "uni", F.concat(F.lit("path:"), t["href"]["path"], F.lit("#token-"), t["href"]["offset"].cast("string"))).otherwise(render(t["href"]))
        return F.struct(
            F.concat(F.lit("tok-"), cut["off"].cast("string")).alias("id"), cut["tok"].alias("t"), t["type"].alias("T"), cut["line"].alias("N"), href.alias("h"),
            F.when(t["href"]["kind"] == "token", F.concat(F.lit("tok-"), t["href"]["offset"].cast("string"))).alias("ht"),
            F.when(t["sym_id"].isNotNull(), F.concat(F.lit("sym:"), t["sym_id"].cast("string"))).alias("s"),
            F.when(t["has_references"], F.concat(F.lit("refs:"), F.col("id").cast("string"), F.lit("/"), cut["off"].cast("string"))).alias("r"),
        )

    body = F.struct(
        _id(F.col("id")).alias("id"), _id(F.col("container")).alias("container"), _choose(F.col("kind"), NODE_KIND_JSON).alias("kind"), "path", "path_id", "member_of",
        F.struct(F.col("start.line").alias("line"), F.col("start.column").alias("col"), F.col("start.offset").alias("off")).alias("start"),
        F.zip_with("_tokens", "_cut", token).alias("text"), F.lit(None).cast("string").alias("references"),
    )
    return ready.select(*keep, F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def _number(text: Column, prefix: str) -> Column:
    """The number after a prefix; null stays null, anything else is an error."""
    number = F.regexp_extract(text, rf"^{prefix}([0-9]+)$", 1).try_cast("bigint")
    return F.when(text.isNotNull(), F.coalesce(number, F.raise_error(F.concat(F.lit(f"no {prefix} id: "), text)).cast("bigint")))


def decode(rows: DataFrame, json: str = "json") -> DataFrame:
    """Nodes (``schema.NODE``, without the ``uim_`` fields) of their JSON form."""
    prepare(rows.sparkSession)
    plain = T.StructType.fromDDL(_PLAIN)
    n = rows.select(F.from_json(json, SCHEMA).cast(plain).alias("n")).select("n.*").withColumn("text", F.coalesce("text", F.array().cast(plain["text"].dataType)))
    of = lambda f: F.transform("text", f)
    real = of(lambda t: _number(t["id"], "tok-"))
    whole = n.withColumn("_j", _joined(F.coalesce("start.off", F.lit(0)), F.coalesce("start.line", F.lit(1)), of(lambda t: t["t"]), real, of(lambda t: t["N"])))
    made = F.arrays_zip(F.col("text").alias("t"), F.col("_j.offsets").alias("offset"), F.col("_j.real_offsets").alias("real_offset"), F.col("_j.real_lines").alias("real_line"))

    def token(z: Column) -> Column:
        t, place = z["t"], _number(z["t"]["ht"], "tok-")
        link = F.when(t["h"].isNotNull(), parse(t["h"]))
        link = F.when(place.isNotNull(), link.withField("kind", F.lit("token")).withField("offset", place)).otherwise(link)
        return F.struct(
            z["offset"].alias("offset"), t["type"], link.cast(HREF).alias("href"), t["r"].isNotNull().alias("has_references"), _number(t["s"], "sym:").alias("sym_id"),
            z["real_offset"].alias("real_offset"), z["real_line"].alias("real_line"), F.lit(None).cast(LOCATION).alias("uim_location"), F.lit(None).cast("boolean").alias("uim_elided"),
        )

    start = F.struct(F.col("start.line").alias("line"), F.col("start.col").alias("column"), F.col("start.off").alias("offset"))
    return whole.select(
        _number(F.col("id"), "id:").alias("id"), _choose(F.col("kind"), _KIND_OF).alias("kind"), "path", _number(F.col("container"), "id:").alias("container"), start.alias("start"),
        F.col("_j.text").alias("text"), F.transform(made, token).alias("tokens"), "member_of", "path_id",
    )
