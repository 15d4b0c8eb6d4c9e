"""One-line summaries of nodes, and entries of a file's table of contents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BRACED = ("FunctionDecl", "EnumDecl", "Method", "Destructor", "FunctionTemplate")
STATEFUL = ("VarDecl", "StructDecl", "ClassDecl", "ClassTemplate")
DOTS = " … "


def braced(tokens: Column, stops: dict[str, str]) -> Column:
    """Texts up to and with the first stopping punctuation, then what stands for the rest; line ends become spaces."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("done"))

    def step(a: Column, t: Column) -> Column:
        flat = F.replace(t["text"], F.lit("\n"), F.lit(" "))
        out = F.struct(F.concat(a["text"], flat).alias("text"), F.lit(False).alias("done"))
        for stop, rest in stops.items():
            out = F.when((t["type"] == "Punctuation") & (t["text"] == stop), F.struct(F.concat(a["text"], flat, F.lit(rest)).alias("text"), F.lit(True).alias("done"))).otherwise(out)
        return F.when(a["done"], a).otherwise(out)

    return F.aggregate(tokens, start, step, lambda a: a["text"])


def simple_summary(kind: Column, tokens: Column, display_name: Column) -> Column:
    """Summaries that need no state beyond a prefix; null for the kinds that do."""
    solid = F.filter(tokens, lambda t: t["type"] != "WS")
    head = lambda i: F.try_element_at(solid, F.lit(i))["text"]
    define = (kind == "PreprocessingDirective") & (head(1) == "#") & (head(2) == "define") & head(3).isNotNull()
    body = F.concat(F.lit("#define "), head(3), F.when(F.size(solid) > 3, " …").otherwise(""))
    using = F.array_join(F.transform(solid, lambda t: t["text"]), "")
    fallback = F.coalesce(display_name, F.concat(F.try_element_at(tokens, F.lit(1))["text"], F.lit(" …")))
    line = (
        F.when(define, body)
        .when(kind.isin(*BRACED), braced(tokens, {"{": DOTS + "}"}))
        .when(kind == "Constructor", braced(tokens, {"{": DOTS + "}", ":": DOTS + "{" + DOTS + "}"}))
        .otherwise(fallback)
    )
    return F.when(kind.isin(*STATEFUL), F.lit(None).cast("string")).when(kind == "UsingDirective", using).otherwise(F.concat(line, F.lit("\n")))


def _flat(tokens: list[dict]) -> str:
    return "".join(t["text"] for t in tokens).replace("\n", " ")


def _template_end(tokens: list[dict], at: int) -> int:
    """Index after the angle bracket that closes the template head at ``at``."""
    depth = 0
    for k in range(at + 1, len(tokens)):
        if tokens[k]["type"] == "Punctuation":
            depth += {"<": 1, ">": -1}.get(tokens[k]["text"], 0)
            if depth == 0 and tokens[k]["text"] == ">":
                return k + 1
    return len(tokens)


def _piece(tokens: list[dict], at: int) -> tuple[str, int, bool]:
    """What the token at ``at`` shows, where reading goes on, and whether it goes on visibly."""
    t = tokens[at]
    if t["text"] == "{":
        end = t.get("sem_end")
        after = at + 1 if end is None else next((k for k in range(at + 1, len(tokens)) if tokens[k]["offset"] >= end), len(tokens))
        return "{" + DOTS + "}", after, True
    if (t["type"], t["text"]) == ("Punctuation", "="):
        return "= …", at + 1, False
    if (t["type"], t["text"]) == ("Keyword", "template"):
        after = _template_end(tokens, at)
        return _flat(tokens[at:after]), after, True
    return _flat([t]), at + 1, True


def declaration(tokens: list[dict]) -> str:
    """Summary of a variable, struct or class: blocks and values fold, template heads stay whole."""
    out, at, visible = "", 0, True
    while at < len(tokens):
        kind = tokens[at].get("sem_kind")
        if visible and kind == "FieldDecl":
            out, visible = out + DOTS + "} ", False
        visible = visible or kind == "VarDecl"
        if visible:
            text, at, visible = _piece(tokens, at)
            out += text
        else:
            at += 1
    return out + "\n"


def summaries(nodes: DataFrame) -> DataFrame:
    """``id, summary``. Wants ``id, kind, display_name, tokens`` (``type, text, offset, sem_kind, sem_end``).

    Only the kinds with a state machine go through Python.
    """
    plain = nodes.where(~F.col("kind").isin(*STATEFUL)).select("id", simple_summary(F.col("kind"), F.col("tokens"), F.col("display_name")).alias("summary"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b.id, "summary": [declaration([dict(t) if isinstance(t, dict) else t.asDict() for t in x]) for x in b.tokens]})

    rest = nodes.where(F.col("kind").isin(*STATEFUL)).select("id", "tokens").mapInPandas(fold, "id long, summary string")
    return plain.unionByName(rest)


def file_entries(nodes: DataFrame) -> DataFrame:
    """Lines of a file's table of contents: summaries in order of start, with byte offset and line."""
    from pyspark.sql import Window as W

    s = nodes.select("id", "path", "start").join(summaries(nodes), "id")
    before = W.partitionBy("path").orderBy("start", "id").rowsBetween(W.unboundedPreceding, -1)
    lines = F.length("summary") - F.length(F.replace("summary", F.lit("\n"), F.lit("")))
    return s.select(
        "path", "id", "summary", F.coalesce(F.sum(F.octet_length("summary")).over(before), F.lit(0)).cast("long").alias("offset"), F.coalesce(F.sum(lines).over(before), F.lit(0)).cast("long").alias("line")
    )
