"""Token streams: offsets, texts, truncation, rendering, and rules that look at a node's tokens.

Long tables have a row for each token, ordered by ``pos`` within ``node_id``.
Windows are partitioned by node, so a shuffle by node is all that they need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.runtime import prepare

#: Lexer of last resort: white space, words, and runs of anything else.
LEX = r"(\s+|[A-Za-z0-9_]+|[^A-Za-z0-9_\s]+)"


def lex(texts: DataFrame, node: str, text: str = "text") -> DataFrame:
    """``node_id, pos, tok`` of every whole text."""
    toks = F.regexp_extract_all(F.col(text), F.lit(LEX), F.lit(1))
    return texts.select(F.col(node).alias("node_id"), F.posexplode(toks).alias("pos", "tok"))


_OUT_ROWS = 16_384
_CLASS = np.full(256, 2, np.int8)
_CLASS[list(b" \t\n\v\f\r")] = 0
_CLASS[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = 1


def lexed(texts: DataFrame, node: str, text: str = "text") -> DataFrame:
    """``lex`` with the byte ``offset`` and 0-based ``line`` of every token, found where the text is.

    Tokens are runs of bytes of one class, so a batch of texts is cut by array
    operations, and no token is shuffled or sorted. Null and empty texts have
    no token.
    """
    prepare(texts.sparkSession)
    kind = texts.schema[node].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.fill_null(batch.column(1), "").cast(pa.large_string())
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            raw = column.buffers()[2]
            data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
            ends = ends - ends[0]
            own = _CLASS[data]
            begins = np.append(True, own[1:] != own[:-1]) if len(data) else np.zeros(0, bool)
            begins[ends[:-1][np.diff(ends) > 0]] = True
            start = np.flatnonzero(begins)
            first = np.searchsorted(start, ends)
            doc = np.repeat(np.arange(len(column)), np.diff(first))
            lines = np.cumsum(np.append(0, data == 10))
            tok = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(data))), pa.py_buffer(np.ascontiguousarray(data)))
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(doc)),
                    pa.array((np.arange(len(start)) - first[doc]).astype(np.int32)),
                    tok.cast(pa.string()),
                    pa.array(start - ends[doc]),
                    pa.array(lines[start] - lines[ends[doc]]),
                ],
                ["node_id", "pos", "tok", "offset", "line"],
            )
            for begin in range(0, out.num_rows, _OUT_ROWS):
                yield out.slice(begin, _OUT_ROWS)

    return texts.select(F.col(node), F.col(text)).mapInArrow(cut, f"node_id {kind}, pos int, tok string, offset long, line long")


def map_tokens(nodes: DataFrame, to: Callable[[Column], Column]) -> DataFrame:
    """Nodes with each token, a struct, replaced by what ``to`` makes of it."""
    return nodes.withColumn("tokens", F.transform("tokens", to))


def in_range(tokens: DataFrame, start: Column, end: Column) -> DataFrame:
    """Tokens (``off``, ``end``) from the one at or after ``start`` to the one that ends at or before ``end``."""
    return tokens.where((F.col("off") >= start) & (F.col("end") <= end))


def token_type(tok: Column) -> Column:
    return F.when(tok.rlike(r"^\s"), "WS").when(tok.rlike(r"^[0-9]"), "Literal").when(tok.rlike(r"^[A-Za-z_]"), "Identifier").otherwise("Punctuation")


def with_offsets(tokens: DataFrame, tok: str = "tok") -> DataFrame:
    """Running UTF-8 byte ``offset`` and 0-based ``line`` of every token."""
    before = W.partitionBy("node_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    lines = F.length(tok) - F.length(F.replace(F.col(tok), F.lit("\n"), F.lit("")))
    return tokens.withColumn("offset", F.coalesce(F.sum(F.octet_length(tok)).over(before), F.lit(0)).cast("long")).withColumn("line", F.coalesce(F.sum(lines).over(before), F.lit(0)).cast("long"))


def deviations(tokens: DataFrame) -> DataFrame:
    """``real_offset`` and ``real_line`` only where a token's true place leaves the running one.

    Wants ``tok``, ``true_offset`` and ``true_line``.
    """
    w = W.partitionBy("node_id").orderBy("pos")
    lines = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit("\n"), F.lit("")))
    expected = F.lag(F.col("true_offset") + F.octet_length("tok")).over(w)
    line = F.lag(F.col("true_line") + lines("tok")).over(w)
    return tokens.withColumn("real_offset", F.when(expected.isNull() | (expected != F.col("true_offset")), F.col("true_offset"))).withColumn("real_line", F.when(line.isNull() | (line != F.col("true_line")), F.col("true_line")))


#: Bytes of text whose tokens are cut together; places within a run are shorts.
RUN_BYTES = 1 << 14


def reconstruct(tokens: DataFrame, nodes: DataFrame) -> DataFrame:
    """Token texts from offsets: each ends where the next begins, the last at the node's end."""
    return reconstruct_runs(tokens, nodes).select("node_id", F.explode("tokens").alias("_t")).select("node_id", "_t.*")


def reconstruct_runs(tokens: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_id, _first, tokens``: ``reconstruct`` with a row for each run, whose first offset is ``_first``.

    Tokens that begin within ``RUN_BYTES`` of a text are one run, so however long
    a node is, no row holds more than a run of it. A run meets the text once and
    takes its own stretch, up to where the next run begins. Runs are shuffled
    once, by node and packed, as texts are; tokens are rows of an array only
    where they get their text.
    """
    rest = [c for c in tokens.columns if c not in ("node_id", "pos", "offset")]
    packed = _packed(tokens.select("node_id", "pos", "offset", *rest))
    after = F.lead(F.struct("_run", "_first")).over(W.partitionBy("node_id").orderBy("_run", "_first"))
    follows = packed.withColumn("_after", after)
    parts = F.collect_list(F.struct("_pos", "pos", "offset", *rest)).alias("_parts")
    following = F.min(F.when(F.col("_after")["_run"] > F.col("_run"), F.col("_after")["_first"])).alias("_next")
    runs = follows.groupBy("node_id", "_run").agg(parts, F.min("_first").alias("_first"), following)
    joined = runs.join(nodes.select("node_id", F.col("text").cast("binary").alias("_raw")), "node_id")
    until = F.coalesce("_next", F.octet_length("_raw").cast("long"))
    kinds = dict(tokens.dtypes)

    def unpacked(part: Column) -> Column:
        pos = lambda i: F.when(F.size(part["pos"]) == 0, (part["_pos"] + i).cast(kinds["pos"])).otherwise(F.get(part["pos"], i))
        place = lambda o: (F.col("_run") * RUN_BYTES + o).cast(kinds["offset"])
        return F.transform(part["offset"], lambda o, i: F.struct(pos(i).alias("pos"), place(o).alias("offset"), *[F.get(part[c], i).alias(c) for c in rest]))

    own = F.array_sort(F.flatten(F.transform("_parts", unpacked))).alias("_t")
    held = joined.select("node_id", own, "_first", F.substring("_raw", (F.col("_first") + 1).cast("int"), (until - F.col("_first")).cast("int")).alias("_raw"))

    def cut(t: Column, i: Column) -> Column:
        start = t["offset"] - F.col("_first")
        end = F.coalesce(F.get("_t", i + 1)["offset"] - F.col("_first"), F.octet_length("_raw").cast("long"))
        return t.withField("tok", F.substring("_raw", (start + 1).cast("int"), (end - start).cast("int")).cast("string"))

    return held.select("node_id", "_first", F.transform("_t", cut).alias("tokens"))


def _packed(tokens: DataFrame) -> DataFrame:
    """Tokens that follow each other within a run of a node as one row of arrays, so that a shuffle moves arrays; ``_run, _first`` are the run and its least offset here.

    Offsets are counted from the run's begin. ``pos`` is empty where it counts on by one from ``_pos``.
    """
    prepare(tokens.sparkSession)
    key, *columns = tokens.columns
    counts = tokens.schema["pos"].dataType.typeName() in ("byte", "short", "integer", "long")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            offset = batch.column(2).cast(pa.int64()).to_numpy(zero_copy_only=False)
            run = offset // RUN_BYTES
            node = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            begin = np.append(0, np.flatnonzero((node[1:] != node[:-1]) | (run[1:] != run[:-1])) + 1)
            sizes = np.diff(np.append(begin, len(offset)))
            pos, first, listed = batch.column(1), np.zeros(len(begin), np.int64), np.ones(len(begin), bool)
            if counts and not pos.null_count:
                at = pos.cast(pa.int64()).to_numpy()
                first, steps = at[begin], np.append(1, np.diff(at))
                steps[begin] = 1
                listed = np.maximum.reduceat(steps != 1, begin)
            edges = lambda n: pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges(np.where(listed, sizes, 0)), pos.filter(pa.array(np.repeat(listed, sizes))))]
            lists += [pa.ListArray.from_arrays(edges(sizes), c) for c in (pa.array((offset % RUN_BYTES).astype(np.int16)), *batch.columns[3:])]
            own = [batch.column(0).take(pa.array(begin)), pa.array(run[begin]), pa.array(np.minimum.reduceat(offset, begin)), pa.array(first)]
            yield pa.RecordBatch.from_arrays([*own, *lists], [key, "_run", "_first", "_pos", *columns])

    arrays = ", ".join(f"`{c}` array<{'smallint' if c == 'offset' else t}>" for c, t in tokens.dtypes[1:])
    return tokens.mapInArrow(pack, f"`{key}` {tokens.dtypes[0][1]}, _run long, _first long, _pos long, {arrays}")


def truncate(tokens: DataFrame, most: int) -> DataFrame:
    """The first ``most`` tokens of a node; where there are so many, a ``<TRUNCATED>`` comment follows, also if there are no more.

    The cut is by position, so no node is counted: the last token kept brings
    the mark. Places of the mark (``off``, ``end``, ``offset``) are where that token ends.
    """
    own = {"pos": F.lit(most), "tok": F.lit("<TRUNCATED>"), "type": F.lit("Comment")}
    if "end" in tokens.columns:
        own["off"] = F.col("end")
    if "offset" in tokens.columns:
        own["offset"] = F.col("offset") + F.octet_length("tok")
    row = F.struct(*[F.col(c) for c in tokens.columns])
    mark = F.struct(*[(own[c] if c in own else F.col(c)).cast(t).alias(c) for c, t in tokens.dtypes])
    kept = tokens.where(F.col("pos") < most)
    return kept.select(F.explode(F.when(F.col("pos") == most - 1, F.array(row, mark)).otherwise(F.array(row))).alias("_t")).select("_t.*")


def fill_gaps(tokens: DataFrame, raw: Column) -> DataFrame:
    """Insert a WS token wherever raw text lies between two tokens (``offset``, ``end``)."""
    before = F.lag("end").over(W.partitionBy("node_id").orderBy("offset"))
    each = tokens.withColumn("_gap", F.col("offset") - before)
    own = F.struct(F.col("offset"), F.col("end"), F.col("tok"), F.col("type"))
    blank = F.struct(
        (F.col("offset") - F.col("_gap")).alias("offset"),
        F.col("offset").alias("end"),
        F.substring(raw.cast("binary"), (F.col("offset") - F.col("_gap") + 1).cast("int"), F.col("_gap").cast("int")).cast("string").alias("tok"),
        F.lit("WS").alias("type"),
    )
    return each.select("node_id", F.explode(F.when(F.col("_gap") > 0, F.array(blank, own)).otherwise(F.array(own))).alias("t")).select("node_id", "t.*")


def first_solid(tokens: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` tokens of a node that are not white space, as an array."""
    solid = tokens.where(F.col("type") != "WS")
    rank = F.row_number().over(W.partitionBy("node_id").orderBy("pos"))
    top = solid.withColumn("_r", rank).where(F.col("_r") <= k)
    return top.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "tok"))), lambda x: x["tok"]).alias("head"))


def heads(texts: DataFrame, node: str, text: str = "text", k: int = 3) -> DataFrame:
    """``first_solid`` of whole texts, found where each text is: no token leaves its row. Texts without such a token have no row."""
    solid = F.filter(F.regexp_extract_all(F.col(text), F.lit(LEX), F.lit(1)), lambda t: token_type(t) != "WS")
    return texts.select(F.col(node).alias("node_id"), F.slice(solid, 1, k).alias("head")).where(F.size("head") > 0)


def skip_reason(kind: Column, root_kind: Column, tokens: Column, inside: Column, forward: Column, index_system: bool = False) -> Column:
    """Why a node is left out, or null. ``tokens`` is an array of ``type, text``; order of rules matters."""
    code = F.exists(tokens, lambda t: t["type"].isin("Literal", "Identifier", "Keyword"))
    head = F.slice(F.filter(tokens, lambda t: t["type"] != "WS"), 1, 3)
    at = lambda i, kind, text=None: (F.try_element_at(head, F.lit(i))["type"] == kind) & (F.lit(True) if text is None else F.try_element_at(head, F.lit(i))["text"] == text)
    hash_ = lambda word: F.coalesce(at(1, "Punctuation", "#") & at(2, "Identifier", word) & at(3, "Identifier"), F.lit(False))
    directive = root_kind == "PreprocessingDirective"
    return (
        F.when((kind == "Definition") & ~code, "not code")
        .when(F.lit(not index_system) & ~inside, "not in repo path and system indexing is disabled")
        .when((root_kind == "FunctionDecl") & forward, "forward decl")
        .when(root_kind == "InclusionDirective", "InclusionDirective")
        .when(directive & hash_("define"), F.lit(None).cast("string"))
        .when(directive & hash_("undef"), "#undef")
        .when(directive, "PreprocessingDirective")
    )


#: Cursor kinds whose tokens link to a symbol.
LINKING_KINDS = ("DeclRefExpr", "MemberRefExpr", "TypeRef", "Method", "Constructor", "Destructor")


def choose_href(type_: Column, elided_node: Column, local_node: Column, local_offset: Column, cursor: Column, sym_id: Column) -> Column:
    """Link of a token: the elided node, else its local definition, else its symbol; only identifiers have the last two."""
    empty = F.lit(None).cast("long")
    made = lambda kind, node, sym, off: F.struct(F.lit(kind).alias("kind"), node.alias("node_id"), sym.alias("sym_id"), off.alias("offset"))
    name = type_ == "Identifier"
    return (
        F.when(elided_node.isNotNull(), made("id", elided_node, empty, empty))
        .when(name & local_node.isNotNull(), made("token", local_node, empty, local_offset))
        .when(name & cursor.isin(*LINKING_KINDS) & sym_id.isNotNull(), made("sym", empty, sym_id, empty))
    )


def longest_line(text: Column) -> Column:
    return F.array_max(F.transform(F.split(text, "\n"), lambda x: F.length(x)))


def expand_tabs(line: Column, stop: int = 8) -> Column:
    """A line with tabs padded to the next multiple of ``stop``."""
    parts = F.split(line, "\t")
    first = F.element_at(parts, 1)
    pad = lambda a: F.concat(a, F.repeat(F.lit(" "), F.lit(stop) - F.pmod(F.length(a), F.lit(stop))))
    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), first, lambda a, x: F.concat(pad(a), x))


def render(tokens: Column) -> Column:
    """A node's text with ``[text|link]`` around linked tokens; ``tokens`` is an array of ``text, href``."""
    shown = F.transform(tokens, lambda t: F.when(t["href"].isNotNull(), F.concat(F.lit("["), t["text"], F.lit("|"), t["href"], F.lit("]"))).otherwise(t["text"]))
    return F.array_join(shown, "")
