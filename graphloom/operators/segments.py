"""Segmentation of annotated files by one pass over their tokens, with a stack of the blocks cut so far.

Windows over extents (``cutting.islands``) cannot say what a pass can: that a
declaration which turns out to begin before the open block takes its start back,
and that blocks already cut which reach or touch the new start are given up. A
file is one group; source files are bounded (``files.MAX_FILE_BYTES``), and only
five numbers a token go to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import cutting, tree
from graphloom.runtime import prepare

_OUT_ROWS = 16_384


class Token(NamedTuple):
    """A token with its cursor (null: -1), the end of the cursor's extent here, and its outermost ancestor with its extent here (null: -1)."""

    off: int
    end: int
    cursor: int
    cursor_end: int
    starts: bool
    top: int
    top_start: int
    top_end: int
    is_top: bool


class Block(NamedTuple):
    cursor: int
    start: int
    end: int


def segment(tokens: list[Token]) -> list[Block]:
    """The blocks of one file, in order; none overlap or touch after a declaration took its start back over them."""
    done: list[Block] = []
    is_open, name, start, reach = False, -1, -1, -1  # a ``reach`` of -1: the cursor lies in another file, its end is not known
    count = len(tokens)
    for i, (at, end, c, c_end, starts, top, top_start, top_end, _) in enumerate(tokens, 1):
        if not is_open:
            if c < 0 or not starts:
                continue
            is_open, name, start, reach = True, c, at, c_end
        if c >= 0 and 0 <= top_start <= start:
            while done and done[-1].end >= top_start:
                done.pop()
            name, start = top, top_start
            if top_end > reach:
                reach = top_end
        if i == count:
            closes = True
        elif reach >= 0:
            closes = tokens[i][0] >= reach
        else:
            closes = tokens[i][2] >= 0 and tokens[i][2] != name and tokens[i][8]
        if closes:
            done.append(Block(name, start, end))
            is_open = False
    return done


def segments(tokens: DataFrame, cursors: DataFrame) -> DataFrame:
    """``path_id, cursor, start, end`` of the outermost blocks of each file.

    ``tokens`` are ``path_id, off, end, cursor`` and ``cursors`` are ``id,
    path_id, parent, kind, start, end`` as in ``cutting``. A block ends with the
    last token before the end of its declaration; one whose declaration lies in
    another file ends before the next token of another top cursor. Tokens
    without a cursor belong to the open block, if there is one. Files without
    blocks have no rows.
    """
    prepare(tokens.sparkSession)
    tops = tree.outermost(cursors.select("id", "parent", "kind")).withColumnRenamed("id", "cursor")
    own = cursors.select(F.col("id").alias("cursor"), F.col("path_id").alias("_path"), F.col("end").alias("_end"), cutting.starts_block(F.col("kind")).alias("starts"), F.col("parent").isNull().alias("is_top"))
    top = cursors.select(F.col("id").alias("top"), F.col("path_id").alias("_top_path"), F.col("start").alias("_top_start"), F.col("end").alias("_top_end"))
    known = own.join(tops, "cursor").join(top, "top")
    # Facts are looked up once for each cursor of a file, and go before the file's tokens.
    here = lambda path, value: F.when(F.col(path) == F.col("path_id"), F.col(value)).otherwise(-1).cast("long")
    met = tokens.where("cursor is not null").select("path_id", "cursor").distinct().join(known, "cursor")
    none = [F.lit(-1).cast("long").alias(c) for c in ("off", "end")]
    facts = met.select("path_id", F.lit(False).alias("is_token"), *none, F.col("cursor").cast("long"), here("_path", "_end").alias("cursor_end"), "starts", F.col("top").cast("long"), here("_top_path", "_top_start").alias("top_start"), here("_top_path", "_top_end").alias("top_end"), "is_top")
    bare = [F.lit(False if c in ("starts", "is_top") else -1).cast(t).alias(c) for c, t in facts.dtypes[5:]]
    each = tokens.select("path_id", F.lit(True).alias("is_token"), F.col("off").cast("long"), F.col("end").cast("long"), F.coalesce(F.col("cursor").cast("long"), F.lit(-1)).alias("cursor"), *bare)
    every = facts.unionByName(each).repartition("path_id").sortWithinPartitions("path_id", "is_token", "off", "end")
    kind = dict(tokens.dtypes)["path_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None  # the file that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            edges = _edges(table)
            rest = table.slice(edges[-2])
            if len(edges) > 2:
                yield _cut_files(table, edges[:-1])
        if rest is not None:
            yield _cut_files(rest, _edges(rest))

    return every.mapInArrow(cut, f"path_id {kind}, cursor long, start long, end long")


def _edges(table: pa.Table) -> list[int]:
    """Where the files of sorted rows begin, and the number of rows."""
    code = table.column("path_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    return [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]


def _cut_files(table: pa.Table, edges: list[int]) -> pa.RecordBatch:
    """The blocks of the files between ``edges``."""
    named = {c: table.column(c).slice(0, edges[-1]).to_numpy() for c in ("is_token", *Token._fields)}
    off, ends, cursor = (named[c].tolist() for c in Token._fields[:3])
    at, found = [], []
    for a, z in zip(edges, edges[1:]):
        first = a + int(np.searchsorted(named["is_token"][a:z], True))
        facts = dict(zip(cursor[a:first], zip(*[named[c][a:first].tolist() for c in Token._fields[3:]], strict=True), strict=True))
        facts[-1] = (-1, False, -1, -1, -1, False)
        # tokens of cursors without a row drop out
        rows = [(o, e, c, *facts[c]) for o, e, c in zip(off[first:z], ends[first:z], cursor[first:z], strict=True) if c in facts]
        blocks = segment(rows)
        at += [a] * len(blocks)
        found += blocks
    out = np.array(found, np.int64).reshape(-1, 3)
    path = table.column("path_id").take(pa.array(at, pa.int64())).combine_chunks()
    return pa.RecordBatch.from_arrays([path, *(pa.array(np.ascontiguousarray(c)) for c in out.T)], ["path_id", *Block._fields])


def lines_as_declarations(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens (words with byte offsets) and cursors of texts (``path_id, text``) read as if each line with a word were a declaration.

    A line's declaration goes from its first word to its last. One that ends in a
    comma takes in the next line too, so that it reaches over it.
    """
    prepare(texts.sparkSession)
    kind = dict(texts.dtypes)["path_id"]
    asked = texts.select("path_id", "text")
    cursor = (F.col("path_id") * F.lit(1 << 32) + F.col("line")).alias("cursor")
    tokens = asked.mapInArrow(lambda batches: _scan(batches, False), f"path_id {kind}, line long, off long, end long").select("path_id", "off", "end", cursor)
    lines = asked.mapInArrow(lambda batches: _scan(batches, True), f"path_id {kind}, line long, start long, end long")
    return tokens, lines.select(cursor.alias("id"), "path_id", F.lit(None).cast("long").alias("parent"), F.lit("VarDecl").alias("kind"), "start", "end").distinct()


def _scan(batches: Iterator[pa.RecordBatch], by_line: bool) -> Iterator[pa.RecordBatch]:
    """Words of texts, or declarations of their lines, each with the number of its line among those with a word."""
    for batch in batches:
        column = pc.fill_null(batch.column(1), "").cast(pa.large_string())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        word = (data != 32) & (data != 10)
        cut = np.zeros(len(data) + 1, bool)
        cut[ends] = True
        begin = np.flatnonzero(word & (cut[:-1] | np.append(True, ~word[:-1])[: len(data)]))
        stop = np.flatnonzero(word & (cut[1:] | np.append(~word[1:], True)[: len(data)])) + 1
        doc = np.searchsorted(ends, begin, "right") - 1
        row = np.cumsum(np.append(0, data == 10))[begin]
        new = np.ones(len(begin), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])
        head = np.flatnonzero(new)
        line = np.cumsum(new) - 1
        of = doc[head]
        number = np.arange(len(head)) - np.searchsorted(of, of)
        if by_line:
            last = np.append(head[1:], len(begin))[: len(head)] - 1
            z = stop[last]
            at_end = cut[z] | (np.append(data, 10)[z] == 10)
            more = at_end & (data[z - 1] == 44) & (np.append(of[1:], -1)[: len(of)] == of)
            z = np.where(more, np.append(z[1:], 0)[: len(z)], z)
            columns, of_row = [number, begin[head] - ends[of], z - ends[of]], of
        else:
            columns, of_row = [number[line], begin - ends[doc], stop - ends[doc]], doc
        out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of_row)), *(pa.array(c.astype(np.int64)) for c in columns)], ["path_id", "line", "start" if by_line else "off", "end"])
        for at in range(0, out.num_rows, _OUT_ROWS):
            yield out.slice(at, _OUT_ROWS)
