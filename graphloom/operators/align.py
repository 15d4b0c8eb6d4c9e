"""Alignment of a file's nodes between two versions."""

from __future__ import annotations

import difflib
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def edit_script(a: list[str], b: list[str]) -> list[str]:
    """A shortest edit script by Myers' greedy algorithm: one of ``=``, ``-``, ``+`` for each line, in order."""
    n, m = len(a), len(b)
    reach, history = {1: 0}, []
    for d in range(n + m + 1):
        history.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= n and x - k >= m:
                break
        else:
            continue
        break
    out: list[str] = []
    x, y = n, m
    for d in range(len(history) - 1, -1, -1):
        before, k = history[d], x - y
        down = k == -d or (k != d and before[k - 1] < before[k + 1])
        px = before[k + 1] if down else before[k - 1]
        py = px - (k + 1 if down else k - 1)
        begin = (px if down else px + 1) if d else 0
        out += ["="] * (x - begin)
        if d:
            out.append("+" if down else "-")
            x, y = px, py
    return out[::-1]


def change_cost(a: list[str], b: list[str]) -> int:
    """Operations of a shortest edit script: runs of kept lines and runs of changed ones; 0 if both are empty.

    Lines dropped and added side by side are one replacement.
    """
    return sum(1 for _ in itertools.groupby(x == "=" for x in edit_script(a, b)))


def align(old: list[list[str]], ids: list[int], new: list[list[str]]) -> list[int | None]:
    """For each new node the id of the old one that it continues, or None; the cheapest order-keeping assignment.

    A pair costs its edit operations, an added or dropped node its lines. At
    equal cost pairs come before drops and drops before additions.
    """
    n, m = len(old), len(new)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    move = [[""] * (m + 1) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            options = []
            if i < n and j < m:
                options.append((change_cost(old[i], new[j]) + best[i + 1][j + 1], 0, "pair"))
            if i < n:
                options.append((len(old[i]) + best[i + 1][j], 1, "drop"))
            if j < m:
                options.append((len(new[j]) + best[i][j + 1], 2, "add"))
            if options:
                best[i][j], _, move[i][j] = min(options)
    out: list[int | None] = []
    i = j = 0
    while i < n or j < m:
        step = move[i][j]
        if step != "drop":
            out.append(ids[i] if step == "pair" else None)
            j += 1
        if step != "add":
            i += 1
    return out


def align_nodes(nodes: DataFrame) -> DataFrame:
    """``file, seq, assigned_id`` of every new node.

    Wants ``file, version`` (old or new), ``seq, node_id, lines``. A file's
    nodes meet in one task: alignment is a dynamic program over one file.
    """

    def per_file(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["version", "seq"])
        old, new = pdf[pdf.version == "old"], pdf[pdf.version == "new"]
        got = align([list(x) for x in old.lines], list(old.node_id), [list(x) for x in new.lines])
        return pd.DataFrame({"file": new.file.to_numpy(), "seq": new.seq.to_numpy(), "assigned_id": pd.array(got, dtype="Int64")})

    kind = nodes.schema["file"].dataType.simpleString()
    return nodes.groupBy("file").applyInPandas(per_file, f"file {kind}, seq long, assigned_id long")


def line_diffs(pairs: DataFrame) -> DataFrame:
    """Unified line difference of ``before`` and ``after``."""

    def diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = ["\n".join(difflib.unified_diff((x or "").split("\n"), (y or "").split("\n"), lineterm="")) for x, y in zip(b.before, b.after, strict=True)]
            yield pd.DataFrame({"id": b.id, "diff": texts})

    return pairs.select("id", "before", "after").mapInPandas(diff, "id long, diff string")
