"""The segmentation pass against a plain restatement, and fixed cases of blocks that touch, overlap and reach back."""

import random

from graphloom.operators import segments
from graphloom.operators.segments import Token


def _tokens(spec, tops):
    """Tokens as ``(off, end, cursor)``; every cursor is a top declaration with an extent or None (another file)."""
    out = []
    for off, end, c in spec:
        a, z = tops.get(c) or (-1, -1)
        out.append(Token(off, end, -1 if c is None else c, -1 if c is None else z, c is not None, -1 if c is None else c, a, z, c is not None))
    return out


def _cut(spec, tops):
    return [tuple(b) for b in segments.segment(_tokens(spec, tops))]


def test_fixed_cases():
    # apart: both stay; without a space between them the second gives the first up
    assert _cut([(0, 3, 1), (4, 7, 2)], {1: (0, 3), 2: (4, 7)}) == [(1, 0, 3), (2, 4, 7)]
    assert _cut([(0, 3, 1), (3, 7, 2)], {1: (0, 3), 2: (3, 7)}) == [(2, 3, 7)]
    # two variables of one declaration: the second begins where the first did
    assert _cut([(0, 3, 1), (4, 5, 1), (5, 6, None), (7, 8, 2)], {1: (0, 5), 2: (0, 8)}) == [(2, 0, 8)]
    # reaching back over several blocks
    assert _cut([(0, 2, 1), (3, 5, 2), (6, 8, 3), (9, 11, 4)], {1: (0, 2), 2: (3, 5), 3: (6, 8), 4: (3, 11)}) == [(1, 0, 2), (4, 3, 11)]
    # a token without a cursor belongs to the open block, not to none
    assert _cut([(0, 1, None), (2, 4, 1), (5, 6, None), (7, 9, 1), (10, 11, None)], {1: (2, 9)}) == [(1, 2, 9)]
    # a declaration of another file ends before the next top cursor
    assert _cut([(0, 2, 9), (3, 5, 9), (6, 7, None), (8, 9, 1)], {9: None, 1: (8, 9)}) == [(9, 0, 7), (1, 8, 9)]
    assert _cut([], {}) == [] and _cut([(0, 4, None)], {}) == []


def _plain(tokens):
    """The same rules, over positions of tokens: where a block opens, what it takes in, and where it closes."""
    cuts, i = [], 0
    while i < len(tokens):
        if tokens[i].cursor < 0 or not tokens[i].starts:
            i += 1
            continue
        name, start, end = tokens[i].cursor, tokens[i].off, tokens[i].cursor_end
        j = i
        while True:
            t = tokens[j]
            if t.cursor >= 0 and t.top_start >= 0 and t.top_start <= start:
                cuts = [c for c in cuts if c[2] < t.top_start] if cuts and cuts[-1][2] >= t.top_start else cuts
                name, start, end = t.top, t.top_start, max(end, t.top_end)
            if j + 1 == len(tokens):
                break
            n = tokens[j + 1]
            if (n.off >= end) if end >= 0 else (n.cursor >= 0 and n.cursor != name and n.is_top):
                break
            j += 1
        cuts.append((name, start, tokens[j].end))
        i = j + 1
    return cuts


def test_random_extents():
    rng = random.Random(4)
    for _ in range(3000):
        at, spec = 0, []
        for _ in range(rng.randint(0, 14)):
            at += rng.choice([0, 0, 1])
            spec.append((at, at + rng.randint(1, 3), rng.choice([None, 1, 2, 3, 4, 5])))
            at = spec[-1][1]
        tops = {c: None if rng.random() < 0.15 else tuple(sorted((rng.randint(0, at + 1), rng.randint(0, at + 1)))) for c in range(1, 6)}
        tokens = _tokens(spec, tops)
        got = [tuple(b) for b in segments.segment(tokens)]
        assert got == _plain(tokens)


def test_segments_on_tables(spark):
    rows = [(1, 0, 3, 10), (1, 3, 7, 12), (1, 9, 11, 13), (2, 0, 2, 11), (2, 3, 5, 20), (3, 0, 1, None)]
    tokens = spark.createDataFrame(rows, "path_id long, off long, end long, cursor long").repartition(3)
    cursors = spark.createDataFrame(
        [(10, 1, None, "VarDecl", 0, 3), (11, 9, None, "Namespace", 0, 100), (12, 1, None, "ClassDecl", 3, 7), (13, 1, 14, "Method", 9, 11), (14, 1, None, "Namespace", 8, 12), (20, 9, 11, "FunctionDecl", 5, 9)],
        "id long, path_id long, parent long, kind string, start long, end long",
    )
    got = segments.segments(tokens, cursors)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 12, 3, 7), (1, 13, 9, 11), (2, 20, 3, 5)]
    assert segments.segments(tokens.limit(0), cursors).count() == 0


def test_lines_as_declarations(spark):
    texts = spark.createDataFrame([(1, "int a,\nb c\n\n  é d"), (2, None), (3, "")], "path_id long, text string")
    got = segments.segments(*segments.lines_as_declarations(texts))
    assert sorted(tuple(r)[2:] for r in got.collect()) == [(0, 10), (14, 18)]
