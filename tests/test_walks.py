"""Walks along chains, cycles and random graphs against plain searches."""

import random
from collections import deque

from graphloom.operators import tree


def _search(edges, start):
    seen, queue = {}, deque((n, 1) for n in edges.get(start, ()))
    while queue:
        n, d = queue.popleft()
        if n not in seen:
            seen[n] = d
            queue.extend((m, d + 1) for m in edges.get(n, ()))
    return seen


def test_distances_of_random_graphs(spark):
    rng = random.Random(6)
    pairs = {(g * 100 + rng.randrange(n), g * 100 + rng.randrange(n)) for g, (n, m) in enumerate([(30, 45), (40, 40), (12, 60), (25, 20)]) for _ in range(m)}
    pairs |= {(900 + i, 900 + (i + 1) % 21) for i in range(21)}  # a ring
    edges = {}
    for a, b in pairs:
        edges.setdefault(a, set()).add(b)
    want = {(a, b, d) for a in edges for b, d in _search(edges, a).items()}
    df = spark.createDataFrame([*pairs, *list(pairs)[:5], (None, 1), (1, None)], "src long, dst long")
    got = tree.distances(df)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert tree.closure(df.limit(0)).count() == 0


def test_chain_of_a_thousand_in_ten_rounds(spark, monkeypatch):
    rounds = []
    put = tree.Tables.put
    monkeypatch.setattr(tree.Tables, "put", lambda self, name, df: (rounds.append(name), put(self, name, df))[1])
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(1000)] + [(5000, None), (5001, 5000), (7, 3), (7, 5001), (8001, 8002), (8002, 8001)], "id long, parent long").coalesce(2)
    got = {(r.id, r.root): r.depth for r in tree.depths(chain).collect()}
    assert all(got[i, 0] == (i if i < 7 else i - 3) for i in range(1000))
    assert {k: v for k, v in got.items() if k[1] == 5000} == {(5000, 5000): 0, (5001, 5000): 1} | {(i, 5000): i - 5 for i in range(7, 1000)}
    assert not any(i > 8000 for i, _ in got)
    assert sum(n.startswith("found") for n in rounds) <= 12
    rounds.clear()
    assert tree.closure(spark.createDataFrame([(i, i + 1) for i in range(300)], "src long, dst long").coalesce(2)).count() == 300 * 301 // 2
    assert len(rounds) <= 11  # 1, 2, 4, ... 512, of which the last is empty
