"""Column functions of the symbol search: subsequence match, positions and score."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest score; a match scores this divided by the key's length.
SCORE_MAX = 9223372036854775807


def subsequence_pattern(query: str) -> str:
    """Regex that finds ``query``'s bytes in order, ASCII case ignored."""
    return "(?is)" + ".*".join(re.escape(c) for c in query)


def is_subsequence(key: Column, query: str) -> Column:
    """True where every character of ``query`` occurs in ``key`` in order.

    Queries with non-ASCII characters match nothing: search keys are ASCII.
    """
    if not query.isascii():
        return F.lit(False)
    return key.rlike(subsequence_pattern(query)) if query else F.lit(True)


def positions(key: Column, query: str) -> Column:
    """0-based positions of the greedy leftmost match; the contiguous range if ``query`` is a substring."""
    if not query:
        return F.array().cast("array<int>")
    q = F.lit(query)
    start = F.struct(F.lit(0).alias("m"), F.array().cast("array<int>").alias("p"))

    def step(acc: Column, i: Column) -> Column:
        hit = (acc["m"] < F.length(q)) & (F.lower(F.substr(key, i, F.lit(1))) == F.lower(F.substr(q, acc["m"] + 1, F.lit(1))))
        return F.when(
            hit, F.struct((acc["m"] + 1).alias("m"), F.concat(acc["p"], F.array((i - 1).cast("int"))).alias("p"))
        ).otherwise(acc)

    greedy = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1))), start, step, lambda a: a["p"])
    at = F.instr(key, query)
    return F.when(at > 0, F.sequence(at - 1, at - 2 + F.lit(len(query))).cast("array<int>")).otherwise(greedy)


def score(key: Column, query: str) -> Column:
    """``SCORE_MAX div length``, halved unless the query is a case-sensitive substring."""
    full = F.call_function("div", F.lit(SCORE_MAX), F.length(key).cast("bigint"))
    return F.when(F.contains(key, F.lit(query)), full).otherwise(F.call_function("div", full, F.lit(2).cast("bigint")))


def search_key(text: Column) -> Column:
    """Key normalisation of the symbol index: control and non-ASCII characters go, DEL stays."""
    return F.regexp_replace(text, r"[^\x20-\x7F]", "")
