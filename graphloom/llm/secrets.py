"""Secret scan over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived
that every match must satisfy. Texts are indexed in segments (one for each
block of texts), for just the trigrams that some query has; intersecting
postings gives each rule's candidates, which the regular expression then
verifies. Rules without a mandatory trigram scan all texts. Segments are built
where the texts are, so nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm import blocks as B
from graphloom.llm.spans import Span, find

_parser = re._parser  # the standard library's own reading of a pattern
#: Strings that one run of a pattern may stand for; more end the run.
MAX_STRINGS = 64

Clause = frozenset[frozenset[int]]


@dataclass(frozen=True)
class Rule:
    """A kind of secret: pattern, least length of ``group``, and whether it is a base rule."""

    kind: str
    pattern: str
    at_least: int = 1
    group: int = 0
    base: bool = False


# The patterns to look for.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, 0, True),
    Rule("hex", r"[0-9a-f]+", 32, 0, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}"),
)


def _trigrams(s: str) -> frozenset[int]:
    b = s.lower().encode() if s.isascii() else s.encode()
    b = bytes(B.FOLD[list(b)]) if b else b
    return frozenset(b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2))


def _class_strings(items: list) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            out.add(chr(arg))
        elif name == "RANGE" and arg[1] - arg[0] < MAX_STRINGS:
            out |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


class _Reader:
    """Collects the clauses of a pattern; ``run`` holds what the current stretch may read."""

    def __init__(self) -> None:
        self.clauses: set[Clause] = set()
        self.run: set[str] = {""}

    def cut(self) -> None:
        options = frozenset(_trigrams(s) for s in self.run)
        if all(options):
            self.clauses.add(options)
        self.run = {""}

    def add(self, strings: set[str]) -> None:
        if len(self.run) * len(strings) > MAX_STRINGS:
            self.cut()
        self.run = {a + b for a, b in product(self.run, strings)}

    def read(self, nodes) -> None:
        for op, arg in nodes:
            strings = _strings(op, arg)
            if strings is not None:
                self.add(strings)
                continue
            self.cut()
            name = str(op)
            if name == "SUBPATTERN":
                self.read(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
                self.read(arg[2])
            elif name == "BRANCH":
                queries = [clauses_of(b) for b in arg[1]]
                if all(queries):  # each branch must give at least one clause; the loosest of it will do
                    self.clauses.add(frozenset(o for q in queries for o in min(q, key=len)))
            self.cut()


def _strings(op, arg) -> set[str] | None:
    """All strings a node matches, if they are few."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg)}
    if name == "IN":
        return _class_strings(arg)
    if name == "SUBPATTERN":
        return _sequence(arg[3])
    if name == "BRANCH":
        parts = [_sequence(b) for b in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] == 1 and (inner := _sequence(arg[2])) is not None:
        return inner | ({""} if arg[0] == 0 else set())
    return None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        strings = _strings(op, arg)
        if strings is None or len(out) * len(strings) > MAX_STRINGS:
            return None
        out = {a + b for a, b in product(out, strings)}
    return out


def clauses_of(nodes) -> set[Clause]:
    r = _Reader()
    r.read(nodes)
    r.cut()
    return r.clauses


def trigram_query(pattern: str) -> set[Clause]:
    """Clauses that all hold in any matching text, letter case aside: each is met by one of its sets of trigrams.

    Empty if the pattern has no mandatory trigram.
    """
    return clauses_of(_parser.parse(pattern, re.ASCII))


class Scanner:
    """The rules' queries, compiled once for each task."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.regex = [re.compile(r.pattern, re.ASCII) for r in rules]
        self.query = [trigram_query(r.pattern) for r in rules]
        self.rank = {r.kind: k for k, r in enumerate(rules)}
        wanted = sorted({t for q in self.query for clause in q for option in clause for t in option})
        self.wanted = np.array(wanted, np.int64)
        self.lookup = np.zeros(1 << 24, bool)
        self.lookup[self.wanted] = True

    def postings(self, block: B.Block) -> dict[int, np.ndarray]:
        """Texts that hold each wanted trigram."""
        d = B.FOLD[block.data].astype(np.int32)
        code = d[:-2] << 16 | d[1:-1] << 8 | d[2:]
        at = np.flatnonzero(self.lookup[code]) if len(d) > 2 else np.zeros(0, np.int64)
        doc = np.searchsorted(block.offs, at, side="right") - 1
        inside = at + 2 < block.offs[doc + 1]
        pair = np.unique(code[at[inside]].astype(np.int64) * block.n + doc[inside])
        gram, doc = pair // block.n, pair % block.n
        cut = np.searchsorted(gram, self.wanted), np.searchsorted(gram, self.wanted, side="right")
        return {int(t): doc[a:b] for t, a, b in zip(self.wanted, *cut, strict=True)}

    def candidates(self, query: set[Clause], postings: dict[int, np.ndarray], n: int) -> np.ndarray:
        left = np.ones(n, bool)
        for clause in query:
            some = np.zeros(n, bool)
            for option in clause:
                every = np.ones(n, bool)
                for t in option:
                    has = np.zeros(n, bool)
                    has[postings[t]] = True
                    every &= has
                some |= every
            left &= some
        return np.flatnonzero(left)

    def scan(self, texts: pa.Array) -> list[list[Span]]:
        out: list[list[Span]] = [[] for _ in range(len(texts))]
        strings = texts.to_pylist()
        for block in B.blocks(texts):
            postings = self.postings(block)
            for rule, regex, query in zip(self.rules, self.regex, self.query, strict=True):
                for k in self.candidates(query, postings, block.n):
                    at = block.row + int(k)
                    for m in regex.finditer(strings[at] or ""):
                        if m.end(rule.group) - m.start(rule.group) >= rule.at_least:
                            out[at].append((rule.kind, m.start(), m.end(), rule.base))
        for own in out:
            own.sort(key=lambda s: (s[1], self.rank[s[0]]))
        return out


_scanner: list[Scanner] = []


def secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` of every whole text; spans by start, then kind.

    Null and empty texts have none, an empty table gives no row. Repeated rows
    are searched each. Whole texts are searched, and no rule looks at a place
    more than a bounded number of times, so very long ones cost their length.
    Spans that begin together stand in the order of the rules. Columns other
    than ``doc_id`` and ``text`` are not read, whatever their names.
    """

    def finder(texts: pa.Array) -> list[list[Span]]:
        if not _scanner:
            _scanner.append(Scanner())
        return _scanner[0].scan(texts)

    return find(docs, finder)
