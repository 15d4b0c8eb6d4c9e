"""Personal data by anchor expansion.

One Aho-Corasick automaton finds what every span must contain or follow:
at-signs, plus signs, digits, scheme marks and identifier cues. A parser for
each anchor then expands from it, in both directions where needed, to the
span's bounds, and validates it. Parsers never look beyond the run of
characters that can belong to the span.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.spans import Span, find

BASE = ["email", "ip", "card", "phone"]
#: Kinds in the order spans are listed; ``address`` and ``account`` are found by schemes and cues.
KINDS = [*BASE, "address", "account"]
# Words that announce an account identifier.
CUES = ("account", "acct", "iban", "customer id", "member id", "policy number")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_RUN = re.compile(r"[0-9]++")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HOST = re.compile(r"(?:[^\s/?#@<>\"']++@)?([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)(?::[0-9]{1,5})?(?:[/?#][^\s<>\"']*)?")
_AFTER_CUE = re.compile(r"(?: (?:number|no\.?|num|id))?[ ]?[:#=]?[ ]?#?", re.IGNORECASE | re.ASCII)
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,19}(?![0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for cue in CUES:
        a.add_word(cue, ("cue", len(cue)))
    a.make_automaton()
    return a


_anchors: list[ahocorasick.Automaton] = []


def _lowered(text: str) -> str:
    """Lower case at the same offsets: one letter alone, U+0130, would become two."""
    return text.replace("\u0130", "\0").lower()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def parse(text: str) -> list[Span]:
    """Spans of one text by kind, then start. Within a kind no two overlap."""
    if not _anchors:
        _anchors.append(_automaton())
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = ip_end = card_end = phone_end = address_end = account_end = 0
    for end, (kind, size) in _anchors[0].iter(_lowered(text)):  # cues are in lower case
        at = end - size + 1
        if kind == "digit":
            if at >= card_end:
                if m := _CARD.match(text, at):
                    card_end = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(m.span())
                else:
                    card_end = at + 1
            if at >= ip_end:
                if m := _IP.match(text, at):
                    ip_end = m.end()
                    if all(map(_at_most_255, m[0].split("."))):
                        out["ip"].append(m.span())
                else:  # no later start in this run of digits can do better
                    ip_end = _RUN.match(text, at).end()
        elif kind == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                out["email"].append((start, m.end()))
        elif kind == "plus":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 8 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    out["phone"].append(m.span())
        elif kind == "scheme":
            start = at
            while start > address_end and text[start - 1] in _SCHEME:
                start -= 1
            if start < at and at >= address_end and (m := _HOST.match(text, at + 3)):
                address_end = m.end()
                stop = m.start() + len(m[0].rstrip(".,;:!?)"))
                if m[1].rpartition(".")[2].isalpha() or _IP.fullmatch(m[1]):
                    out["address"].append((start, stop))
        elif at >= account_end:
            begin = _AFTER_CUE.match(text, end + 1).end()
            m = _IBAN.match(text, begin)
            if not (m and _iban(m[0])):
                m = _ACCOUNT.match(text, begin)
            if m:
                account_end = m.end()
                out["account"].append(m.span())
    return [(k, a, b, k in BASE) for k in KINDS for a, b in out[k]]


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` of every whole text; spans by kind, then start.

    Null and empty texts have none, an empty table gives no row. Repeated rows
    are searched each. Whole texts are read in one pass of the automaton; a
    parser looks back no further than the anchor before it, so very long texts
    cost their length. Where spans of a kind could overlap, the leftmost stays.
    Columns other than ``doc_id`` and ``text`` are not read, whatever their names.
    """

    def finder(texts: pa.Array) -> list[list[Span]]:
        return [parse(t) for t in texts.to_pylist()]

    return find(docs, finder)
