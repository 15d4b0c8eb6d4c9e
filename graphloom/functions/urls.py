"""Symbolic URLs: ``id:N``, ``sym:N``, ``path:P``, ``cur/N``, ``refs:N/O`` and ``slice:f/B[s:e]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SLICE = r"^slice:f/([0-9]+)\[([0-9]+):([0-9]+)\]$"
_REFS = r"^refs:([0-9]+)/([0-9]+)$"
_TOKEN = r"^path:(.*)#token-([0-9]+)$"


def _number(url: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(url, pattern, group).try_cast("bigint")


def parse(url: Column) -> Column:
    """Struct of ``kind`` and operands; kind ``bad`` for anything else.

    ``path:P#token-N`` gives kind ``token``, a place in a file, with both
    operands.
    """
    none = F.lit(None).cast("bigint")

    def made(kind: str, node=none, sym=none, path=None, offset=none, blob=none, end=none) -> Column:
        text = F.lit(None).cast("string") if path is None else path
        return F.struct(
            F.lit(kind).alias("kind"), node.alias("node_id"), sym.alias("sym_id"), text.alias("path"), offset.alias("offset"), blob.alias("blob_id"), end.alias("end")
        )

    number = lambda prefix: _number(url, rf"^{prefix}\+?([0-9]+)$")
    numbers = lambda p, n: F.greatest(*[_number(url, p, g).isNull().cast("int") for g in range(1, n + 1)]) == 0
    bad = made("bad")
    return (
        F.when(url.startswith("id:"), F.when(number("id:").isNotNull(), made("id", node=number("id:"))).otherwise(bad))
        .when(url.startswith("sym:"), F.when(number("sym:").isNotNull(), made("sym", sym=number("sym:"))).otherwise(bad))
        .when(url.rlike(_TOKEN), made("token", path=F.regexp_extract(url, _TOKEN, 1), offset=_number(url, _TOKEN, 2)))
        .when(url.startswith("path:"), made("path", path=F.substr(url, F.lit(6))))
        .when(url.startswith("cur/"), F.when(number("cur/").isNotNull(), made("direct", node=number("cur/"))).otherwise(bad))
        .when(url.rlike(_REFS) & numbers(_REFS, 2), made("refs", node=_number(url, _REFS, 1), offset=_number(url, _REFS, 2)))
        .when(url.rlike(_SLICE) & numbers(_SLICE, 3), made("slice", blob=_number(url, _SLICE, 1), offset=_number(url, _SLICE, 2), end=_number(url, _SLICE, 3)))
        .otherwise(bad)
    )


def render(href: Column) -> Column:
    """URL of a parsed link; direct links print as ``id:N``."""
    k = href["kind"]
    return (
        F.when(k.isin("id", "direct"), F.concat(F.lit("id:"), href["node_id"]))
        .when(k == "sym", F.concat(F.lit("sym:"), href["sym_id"]))
        .when(k == "refs", F.concat(F.lit("refs:"), href["node_id"], F.lit("/"), href["offset"]))
        .when(k == "slice", F.concat(F.lit("slice:f/"), href["blob_id"], F.lit("["), href["offset"], F.lit(":"), href["end"], F.lit("]")))
        .when(k == "path", F.concat(F.lit("path:"), href["path"]))
        .when(k == "token", F.concat(F.lit("path:"), href["path"], F.lit("#token-"), href["offset"]))
    )


def build_ref(ref: Column) -> Column:
    """Repository, branch and build of a catalog reference."""
    p = r"repos/([^/]+)/branches/([^/]+)/builds/([^/]+)"
    part = lambda g: F.nullif(F.regexp_extract(ref, p, g), F.lit(""))
    return F.struct(part(1).alias("repo_id"), F.try_url_decode(F.replace(part(2), F.lit("+"), F.lit("%2B"))).alias("branch"), part(3).alias("build_id"))


def git_repository(url: Column, host: str = "github.com") -> Column:
    """Owner and repository of a Git host's https or ssh URL, or of ``owner/name``."""
    h = host.replace(".", r"\.")
    p = rf"(?:https?://{h}/|git@{h}:|^)([^/\s]+)/([^/\s.]+)(?:\.git)?/?$"
    part = lambda g: F.nullif(F.regexp_extract(url, p, g), F.lit(""))
    return F.struct(part(1).alias("owner"), part(2).alias("repository"))


def radix_prefixes(key: Column, bits: tuple[int, ...] = (14, 14, 14, 22)) -> list[Column]:
    """The digits of a key in the fixed-fan-out index, low bits first."""
    out, offset = [], 0
    for level, width in enumerate(bits):
        out.append(F.shiftrightunsigned(key, offset).bitwiseAND((1 << width) - 1).alias(f"prefix{level}"))
        offset += width
    return out
