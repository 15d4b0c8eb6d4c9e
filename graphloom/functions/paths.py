"""Column functions on slash-separated paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_repo(path: Column) -> Column:
    """Relative and not climbing out: whole components count, so a file named ``..x`` is inside."""
    return ~(path.startswith("/") | (path == "..") | path.startswith("../"))


def parent(path: Column) -> Column:
    """Everything before the last slash; the empty path for a single name."""
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ancestors(path: Column) -> Column:
    """Directories from the root ('') down to the parent."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def normalise(path: Column) -> Column:
    """Empty and ``.`` components go; ``a/..`` pairs cancel. A leading slash stays, leading ``..`` of relative paths too."""
    absolute = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    start = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        climbs = (x == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != "..")
        stays = (x == "..") & absolute & (F.size(acc) == 0)
        return F.when(climbs, F.slice(acc, F.lit(1), F.size(acc) - 1)).when(stays, acc).otherwise(F.concat(acc, F.array(x)))

    return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(F.aggregate(parts, start, step), "/"))


def relative_to(path: Column, prefix: str) -> Column:
    """``path`` without the directory ``prefix``; other paths stay as they are."""
    p = prefix.rstrip("/")
    return F.when(path == p, "").when(path.startswith(p + "/"), F.substr(path, F.lit(len(p) + 2))).otherwise(path)


def strip_dot(path: Column) -> Column:
    return F.regexp_replace(path, r"^(\./)+", "")


def encode_branch(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("~"))


def decode_branch(name: Column) -> Column:
    """Inverse of ``encode_branch`` but for names with a tilde of their own."""
    return F.replace(name, F.lit("~"), F.lit("/"))


def safe_argument(value: Column) -> Column:
    """Route arguments must have neither dots nor slashes."""
    return ~value.rlike("[./]")


def location(path: Column, line: Column, column: Column) -> Column:
    return F.format_string("%s:%d:%d", path, line, column)
