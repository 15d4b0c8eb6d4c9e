"""Scans of repositories: listings, file contents, compile commands, and Python sources."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import normalise, relative_to, strip_dot

#: Larger files are left out.
MAX_FILE_BYTES = 5_000_000


def source_files(spark: SparkSession, root: str, pattern: str = "*", most: int = MAX_FILE_BYTES) -> DataFrame:
    """``path, length, content`` of files up to ``most`` bytes, below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.where(F.col("length") <= most).select("path", "length", "content")


def is_binary(content: Column) -> Column:
    """A zero byte, or bytes that are no UTF-8."""
    return F.contains(content, F.lit(bytearray(b"\x00"))) | ~F.is_valid_utf8(content.cast("string"))


def unparsed(files: DataFrame) -> DataFrame:
    """``path, text, is_binary``: binary contents read ``<BINARY>``."""
    odd = is_binary(F.col("content"))
    return files.select("path", F.when(odd, "<BINARY>").otherwise(F.col("content").cast("string")).alias("text"), odd.alias("is_binary"))


def listed(lines: DataFrame, known: DataFrame | None = None, column: str = "value") -> DataFrame:
    """Paths of a listing without ``./``, each once; less the ``known`` ones."""
    paths = lines.select(strip_dot(F.col(column)).alias("path")).where("path <> ''").distinct()
    return paths if known is None else paths.join(known.select("path"), "path", "left_anti")


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a compile-commands file; one that is empty, or no array of commands, is an error."""
    rows = spark.read.schema("directory string, command string, file string, arguments array<string>, _corrupt_record string").option("multiLine", "true").json(path)
    head = rows.select("file", "_corrupt_record").take(1)
    if not head:
        raise ValueError(f"no commands in {path}")
    if head[0]["_corrupt_record"] is not None or head[0]["file"] is None:
        raise ValueError(f"malformed compile commands in {path}: an array of commands is expected")
    return rows.drop("_corrupt_record")


#: A word of a command line: bare characters, escapes, and quoted stretches.
_SHELL_WORD = r"""((?:[^\s"'\\]++|\\.|"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^']*+')++)"""


def shell_words(command: Column) -> Column:
    """The words of a command line, quotes and escapes resolved."""
    words = F.regexp_extract_all(command, F.lit(_SHELL_WORD), F.lit(1))
    bare = lambda w: F.regexp_replace(w, r"""(?s)"([^"\\]*+(?:\\.[^"\\]*+)*+)"|'([^']*+)'|\\(.)""", "$1$2$3")
    return F.transform(words, lambda w: F.when(w.contains('"'), F.regexp_replace(bare(w), r"""\\(["\\])""", "$1")).otherwise(bare(w)))


#: Arguments that are left out: they name files of a build.
DROPPED = ("-frandomize-layout-seed-file",)


def plan_units(commands: DataFrame, prefix: str, only: list[str] | None = None, drop: tuple[str, ...] = DROPPED, extra: tuple[str, ...] = ()) -> DataFrame:
    """``path, directory, args, seq``: one unit a command, numbered from 1 in the table's order.

    Paths are below ``prefix``. The file's own name and arguments that begin with
    one of ``drop`` leave the arguments, ``extra`` ones follow. With ``only`` the
    first command of each requested file; a file without one is an error.
    """
    from graphloom.operators.search import dense_ids

    file = F.when(F.col("file").startswith("/"), F.col("file")).otherwise(F.concat_ws("/", "directory", "file"))
    args = F.coalesce(F.col("arguments"), shell_words(F.col("command")))
    kept = F.filter(args, lambda a: (a != F.col("file")) & ~_starts(a, drop))
    each = commands.select(
        relative_to(normalise(file), prefix).alias("path"), F.col("directory"), F.concat(kept, F.array(*[F.lit(x) for x in extra]).cast("array<string>")).alias("args"), F.monotonically_increasing_id().alias("_at")
    )
    units = dense_ids(each, ["_at"], "seq", 1).drop("_at")
    if only is None:
        return units
    asked = commands.sparkSession.createDataFrame([(p,) for p in only], "path string")
    missing = [r["path"] for r in asked.join(units, "path", "left_anti").collect()]
    if missing:
        raise ValueError(f"no command for {', '.join(sorted(missing))}")
    from graphloom.operators.symbols import first

    return first(units.join(asked, "path", "left_semi"), ["path"], ["seq"])


def _starts(a: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | a.startswith(p)
    return out


def once_per_file(units: DataFrame) -> DataFrame:
    """``file, unit``: each file is read in the first unit, by number, that includes it."""
    return units.groupBy("file").agg(F.min("unit").alias("unit"))


def python_definitions(files: DataFrame) -> DataFrame:
    """``path, name, kind, context, start, end, nest_level`` of functions and classes of Python sources, by byte offset.

    Sources that do not parse have a row with kind ``error``.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, t in zip(b.path, b.text, strict=True) for r in _definitions(p, t or "")]
            yield pd.DataFrame(rows, columns=["path", "name", "kind", "context", "start", "end", "nest_level"])

    return files.select("path", "text").mapInPandas(scan, "path string, name string, kind string, context string, start long, end long, nest_level int")


def _definitions(path: str, text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        return [(path, str(e)[:200], "error", "", 0, 0, 0)]
    starts = [0, *(m.end() for m in re.finditer(rb"\r\n|\r|\n", text.encode()))]  # lines as the parser counts them
    out: list[tuple] = []

    def visit(node: ast.AST, context: list[str], level: int) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([child.lineno, *[d.lineno for d in child.decorator_list]])
                begin = starts[first - 1] + (child.col_offset if first == child.lineno else child.decorator_list[0].col_offset - 1)
                kind = "Class" if isinstance(child, ast.ClassDef) else "Definition"
                out.append((path, child.name, kind, ".".join(context), begin, starts[child.end_lineno - 1] + child.end_col_offset, level))
                visit(child, [*context, child.name], level + 1)
            else:
                visit(child, context, level)

    visit(tree, [], 1)
    return out


def python_tokens(files: DataFrame) -> DataFrame:
    """``path, pos, type, tok, off``: tokens of Python sources with the white space between them, byte offsets.

    What follows a place where the tokenizer fails is one token of type ``Error``.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, k, *t) for p, x in zip(b.path, b.text, strict=True) for k, t in enumerate(_tokens(x or ""))]
            yield pd.DataFrame(rows, columns=["path", "pos", "type", "tok", "off"])

    return files.select("path", "text").mapInPandas(scan, "path string, pos int, type string, tok string, off long")


def _tokens(text: str) -> list[tuple[str, str, int]]:
    import keyword

    starts = [0, *(m.end() for m in re.finditer("\n", text))]  # lines as readline gives them
    found: list[tuple[int, int, str]] = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.string.strip() and t.type not in (tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.NEWLINE, tokenize.NL):
                name = {tokenize.COMMENT: "Comment", tokenize.STRING: "Literal", tokenize.NUMBER: "Literal", tokenize.OP: "Punctuation"}.get(t.type, "Identifier")
                name = "Keyword" if name == "Identifier" and keyword.iskeyword(t.string) else name
                found.append((starts[t.start[0] - 1] + t.start[1], starts[t.end[0] - 1] + t.end[1], name))
    except (tokenize.TokenError, IndentationError, SyntaxError):
        rest = found[-1][1] if found else 0
        if text[rest:].strip():
            found.append((rest, len(text), "Error"))
    out, at, byte = [], 0, 0
    for a, b, kind in [*found, (len(text), len(text), "")]:
        for piece, name in ((text[at:a], "WS"), (text[a:b], kind)):
            if piece:
                out.append((name, piece, byte))
                byte += len(piece.encode())
        at = b
    return out
