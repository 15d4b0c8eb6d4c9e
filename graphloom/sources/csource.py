"""C and C++ sources: tokens with byte offsets, include lines, and which file each of them reads.

The lexer is a state machine over bytes, written as one pattern whose branches
are the states; every branch runs forward only, so a token costs its length. It
loses nothing: the tokens of a text, joined, are the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import ancestors, normalise, parent
from graphloom.runtime import prepare

# The keywords of C and C++, and operators of more than one character, longest first.
KEYWORDS = frozenset(
    """alignas alignof and and_eq asm auto bitand bitor bool break case catch char class compl concept const const_cast consteval constexpr constinit continue
    co_await co_return co_yield decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long
    mutable namespace new noexcept not not_eq nullptr operator or or_eq private protected public register reinterpret_cast requires restrict return short signed
    sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename typeof union unsigned using virtual
    void volatile wchar_t while xor xor_eq _Alignas _Alignof _Atomic _Bool _Complex _Generic _Imaginary _Noreturn _Static_assert _Thread_local""".split()
)
OPERATORS = ("<=>", "->*", "...", "<<=", ">>=", "::", "->", ".*", "++", "--", "<<", ">>", "<=", ">=", "==", "!=", "&&", "||", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "##")

_PATTERN = re.compile(
    rb"(?P<WS>(?:[ \t\r\n\v\f]|\\\r?\n)++)"
    rb"|(?P<Comment>//(?:[^\\\n]|\\\r?\n|\\)*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?)"
    rb"|(?P<Raw>(?:u8|[uUL])?R\"(?P<mark>[^ ()\\\t\v\f\n]{0,16})\()"
    rb"|(?P<Literal>(?:u8|[uUL])?\"(?:[^\"\\\n]|\\(?s:.))*+\"?|(?:u8|[uUL])?'(?:[^'\\\n]|\\(?s:.))*+'?|\.?[0-9](?:[eEpP][+-]|'?[0-9A-Za-z_.])*+)"
    rb"|(?P<Identifier>[A-Za-z_$\x80-\xff][0-9A-Za-z_$\x80-\xff]*+)"
    rb"|(?P<Punctuation>" + b"|".join(re.escape(o.encode()) for o in OPERATORS) + rb"|(?s:.))"
)
_DIRECTIVE = re.compile(rb"(?:[ \t]|\\\r?\n)*+([A-Za-z_]*)")


#: Tokens of a text that ``type_runs`` joins at once.
RUN_TOKENS = 8192


def lex(data: bytes) -> Iterator[tuple[str, int, int, str | None, int | None]]:
    """Type, start and end of each token, and name and place of the preprocessor directive that it belongs to (its ``#`` on)."""
    at, fresh, directive, began = 0, True, None, None
    while at < len(data):
        m = _PATTERN.match(data, at)
        kind, end = m.lastgroup, m.end()
        if m["Raw"] is not None:  # up to its own closing mark, or to the end
            close = data.find(b")" + m["mark"] + b'"', end)
            kind, end = "Literal", len(data) if close < 0 else close + len(m["mark"]) + 2
        tok = data[at:end]
        if kind == "WS" and b"\n" in tok.replace(b"\\\n", b"").replace(b"\\\r\n", b""):
            fresh, directive, began = True, None, None
        elif kind == "Punctuation" and tok == b"#" and fresh:
            # The name follows, after blanks at most.
            directive, began, fresh = _DIRECTIVE.match(data, end)[1].decode(), at, False
        elif kind not in ("WS", "Comment"):
            fresh = False
        if kind == "Identifier" and tok.decode(errors="replace") in KEYWORDS:
            kind = "Keyword"
        yield kind, at, end, directive, began
        at = end


def c_tokens(files: DataFrame, key: str = "path") -> DataFrame:
    """``<key>, pos, type, tok, off, directive, directive_off`` of sources (``<key>, text``): all tokens with the white space between, byte offsets.

    Comments and strings that do not end go to the end of the text, or of the
    line for plain strings; any other byte is punctuation. Null texts have no
    tokens. Rows go out in batches, so a long text is never held as rows.
    """
    prepare(files.sparkSession)
    names = [key, "pos", "type", "tok", "off", "directive", "directive_off"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key_type, rows = batch.schema.field(0).type, []
            for k, text in zip(batch.column(0), batch.column(1), strict=True):
                name, data = k.as_py(), (text.as_py() or "").encode()
                for pos, (kind, a, z, directive, began) in enumerate(lex(data)):
                    rows.append((name, pos, kind, data[a:z].decode(errors="replace"), a, directive, began))
                    if len(rows) == 8192:
                        yield _batch(rows, key_type, names)
                        rows = []
            if rows:
                yield _batch(rows, key_type, names)

    return files.select(key, "text").mapInArrow(scan, f"`{key}` {dict(files.dtypes)[key]}, pos int, type string, tok string, off long, directive string, directive_off long")


def _batch(rows: list[tuple], key_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    types = [key_type, pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def type_runs(files: DataFrame, key: str = "path") -> DataFrame:
    """``<key>, type, first, n, offsets, last_off, text``: the tokens of ``c_tokens`` by type within runs of ``RUN_TOKENS`` of a text.

    ``first`` is the number of the run, ``offsets`` the sum of their offsets and
    ``text`` the tokens of that type joined, so that what is grouped by text and
    type afterwards is rows of runs, not of tokens.
    """
    prepare(files.sparkSession)
    names = [key, "type", "first", "n", "offsets", "last_off", "text"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.schema.field(0).type, pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            rows: list[tuple] = []
            for k, text in zip(batch.column(0), batch.column(1), strict=True):
                name, data = k.as_py(), (text.as_py() or "").encode()
                tokens, run = lex(data), 0
                while part := list(islice(tokens, RUN_TOKENS)):
                    by_type: dict[str, list[tuple[int, int]]] = {}
                    for kind, a, z, _, _ in part:
                        by_type.setdefault(kind, []).append((a, z))
                    for kind, places in by_type.items():
                        rows.append((name, kind, run, len(places), sum(a for a, _ in places), places[-1][0], "".join([data[a:z].decode(errors="replace") for a, z in places])))
                    run += 1
                    if len(rows) >= 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return files.select(key, "text").mapInArrow(scan, f"`{key}` {dict(files.dtypes)[key]}, type string, first int, n long, offsets long, last_off long, text string")


def include_lines(files: DataFrame) -> DataFrame:
    """``path, off, name, quoted``: the include lines of sources (``path, text``), not those in comments or strings.

    Names are as written; lines whose name is a macro have no row. Each line's
    words are joined where the text is lexed, so only include lines leave it.
    """
    prepare(files.sparkSession)
    wanted = ("include", "include_next", "import")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch.column(0), batch.column(1), strict=True):
                name, data, words, place = path.as_py(), (text.as_py() or "").encode(), [], None
                for kind, a, z, directive, began in lex(data):
                    if began != place:
                        if words:
                            rows.append((name, place, "".join(words)))
                        words, place = [], began
                    if directive in wanted and kind != "Comment" and a > began:
                        words.append(data[a:z].decode(errors="replace"))
                if words:
                    rows.append((name, place, "".join(words)))
                if len(rows) >= 8192:
                    yield _lines(rows, batch.schema.field(0).type)
                    rows = []
            if rows:
                yield _lines(rows, batch.schema.field(0).type)

    text = files.select("path", "text").mapInArrow(scan, f"path {dict(files.dtypes)['path']}, directive_off long, line string")
    name = F.regexp_extract("line", r'^\s*\w+\s*(?:"([^"]+)"|<([^>]+)>)', 1)
    angled = F.regexp_extract("line", r'^\s*\w+\s*(?:"([^"]+)"|<([^>]+)>)', 2)
    return text.select("path", F.col("directive_off").alias("off"), F.when(name != "", name).otherwise(angled).alias("name"), (name != "").alias("quoted")).where("name <> ''")


def _lines(rows: list[tuple], path_type: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [path_type, pa.int64(), pa.string()], strict=True)], ["path", "directive_off", "line"])


def search_folders(units: DataFrame) -> DataFrame:
    """``unit, rank, folder`` from compile commands (``path, directory, args``): ``-I`` in order, then ``-isystem``; ``-iquote`` (``quoted_only``) comes first.

    An option and its folder may be one argument or two.
    """
    flat = units.select(F.col("path").alias("unit"), "directory", "args", F.posexplode("args").alias("i", "arg"))
    given = F.regexp_extract("arg", r"^(-iquote|-isystem|-I)(.*)$", 2)
    option = F.regexp_extract("arg", r"^(-iquote|-isystem|-I)(.*)$", 1)
    folder = F.when(given != "", given).otherwise(F.try_element_at("args", F.col("i") + 2))
    place = F.when(option == "-iquote", 0).when(option == "-I", 1).otherwise(2)
    named = flat.where(option != "").select("unit", "directory", folder.alias("folder"), (place * 100_000 + F.col("i")).cast("long").alias("rank"), (option == "-iquote").alias("quoted_only"))
    absolute = F.when(F.col("folder").startswith("/"), F.col("folder")).otherwise(F.concat_ws("/", "directory", "folder"))
    return named.where("folder is not null").select("unit", "rank", normalise(absolute).alias("folder"), "quoted_only")


def resolve_includes(lines: DataFrame, known: DataFrame, folders: DataFrame) -> DataFrame:
    """``unit, src, off, dst``: which known file (``path``) each include line reads in each unit; lines that find none have no row.

    A quoted name is looked for beside its file first; then, as other names, in
    the unit's folders by rank (``folders`` is ``search_folders``). The first
    folder that has it wins. A name that is a full path stands for itself. What
    is found without a folder has a null ``unit`` and holds in all of them.

    Every known file is cut into folder and rest at each of its slashes, and
    every folder stands under each of its ancestors with the number of ``..``
    that lead there, so all lookups are joins on equal keys that only meet hits.
    """
    files = known.select(F.col("path").alias("dst")).distinct()
    full = F.col("name").startswith("/")
    beside = normalise(F.when(full, F.col("name")).when(parent(F.col("path")) == "", F.col("name")).otherwise(F.concat_ws("/", parent(F.col("path")), "name")))
    own = lines.where(full | F.col("quoted")).withColumn("dst", beside).join(files, "dst").select(F.lit(None).cast(dict(folders.dtypes)["unit"]).alias("unit"), F.col("path").alias("src"), "off", "dst")
    left = lines.where(~full).join(own.select(F.col("src").alias("path"), "off"), ["path", "off"], "left_anti")
    plain = normalise(F.col("name"))
    climbs = F.size(F.split(F.regexp_extract(plain, r"^((?:\.\./)*)", 1), "/")) - 1
    asked = left.select(F.col("path").alias("src"), "off", "quoted", climbs.alias("up"), F.regexp_replace(plain, r"^(\.\./)+", "").alias("rest"))
    parts = F.split("dst", "/")
    each = F.explode(F.sequence(F.when(F.col("dst").startswith("/"), 1).otherwise(0), F.size(parts) - 1)).alias("i")
    join = lambda a, n: F.array_join(F.slice("parts", a, n), "/")
    cut = files.select("dst", parts.alias("parts"), each).select("dst", join(F.lit(1), F.col("i")).alias("at"), join(F.col("i") + 1, F.size("parts")).alias("rest"))
    above = F.concat(F.array("folder"), F.reverse(ancestors(F.col("folder"))))
    reach = folders.select("unit", "rank", "quoted_only", F.posexplode(above).alias("up", "at"))
    hits = asked.join(cut, "rest").join(reach, ["up", "at"]).where(F.col("quoted") | ~F.col("quoted_only"))
    return own.unionByName(hits.groupBy("unit", "src", "off").agg(F.min_by("dst", "rank").alias("dst")))


def included_files(resolved: DataFrame, units: DataFrame) -> DataFrame:
    """``unit, file``: every file that a unit (``path``) reads, itself included, through any number of includes.

    Rows of ``resolve_includes`` without a unit hold in every unit. Rounds go on
    until one finds nothing new; include cycles are fine.
    """
    from graphloom.runtime import Tables

    tables = Tables(units.sparkSession, "includes")
    edges = tables.put("edges", resolved.select("unit", "src", "dst").distinct())
    seen = new = tables.put("files-0", units.select(F.col("path").alias("unit"), F.col("path").alias("file")).distinct())
    k = 0
    while True:
        k += 1
        at = new.select(F.col("unit").alias("_unit"), F.col("file").alias("src"))
        anywhere = at.join(edges.where("unit is null").select("src", "dst"), "src").select(F.col("_unit").alias("unit"), F.col("dst").alias("file"))
        there = at.withColumnRenamed("_unit", "unit").join(edges.where("unit is not null"), ["unit", "src"]).select("unit", F.col("dst").alias("file"))
        new = tables.put(f"files-{k}", anywhere.unionByName(there).distinct().join(seen, ["unit", "file"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
