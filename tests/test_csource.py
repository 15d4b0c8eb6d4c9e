"""C tokens, include lines and include search on small sources."""

import pytest

from graphloom.sources import csource


def _lexed(text):
    data = text.encode()
    got = list(csource.lex(data))
    assert b"".join(data[a:z] for _, a, z, *_ in got) == data and [x[1] for x in got][1:] == [x[2] for x in got][:-1]
    return [(k, data[a:z].decode()) for k, a, z, *_ in got if k != "WS"]


def test_tokens():
    assert _lexed("int x = 0x1F'0p+3;") == [("Keyword", "int"), ("Identifier", "x"), ("Punctuation", "="), ("Literal", "0x1F'0p+3"), ("Punctuation", ";")]
    assert _lexed('/* a "b */ "c /* d" \'\\\'\' // e \\\n f') == [("Comment", '/* a "b */'), ("Literal", '"c /* d"'), ("Literal", "'\\''"), ("Comment", "// e \\\n f")]
    assert _lexed('u8R"x(a)" )y" )x" L"z" R"(q)"') == [("Literal", 'u8R"x(a)" )y" )x"'), ("Literal", 'L"z"'), ("Literal", 'R"(q)"')]
    assert _lexed("a->*b<=>c...<<=::") == [("Identifier", "a"), ("Punctuation", "->*"), ("Identifier", "b"), ("Punctuation", "<=>"), ("Identifier", "c"), ("Punctuation", "..."), ("Punctuation", "<<="), ("Punctuation", "::")]
    assert _lexed("/* open * /") == [("Comment", "/* open * /")] and _lexed('"open\nx') == [("Literal", '"open'), ("Identifier", "x")]
    assert _lexed('R"(open') == [("Literal", 'R"(open')] and _lexed("é日$1 \\") == [("Identifier", "é日$1"), ("Punctuation", "\\")]
    assert _lexed("") == []


@pytest.mark.parametrize("one", ["/*", '"', "\\", "R\"(", "'", "a", "/", "*", "0'", "\\\n", "#"])
def test_long_texts_are_linear(one):
    data = (one * (1 << 20)).encode()[: 1 << 20]
    assert sum(z - a for _, a, z, *_ in csource.lex(data)) == len(data)


def test_directives():
    text = "#define X(a) \\\n  a#b\n  # include <s.h>\nx # y\n#\n/* c */ #if 1 /* two\nlines */ Z\nw"
    got = [(text.encode()[a:z].decode(), d) for k, a, z, d, _ in csource.lex(text.encode()) if k not in ("WS", "Comment")]
    assert {t: d for t, d in got if t in ("X", "b", "s", "y", "Z", "w", "1")} == {"X": "define", "b": "define", "s": "include", "y": None, "1": "if", "Z": "if", "w": None}


def test_tables_and_awkward_texts(spark):
    rows = [("a", "x\n  yé z"), (None, "q"), ("n", None), ("e", ""), ("a", "x")]
    got = sorted(map(tuple, csource.c_tokens(spark.createDataFrame(rows, "path string, text string")).collect()), key=str)
    assert [(r[0], r[1], r[3], r[4]) for r in got if r[2] == "Identifier"] == [("a", 0, "x", 0), ("a", 0, "x", 0), ("a", 2, "yé", 4), ("a", 4, "z", 8), (None, 0, "q", 0)]


def test_include_path_layout(spark):
    """A unit with a folder of headers, one header beside another, cycles, names with dots, and a name that two folders have."""
    files = {
        "/r/main.c": '#include "local.h"\n#include <lib.h>\n// #include <no.h>\nchar *s = "\\\n#include <no.h>";\n#include MACRO\n#include <both.h>\n#include <../up/u.h>\n',
        "/r/local.h": '#include "sub/deep.h"\n',
        "/r/sub/deep.h": '#include "../local.h"\n  #  include "lib.h" // as the folder has it\n',
        "/r/include/lib.h": "#pragma once\n#include <lib.h>\n#include </abs/x.h>\n",
        "/r/include/both.h": "", "/r/second/both.h": '#include "only_quoted.h"\n', "/r/q/only_quoted.h": "", "/r/up/u.h": "", "/abs/x.h": "", "/r/no.h": "", "/r/other.c": "#include <both.h>\n#include <only_quoted.h>\n#include <nowhere.h>",
    }
    sources = spark.createDataFrame(list(files.items()), "path string, text string").repartition(3)
    lines = csource.include_lines(sources)
    assert sorted((r.path, r.name, r.quoted) for r in lines.where("path = '/r/main.c'").collect()) == [("/r/main.c", "../up/u.h", False), ("/r/main.c", "both.h", False), ("/r/main.c", "lib.h", False), ("/r/main.c", "local.h", True)]
    units = spark.createDataFrame(
        [("/r/main.c", "/r", ["cc", "-isystem", "second", "-I", "include", "-iquote", "q", "-c"]), ("/r/other.c", "/r/sub", ["-I../second/", "-iquote/r/q", "-I"])], "path string, directory string, args array<string>"
    )
    folders = csource.search_folders(units)
    assert [(r.unit, r.folder) for r in folders.orderBy("unit", "rank").collect()] == [("/r/main.c", "/r/q"), ("/r/main.c", "/r/include"), ("/r/main.c", "/r/second"), ("/r/other.c", "/r/q"), ("/r/other.c", "/r/second")]
    found = csource.resolve_includes(lines, sources, folders)
    hits = {(r.unit, r.src, r.dst) for r in found.collect()}
    assert {(None, "/r/main.c", "/r/local.h"), (None, "/r/local.h", "/r/sub/deep.h"), (None, "/r/sub/deep.h", "/r/local.h"), (None, "/r/include/lib.h", "/abs/x.h")} == {h for h in hits if h[0] is None}
    assert {(s.split("/")[-1], d) for u, s, d in hits if u == "/r/main.c" and s in ("/r/main.c", "/r/sub/deep.h")} == {("main.c", "/r/include/lib.h"), ("main.c", "/r/include/both.h"), ("main.c", "/r/up/u.h"), ("deep.h", "/r/include/lib.h")}
    assert {d for u, s, d in hits if u == s == "/r/other.c"} == {"/r/second/both.h"}
    reads = csource.included_files(found, units)
    assert {r.file for r in reads.where("unit = '/r/main.c'").collect()} == {"/r/main.c", "/r/local.h", "/r/sub/deep.h", "/r/include/lib.h", "/r/include/both.h", "/r/up/u.h", "/abs/x.h"}
    assert {r.file for r in reads.where("unit = '/r/other.c'").collect()} == {"/r/other.c", "/r/second/both.h", "/r/q/only_quoted.h"}
