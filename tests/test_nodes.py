"""Cutting of files, the JSON form of nodes, and the catalog of stored builds."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import cutting, nodejson, resolve, search, store, tokens
from graphloom.plans import interchange, service
from graphloom.sources import uim

CURSORS = "id long, path_id long, parent long, kind string, name string, is_definition boolean, start long, end long"
TOKENS = "path_id long, off long, end long, tok string, type string, cursor long"

# namespace { class C { int x; void m() {..} void d(); C() {..} } ; struct-and-variable, overlapping } #include
FILE_CURSORS = [
    (1, 7, None, "Namespace", "n", True, 0, 200),
    (2, 7, 1, "ClassDecl", "C", True, 10, 100),
    (3, 7, 2, "FieldDecl", "x", True, 20, 25),
    (4, 7, 2, "Method", "m", True, 30, 50),
    (5, 7, 4, "DeclRefExpr", None, False, 35, 40),
    (6, 7, 2, "Method", "d", False, 55, 60),
    (7, 7, 2, "Constructor", "C", True, 60, 80),
    (8, 7, 1, "StructDecl", "S", True, 110, 130),
    (9, 7, 1, "VarDecl", "s", True, 110, 140),
    (10, 7, 1, "FunctionDecl", "f", True, 140, 150),
    (11, 8, None, "MacroExpansion", "M", False, 0, 9),
]
FILE_TOKENS = [(7, off, off + 5, f"t{off}", "Identifier", cur) for off, cur in [(0, 1), (10, 2), (20, 3), (30, 4), (35, 5), (45, 4), (55, 6), (60, 7), (70, 7), (90, 2), (100, None), (110, 8), (120, 8), (135, 9), (140, 10), (145, 10), (190, 1)]]
FILE_TOKENS += [(7, 160, 165, "t160", "Identifier", 11), (9, 0, 4, "mov", "Identifier", 1)]


def test_cutting(spark):
    toks, cursors = spark.createDataFrame(FILE_TOKENS, TOKENS), spark.createDataFrame(FILE_CURSORS, CURSORS)
    cut = cutting.blocks(toks, cursors, toks.where("path_id = 9"))
    rows = cut.collect()
    ids = {(r.path_id, r.nest_level, r.start): r.node_id for r in rows}
    of = {v: k for k, v in ids.items()}
    got = {(r.path_id, r.nest_level, r.start, r.end, r.cursor, r.kind, r.member_of, of.get(r.outer_id)) for r in rows}
    assert got == {
        (7, 0, 0, 195, None, "SourceFile", None, None),
        (7, 1, 10, 100, 2, "Class", None, (7, 0, 0)),
        (7, 1, 110, 140, 9, "Definition", None, (7, 0, 0)),
        (7, 1, 140, 150, 10, "Definition", None, (7, 0, 0)),
        (7, 1, 160, 165, 11, "Definition", None, (7, 0, 0)),
        (7, 2, 30, 50, 4, "Definition", "C", (7, 1, 10)),
        (7, 2, 60, 80, 7, "Definition", "C", (7, 1, 10)),
        (9, 0, 0, 4, None, "SourceFile", None, None),
    }
    text = {}
    for r in cutting.block_tokens(toks, cut).orderBy("node_id", "pos").collect():
        text.setdefault(of[r.node_id], []).append(r.tok if r.elides is None else of[r.elides])
    assert text == {
        (7, 0, 0): ["t0", (7, 1, 10), "t100", (7, 1, 110), (7, 1, 140), (7, 1, 160), "t190"],
        (7, 1, 10): ["t10", "t20", (7, 2, 30), "t55", (7, 2, 60), "t90"],
        (7, 1, 110): ["t110", "t120", "t135"], (7, 1, 140): ["t140", "t145"], (7, 1, 160): ["t160"],
        (7, 2, 30): ["t30", "t35", "t45"], (7, 2, 60): ["t60", "t70"], (9, 0, 0): ["mov"],
    }
    short = cutting.block_tokens(toks, cut, 2).where(F.col("node_id") == ids[7, 2, 30]).orderBy("pos").collect()
    assert [r.tok for r in short] == ["t30", "t35", "<TRUNCATED>"]
    assert cutting.blocks(toks.limit(0), cursors).count() == 0
    assert [r.a for r in spark.createDataFrame([("x.S",), ("x.c",), ("b.asm",)], "p string").select(cutting.is_assembly(F.col("p")).alias("a")).collect()] == [True, False, True]


def test_context_and_facts(spark):
    cols = "id long, semantic_parent long, name string, is_definition boolean, is_declaration boolean"
    rows = [(1, None, "n", True, True), (2, 1, "C", True, True), (3, 2, None, True, True), (4, 3, "m", False, True), (5, 4, "x", False, False), (6, 99, "o", True, True)]
    got = {r.id: r.context for r in cutting.definition_context(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: ["n"], 2: ["C", "n"], 3: ["C", "n"], 4: ["m", "C", "n"], 5: ["m", "C", "n"], 6: ["o"]}
    with pytest.raises(ValueError):
        cutting.definition_context(spark.createDataFrame([(1, 2, "a", True, True), (2, 1, "b", True, True)], cols))

    cols = "id long, kind string, usr string, is_definition boolean, reference long, definition long, path string, start long"
    rows = [(1, "FunctionDecl", "u1", True, None, None, "a.c", 5), (2, "DeclRefExpr", None, False, 1, None, "b.c", 9), (3, "TypeRef", None, False, 1, 4, "b.c", 10), (4, "StructDecl", "u4", True, None, None, "s.h", 3), (5, "DeclRefExpr", None, False, 6, None, "b.c", 11), (6, "Namespace", "u6", True, None, None, "n.h", 0), (7, "Method", "u7", False, 1, None, "b.c", 12)]
    known = cutting.facts(spark.createDataFrame(rows, cols))
    assert {r.id: (r.usr, r.local_path, r.local_offset) for r in known.collect()} == {1: ("u1", None, None), 2: ("u1", "a.c", 5), 3: ("u1", "s.h", 3), 4: ("u4", None, None), 5: ("u6", None, None), 6: ("u6", None, None), 7: ("u7", None, None)}
    toks = spark.createDataFrame([(0, 2), (1, None)], "off long, cursor long")
    assert {r.off: r.sem and r.sem.usr for r in cutting.with_facts(toks, known).collect()} == {0: "u1", 1: None}
    with pytest.raises(Exception, match="no facts of cursor 77"):
        cutting.with_facts(spark.createDataFrame([(0, 77)], "off long, cursor long"), known).collect()


def _href(kind, **own):
    return {"kind": kind, "node_id": None, "sym_id": None, "path": None, "offset": None, "blob_id": None, "end": None} | own


def _token(offset, link=None, real=None, line=None, **own):
    return {"offset": offset, "type": "Identifier", "href": link, "has_references": False, "sym_id": None, "real_offset": real, "real_line": line, "uim_location": None, "uim_elided": None} | own


def _node(id_, path, text, toks, **own):
    return {"id": id_, "kind": "Class", "path": path, "container": 3, "start": {"line": 4, "column": 2, "offset": 50}, "text": text, "tokens": toks, "member_of": None, "path_id": 1, "uim_reference_context": None, "uim_nest_level": None} | own


def test_node_json(spark):
    toks = [_token(0, _href("token", node_id=9, offset=7)), _token(3, _href("id", node_id=8), sym_id=5), _token(5, real=90, line=9, has_references=True), _token(6, _href("path", path="a/b"))]
    rows = [_node(1, "p", "é\nab x", toks), _node(2, "q", "", [], container=None, kind="SourceFile")]
    nodes = spark.createDataFrame(rows, schema.NODE)
    text = {r.id: json.loads(r.json) for r in nodejson.encode(nodes).collect()}
    assert [text[1][k] for k in ("id", "container", "kind", "path", "path_id", "member_of", "references")] == ["id:1", "id:3", "class", "p", 1, None, None]
    assert text[1]["start"] == {"line": 4, "col": 2, "off": 50} and (text[2]["kind"], text[2]["container"], text[2]["text"]) == ("fullsourcefile", None, [])
    keys = ("id", "t", "T", "N", "h", "ht", "s", "r")
    assert [tuple(t[k] for k in keys) for t in text[1]["text"]] == [
        ("tok-50", "é\n", "Identifier", 4, "id:9", "tok-7", None, None), ("tok-53", "ab", "Identifier", 5, "id:8", None, "sym:5", None),
        ("tok-90", " ", "Identifier", 9, None, None, None, "refs:1/90"), ("tok-91", "x", "Identifier", 9, "path:a/b", None, None, None),
    ]
    again = nodejson.decode(nodejson.encode(nodes))
    assert {r.id: r for r in again.collect()} == {r.id: r for r in nodes.select(again.columns).collect()}
    with pytest.raises(Exception, match="no id: id"):
        nodejson.decode(spark.createDataFrame([('{"id":"x:1"}',)], "json string")).collect()


def test_service(spark, tmp_path):
    nodes = [_node(0, "/r/a.py", "def f", [_token(0, _href("uni", path="/r/b.py", offset=0), uim_location={"line": 1, "column": 1, "offset": 50})], kind="Definition", container=None), _node(0, "/r/b.py", "g", [], kind="SourceFile", container=None, start=None)]
    items = [{"key": "fun", "href": _href("uni", path="/r/a.py", offset=50), "kind": "Symbol", "path": "/r/a.py", "type": None}]
    service.LANGUAGES["test"] = lambda s, root: (s.createDataFrame(nodes, schema.NODE), s.createDataFrame(items, schema.INDEX_ITEM))
    api = service.Service(spark, str(tmp_path / "store"))
    api.index("repo", "feature/x", "b1", "", "test", "/r")
    api.index("repo", "feature/x", "b2", "", "test", "/r")
    assert [(r.id, r.public) for r in api.repos().collect()] == [("repo", True)] and [r.id for r in api.branches("repo").collect()] == ["feature~x"]
    assert [r.build_id for r in api.builds("repo", "feature~x").collect()] == ["b2", "b1"] and api.build("repo", "feature~x", "b1").first().status == "Ready"
    urls = ["path:a.py", "path:", "path:b.py#token-3", "id:999", "sym:1", "what"]
    got = {r.url: r for r in api.resolve("repo", "b1", spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert {u: got[u].status for u in urls} == {"path:a.py": "not found", "path:": "not found", "path:b.py#token-3": "ok", "id:999": "not found", "sym:1": "not found", "what": "bad url"}
    target = json.loads(got["path:b.py#token-3"].content)
    assert target["text"] == [] and target["path"] == "b.py"
    found = api.search("repo", "b1", "fu").first()
    back = api.resolve("repo", "b1", spark.createDataFrame([(f"id:{found.node_id}",), (f"refs:{target['id'][3:]}/0",)], "url string")).collect()
    assert sorted(r.status for r in back) == ["ok", "ok"] and "def f" in [t["t"] for r in back for t in json.loads(r.content).get("text", [])]
    with pytest.raises(ValueError):
        api.search("../x", "b1", "f")
    repos = spark.createDataFrame([("b", True, "me", "b"), ("a", False, "me", "a"), ("a2", True, "you", "a2")], "id string, public boolean, owner string, name string")
    assert [r.id for r in service.repo_order(repos).collect()] == ["a2", "b", "a"]
    assert {r.id for r in service.select_repos(repos, spark.createDataFrame([("a",), ("a2",)], "repo_id string"), "me").collect()} == {"a"}


def test_small_operators(spark, tmp_path):
    f = tmp_path / "nodes.uim"
    one = {"id": 5, "kind": "File", "path": "p", "text": "x"}
    f.write_bytes(uim.encode_node(one) + uim.encode_node(one | {"id": 6}) + uim.encode_node(one | {"text": "later"}))
    got = {r.url: (r.status, r.start is not None) for r in resolve.resolve_blob(spark.createDataFrame([("id:5",), ("id:7",), ("path:p",), ("?",)], "url string"), uim.read(spark, str(f))).collect()}
    assert got == {"id:5": ("ok", True), "id:7": ("not found", False), "path:p": ("unsupported", False), "?": ("bad url", False)}
    runs = store.file_runs(spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, None), (1, 4, None), (1, 5, 5), (2, 1, 5)], "unit long, n long, path_id long"), "unit", "n")
    assert {(r.unit, r.n): r.run for r in runs.collect()} == {(1, 1): 0, (1, 2): 0, (1, 3): 1, (1, 4): 1, (1, 5): 2, (2, 1): 0}
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, path string")
    assert {(r.id, r.path_id) for r in store.with_path_ids(df, spark.createDataFrame([("a", 9)], "path string, path_id long")).collect()} == {(1, 9), (2, None)}
    assert {(r.path, r.already_processed) for r in store.split_processed(df.where("path is not null").unionByName(df.where("id = 1")), df.select("path")).collect()} == {("a", True)}
    for mode, place in (("memory", "kept_rows"), ("json", str(tmp_path / "j")), ("file", str(tmp_path / "p"))):
        store.write_table(df, place, mode)
        assert {tuple(r) for r in store.read_table(spark, place, mode, df.schema).collect()} == {(1, "a"), (2, None)}
    words = search.dictionary(df, "path")
    assert [tuple(r) for r in search.decode_ids(spark.createDataFrame([(0,), (4,)], "path_no long"), words, "path_no", "path").orderBy("path_no").collect()] == [(0, "a"), (4, None)]
    assert search.prefixed(df, "a", "path").count() == 1
    mapped = tokens.map_tokens(spark.createDataFrame([([{"t": 1}, {"t": 2}],)], "tokens array<struct<t:int>>"), lambda t: t["t"] + 1)
    assert mapped.first().tokens == [2, 3]
    toks = spark.createDataFrame([(0, 3), (3, 5), (5, 9)], "off long, end long")
    assert [r.off for r in tokens.in_range(toks, F.lit(2), F.lit(5)).collect()] == [3]
