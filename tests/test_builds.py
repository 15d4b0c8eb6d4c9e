"""Builds that continue the last one: stable ids, places that stay, what is written."""

import pytest

from graphloom import schema
from graphloom.plans import builds, interchange, service


def _href(kind, **own):
    return {"kind": kind, "node_id": None, "sym_id": None, "path": None, "offset": None, "blob_id": None, "end": None} | own


def _token(offset, link=None, at=None, sym=None):
    place = None if at is None else {"line": 1, "column": 1, "offset": at}
    return {"offset": offset, "type": "Identifier", "href": link, "has_references": False, "sym_id": sym, "real_offset": None, "real_line": None, "uim_location": place, "uim_elided": None}


def _node(path, text, start=0, kind="Definition", tokens=()):
    return {"id": 0, "kind": kind, "path": f"/r/{path}", "container": None, "start": {"line": 1, "column": 1, "offset": start}, "text": text, "tokens": list(tokens), "member_of": None, "path_id": 0, "uim_reference_context": None, "uim_nest_level": None}


def _uni(path, offset):
    return _href("uni", path=f"/r/{path}", offset=offset)


def _build(spark, folder, build, nodes, before=None):
    found = interchange.index(spark.createDataFrame(nodes, schema.NODE), spark.createDataFrame([], schema.INDEX_ITEM), "/r", builds.ids(spark, folder, "repo", before))
    builds.write(found, folder, "repo", "main", build, before)
    return {(r.path, r.text): r for r in builds.nodes(spark, folder, "repo", build).collect()}


def test_second_build_keeps_ids_and_places(spark, tmp_path):
    folder = str(tmp_path)
    a = _node("m/a.c", "void a() { b(); }", tokens=[_token(11, _uni("m/b.c", 5), at=11)])
    b = _node("m/b.c", "void b() { }", tokens=[_token(5, sym=77)])
    one = _build(spark, folder, "b1", [a, b])
    # another file that sorts before both, an edit of b, and a new node in a's file
    edited = b | {"text": "void b() { 1; }"}
    extra = _node("m/a.c", "int x;", 40)
    two = _build(spark, folder, "b2", [_node("a/first.c", "x"), a, extra, edited], "b1")
    ids = lambda rows: {(p, t.split("(")[0]): r.id for (p, t), r in rows.items()}
    assert ids(one).items() <= ids(two).items()
    assert len(set(ids(two).values())) == 4 and min(r.id for k, r in two.items() if k[0] == "a/first.c") > max(ids(one).values())
    assert two["m/a.c", a["text"]].written == "b1" and one["m/a.c", a["text"]].sha256 == two["m/a.c", a["text"]].sha256
    assert {k[1]: r.written for k, r in two.items()} == {"x": "b2", a["text"]: "b1", "int x;": "b2", edited["text"]: "b2"}
    # links lead to the same nodes, and the set of b's references is not stored twice
    assert two["m/a.c", a["text"]].tokens[0].href.node_id == two["m/b.c", edited["text"]].id
    refs = builds.references(spark, folder, "repo", "b2").collect()
    assert [(r.node_id, r.offset, r.written) for r in refs] == [(two["m/b.c", edited["text"]].id, 5, "b1")]
    assert spark.read.parquet(f"{folder}/repo/slices/written=b2").count() == 0
    # a build without b, then one with it again: the id comes back
    three = _build(spark, folder, "b3", [a], "b2")
    four = _build(spark, folder, "b4", [a, b], "b3")
    assert len(three) == 1 and four["m/b.c", b["text"]].id == one["m/b.c", b["text"]].id and four["m/b.c", b["text"]].written == "b4"
    status = {r.node_id: r.status for r in builds.changes(spark, folder, "repo", "b1", "b2").collect()}
    assert sorted(status.values()) == ["added", "added", "reused", "rewritten"]
    assert builds.unused(spark, folder, "repo", ["b4"]) == ["b2", "b3"] or "b2" in builds.unused(spark, folder, "repo", ["b4"])
    with pytest.raises(ValueError, match="there already"):
        _build(spark, folder, "b4", [a])
    with pytest.raises(ValueError, match="no build"):
        builds.nodes(spark, folder, "repo", "b9")


def test_service_continues_and_resolves_symbols(spark, tmp_path):
    state = {"nodes": [_node("a.c", "void a() { }", tokens=[_token(5, sym=9)]), _node("b.c", "b", tokens=[_token(0, _href("sym", sym_id=9), sym=9)])]}
    service.LANGUAGES["changing"] = lambda s, root: (s.createDataFrame(state["nodes"], schema.NODE), s.createDataFrame([], schema.INDEX_ITEM))
    api = service.Service(spark, str(tmp_path))
    assert builds.latest(spark, str(tmp_path), "repo") is None
    api.index("repo", "a~b", "b1", "", "changing", "/r")
    state["nodes"].insert(0, _node("a.b", "new"))
    api.index("repo", "a~b", "b2", "", "changing", "/r")
    urls = spark.createDataFrame([("sym:9",), ("sym:8",), ("slice:f/1[0:2]",)], "url string")
    for build in ("b1", "b2"):
        got = {r.url: (r.status, r.node_id) for r in api.resolve("repo", build, urls).collect()}
        node = next(r.id for r in builds.nodes(spark, str(tmp_path), "repo", build).collect() if r.path == "a.c")
        assert got == {"sym:9": ("ok", node), "sym:8": ("not found", None), "slice:f/1[0:2]": ("unsupported", None)}
    assert [r.build_id for r in api.builds("repo", "a~b").collect()] == ["b2", "b1"]


def test_empty_builds(spark, tmp_path):
    assert _build(spark, str(tmp_path), "b1", []) == {}
    assert len(_build(spark, str(tmp_path), "b2", [_node("x", "y")], "b1")) == 1
    assert _build(spark, str(tmp_path), "b3", [], "b2") == {}


def test_texts_are_written_once(spark, tmp_path, monkeypatch):
    made, put = [], builds.Tables.put
    monkeypatch.setattr(builds.Tables, "put", lambda self, name, df: made.append((name, df.columns)) or put(self, name, df))
    nodes = [_node("a.c", None, kind="SourceFile"), _node("a.c", "int é;\n", 0), _node("a.c", "", 9), _node("b.c", "x" * 99_999, kind="SourceFile"), _node("b.c", "x" * 99_999)]
    got = _build(spark, str(tmp_path), "b1", nodes)
    assert made and not [name for name, columns in made if "text" in columns]
    assert set(got) == {(n["path"][3:], n["text"]) for n in nodes}
    again = _build(spark, str(tmp_path), "b2", [*nodes[:1], nodes[1] | {"text": "int ö;\n"}, *nodes[2:]], "b1")
    assert {(k, r.written) for k, r in again.items()} == {(k, "b1") for k in got if k[1] != "int é;\n"} | {(("a.c", "int ö;\n"), "b2")}


def test_nodes_of_a_place_given_twice_stay_apart(spark):
    nodes = [_node("a.c", "one"), _node("a.c", "two")]
    found = interchange.index(spark.createDataFrame(nodes, schema.NODE), spark.createDataFrame([], schema.INDEX_ITEM), "/r")
    assert {r.text for r in found["nodes"].collect()} == {"one", "two"} and found["nodes"].count() == 2


def test_resolve_moves_content_once(spark, tmp_path):
    service.LANGUAGES["some"] = lambda s, root: (s.createDataFrame([_node("a.c", "void a() { }", tokens=[_token(5, sym=9)]), _node("b.c", "a()", tokens=[_token(0, _uni("a.c", 5), at=0)])], schema.NODE), s.createDataFrame([], schema.INDEX_ITEM))
    api = service.Service(spark, str(tmp_path))
    api.index("repo", "m", "b1", "", "some", "/r")
    a = next(r.id for r in builds.nodes(spark, str(tmp_path), "repo", "b1").collect() if r.path == "a.c")
    urls = [f"id:{a}", f"id:{a}", "id:999", "path:none", "what", "sym:9", "sym:1", f"refs:{a}/5", f"refs:{a}/6", "slice:f/1[0:2]"]
    out = api.resolve("repo", "b1", spark.createDataFrame([(u,) for u in urls], "url string"))
    got = {r.url: (r.status, r.node_id, r.content is not None) for r in out.collect()}
    ok, lost = ("ok", a, True), ("not found", None, False)
    assert got == {f"id:{a}": ok, "id:999": lost, "path:none": lost, "what": ("bad url", None, False), "sym:9": ok, "sym:1": lost, f"refs:{a}/5": ok, f"refs:{a}/6": lost, "slice:f/1[0:2]": ("unsupported", None, False)} and out.count() == 9
    top = out._jdf.queryExecution().optimizedPlan().toString().split("\n", 1)[0]
    assert top.startswith("Union")  # no join over contents
