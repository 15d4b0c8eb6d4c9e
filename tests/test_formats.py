"""Data sources for interchange files and for JSON documents without delimiters."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.schema import NODE_KINDS
from graphloom.sources import formats, uim


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    formats.register(spark)


def _nodes(n, seed=1):
    rng = random.Random(seed)
    return [{"id": i, "kind": NODE_KINDS[i % 6], "path": f"d{i % 3}/f{i}.c", "container": i // 2, "text": "é" * rng.choice([0, 3, 200, 5000]), "tokens": [{"offset": 2 * j, "type": "Identifier"} for j in range(i % 5)]} for i in range(1, n + 1)]


def test_uim_in_many_tasks_equals_decode(spark, tmp_path, monkeypatch):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.uim").write_bytes(b"".join(map(uim.encode_node, _nodes(300))))
    (tmp_path / "sub" / "b.uim").write_bytes(b"".join(map(uim.encode_node, _nodes(40, 2))))
    (tmp_path / "_SUCCESS").write_bytes(b"no records")
    (tmp_path / "empty.uim").write_bytes(b"")
    whole = uim.decode(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.uim").load(str(tmp_path)), "nodes")
    df = spark.read.format("uim").option("partitionBytes", "50000").load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 10
    assert df.schema == whole.schema
    assert sorted(map(str, df.collect())) == sorted(map(str, whole.collect()))


def test_uim_chunks_and_records_of_any_length(tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "CHUNK", 37)
    data = b"".join(map(uim.encode_node, _nodes(60)))
    (tmp_path / "a.uim").write_bytes(data)
    for most in (1, 500, 10**9):
        reader = formats.UimReader(str(tmp_path / "a.uim"), "nodes", uim.full_schema("nodes"), most)
        parts = reader.partitions()
        assert [p.start for p in parts] == [0, *[p.end for p in parts[:-1]]] and parts[-1].end == len(data)
        got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert [(r["id"], r["record_offset"], r["text"]) for r in got] == [(n["id"], at, n["text"]) for n, (_, at, _) in zip(_nodes(60), uim.messages(data), strict=True)]
    (tmp_path / "a.uim").write_bytes(data[:-1])
    reader = formats.UimReader(str(tmp_path / "a.uim"), "nodes", uim.full_schema("nodes"), 10**9)
    with pytest.raises(ValueError):
        [list(reader.read(p)) for p in reader.partitions()]


def test_uim_columns_and_filters(spark, tmp_path):
    (tmp_path / "a.uim").write_bytes(b"".join(map(uim.encode_node, _nodes(100))))
    df = spark.read.format("uim").schema("path string, id long, kind string").load(str(tmp_path))
    assert df.columns == ["path", "id", "kind"]
    assert sorted(r.id for r in df.where("kind = 'File'").collect()) == [i for i in range(1, 101) if NODE_KINDS[i % 6] == "File"]
    assert [r.path for r in df.where(F.col("id").isin(5, 7, 1000) & (F.col("path") != "d1/f7.c")).collect()] == ["d2/f5.c"]
    assert df.where("kind = 'File' and id = 1").count() == 0
    reader = formats.UimReader("", "nodes", df.schema, 1)
    list(reader.pushFilters([formats.EqualTo(("kind",), "File"), formats.In(("id",), (2, 8))]))
    bodies = [body for body, _, _ in uim.messages(b"".join(map(uim.encode_node, _nodes(8))))]
    assert [uim.record(b, "nodes", {"id"}, reader.wanted, 0, 0) for b in (bodies[0], bodies[1], bodies[7])] == [[], [{"id": 2}], [{"id": 8}]]
    with pytest.raises(Exception, match="nodes or items"):
        spark.read.format("uim").option("kind", "x").load(str(tmp_path)).collect()


DOCS = [{"a": 1}, {"a": {"b": [1, {"c": "}{][\\\" é"}]}}, [], {}, [[["x"]]], {"\\": "\\\\", "q\"": "]"}]


@pytest.mark.parametrize("between", ["", "\n", " ,\t"])
def test_documents_in_chunks(between):
    data = between.join(json.dumps(d, ensure_ascii=False) for d in DOCS * 3).encode()
    for size in (1, 2, 3, 7, 1000):
        docs = formats.Documents()
        got = [json.loads(x) for at in range(0, len(data), size) for x in docs.feed(data[at : at + size])]
        docs.end()
        assert got == DOCS * 3
    for bad in (b"{}}", b"{} x", b"7{}", b'"a'):
        with pytest.raises(ValueError):
            list(formats.Documents().feed(bad))
    cut = formats.Documents()
    list(cut.feed(b'{"a": "}'))
    with pytest.raises(ValueError):
        cut.end()


def test_json_round_trip_append_overwrite(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(i, f'say "{{{i}" \\ é\n', [i, None], None) for i in range(50)], "id long, text string, xs array<int>, none string").repartition(4)
    df.write.format("jsondocs").mode("append").save(path)
    assert sorted(json.loads(r.value)["id"] for r in spark.read.format("jsondocs").load(path).collect()) == list(range(50))
    back = spark.read.format("jsondocs").load(path).select(F.from_json("value", df.schema).alias("r")).select("r.*")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    df.limit(0).write.format("jsondocs").mode("append").save(path)
    df.where("id < 3").write.format("jsondocs").mode("append").save(path)
    assert spark.read.format("jsondocs").load(path).count() == 53
    df.where("id < 3").write.format("jsondocs").mode("overwrite").save(path)
    assert spark.read.format("jsondocs").load(path).count() == 3
    assert sorted(p.suffix for p in (tmp_path / "out").iterdir()) == [".json"] * len(list((tmp_path / "out").iterdir()))


def test_aborted_write_leaves_nothing(spark, tmp_path):
    path = tmp_path / "out"
    ok = spark.createDataFrame([(1,)], "id long")
    ok.write.format("jsondocs").mode("append").save(str(path))
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("jsondocs").mode("append").save(str(path))
    assert spark.read.format("jsondocs").load(str(path)).count() == 1
    assert len(list(path.rglob("*"))) == 1
