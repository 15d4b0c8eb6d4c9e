"""Small operators that no query names: files read once, capped entries, line differences, cursor hashes."""

from pyspark.sql import functions as F

from graphloom.operators import align, symbols, tree
from graphloom.sources import files


def test_each_file_goes_to_its_first_unit(spark):
    rows = [("a.h", 7), ("a.h", 3), ("b.h", 3), ("b.h", 3), ("c.h", None), ("c.h", 9), (None, 4), ("d.h", None)]
    got = {(r.file, r.unit) for r in files.once_per_file(spark.createDataFrame(rows, "file string, unit long")).collect()}
    assert got == {("a.h", 3), ("b.h", 3), ("c.h", 9), (None, 4), ("d.h", None)}


def test_entries_stop_at_their_cap(spark):
    rows = [(n, p, f"t{p}") for n, size in ((1, 9), (2, 7), (3, 2), (None, 8)) for p in range(size)]
    tokens = spark.createDataFrame(rows, "node_id long, pos long, tok string").repartition(4)
    got = sorted((r.node_id or 0, r.pos, r.tok) for r in tree.truncate_entries(tokens, 7).collect())
    assert got == sorted((n or 0, p, t) for n, p, t in rows if p < 7)
    assert tree.truncate_entries(tokens.where("false"), 7).count() == 0


def test_line_differences(spark):
    rows = [(1, "a\nb\nc", "a\nx\nc"), (2, "same", "same"), (3, None, "new"), (4, "gone", None), (5, None, None)]
    got = {r.id: r.diff for r in align.line_diffs(spark.createDataFrame(rows, "id long, before string, after string")).collect()}
    assert got[1].split("\n")[2:] == ["@@ -1,3 +1,3 @@", " a", "-b", "+x", " c"]
    assert got[2] == got[5] == ""
    assert got[3].split("\n")[3:] == ["-", "+new"] and got[4].split("\n")[3:] == ["-gone", "+"]


def test_cursor_hash_tells_parts_apart(spark):
    rows = [("f", 1, 2), ("f", 2, 1), ("g", 1, 2), ("f", 1, 2), (None, 1, 2)]
    hashed = spark.createDataFrame(rows, "path string, start long, end long").withColumn("h", symbols.cursor_identity(F.col("path"), F.col("start"), F.col("end")))
    by = {}
    for r in hashed.collect():
        by.setdefault(r.h, set()).add((r.path, r.start, r.end))
    assert len(by) == 4 and all(len(v) == 1 for v in by.values())
