"""Claims and pending units over several micro-batches and restarts."""

import time

import pytest
from graphloom.streaming import state


class Feed:
    """A folder of Parquet files, one a micro-batch, and a query that is stopped after each."""

    def __init__(self, spark, root, operator):
        self.spark, self.root, self.operator = spark, root, operator

    def send(self, rows, wanted=None):
        """What comes out after a file more; with ``wanted`` the query runs on until so many rows have come."""
        self.spark.createDataFrame(rows, state.MESSAGE).coalesce(1).write.mode("append").parquet(f"{self.root}/in")
        before = set(map(tuple, self.rows()))
        source = self.spark.readStream.schema(state.MESSAGE).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/in")
        writer = self.operator(source).writeStream.format("parquet").option("checkpointLocation", f"{self.root}/ck")
        if wanted is None:
            q = writer.trigger(availableNow=True).start(f"{self.root}/out")
            assert q.awaitTermination(60)
        else:
            q = writer.trigger(processingTime="200 milliseconds").start(f"{self.root}/out")
            for _ in range(100):
                if not q.isActive or len(set(map(tuple, self.rows())) - before) >= wanted:
                    break
                time.sleep(0.3)
            q.stop()
        assert q.exception() is None
        return set(map(tuple, self.rows())) - before

    def rows(self):
        try:
            return self.spark.read.parquet(f"{self.root}/out").collect()
        except Exception:
            return []


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _block(unit, seq, path):
    return (unit, seq, "block", path, f"{path}@{unit}.{seq}")


def _end(unit):
    return (unit, None, "end", None, None)


def test_units_are_held_until_they_end(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), state.whole_units)
    assert feed.send([_block(1, 2, "b"), _block(2, 1, "x"), _block(1, 1, "a")]) == set()
    # a restarted query still has the blocks of both units
    got = feed.send([_end(1), _block(2, 2, "y"), _block(1, 3, "c")])
    assert [(r[0], r[1], r[2], r[4]) for r in sorted(got)] == [(1, 1, "a", "ended"), (1, 2, "b", "ended"), (1, 3, "c", "ended")]
    got = feed.send([_end(2), _end(3), _block(1, 9, "z"), _end(1)])
    assert [(r[0], r[1], r[2], r[4]) for r in sorted(got)] == [(1, 9, "z", "late"), (2, 1, "x", "ended"), (2, 2, "y", "ended")]


def test_lost_units_are_given_up(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), lambda m: state.whole_units(m, patience_ms=1500))
    got = feed.send([_block(1, 1, "a"), _block(2, 1, "b"), _block(3, 1, "c"), _end(3)], wanted=3)
    assert {(r[0], r[2], r[4]) for r in got} == {(3, "c", "ended"), (1, "a", "lost"), (2, "b", "lost")}
    got = feed.send([_block(1, 2, "d"), _end(2), _block(4, 1, "e")], wanted=2)  # a restart
    assert {(r[0], r[2], r[4]) for r in got} == {(1, "d", "late"), (4, "e", "lost")}


def test_a_file_is_claimed_once_over_batches(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), state.claim_files)
    got = feed.send([_block(7, 1, "h"), _block(5, 1, "h"), _block(7, 2, "a"), _end(7), _block(5, 2, None)])
    assert {(r[0], r[2], r[3]) for r in got} == {(5, "block", "h"), (7, "block", "a"), (7, "end", None), (5, "block", None)}
    # later batches and restarts keep the claim, also against a lesser unit
    got = feed.send([_block(1, 1, "h"), _block(5, 3, "h"), _block(1, 2, "n"), _end(1)])
    assert {(r[0], r[1], r[3]) for r in got} == {(5, 3, "h"), (1, 2, "n"), (1, None, None)}
