"""State of scanned units on a stream: who claims a file, and what a unit holds back until it ends.

Scanners send rows ``unit, seq, kind, path, body``: any number of ``block`` rows
and one ``end`` row a unit, in any order between units and over any number of
micro-batches. Both operators keep their state in Spark's state store, keyed and
checkpointed, so a restarted query goes on where the last one ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: State of this kind lives in RocksDB.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MESSAGE = StructType().add("unit", "long").add("seq", "long").add("kind", "string").add("path", "string").add("body", "string")


def _session(messages: DataFrame) -> None:
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Claims(StatefulProcessor):
    """One path: the unit that claimed it, for good."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owner = handle.getValueState("owner", "unit long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had = self.owner.get()
        owner, kept = (had[0] if had else None), []
        for batch in rows:
            # Within a micro-batch the least unit claims, whatever the order of its rows; others' rows go at the end.
            least = int(batch["unit"].min())
            if had is None and (owner is None or least < owner):
                owner = least
            kept.append(batch)
        if had is None and owner is not None:
            self.owner.update((owner,))
        for batch in kept:
            own = batch[batch["unit"] == owner]
            if len(own):
                yield own[MESSAGE.names]

    def close(self) -> None:
        pass


def claim_files(messages: DataFrame) -> DataFrame:
    """Messages without the blocks of files that another unit has claimed.

    A file belongs to the least unit of the first micro-batch that has blocks of
    it, in all later micro-batches too. ``end`` rows and blocks without a path
    pass. The state is one number a file.
    """
    _session(messages)
    picked = messages.select(*MESSAGE.names)
    held = picked.where((F.col("kind") == "block") & F.col("path").isNotNull()).groupBy("path").transformWithStateInPandas(_Claims(), MESSAGE, "Append", "None")
    return held.unionByName(picked.where((F.col("kind") != "block") | F.col("path").isNull()))


FLUSHED = StructType().add("unit", "long").add("seq", "long").add("path", "string").add("body", "string").add("status", "string")


class _Units(StatefulProcessor):
    """One unit: its pending blocks, whether it has ended, and the timer that gives it up."""

    def __init__(self, patience_ms: int, memory_ms: int) -> None:
        self.patience, self.memory = patience_ms, memory_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "seq long, path string, body string")
        self.due = handle.getValueState("due", "at long")
        self.closed = handle.getValueState("closed", "status string", self.memory or None)

    def _flushed(self, unit, status: str, rows: list[tuple]) -> pd.DataFrame:
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or ""))
        return pd.DataFrame([(unit, *r, status) for r in rows], columns=FLUSHED.names).astype({"seq": "Int64"})

    def _give_up_timer(self) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        blocks, ended = [], False
        for batch in rows:
            ended = ended or bool((batch["kind"] == "end").any())
            held = batch[batch["kind"] == "block"]
            blocks += [(None if pd.isna(s) else int(s), p, b) for s, p, b in zip(held["seq"], held["path"], held["body"], strict=True)]
        if self.closed.exists():
            if blocks:
                yield self._flushed(key[0], "late", blocks)
        elif ended:
            yield self._flushed(key[0], "ended", [*map(tuple, self.pending.get()), *blocks])
            self.pending.clear()
            self._give_up_timer()
            self.closed.update(("ended",))
        elif blocks:
            self.pending.appendList(blocks)
            if self.patience:
                self._give_up_timer()
                at = timerValues.getCurrentProcessingTimeInMs() + self.patience
                self.handle.registerTimer(at)
                self.due.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = [tuple(r) for r in self.pending.get()]
        self.pending.clear()
        self.due.clear()
        self.closed.update(("lost",))
        if rows:
            yield self._flushed(key[0], "lost", rows)

    def close(self) -> None:
        pass


def whole_units(messages: DataFrame, patience_ms: int = 0, memory_ms: int = 0) -> DataFrame:
    """``unit, seq, path, body, status``: the blocks of each unit together, once its ``end`` is there.

    Status is ``ended``; ``lost`` for the blocks of a unit from which nothing
    came for ``patience_ms`` of processing time (0: wait for ever), which closes
    it; ``late`` for blocks that come after their unit was closed. A closed unit
    is remembered for ``memory_ms`` (0: for ever). A unit that ends without
    blocks gives no rows; a second end changes nothing. Blocks are sorted by
    ``seq``, null ones last. With patience or memory the query looks at the
    clock in each micro-batch, so it wants a processing-time trigger; an
    available-now run of it would not end.
    """
    _session(messages)
    keyed = messages.select(*MESSAGE.names).where(F.col("unit").isNotNull()).groupBy("unit")
    return keyed.transformWithStateInPandas(_Units(patience_ms, memory_ms), FLUSHED, "Append", "ProcessingTime" if patience_ms or memory_ms else "None")
