"""Benchmark decontamination by greedy string tiling.

Words (letters, digits and anything beyond ASCII, A-Z lower-cased) of each
document and each benchmark item are hashed in running windows (Karp-Rabin).
Windows that both have are shared seeds, confirmed word by word. Seeds that
follow one another on a diagonal are one match, and only its first and last
seed are looked up, so a repeated word costs its matches and not its seeds. For
each pair of document and item the longest match is marked as a tile, again and
again, tokens being marked once at most, so that passages in another order are
all counted. A document is contaminated when tiles cover enough of an item.

The benchmark is a stated query set: it is sent to the tasks in blocks of a
bounded number of words, and every document meets every block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.llm import blocks as B
from graphloom.runtime import prepare

MIN_MATCH = 5
COVERAGE = 0.5
BLOCK_WORDS = 2_000_000
#: Neighbours of the first and last word of a text, and of an item: equal to no word's hash but by chance, and not to each other.
_TEXT_END, _ITEM_END = B.U(0x6A09E667F3BCC908), B.U(0xBB67AE8584CAA73B)


def _beside(w: B.Words, at: np.ndarray, k: int, end: B.U) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words before and after each window of ``k`` words."""
    last = w.first[w.doc[at] + 1]
    padded = np.append(w.hash, end)
    before = np.where(at > w.first[w.doc[at]], padded[at - 1], end)
    after = np.where(at + k < last, padded[np.minimum(at + k, len(w.hash))], end)
    return before, after


class Windows:
    """All windows of ``k`` words of some items, sorted by hash and the word before, and again by the word after."""

    def __init__(self, k: int, parts: list[tuple[np.ndarray, ...]]):
        self.k = k
        h, item, place, before, after = (np.concatenate(c) for c in zip(*parts, strict=True))
        self.sides = []
        for beside in (before, after):
            order = np.lexsort((place, item, beside, h))
            self.sides.append((h[order], beside[order], item[order], place[order]))
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[h & B.U((1 << 20) - 1)] = True

    def ends(self, side: int, h: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For windows of texts, the items' equal windows beside which another word stands: index of the window, item, place."""
        hashes, own, item, place = self.sides[side]
        lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        found = np.flatnonzero(hi > lo)
        lo, hi, beside = lo[found], hi[found], beside[found]
        # within a hash's entries those with the same word beside are together
        same_lo, same_hi = _search_within(own, lo, hi, beside, "left"), _search_within(own, lo, hi, beside, "right")
        times = (hi - lo) - (same_hi - same_lo)
        at = np.repeat(found, times)
        step = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        lo, same_lo, same_hi = (np.repeat(x, times) for x in (lo, same_lo, same_hi))
        entry = lo + step
        entry += np.where(entry >= same_lo, same_hi - same_lo, 0)
        return at, item[entry], place[entry]


def _search_within(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, side: str) -> np.ndarray:
    """``searchsorted`` of each wanted key in its own sorted stretch of ``keys``, by halves for all at once."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        at = keys[np.minimum(mid, len(keys) - 1)]
        right = open_ & ((at < wanted) if side == "left" else (at <= wanted))
        lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)


class Items:
    """A block of benchmark items, their words and windows.

    Items of fewer than ``k`` words have one window, of all their words, and
    match as a whole.
    """

    def __init__(self, ids: list, texts: list[str | None], k: int):
        self.k, self.ids, self.sizes = k, ids, np.zeros(len(ids), np.int64)
        words: list[np.ndarray] = []
        parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for block in B.blocks(pa.array(texts, pa.string())):
            w = B.words(block, inside=B.ALNUM, fold=B.FOLD)
            size = np.diff(w.first)
            self.sizes[block.row : block.row + block.n] = size
            words += [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
            for m in range(1, k + 1):
                at, h = B.windows(w, m)
                some = size[w.doc[at]] == m if m < k else np.ones(len(at), bool)
                if some.any():
                    at, h = at[some], h[some]
                    doc = w.doc[at]
                    parts.setdefault(m, []).append((h, doc + block.row, at - w.first[doc], *_beside(w, at, m, _ITEM_END)))
        self.windows = [Windows(m, p) for m, p in parts.items()]
        self.flat = np.concatenate([np.zeros(0, B.U), *words])
        self.begin = np.cumsum(np.append(0, self.sizes))


def matches(w: B.Words, items: Items) -> np.ndarray:
    """Every maximal match of at least a window: rows of text, item, place in the text, place in the item, words."""
    out = []
    for held in items.windows:
        k = held.k
        at, h = B.windows(w, k)
        maybe = held.bitmap[h & B.U(len(held.bitmap) - 1)]
        at, h = at[maybe], h[maybe]
        if not len(at):
            continue
        sides = []
        for side, beside in enumerate(_beside(w, at, k, _TEXT_END)):
            index, item, place = held.ends(side, h, beside)
            own = at[index]
            doc = w.doc[own]
            rows = np.stack([doc, item, own - w.first[doc], place], axis=1)
            sides.append(rows[np.lexsort((rows[:, 2], rows[:, 2] - rows[:, 3], item, doc))])
        # on a diagonal first and last windows alternate, so the n-th of one kind belongs to the n-th of the other
        first, last = sides
        rows = np.column_stack([first, last[:, 2] - first[:, 2] + k])
        true = np.ones(len(rows), bool)
        for x in range(k):  # words, not only the window's hash
            true &= w.hash[w.first[rows[:, 0]] + rows[:, 2] + x] == items.flat[items.begin[rows[:, 1]] + rows[:, 3] + x]
        out.append(rows[true])
    return np.concatenate(out) if out else np.zeros((0, 5), np.int64)


def tiles(found: np.ndarray, k: int, size: int) -> list[tuple[int, int, int]]:
    """Tiles (place in text, place in item, words) from the maximal matches of one pair, longest first.

    Ties go to the match that comes first in the item, then in the text.
    """
    heap = [(-int(n), int(j), int(i)) for i, j, n in found]
    heapq.heapify(heap)
    base = int(found[:, 0].min()) if len(found) else 0
    text_marked = np.zeros(int((found[:, 0] + found[:, 2]).max()) - base if len(found) else 0, bool)
    item_marked = np.zeros(size, bool)
    left, least = size, min(k, size)
    out = []
    while heap and left >= least:
        n, j, i = heapq.heappop(heap)
        taken = item_marked[j : j - n] | text_marked[i - base : i - base - n]
        if not taken.any():
            out.append((i, j, -n))
            left += n
            item_marked[j : j - n] = True
            text_marked[i - base : i - base - n] = True
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # what is left of the match competes again
            if y - x >= least:
                heapq.heappush(heap, (x - y, j + x, i + x))
    return out


def _hits(block: B.Block, items: Items, coverage: float) -> Iterator[tuple[int, int, int, int]]:
    """Text, item, tiles and covered words of each pair that reaches the coverage."""
    found = matches(B.words(block, inside=B.ALNUM, fold=B.FOLD), items)
    if not len(found):
        return
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    edge = np.ones(len(found), bool)
    edge[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    cut = np.append(np.flatnonzero(edge), len(found))
    total = np.add.reduceat(found[:, 4], cut[:-1])
    for a, b, words in zip(cut[:-1], cut[1:], total, strict=True):
        doc, item = int(found[a, 0]), int(found[a, 1])
        size = int(items.sizes[item])
        if words < coverage * size:  # all matches together cover too little
            continue
        got = tiles(found[a:b, 2:], items.k, size)
        covered = sum(n for _, _, n in got)
        if covered >= coverage * size:
            yield doc, item, len(got), covered


def item_blocks(benchmark: DataFrame, k: int, block_words: int) -> Iterator[Items]:
    """Items with a text, in blocks of about ``block_words`` words."""
    ids, texts, total = [], [], 0
    for r in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        total += r["text"].count(" ") + 1
        if total >= block_words:
            yield Items(ids, texts, k)
            ids, texts, total = [], [], 0
    if ids:
        yield Items(ids, texts, k)


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id, coverage, n_tiles, matched_words, item_words`` of every contaminated pair.

    Clean documents have no row. Null and empty texts match nothing. An item of
    fewer than ``k`` words matches where a document has all of them in a row.
    Repeated rows, and rows without an id, are reported each; ids may be of any
    type. Of matches of one length the first in the item, then in the text, is
    marked first. Texts are taken whole. An empty table on either side gives no
    row. Other columns of either table are not read.
    """
    prepare(docs.sparkSession)
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, coverage double, n_tiles int, matched_words long, item_words long"
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = None
    for items in item_blocks(benchmark, k, block_words):

        def match(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(block.row + d, i, n, c) for block in B.blocks(batch.column(1)) for d, i, n, c in _hits(block, items, coverage)]
                sizes = [int(items.sizes[i]) for _, i, _, _ in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                        pa.array([items.ids[r[1]] for r in rows], item_type),
                        pa.array([r[3] / s for r, s in zip(rows, sizes, strict=True)], pa.float64()),
                        pa.array([r[2] for r in rows], pa.int32()),
                        pa.array([r[3] for r in rows], pa.int64()),
                        pa.array(sizes, pa.int64()),
                    ],
                    ["doc_id", "item_id", "coverage", "n_tiles", "matched_words", "item_words"],
                )

        part = docs.select("doc_id", "text").mapInArrow(match, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, k: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without contaminated rows.

    No shuffle, so ids need not be unique or present, and repeated rows go or
    stay together. Columns of any name are returned as they are; without items
    everything stays. Otherwise as in ``contamination``.
    """
    prepare(docs.sparkSession)
    names, at = docs.columns, docs.columns.index("text")
    # Python workers take plain names only; the given ones return at the end.
    docs = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    for items in item_blocks(benchmark, k, block_words):

        def keep(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = np.ones(batch.num_rows, bool)
                for block in B.blocks(batch.column(at)):
                    for d, _, _, _ in _hits(block, items, coverage):
                        ok[block.row + d] = False
                yield batch.filter(pa.array(ok))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs.toDF(*names)
