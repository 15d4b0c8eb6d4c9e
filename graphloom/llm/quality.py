"""Quality rules: divergence of a document's histograms from its language's reference.

Two histograms are taken of every whole text: code points by character class,
and common function words (plus one bin for all other words). The reference of
a language is the same histogram summed over all of its documents. A document
is rejected when the Jensen-Shannon distance (base 2, 0 to 1) to its reference
exceeds a threshold, unless it is too short to judge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from graphloom.llm import blocks as B
from graphloom.runtime import prepare, stash

# Frequent function words of English, French, German and Spanish.
COMMON_WORDS = (
    "the of and to in is it that for on with as at by from this be are was have not or you an a "
    "le la les de des du et en un une que qui dans pour sur par au avec il est ce se ne pas plus "
    "der die das und den dem ein eine ist nicht von zu mit sich auf fur im als auch es an werden aus "
    "el los las y una por con para del lo como su al mas pero sus o este si"
).split()
N_CLASSES = 7
CHAR_LIMIT = 0.30
#: The word limit is WORD_LIMIT + WORD_NOISE / sqrt(words): short texts scatter more.
WORD_LIMIT = 0.24
WORD_NOISE = 0.9
MIN_WORDS = 80
#: Languages whose references the driver holds; those of rarer ones are joined as a table.
MAX_LANGUAGES = 256

_CLASS = np.full(256, 4, np.int64)  # other ASCII: controls and symbols
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[list(b" \t\n\v\f\r")] = 3
_CLASS[list(b".,;:!?'\"()-")] = 5
_CLASS[128:] = 6  # letters beyond ASCII, by their lead byte
_LEAD = ~B.lut(range(0x80, 0xC0))
_SYMBOL = B.lut(b"#*$%&|<>")
_vocabulary: list[tuple[np.ndarray, np.ndarray]] = []


def _common_bin(hashes: np.ndarray) -> np.ndarray:
    """Bin of each word: its place in the list of distinct common words, or the last bin."""
    if not _vocabulary:
        h = B.hash_words(list(dict.fromkeys(COMMON_WORDS)))
        order = np.argsort(h)
        _vocabulary.append((h[order], order))
    known, place = _vocabulary[0]
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, place[at], len(known))


N_WORDS = len(dict.fromkeys(COMMON_WORDS)) + 1


def _later_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line; ``bytes.strip`` takes the white space that bounds words."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def _counts(block: B.Block) -> dict[str, np.ndarray]:
    n, data = block.n, block.data
    doc_of_byte = np.repeat(np.arange(n), np.diff(block.offs))
    lead = _LEAD[data]
    chars = np.bincount((doc_of_byte * N_CLASSES + _CLASS[data])[lead], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    w = B.words(block)
    n_words = np.diff(w.first)
    symbols = np.bincount(doc_of_byte[_SYMBOL[data]], minlength=n)
    dup_lines = np.array([_later_lines(data[a:b].tobytes()) for a, b in zip(block.offs[:-1], block.offs[1:], strict=True)], np.int64)
    at, h3 = B.windows(w, 3)
    _, shared = B.repeats(B.in_doc(h3, w.doc[at]))
    covered = np.zeros(len(w.hash) + 3, bool)
    for k in range(3):
        covered[at[shared] + k] = True
    repeat_words = np.bincount(w.doc[covered[: len(w.hash)]], minlength=n)
    folded = B.range_hash(B.FOLD[data], w.start, w.end)
    common = np.bincount(w.doc * N_WORDS + _common_bin(folded), minlength=n * N_WORDS).reshape(n, N_WORDS)
    return {
        "chars": chars,
        "common": common,
        "n_words": n_words,
        "word_chars": chars.sum(1) - chars[:, 3],
        "n_symbols": symbols,
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words,
    }


def _reference_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str | None, list] = {}
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        for block in B.blocks(batch.column(0)):
            c = _counts(block)
            place: dict[str | None, int] = {}
            at = np.array([place.setdefault(x, len(place)) for x in langs[block.row : block.row + block.n]], np.int64)
            chars, common = np.zeros((len(place), N_CLASSES), np.int64), np.zeros((len(place), N_WORDS), np.int64)
            np.add.at(chars, at, c["chars"])
            np.add.at(common, at, c["common"])
            docs = np.bincount(at, minlength=len(place))
            for lang, i in place.items():
                got = total.setdefault(lang, [0, np.zeros(N_CLASSES, np.int64), np.zeros(N_WORDS, np.int64)])
                got[0] += int(docs[i])
                got[1] += chars[i]
                got[2] += common[i]
    names = list(total)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(names, pa.string()),
            pa.array([total[k][0] for k in names], pa.int64()),
            pa.array([np.concatenate(total[k][1:]).tolist() for k in names], pa.list_(pa.int64())),
        ],
        ["lang", "docs", "counts"],
    )


Histograms = tuple[np.ndarray, np.ndarray]


def references(docs: DataFrame) -> tuple[dict[str | None, Histograms], DataFrame | None]:
    """Histograms of the most frequent languages, under None those of all documents; and a table of the others.

    Every document counts. At most ``MAX_LANGUAGES`` languages come to the
    driver; what is beyond stays a table ``_lang, _ref``, None if there is nothing.
    """
    width = N_CLASSES + N_WORDS
    parts = docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(_reference_sums, "lang string, docs long, counts array<long>")
    totals = [F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(width)]
    sums = stash(parts.rollup("lang").agg(F.grouping("lang").alias("all"), F.sum("docs").alias("docs"), *totals), "references")
    rows = sums.where((F.col("all") == 1) | F.col("lang").isNotNull()).orderBy(F.desc("all"), F.desc("docs"), "lang").limit(MAX_LANGUAGES + 2).collect()
    every, more, rows = rows[0], len(rows) > MAX_LANGUAGES + 1, rows[1 : MAX_LANGUAGES + 1]
    cut = lambda r: (np.array([r[f"c{i}"] or 0 for i in range(N_CLASSES)], float), np.array([r[f"c{i}"] or 0 for i in range(N_CLASSES, width)], float))
    held = {None: cut(every)} | {r["lang"]: cut(r) for r in rows}
    if not more:
        return held, None
    known = [r["lang"] for r in rows]
    rest = sums.where((F.col("all") == 0) & F.col("lang").isNotNull() & ~F.col("lang").isin(known))
    return held, rest.select(F.col("lang").alias("_lang"), F.array(*[F.coalesce(f"c{i}", F.lit(0)) for i in range(width)]).alias("_ref"))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise Jensen-Shannon distance of counts to counts; 0 where either has none."""
    ps, qs = p.sum(1, keepdims=True), q.sum(1, keepdims=True)
    a, b = p / np.maximum(ps, 1), q / np.maximum(qs, 1)
    m = (a + b) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(a > 0, a * np.log2(a / m), 0).sum(1)
        right = np.where(b > 0, b * np.log2(b / m), 0).sum(1)
    return np.where((ps[:, 0] > 0) & (qs[:, 0] > 0), np.sqrt(np.maximum(0, (left + right) / 2)), 0.0)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judge(texts: pa.Array, langs: pa.Array, joined: pa.Array | None, refs: dict, char_limit: float, word_limit: float, min_words: int) -> dict[str, np.ndarray]:
    names = langs.to_pylist()
    parts: list[dict[str, np.ndarray]] = []
    for block in B.blocks(texts):
        c = _counts(block)
        if joined is None:
            own = [refs.get(x, refs[None]) for x in names[block.row : block.row + block.n]]
        else:
            whole = np.array(joined.slice(block.row, block.n).to_pylist(), float)
            own = list(zip(whole[:, :N_CLASSES], whole[:, N_CLASSES:], strict=True))
        c["js_char"] = js_distance(c.pop("chars"), np.array([r[0] for r in own]))
        c["js_word"] = js_distance(c.pop("common"), np.array([r[1] for r in own]))
        n = c["n_words"]
        c["base_failed"] = (n < 50) | (100 * c["n_repeat_words"] > 50 * n)
        far = (c["js_char"] > char_limit) | (c["js_word"] > word_limit + WORD_NOISE / np.sqrt(np.maximum(n, 1)))
        c["kept"] = ~c["base_failed"] & ((n < min_words) | ~far)
        parts.append(c)
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def quality(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, min_words: int = MIN_WORDS, keep_columns: bool = False, kept_only: bool = False) -> DataFrame:
    """Judge every document; one row each.

    Two scans of the texts and no shuffle of them: the first sums the language
    references, the second judges against them. Only documents of languages
    beyond the ``MAX_LANGUAGES`` most frequent ones are joined with their
    references, in one more scan.

    ``keep_columns`` returns the columns of ``docs`` alone (with ``kept_only``
    the documents that pass), else ``doc_id``, the base measures, ``js_char``,
    ``js_word``, ``base_failed`` and ``kept``. Null and empty texts have no
    words and fail the base rule. A null language is compared with the
    whole corpus; a missing ``lang`` column counts as null. Repeated rows are
    judged alike, each on its own. Whole texts are read, a very long one by
    itself; an empty table gives no row. Columns of ``docs`` may have any names.
    """
    prepare(docs.sparkSession)
    source = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    if docs.isEmpty():
        refs, rest = {None: (np.zeros(N_CLASSES), np.zeros(N_WORDS))}, None
    else:
        refs, rest = references(source)
    if keep_columns:
        # Python workers take plain names only; the given ones return at the end.
        names, schema = list(docs.columns), StructType([StructField(f"_c{i}", f.dataType, f.nullable) for i, f in enumerate(docs.schema)])
    else:
        names = ["doc_id", "text"]
        fields = ", ".join(f"{k} long" for k in MEASURES)
        schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {fields}, js_char double, js_word double, base_failed boolean, kept boolean"
    t_at, width = names.index("text"), len(names)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            joined = batch.column(width + 1) if batch.num_columns > width + 1 else None
            c = _judge(batch.column(t_at), batch.column(width), joined, refs, char_limit, word_limit, min_words)
            if keep_columns:
                out = batch.select(list(range(width)))
                yield out.filter(pa.array(c["kept"])) if kept_only else out
                continue
            longs = [pa.array(c[k].astype(np.int64)) for k in MEASURES]
            rest = [pa.array(c["js_char"]), pa.array(c["js_word"]), pa.array(c["base_failed"]), pa.array(c["kept"])]
            out = pa.RecordBatch.from_arrays([batch.column(0), *longs, *rest], ["doc_id", *MEASURES, "js_char", "js_word", "base_failed", "kept"])
            yield out.filter(out.column("kept")) if kept_only else out

    lang = F.col("lang").cast("string")
    name = lambda c: "`" + c.replace("`", "``") + "`"
    own = "_lang"
    plain = [f"_c{i}" for i in range(width)]
    given = source.select(*[F.col(name(c)).alias(p) for c, p in zip(names, plain, strict=True)], lang.alias(own))
    back = lambda df: df.toDF(*names) if keep_columns else df
    if rest is None:
        return back(given.mapInArrow(judged, schema))
    held = F.coalesce(F.col(own).isin([x for x in refs if x is not None]), F.lit(True))
    more = rest.withColumnsRenamed({"_lang": own, "_ref": f"{own}ref"})
    rare = given.where(~held).join(more, own).select(*plain, own, f"{own}ref")
    return back(given.where(held).mapInArrow(judged, schema).union(rare.mapInArrow(judged, schema)))
