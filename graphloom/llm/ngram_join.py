"""N-gram Jaccard join: links and components of documents whose shingle sets are similar.

The document by n-gram incidence matrix is multiplied by its transpose in
blocks, and only where a link can show. Documents with equal sets are one
class, one row of the matrix. What cannot be in a link goes first, by bounds
that follow from the sets' sizes alone:

1. Prefixes. In one global order of n-grams, those of rare words first, the
   ends of two linked sets' prefixes hold some n-grams of both. A class with
   fewer n-grams in its prefix that any other class has is out.
2. Frequencies. Of what is left, whole sets are counted: a class shares at
   least the threshold's part of its n-grams with others, or is out. N-grams of
   one class alone leave the matrix.
3. Blocks. With exact frequencies the prefixes are taken again, rarest first.
   Classes that they connect, directly or by others, are a block of the matrix;
   no link crosses blocks.

4. Middles. In a block of more classes than a tile holds, those that differ
   little from what most of the block has in common link with one another by
   the triangle inequality of set differences. They are counted together, not
   by pairs, so a group of near copies costs its members.

What is left of a block is cut into tiles of a bounded number of classes and
n-grams, against itself and against the classes near the middle. A tile
accumulates the overlap counts of its rows, discards pairs whose sizes or counts
bound them below the threshold, and returns for each class how many documents
it links with and the least class of its links' component. So no table of pairs
is ever made, and a frequent n-gram costs its documents, not their square.
The prefix order, middles and the cut into tiles decide the cost, never the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import blocks as B
from graphloom.llm.components import components
from graphloom.runtime import Tables, prepare

N = 5
PERCENT = 80
#: Words are weighed by the frequency of their bin of so many bits.
WORD_BITS = 16
#: Hundredths of a set by which its prefix is longer than one shared n-gram needs.
EXTRA = 5
#: Bits of the candidates' filter for each of them, and the bytes that it never exceeds.
FILTER_BITS = 12
FILTER_BYTES = 32 << 20
#: A tile has about so many n-grams and classes to each side.
TILE_GRAMS = 1 << 20
TILE_CLASSES = 512
#: Most parts in which the classes of one block meet the block's middle; a part has at least ``TILE_CLASSES``.
SALTS = 64
#: N-grams of at most so many of a tile's classes are counted by pairs, others by a dense product of so many cells.
SPARSE = 16
DENSE_CELLS = 1 << 22

_LOW = B.U((1 << 56) - 1)


def shingle_sets(block: B.Block, n: int, weight: np.ndarray) -> list[tuple[np.ndarray, bytes | None]]:
    """Each text's sorted distinct ``n``-word windows and the 128-bit identity of the set.

    A window is a 56-bit hash under a byte that adds the weights of its words,
    so that sets are sorted with rare words first. A text of fewer words has all
    of them as its one window; one without words has no window and no identity.
    A set of one window is identified by that window's words, any other by its
    windows' hashes of 64 bits, of which it has at least two.
    """
    w = B.words(block, fold=B.FOLD)
    at, full = B.windows(w, n)
    own_weight = weight[w.hash >> B.U(64 - WORD_BITS)]
    total = np.zeros(len(at), B.U)
    for k in range(n):
        total += own_weight[at + k]
    h = (full & _LOW) | (np.minimum(total, 255).astype(B.U) << B.U(56))
    cut = np.searchsorted(w.doc[at], np.arange(block.n + 1)) if len(at) else np.zeros(block.n + 1, np.int64)
    out: list[tuple[np.ndarray, bytes | None]] = []
    for i in range(block.n):
        lo, hi, own = cut[i], cut[i + 1], range(w.first[i], min(w.first[i + 1], w.first[i] + n))
        if not len(own):
            out.append((h[:0], None))
            continue
        s, place = np.unique(h[lo:hi], return_index=True)
        if len(s) > 1:
            identity = hashlib.blake2b(s.tobytes() + full[lo:hi][place].sum(dtype=B.U).tobytes(), digest_size=16)
        else:
            words = b" ".join(B.FOLD[block.data[w.start[k] : w.end[k]]].tobytes() for k in own)
            identity = hashlib.blake2b(words, digest_size=16)
            s = np.frombuffer(identity.digest()[:8], B.U) & _LOW if not len(s) else s
        out.append((s, identity.digest()))
    return out


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, B.U)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def word_weights(texts: DataFrame) -> np.ndarray:
    """The rounded logarithm of each bin's words in all texts: exact counts, ``2 ** WORD_BITS`` numbers at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros(1 << WORD_BITS, np.int64)
        for batch in batches:
            for block in B.blocks(batch.column(0)):
                w = B.words(block, fold=B.FOLD)
                bins += np.bincount((w.hash >> B.U(64 - WORD_BITS)).astype(np.int64), minlength=1 << WORD_BITS)
        some = np.flatnonzero(bins)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(bins[some])], ["bin", "c"])

    sums = texts.mapInArrow(count, "bin int, c long").groupBy("bin").agg(F.sum("c").alias("c")).toArrow()
    weight = np.zeros(1 << WORD_BITS, np.uint8)
    weight[sums["bin"].to_numpy()] = np.round(np.log2(sums["c"].to_numpy() + 1)).astype(np.uint8)
    return weight


def _least(n, percent: int):
    """N-grams that a set of ``n`` shares with any set that it links with; for numbers and columns."""
    return F.ceil(n * percent / 100) if isinstance(n, Column) else -(-n * percent // 100)


def _surplus(n, percent: int):
    """N-grams by which a set's prefix is longer than needed to share one with every set that it links with."""
    if isinstance(n, Column):
        return F.greatest(F.lit(1), F.least(_least(n, percent), F.ceil(n * EXTRA / 100)))
    return max(1, min(_least(n, percent), -(-n * EXTRA // 100)))


def _can_differ(n: int, percent: int) -> bool:
    """Whether a set of ``n`` can link with a set other than itself."""
    return 100 * n >= percent * (n + 1)


def signatures(rows: DataFrame, n: int, percent: int, weight: np.ndarray) -> DataFrame:
    """``doc_id, key, n, cid, prefix`` for each row of ``doc_id, key, text``; no ``cid`` without words.

    Two sets that link share at least the lesser one's surplus in their
    prefixes: what lies before the nearer end is common to both orders.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # of this partition, to list the n-grams of its copies once
        for batch in batches:
            sizes, ids, prefixes = [], [], []
            for block in B.blocks(batch.column(2)):
                for s, c in shingle_sets(block, n, weight):
                    k = len(s)
                    listed = k and c not in seen and _can_differ(k, percent)
                    sizes.append(k)
                    ids.append(c)
                    prefixes.append(s[: k - _least(k, percent) + _surplus(k, percent)] if listed else s[:0])
                    seen.add(c)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), _lists(prefixes)], ["doc_id", "key", "n", "cid", "prefix"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(sign, f"doc_id {kind}, key long, n long, cid binary, prefix array<long>")


class Filter:
    """A Bloom filter over row keys, sized by their number up to ``FILTER_BYTES``; it may pass others, never stop one."""

    def __init__(self, keys: DataFrame, number: int) -> None:
        bits = min(FILTER_BYTES * 8, max(64, 1 << (FILTER_BITS * number - 1).bit_length()))
        self.bits = bits
        place = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(i), "key"), F.lit(bits)) for i in range(3)]))
        word = keys.select(place.alias("x")).select(F.shiftright("x", 6).alias("w"), F.expr("shiftleft(1L, cast(x & 63 as int))").alias("m"))
        got = word.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()  # combined before it reaches the driver
        self.words = np.zeros(bits >> 6, B.U)
        self.words[got["w"].to_numpy()] = got["m"].to_numpy().view(B.U)

    def passes(self, places: list[np.ndarray]) -> np.ndarray:
        ok = np.ones(len(places[0]), bool)
        for x in places:
            ok &= (self.words[x >> 6] >> (x & 63).astype(B.U)) & B.U(1) == 1
        return ok

    def places(self) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(i), "key"), F.lit(self.bits)).alias(f"x{i}") for i in range(3)]


def full_sets(rows: DataFrame, wanted: DataFrame, n: int, weight: np.ndarray) -> DataFrame:
    """``cid, n, grams`` of the wanted classes, from the row that ``wanted`` (``cid, key``) names, once each."""
    held = Filter(wanted.select("key"), wanted.count())

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = held.passes([batch.column(k).to_numpy() for k in (2, 3, 4)])
            batch = batch.filter(pa.array(ok))
            keys = batch.column(0)
            for block in B.blocks(batch.column(1)):
                found = shingle_sets(block, n, weight)
                own = keys.slice(block.row, block.n)
                yield pa.RecordBatch.from_arrays([own, pa.array([c for _, c in found], pa.binary()), pa.array([len(s) for s, _ in found], pa.int64()), _lists([s for s, _ in found])], ["key", "cid", "n", "grams"])

    sets = rows.select("key", "text", *held.places()).mapInArrow(pick, "key long, cid binary, n long, grams array<long>")
    # A class has one key, so rows that repeat are found where the join has put them.
    return sets.join(wanted.select("cid", "key"), ["cid", "key"], "left_semi").dropDuplicates(["cid", "key"]).drop("key")


def candidates(signed: DataFrame, classes: DataFrame, tables: Tables, percent: int) -> DataFrame:
    """``cid, key`` of the classes whose prefixes share enough n-grams with other classes' prefixes."""
    listed = signed.where(F.size("prefix") > 0).select(F.xxhash64("cid").alias("c"), F.explode("prefix").alias("gram"))
    ends = listed.groupBy("gram").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    shared = tables.put("shared", ends.select("gram"))
    have = listed.join(shared, "gram").groupBy("c").agg(F.count(F.lit(1)).alias("have"))
    need = _surplus(_least(F.col("n"), percent), percent)  # the least surplus of a set that it may link with
    enough = F.col("have") >= need * F.col("listings")  # each listing of a class counted the same n-grams
    found = classes.withColumn("c", F.xxhash64("cid")).join(have, "c").where(enough).select("cid", "key")
    out = tables.put("candidates", found)
    tables.drop("shared")
    return out


def vectors(sets: DataFrame, tables: Tables, percent: int) -> DataFrame:
    """``k, n, grams`` of the classes that share enough n-grams: the shared ones, rarest first."""
    listed = sets.select("k", F.explode("grams").alias("gram"))
    often = tables.put("frequencies", listed.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    shared = listed.join(often, "gram").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    grams = shared.select("k", F.transform("grams", lambda g: g["gram"]).alias("grams"))
    enough = F.size("grams") >= _least(F.col("n"), percent)
    out = tables.put("vectors", grams.join(sets.select("k", "n"), "k").where(enough))
    tables.drop("frequencies")
    return out


def connected(vectors: DataFrame, percent: int) -> DataFrame:
    """``node, label``: the block of each class whose prefix shares an n-gram with another one's.

    Of a set's least number of common n-grams one lies in the prefix here: what
    is missing in ``grams`` is common to none, so the prefix is shorter by that.
    """
    heads = vectors.select("k", F.explode(F.slice("grams", F.lit(1), (F.size("grams") - _least(F.col("n"), percent) + 1).cast("int"))).alias("gram"))
    hubs = heads.groupBy("gram").agg(F.min("k").alias("hub"), F.max("k").alias("last")).where("hub < last").select("gram", "hub")
    return components(heads.join(hubs, "gram").where("k <> hub").select("k", "hub").distinct(), "blocks", "k", "hub")


def _overlaps(owner: np.ndarray, grams: np.ndarray, left: np.ndarray, right: np.ndarray, m: int) -> np.ndarray:
    """Common n-grams of each set of ``left`` with each of ``right``; ``grams`` has those of all ``m`` sets."""
    place = np.unique(grams, return_inverse=True)[1]
    times = np.bincount(place)
    order = np.argsort(place[times[place] > 1], kind="stable")
    owner, place = owner[times[place] > 1][order], place[times[place] > 1][order]
    count = times[place]
    counts = np.zeros(m * m, np.int64)
    few = count <= SPARSE
    a, p = owner[few], place[few]
    for step in range(1, min(SPARSE, len(p))):
        same = p[:-step] == p[step:]
        if not same.any():
            break
        counts += np.bincount(a[:-step][same] * m + a[step:][same], minlength=m * m)
    both = counts.reshape(m, m)
    overlap = (both + both.T)[np.ix_(left, right)]
    a, p = owner[~few], place[~few]
    p = np.cumsum(np.append(0, p[1:] != p[:-1])) if len(p) else p
    wide = max(1, DENSE_CELLS // m)
    for first in range(0, int(p[-1]) + 1 if len(p) else 0, wide):
        lo, hi = np.searchsorted(p, [first, first + wide])
        has = np.zeros((m, wide), np.float32)
        has[a[lo:hi], p[lo:hi] - first] = 1
        overlap += (has[left] @ has[right].T).astype(np.int64)
    return overlap


def _tile(ids: np.ndarray, sides: np.ndarray, weight: np.ndarray, n: np.ndarray, sizes: np.ndarray, grams: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each class of a tile: the documents of others that it links with, and the least class of its links' component.

    Classes of one side meet those of the other, or each other if there is one side only.
    """
    m, one = len(ids), sides.min() == sides.max()
    left, right = np.flatnonzero(sides == sides.min()), np.flatnonzero(sides == sides.max())
    overlap = _overlaps(np.repeat(np.arange(m), sizes), grams, left, right, m)
    a, b = n[left][:, None], n[right][None, :]
    linked = overlap * 100 >= (a + b - overlap) * percent  # sizes too far apart fail here too: an overlap is at most the lesser size
    if one:
        np.fill_diagonal(linked, False)
    more = np.zeros(m, np.int64)
    more[left] = linked @ weight[right]
    if not one:
        more[right] = weight[left] @ linked
    least = ids.copy()
    x, y = np.nonzero(linked)
    x, y = left[x], right[y]
    while True:
        low = np.minimum(least[x], least[y])
        before = least.copy()
        np.minimum.at(least, x, low)
        np.minimum.at(least, y, low)
        if (before == least).all():
            return more, least


def _by_block(members: DataFrame, middles: DataFrame) -> DataFrame:
    """Rows of classes with the row of their block, if any; both sides have the block's ``classes``.

    Only a block of many classes is split by a salt, in parts by their number, so
    copies of the blocks' rows grow as the classes do. Nothing is broadcast: the
    estimate of a copied row does not count its copies.
    """
    parts = F.least(F.lit(SALTS), F.ceil(F.col("classes") / TILE_CLASSES)).cast("long")
    salted = members.withColumn("salt", F.pmod(F.xxhash64("k"), parts))
    copied = middles.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return salted.join(copied.drop("classes").hint("merge"), ["label", "salt"]).drop("salt")


def _cuts(of: Column) -> Column:
    """Parts of bounded n-grams and classes for the rows where ``of`` holds; 0 if there are none."""
    return F.greatest(F.ceil(F.sum(F.when(of, F.col("grams")).otherwise(0)) / TILE_GRAMS), F.ceil(F.sum(of.cast("long")) / TILE_CLASSES))


def centred(vectors: DataFrame, own: DataFrame, tables: Tables, percent: int) -> DataFrame:
    """``k`` of the classes that lie near the middle of their block, one of more than one part (``k, label, classes``): any two of a block link.

    A block's middle is the set of n-grams that more than half of its classes
    hold, so it has at most twice their mean. With ``t`` the threshold, two sets
    of ``a`` and ``b`` n-grams link when they differ in at most
    ``(a + b) * (1 - t) / (1 + t)``; they do if each differs from any third set
    in at most its own share of that.
    """
    sets = own.select("k", "label", "classes").join(vectors, "k")
    held = sets.select("label", "classes", F.explode("grams").alias("gram")).groupBy("label", "classes", "gram").agg(F.count(F.lit(1)).alias("held"))
    middle = tables.put("middles", held.where("2 * held > classes").groupBy("label", "classes").agg(F.collect_list("gram").alias("middle")))
    apart = F.col("n") + F.size("middle") - 2 * F.size(F.array_intersect("grams", "middle"))
    near = _by_block(sets.select("k", "label", "classes", "n", "grams"), middle).where(apart * (100 + percent) <= F.col("n") * (100 - percent))
    return near.select("k")


def tiled(vectors: DataFrame, blocks: DataFrame, copies: DataFrame, tables: Tables, percent: int) -> DataFrame:
    """``k, more, least`` of every class of a block and each of its tiles.

    Classes near their block's middle are counted as one: each links with all
    the others of them. Tiles pair the remaining classes with each other and
    with those, never two classes near the middle.

    A block of one part is one tile and needs no row of its own. Rows of the
    others are broadcast: each stands for more than ``TILE_CLASSES`` classes or
    ``TILE_GRAMS`` n-grams.
    """
    members = vectors.select("k", F.size("grams").alias("grams")).join(blocks.withColumnRenamed("node", "k"), "k").join(copies, "k")
    members = tables.put("members", members)
    large = members.groupBy("label").agg(F.count(F.lit(1)).alias("classes"), _cuts(F.lit(True)).alias("cuts")).where("cuts > 1").select("label", "classes")
    large = tables.put("large", large)
    own = tables.put("large_members", members.join(F.broadcast(large), "label"))
    near = tables.put("near", centred(vectors, own, tables, percent).withColumn("near", F.lit(True)))
    marked = tables.put("marked", own.join(near, "k", "left").withColumn("near", F.coalesce("near", F.lit(False))))
    tables.drop("large_members", "middles", "near")
    is_near = F.col("near")
    sized = tables.put(
        "sized",
        marked.groupBy("label").agg(
            _cuts(is_near).alias("inner"), _cuts(~is_near).alias("outer"), F.sum(F.when(is_near, F.col("copies"))).alias("held"), F.min(F.when(is_near, F.col("k"))).alias("least")
        ),
    )
    dealt = marked.drop("grams").join(F.broadcast(sized), "label")
    as_one = dealt.where("near").select("k", (F.col("held") - F.col("copies")).alias("more"), "least")
    place, zero = F.xxhash64("k"), F.lit(0).cast("long")
    side = F.when(is_near, F.pmod(place, F.col("inner"))).otherwise(F.col("inner") + F.pmod(place, F.col("outer")))
    others = F.sequence(F.when(is_near, F.col("inner")).otherwise(zero), F.col("inner") + F.col("outer") - 1)
    met = dealt.where("outer > 0").select("k", "copies", "label", side.alias("side"), others.alias("others"))
    whole = members.join(F.broadcast(large), "label", "left_anti").select("k", "copies", "label", zero.alias("side"), F.array(zero).alias("others"))
    tiles = met.unionByName(whole).join(vectors, "k").select("k", "copies", "n", "label", "side", "grams", F.explode("others").alias("other"))
    tiles = tiles.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("other")

    def count(tile: pa.Table) -> pa.Table:
        sides, ids = tile["side"].to_numpy(), tile["k"].to_numpy()
        if tile["i"][0].as_py() != tile["j"][0].as_py() and sides.min() == sides.max():  # no class fell into the other part
            return pa.table({"k": pa.array([], pa.int64()), "more": pa.array([], pa.int64()), "least": pa.array([], pa.int64())})
        lists = tile["grams"].combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        more, least = _tile(ids, sides, tile["copies"].to_numpy(), tile["n"].to_numpy(), sizes, lists.flatten().to_numpy(), percent)
        return pa.table({"k": ids, "more": more, "least": least})

    counted = tiles.groupBy("label", "i", "j").applyInArrow(count, "k long, more long, least long")
    return counted.unionByName(as_one)


def _linked(rows: DataFrame, signed: DataFrame, classes: DataFrame, tables: Tables, n: int, percent: int, weight: np.ndarray) -> DataFrame | None:
    """``cid, label, more`` of the classes that may link with another: component and linked documents of other classes."""
    chosen = candidates(signed, classes, tables, percent)
    tables.drop("signatures")
    if chosen.isEmpty():
        return None
    sets = tables.put("sets", full_sets(rows, chosen, n, weight).withColumn("k", F.monotonically_increasing_id()))
    tables.drop("candidates")
    rest = vectors(sets, tables, percent)
    copies = sets.select("k", "cid").join(classes.select("cid", "copies"), "cid").select("k", "copies")
    found = tables.put("tiles", tiled(rest, connected(rest, percent), copies, tables, percent))
    tables.drop("members", "large", "marked", "sized")
    labels = components(found.select("k", "least"), "links", "k", "least").withColumnRenamed("node", "k")
    more = found.groupBy("k").agg(F.sum("more").alias("more"))
    out = tables.put("linked", sets.select("k", "cid").join(labels, "k").join(more, "k").select("cid", "label", "more"))
    tables.drop("sets", "vectors", "tiles")
    return out


def _classes(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, key, n, cid`` of each row; ``cid, component, component_id, n_links`` of each class."""
    spark = docs.sparkSession
    prepare(spark)
    tables = Tables(spark, "ngram_join")
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    weight = word_weights(rows.select("text"))
    signed = tables.put("signatures", signatures(rows, n, percent, weight))
    documents = tables.put("documents", signed.select("doc_id", "key", "n", "cid"))
    listings = F.sum(F.when(F.size("prefix") > 0, 1).otherwise(0))
    each = signed.where("cid is not null").groupBy("cid").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"), listings.alias("listings"), F.min("doc_id").alias("component_id"))
    classes = tables.put("classes", each)
    alone = classes.select("cid", F.col("cid").alias("component"), "component_id", (F.col("copies") - 1).alias("n_links"))
    linked = _linked(rows, signed, classes, tables, n, percent, weight)
    if linked is None:
        return documents, alone
    held = linked.join(alone, "cid")
    least = held.groupBy("label").agg(F.min("component_id").alias("component_id"), F.min("component").alias("component"))
    joined = held.select("cid", "label", (F.col("n_links") + F.col("more")).alias("n_links")).join(least, "label").select("cid", "component", "component_id", "n_links")
    return documents, tables.put("grouped", alone.join(joined.select("cid"), "cid", "left_anti").unionByName(joined))


def near_copies(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for each row of ``docs``.

    Words are runs without ASCII white space, A-Z lower-cased. A document's set
    has its distinct ``n``-word windows, or the sequence of all its words if it
    has fewer. Documents link when their sets' Jaccard similarity is at least
    ``percent`` hundredths; ``component_id`` is the smallest ``doc_id`` that
    links reach, the document's own included; ``n_links`` is the exact number of
    other documents that a document links with.

    Null, empty and blank texts have 0 shingles and link with nothing. A null
    ``doc_id`` links like others but is never a component's id unless nothing
    else is there. Rows that repeat a ``doc_id`` are documents of their own, and
    equal rows link with each other. Texts of any length are taken whole. An
    empty table gives no row. Other columns of ``docs``, whatever their names,
    are not read. N-grams are compared by 56 bits of a hash within pairs, sets
    by 128 bits.
    """
    documents, classes = _classes(docs, n, percent)
    key = F.coalesce("cid", F.unhex(F.hex("key")))  # spreads rows without words; at most 8 bytes equal no class
    own = documents.select("doc_id", F.col("n").alias("n_shingles"), key.alias("cid"))
    return own.join(classes, "cid", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component of similar documents.

    It is the row of the smallest ``doc_id``, nulls last; between rows of one
    ``doc_id`` a hash of the text decides, and of equal rows one stays. Rows
    without words are in no component and all stay, as does everything that
    links with nothing. An empty table stays empty. Columns of any name are
    returned as they are.
    """
    documents, classes = _classes(docs, n, percent)
    tables = Tables(docs.sparkSession, "keep_one")
    grouped = documents.where("cid is not null").join(classes.select("cid", "component"), "cid").select("doc_id", "key", "component")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "key")).alias("first")
    several = grouped.groupBy("component").agg(first, F.count(F.lit(1)).alias("rows")).where("rows > 1").select("component", "first")
    is_first = F.col("doc_id").eqNullSafe(F.col("first")["doc_id"]) & (F.col("key") == F.col("first")["key"])
    verdict = grouped.join(several, "component").groupBy("doc_id", "key").agg(F.max(is_first).alias("stays"), F.count(F.lit(1)).alias("times"))
    marks = tables.put("marks", verdict.where("not stays or times > 1").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "stays", "times"))
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("_row")
    given = docs.select(row, F.col("doc_id").alias("_doc"), F.xxhash64("doc_id", "text").alias("_hash"))
    left = given.join(marks, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_key")), "left").where(F.coalesce("stays", F.lit(True)))
    if marks.where("stays").isEmpty():
        return left.select("_row.*")
    repeated = F.coalesce(F.col("times") > 1, F.lit(False))
    once = left.where(repeated).dropDuplicates(["_doc", "_hash"])
    return left.where(~repeated).select("_row.*").unionByName(once.select("_row.*"))
