"""N-gram Jaccard self-join by MinHash banding.

1. Each text's distinct word n-grams become 64-bit hashes; rows * bands minima of permuted hashes give its
   band hashes. Texts of equal n-gram sets become one class with the smallest doc_id as its representative.
2. Band hashes are shuffled; those that several representatives share are buckets. Bucket members are
   dealt into blocks of at most BLOCK, and every pair of blocks is a group, so a hot bucket is spread over
   many tasks, and within a group pairs are matrix entries, never rows.
3. A pair is verified in the first band that it shares, once. Only members with such a pair send their
   full n-gram sets to the group; verification counts each member's links and keeps a spanning set of
   edges, so what leaves a task grows with its members.
4. Components over the edges give the near-duplicate classes.

Two texts are linked from a similarity of LEAST = 0.8 of their sets of 5-grams on; near copies below that
are not, whatever their texts look like. The bands find a pair at 0.8 with probability RECALL, any above it more
surely, and verification adds no pair. A bucket of n distinct texts is dealt to (n / BLOCK) ** 2 / 2 groups, so a
member and its band hashes are sent n / BLOCK times a band: bytes grow with n ** 2 / BLOCK for distinct texts
in one bucket, while equal sets are one member from the start.

Texts of fewer than n words are one n-gram of all their words. Null texts and texts without words have no
n-grams: they link with nothing and are classes of their own. Texts of any length are read whole. Equal texts
are copies of one class, of which the smallest doc_id comes first. Rows that repeat a doc_id are one document,
with the smallest of their set hashes; rows with a null doc_id can't be told apart: they have a null class and no
links, and keep_one() keeps them all. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textkit as tk
from riskloom.llm.common import checkpointed
from riskloom.llm.components import components

SIZE = 5
LEAST = 0.8
RECALL = 0.9999
MOST_BANDS = 20
BLOCK = 512
#: What a group of bucket members is told by.
GROUP = ("key", "one", "two")


def banding(least: float = LEAST, recall: float = RECALL, most_bands: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows with which at most `most_bands` bands find a pair of similarity `least` with probability `recall`."""
    best = None
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - least**rows)) if least < 1 else 1
        if bands <= most_bands:
            best = (bands, rows)
    return best or (most_bands, 1)


def ngrams(block: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash): the distinct n-grams of a block's texts, by row and hash."""
    raw, bounds = tk.text_bytes(block.column("text"))
    starts, ends, first = tk.words(raw, bounds)
    sums, inverses = tk.rolling(tk.word_hashes(raw, starts, ends))
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
    h = tk.span_hash(sums, inverses, at, np.minimum(at + size, first[1:][row]))
    order = np.lexsort([h, row])
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def band_hashes(h: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row of band hashes for each run of n-gram hashes that begins at `first`."""
    factors = np.random.default_rng(7).integers(1, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(first), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(first), b + 1, np.uint64)
            for r in range(rows):
                key = tk.mix(key * np.uint64(31) + np.minimum.reduceat(h * factors[b * rows + r], first))
            out[:, b] = key
    return out


def freeing(work: Callable) -> Callable:
    """A mapInArrow function that hands what its task has freed back to the system, as workers live on between stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()

    return run


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, d1, d2, bands): two hashes of each text's n-gram set, and its band hashes; no row without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches):
            row, h = ngrams(block, size)
            if not len(h):
                continue
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            with np.errstate(over="ignore"):
                digests = [np.add.reduceat(tk.mix(h ^ np.uint64(salt)), first).view(np.int64) for salt in (0x9E3779B9, 0x7F4A7C15)]
            keys = band_hashes(h, first, bands, rows).view(np.int64)
            ids = block.column("doc_id").take(pa.array(row[first]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, digests), lists], ["doc_id", "d1", "d2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(freeing(sign), "doc_id long, d1 long, d2 long, bands array<long>")


def _bands(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(n, -1)


def _own_pairs(bands: np.ndarray, band: int, block: np.ndarray, cross: bool) -> np.ndarray:
    """bool[m, m], upper half: the pairs that share this band and none before it."""
    pairs = np.triu(bands[:, None, band] == bands[None, :, band], 1)
    for b in range(band):
        pairs &= bands[:, None, b] != bands[None, :, b]
    if cross:
        pairs &= block[:, None] != block[None, :]
    return pairs


def _members(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of bucket members that have a pair to verify in their group."""
    n = table.num_rows
    bands = _bands(table.column("bands"), n)
    band, block, one, two = (table.column(c).to_numpy() for c in ("band", "block", "one", "two"))
    size = np.diff(cuts)
    keep = np.zeros(n, bool)
    a = cuts[:-1][size == 2]
    equal = bands[a] == bands[a + 1]
    own = equal.argmax(axis=1) == band[a]
    own &= (one[a] == two[a]) | (block[a] != block[a + 1])
    keep[a[own]] = keep[a[own] + 1] = True
    for g in np.flatnonzero(size > 2):
        s = slice(cuts[g], cuts[g + 1])
        pairs = _own_pairs(bands[s], band[cuts[g]], block[s], one[cuts[g]] != two[cuts[g]])
        keep[s] = pairs.any(axis=0) | pairs.any(axis=1)
    out = table.select(["key", "band", "one", "two", "block", "rep"]).take(pa.array(np.flatnonzero(keep)))
    yield from out.to_batches()


def _verifier(least: float) -> Callable:
    """Links of each member of a group, and the least member of its part of the group."""

    def verify(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        bands = _bands(table.column("bands"), n)
        band, block, one, two, rep, copies = (table.column(c).to_numpy() for c in ("band", "block", "one", "two", "rep", "copies"))
        sets = table.column("grams").combine_chunks()
        offsets = sets.offsets.to_numpy().astype(np.int64)
        grams = sets.values.to_numpy()
        root, links = rep.copy(), np.zeros(n, np.int64)
        for g in range(len(cuts) - 1):
            a, b = cuts[g], cuts[g + 1]
            if b - a == 2:
                x, y = grams[offsets[a] : offsets[a + 1]], grams[offsets[a + 1] : offsets[a + 2]]
                if min(len(x), len(y)) < least * max(len(x), len(y)) or (one[a] != two[a] and block[a] == block[a + 1]) or (bands[a] == bands[a + 1]).argmax() != band[a]:
                    continue
                common = _shared(x, y)
                if common / (len(x) + len(y) - common) >= least:
                    root[a : a + 2] = min(rep[a], rep[a + 1])
                    links[a], links[a + 1] = copies[a + 1], copies[a]
                continue
            pairs = _own_pairs(bands[a:b], band[a], block[a:b], one[a] != two[a])
            if not pairs.any():
                continue
            common = _shared_matrix(grams[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1]))
            own = np.diff(offsets[a : b + 1])
            pairs &= common / np.maximum(own[:, None] + own[None, :] - common, 1) >= least
            pairs |= pairs.T
            links[a:b] = pairs @ copies[a:b]
            local = rep[a:b]
            while True:  # the least member spreads over the links
                lower = np.minimum(local, np.where(pairs, local[None, :], np.iinfo(np.int64).max).min(axis=1))
                if (lower == local).all():
                    break
                local = lower
            root[a:b] = local
        found = np.flatnonzero(links)
        order = found[np.lexsort([root[found], rep[found]])]
        if len(order):
            first = np.flatnonzero(np.r_[True, (rep[order][1:] != rep[order][:-1]) | (root[order][1:] != root[order][:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(rep[order][first]), pa.array(root[order][first]), pa.array(np.add.reduceat(links[order], first))], ["rep", "root", "links"])

    return verify


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """The common members of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _shared_matrix(grams: np.ndarray, sizes: np.ndarray, wide: int = 8192) -> np.ndarray:
    """int64[m, m]: the common members of each two sets, by products of 0/1 blocks of `wide` n-grams."""
    m = len(sizes)
    _, code = np.unique(grams, return_inverse=True)
    often = np.bincount(code) > 1
    shared = often[code]  # n-grams of one set only have no part in a common count
    row = np.repeat(np.arange(m), sizes)[shared]
    code = (np.cumsum(often) - 1)[code[shared]]
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    total = np.zeros((m, m), np.int64)
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, wide):
        s = slice(*np.searchsorted(code, [low, low + wide]))
        x = np.zeros((m, wide), np.float32)
        x[row[s], code[s] - low] = 1
        total += (x @ x.T).astype(np.int64)
    return total


def near_duplicates(docs: DataFrame, size: int = SIZE, least: float = LEAST, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies): each document's class, the documents that are linked to it, and those of an equal n-gram set.

    class_id is the smallest doc_id that links lead to; n_links counts documents, n_copies included.
    """
    bands, rows = banding(least, recall)
    nameless = docs.filter(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_copies"))
    docs = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    signed = checkpointed(signatures(docs, size, bands, rows))
    again = repeated_ids(docs)
    if again is not None:
        signed = checkpointed(signed.groupBy("doc_id").agg(F.min(F.struct("d1", "d2", "bands")).alias("m")).select("doc_id", "m.*"))
    reps = signed.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    reps = checkpointed(reps)
    keyed = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = checkpointed(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))  # written, so that hot sides of joins may be split
    placed = keyed.join(shared, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    paired = placed.select("key", "band", "rep", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    paired = paired.select("key", "band", "rep", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    tested = paired.join(reps.select("rep", "bands"), "rep").repartition(*GROUP).sortWithinPartitions(*GROUP)
    needed = tested.select("key", "band", "one", "two", "block", "rep", "bands").mapInArrow(freeing(tk.by_group(_members, GROUP)), "key long, band int, one int, two int, block int, rep long")
    lists = needed.groupBy("rep").agg(F.collect_list(F.struct("key", "band", "one", "two", "block")).alias("groups"))
    wanted = lists.join(reps.select("rep", "copies", "bands"), "rep").withColumnRenamed("rep", "doc_id")

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.blocks(batches):
            row, h = ngrams(b, size)
            bounds = np.searchsorted(row, np.arange(b.num_rows + 1))
            sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array((h ^ np.uint64(1 << 63)).view(np.int64)))  # in order as signed numbers
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("copies"), b.column("bands"), b.column("groups"), sets], ["rep", "copies", "bands", "groups", "grams"])

    kind = "array<struct<key:long,band:int,one:int,two:int,block:int>>"
    sets = docs.join(wanted, "doc_id").select("doc_id", "text", "copies", "bands", "groups").mapInArrow(freeing(grams_of), f"rep long, copies long, bands array<long>, groups {kind}, grams array<long>")
    sent = sets.select("rep", "copies", "bands", "grams", F.inline("groups")).repartition(*GROUP).sortWithinPartitions(*GROUP)
    verified = checkpointed(sent.mapInArrow(freeing(tk.by_group(_verifier(least), GROUP)), "rep long, root long, links long"))
    roots = components(verified.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = checkpointed(reps.select("rep", "copies", "d1", "d2").join(links, "rep", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left"))
    known = signed.select("doc_id", "d1", "d2").join(classes, ["d1", "d2"]).select("doc_id", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), (F.col("copies") - 1).alias("n_copies"))
    bare = docs.select("doc_id").join(signed.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_copies"))
    return known.unionAll(bare if again is None else bare.distinct()).unionAll(nameless)


def repeated_ids(docs: DataFrame) -> DataFrame | None:
    """(doc_id): the ids that several rows have; None if there are none."""
    again = checkpointed(docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    return again if again.limit(1).count() else None


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that are the first of their near-duplicate class, one for each doc_id; all rows with a null doc_id."""
    first = near_duplicates(docs, **how).filter("doc_id = class_id").select("doc_id")
    kept = docs.join(first, "doc_id", "left_semi").select(*docs.columns)
    again = repeated_ids(docs)
    if again is not None:
        kept = kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*docs.columns)
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))


def op8(docs: DataFrame) -> DataFrame:
    """Each document's near-duplicate class and number of links."""
    return near_duplicates(docs)
