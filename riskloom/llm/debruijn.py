"""Removal of repeated word passages with a compacted de Bruijn graph.

Edges are the windows of `width` words, nodes the width - 1 words that two neighbouring windows share.
Neighbouring windows of a text whose first SPREAD 4-grams have the same least hash travel as one
segment, a path of edges; which windows share it depends on their words alone, so equal windows lie at
the same place before equal anchors, and windows of different `core` words (those from the anchor on that
all its windows hold) cannot be equal. Equal segments are one class; the smallest document that holds it is
its owner.

1. Spark takes the smallest and largest document of each core, with partial sums; only segments of cores
   that two documents hold go on, by a join. A hot core is one row a task in the sums, and its side of the
   join may be split, as it is an ordinary skewed join; no task gathers the segments of a core.
2. Classes that a later document repeats are the graph. Where a node joins just one class to just one
   other, the two compact: joins with doubled steps give each class its path and its place there.
3. Occurrences of a path's classes in a document become one span; source coordinates verify it: the
   lengths of its segments must add up to its extent, or the segments stay single.
4. Cores with several classes may share some windows only: the owners' segments there are split into
   edges, and an edge that a smaller document also holds is removed as well, by sums and a join again.

A class is told by two 64-bit hashes, with hashes of words and bases of their own. Null texts have no words;
texts of fewer than `width` words lose none; texts of any length are read whole, and memory follows the
longest; repeats within one document stay; of equal texts the one with the smallest doc_id stays whole; other
columns are not read. Rows with a null doc_id can't be compared: they take no part and keep everything. Rows
that repeat a doc_id must hold one text, and keep what none of smaller documents holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textkit as tk
from riskloom.llm.common import checkpointed

WIDTH = 50
SPREAD = 26
GRAM = 4
_SECOND = 0xA0761D6478BD642F


class Segments:
    """The segments of a block of texts: bounds lo..hi of window starts by word, and the hashes of their words."""

    def __init__(self, block: pa.RecordBatch, width: int):
        raw, bounds = tk.text_bytes(block.column("text"))
        starts, ends, self.first = tk.words(raw, bounds)
        words = tk.word_hashes(raw, starts, ends)
        self.width = width
        self.one = tk.rolling(words)
        self.two = tk.rolling(tk.word_hashes(raw, starts, ends, _SECOND), _SECOND)
        n = len(words)
        sizes = np.diff(self.first)
        count = np.maximum(sizes - width + 1, 0)
        total = int(count.sum())
        self.row = np.repeat(np.arange(len(sizes)), count)
        start = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[:-1], count)
        self.lo = self.hi = self.at = np.zeros(0, np.int64)
        if total:
            place = np.arange(n)
            grams = tk.span_hash(*self.one, place, np.minimum(place + GRAM, n))
            own = tk.sliding_argmin(grams, SPREAD)[start]
            cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (self.row[1:] != self.row[:-1])])
            last = np.r_[cut[1:], total] - 1
            self.row, self.at, self.lo, self.hi = self.row[cut], own[cut], start[cut], start[last]
        self.ids = block.column("doc_id").to_numpy(zero_copy_only=False)

    def hashed(self, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
        return tk.span_hash(*(self.two if second else self.one), start, end).view(np.int64)


def cores(docs: DataFrame, width: int = WIDTH, placed: bool = True) -> DataFrame:
    """(core, doc_id, lo): the core hash of every segment and its place; or (core, least, most), the documents of each in a block of texts."""
    core_words = width - SPREAD + 1

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches):
            s = Segments(block, width)
            if not len(s.lo):
                continue
            core, ids = s.hashed(s.at, s.at + core_words), s.ids[s.row]
            if placed:
                yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(ids), pa.array((s.lo - s.first[s.row]).astype(np.int32))], ["core", "doc_id", "lo"])
                continue
            order = np.lexsort([ids, core])
            core, ids = core[order], ids[order]
            first = np.flatnonzero(np.r_[True, core[1:] != core[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(core[first]), pa.array(ids[first]), pa.array(ids[np.r_[first[1:], len(ids)] - 1])], ["core", "least", "most"])

    return docs.select("doc_id", "text").mapInArrow(shard, "core long, doc_id long, lo int" if placed else "core long, least long, most long")


def segments_at(docs: DataFrame, width: int) -> DataFrame:
    """docs' segments that begin at `los` (array<int>): doc_id, lo, core, whole and check hashes, end nodes, windows."""
    core_words = width - SPREAD + 1

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches):
            s = Segments(block, width)
            lists = block.column("los")
            where = lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(s.first[:-1], np.diff(lists.offsets.to_numpy()))
            k = np.flatnonzero(np.isin(s.lo, where))
            lo, hi = s.lo[k], s.hi[k]
            columns = [s.ids[s.row[k]], lo - s.first[s.row[k]], s.hashed(s.at[k], s.at[k] + core_words), s.hashed(lo, hi + width), s.hashed(lo, hi + width, True), s.hashed(lo, lo + width - 1), s.hashed(hi + 1, hi + width), (hi - lo + 1).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["doc_id", "lo", "core", "whole", "check", "src", "dst", "windows"])

    return docs.select("doc_id", "text", "los").mapInArrow(shard, "doc_id long, lo long, core long, whole long, check long, src long, dst long, windows int")


def compact(edges: DataFrame) -> DataFrame:
    """(id, path, offset): the nonbranching path of each edge (id, src, dst, windows), by its first edge, and the windows before it.

    Steps double with each join, so a path of n edges takes log2(n) rounds; edges on a cycle, which has
    no first edge, stay paths of their own.
    """
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.min("id").alias("next"))
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min(F.struct("id", "windows")).alias("prev"))
    links = ins.join(outs, "node").filter("n_in = 1 AND n_out = 1 AND prev.id <> next").select(F.col("next").alias("id"), F.col("prev.id").alias("back"), F.col("prev.windows").cast("long").alias("far"))
    state = edges.select("id").join(links, "id", "left").select("id", F.coalesce("back", "id").alias("path"), F.coalesce("far", F.lit(0)).cast("long").alias("offset"), F.col("back").isNull().alias("done"))
    state = checkpointed(state)
    left = state.filter("NOT done").count()
    while left:
        to = state.select(F.col("id").alias("path"), F.col("path").alias("__path"), F.col("offset").alias("__offset"), F.col("done").alias("__done"))
        moved = state.filter("NOT done").join(to, "path").select("id", F.col("__path").alias("path"), (F.col("offset") + F.col("__offset")).alias("offset"), F.col("__done").alias("done"))
        state = checkpointed(state.filter("done").unionAll(moved))
        before, left = left, state.filter("NOT done").count()
        if left == before:
            break
    return state.select("id", F.when(F.col("done"), F.col("path")).otherwise(F.col("id")).alias("path"), F.when(F.col("done"), F.col("offset")).otherwise(F.lit(0)).alias("offset"))


def edges_of(docs: DataFrame, width: int) -> DataFrame:
    """(edge, check, doc_id, lo): single edges of docs' segments at `los` (array<struct<lo,windows>>)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches):
            s = Segments(block, width)
            lists = block.column("los")
            flat = lists.flatten()
            row = np.repeat(np.arange(block.num_rows), np.diff(lists.offsets.to_numpy()))
            lo, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "windows"))
            which = np.repeat(np.arange(len(n)), n)
            at = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            word = at + s.first[row[which]]
            yield pa.RecordBatch.from_arrays([pa.array(s.hashed(word, word + width)), pa.array(s.hashed(word, word + width, True)), pa.array(s.ids[row[which]]), pa.array(at)], ["edge", "check", "doc_id", "lo"])

    return docs.select("doc_id", "text", "los").mapInArrow(split, "edge long, check long, doc_id long, lo long")


def shared_segments(docs: DataFrame, dealt: DataFrame, width: int = WIDTH) -> DataFrame:
    """The segments whose core at least two documents hold, as segments_at() gives them. `dealt` are the same docs by doc_id."""
    met = cores(docs, width, placed=False).groupBy("core").agg(F.min("least").alias("least"), F.max("most").alias("most")).filter("least < most").select("core")
    met = checkpointed(met)  # written, it is a plain side of the join, whose other side may be split where a core is hot
    los = cores(docs, width).join(met, "core").groupBy("doc_id").agg(F.collect_list("lo").alias("los"))
    return segments_at(dealt.join(los, "doc_id"), width)


def repeated_spans(docs: DataFrame, dealt: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, runs): by document, array<struct<lo,hi>> of the starts of windows that a smaller document also holds.

    `dealt` are the same docs by doc_id, for the joins that come after the first pass.
    """
    shared = checkpointed(shared_segments(docs, dealt, width).withColumn("id", F.xxhash64("core", "whole", "check")).drop("whole", "check"))
    first = lambda c: F.first(c).alias(c)
    classes = checkpointed(shared.groupBy("id").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("most"), first("core"), first("src"), first("dst"), first("windows")))
    again = classes.filter("most > owner")
    paths = compact(again.select("id", "src", "dst", "windows"))
    marked = checkpointed(again.select("id", "owner").join(paths, "id"))
    placed = shared.select("id", "doc_id", "lo", "windows").join(marked, "id").filter("doc_id > owner")
    spans = placed.groupBy("doc_id", "path", (F.col("lo") - F.col("offset")).alias("diagonal")).agg(
        F.min("lo").alias("lo"), F.max(F.col("lo") + F.col("windows") - 1).alias("hi"), F.sum("windows").alias("n"), F.collect_list(F.struct("lo", (F.col("lo") + F.col("windows") - 1).alias("hi"))).alias("each")
    )
    long_spans = spans.select("doc_id", F.explode(F.when(F.col("n") == F.col("hi") - F.col("lo") + 1, F.array(F.struct("lo", "hi"))).otherwise(F.col("each"))).alias("run"))

    many = classes.groupBy("core").count().filter("count > 1").select("core")
    split = shared.select("id", "doc_id", "lo", "windows").join(classes.join(many, "core").select("id", F.col("owner").alias("doc_id")), ["id", "doc_id"])
    wanted = checkpointed(split.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "windows")).alias("los")))
    edges = edges_of(dealt.join(wanted, "doc_id"), width)
    least = edges.groupBy("edge", "check").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("edge", "check", "least")
    # joined by a key that the sums aren't dealt by: then both sides are exchanged for the join, and a hot edge may be split
    both = lambda df: df.withColumn("both", F.xxhash64("edge", "check"))
    singles = both(edges).join(both(least), ["both", "edge", "check"]).filter("doc_id > least").select("doc_id", F.struct("lo", F.col("lo").alias("hi")).alias("run"))
    return long_spans.unionAll(singles).groupBy("doc_id").agg(F.collect_list("run").alias("runs"))


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words left of each text, joined by one space."""
    named = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    base = named.repartition("doc_id")
    spans = repeated_spans(named, base, width)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches):
            raw, bounds = tk.text_bytes(block.column("text"))
            starts, ends, first = tk.words(raw, bounds)
            text = raw.tobytes()
            removed, kept = [], []
            for i, runs in enumerate(block.column("runs").to_pylist()):
                a, b = first[i], first[i + 1]
                gone = np.zeros(b - a + 1, np.int32)
                for r in runs or ():
                    gone[r["lo"]] += 1
                    gone[r["hi"] + width] -= 1
                keep = np.flatnonzero(np.cumsum(gone)[:-1] == 0) + a
                removed.append(int(b - a - len(keep)))
                kept.append(b" ".join([text[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist())]))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(np.diff(first)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    nameless = docs.filter(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(None).cast("array<struct<lo:long,hi:long>>").alias("runs"))
    return base.join(spans, "doc_id", "left").select("doc_id", "text", "runs").unionAll(nameless).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary")


def op7(docs: DataFrame) -> DataFrame:
    """The digest of each document without the passages of 50 words that a smaller document holds."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
