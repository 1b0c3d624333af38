"""Removal of repeated byte strings by merging the Burrows-Wheeler transforms of shards.

Sparse suffixes. Every window of `width` bytes owns one anchor: the first least hash among the 8-grams
that start in its first SPREAD places. Which place that is depends on the window's bytes alone, so equal
windows own equal anchors, and only suffixes at anchors have to be sorted (about two in SPREAD). An
anchor's windows start at lo..hi; each holds the SPREAD-independent `core` bytes from the anchor on.

1. Spark counts the anchors of each core, with partial sums; a join by core gives the anchors whose core is
   met again. The others own no repeated window and go. A hot core is one row a task in the count, and its
   side of the join may be split, as it is an ordinary skewed join.
2. For the rest each shard writes its transform: suffixes from the anchor on, sorted, with the bytes that
   precede each (the symbols of a transform, as far back as the anchor's first window). Equal entries of a
   shard are one row with their places.
3. Rows meet by core, in the order in which the shards have stored them. A merge task interleaves the
   shards' runs: entries start as one interval a core, and a round for each eight bytes that follow merges
   the runs within the intervals that still hold several entries. Then it steps backward as in merging
   transforms: step d deals the interleave of step d - 1 stably by the d-th preceding byte, which gives the
   order of the suffixes that start d bytes before the anchors from what is stored, without looking at what
   follows. Common prefixes follow along: one more than the least between two neighbours before the step,
   or none where their bytes differ. Entries that a preceding byte parts from all others end there. An
   interval of common prefixes of `width` and more at step d is a repeated window.
4. Repeated windows go back to their texts as runs.

A core that is met more than MOST_IN_CORE times isn't gathered: its windows are counted one by one by
Spark, with partial sums, which is exact too. A core is told by two 64-bit hashes of its 8-grams with bases of
their own; what is around it is compared byte by byte.

Null texts are empty; texts under `width` bytes keep everything; texts of any length are read whole, and
memory follows the longest; repeated rows count as occurrences of one another; other columns are not read.
Rows with a null doc_id can't be told apart: they take no part and keep everything. Rows that repeat a
doc_id must hold one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textkit as tk
from riskloom.llm.common import checkpointed

WIDTH = 200
SPREAD = 128
GRAM = 8
MOST_IN_CORE = 50_000


def core_bytes(width: int, spread: int = SPREAD) -> int:
    return width - spread + 1


def grams_of(raw: np.ndarray) -> np.ndarray:
    """A scrambled number for the eight bytes from each place on."""
    return tk.mix(tk.byte_grams(raw))


def anchors(grams: np.ndarray, bounds: np.ndarray, width: int, spread: int = SPREAD) -> tuple[np.ndarray, ...]:
    """(row, at, lo, hi): the anchors of all rows, with the first and last start of the windows that each owns."""
    sizes = np.diff(bounds)
    count = np.maximum(sizes - width + 1, 0)
    total = int(count.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 4
    row = np.repeat(np.arange(len(sizes)), count)
    start = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(bounds[:-1], count)
    own = tk.sliding_argmin(grams, spread)[start]
    cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (row[1:] != row[:-1])])
    last = np.r_[cut[1:], total] - 1
    return row[cut], own[cut], start[cut], start[last]


def _runs(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): a stable order by keys, and where a new value of the keys begins in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _hash(grams: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of the bytes start:end by the 8-grams in them, so that no two letters make a pattern of the bytes."""
    return tk.span_hash(*tk.rolling(grams, base), start, end - GRAM + 1).view(np.int64)


BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x2545F4914F6CDD1D)


def cores(docs: DataFrame, width: int = WIDTH, placed: bool = True) -> DataFrame:
    """(core, doc_id, at): the hash of every anchor's core and its place; or (core, n), the anchors of each in a block of texts."""
    wide = core_bytes(width)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches):
            raw, bounds = tk.text_bytes(block.column("text"))
            grams = grams_of(raw)
            row, at, _, _ = anchors(grams, bounds, width)
            if not len(at):
                continue
            core = _hash(grams, at, at + wide, BASES[0])
            if placed:
                yield pa.RecordBatch.from_arrays([pa.array(core), block.column("doc_id").take(pa.array(row)), pa.array((at - bounds[row]).astype(np.int32))], ["core", "doc_id", "at"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(core, return_counts=True)], ["core", "n"])

    return docs.select("doc_id", "text").mapInArrow(shard, "core long, doc_id long, at int" if placed else "core long, n long")


def repeated_anchors(docs: DataFrame, width: int = WIDTH, most_in_core: int = MOST_IN_CORE) -> DataFrame:
    """(doc_id, ats): by document, array<struct<at,hot>> of the anchors whose core is met at least twice; hot: more than most_in_core times."""
    met = cores(docs, width, placed=False).groupBy("core").agg(F.sum("n").alias("n")).filter("n > 1")
    met = checkpointed(met)  # written, it is a plain side of the join, whose other side may be split where a core is hot
    found = cores(docs, width).join(met, "core").select("doc_id", "at", (F.col("n") > most_in_core).alias("hot"))
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("at", "hot")).alias("ats"))


def transforms(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(core, check, stored, after, before, lo, hi, hot, places): each shard's sparse transform, for docs with a column `ats`.

    `after` are the bytes behind the core to the end of the anchor's last window, `before` those back to its
    first window in reverse; lo and hi are how far before the anchor its first and last windows start.
    `stored` numbers the shards' entries in their order.
    """
    wide = core_bytes(width)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        stored = (context.partitionId() if context else 0) << 40
        for block in tk.blocks(batches):
            raw, bounds = tk.text_bytes(block.column("text"))
            grams = grams_of(raw)
            row, at, lo, hi = anchors(grams, bounds, width)
            wanted = np.zeros(len(raw) + 1, np.int8)
            ats = block.column("ats")
            lists = ats.flatten()
            where = lists.field("at").to_numpy(zero_copy_only=False) + np.repeat(bounds[:-1], np.diff(ats.offsets.to_numpy()))
            wanted[where] = 1 + lists.field("hot").to_numpy(zero_copy_only=False)
            keep = wanted[at] > 0
            row, at, lo, hi = row[keep], at[keep], lo[keep], hi[keep]
            if not len(at):
                continue
            core, check = (_hash(grams, at, at + wide, base) for base in BASES[:2])
            whole = _hash(grams, lo, hi + width, BASES[2])
            ids = block.column("doc_id").to_numpy(zero_copy_only=False)
            order, first = _runs([core, check, whole, at - lo])
            place = np.stack([ids[row][order], (at - bounds[row])[order]], 1)
            text = raw.tobytes()
            head = order[first]
            a, l, h = at[head], lo[head], hi[head]
            after = [text[x + wide : y + width] for x, y in zip(a.tolist(), h.tolist())]
            before = [text[x:y][::-1] for x, y in zip(l.tolist(), a.tolist())]
            run = np.array(sorted(range(len(after)), key=after.__getitem__), np.int64)  # the shard's suffixes in order
            rank = np.empty(len(run), np.int64)
            rank[run] = np.arange(len(run)) + stored
            stored += len(run)
            yield pa.RecordBatch.from_arrays(
                [pa.array(core[head]), pa.array(check[head]), pa.array(rank), pa.array(after, pa.binary()), pa.array(before, pa.binary()), pa.array((a - l).astype(np.int32)), pa.array((a - h).astype(np.int32)), pa.array(wanted[a] > 1), tk.binary_pairs(first, place)],
                ["core", "check", "stored", "after", "before", "lo", "hi", "hot", "places"],
            )

    return docs.select("doc_id", "text", "ats").mapInArrow(shard, "core long, check long, stored long, after binary, before binary, lo int, hi int, hot boolean, places binary")


def _padded(strings: pa.Array, wide: int) -> np.ndarray:
    """The strings as rows of bytes, zeros beyond their ends; wide is filled up to a multiple of eight."""
    bounds = np.frombuffer(strings.buffers()[1], np.int32, len(strings) + 1 + strings.offset)[strings.offset :].astype(np.int64)
    raw = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    sizes = np.minimum(np.diff(bounds), wide)
    out = np.zeros((len(strings), max(1, -(-wide // 8)) * 8), np.uint8)
    row = np.repeat(np.arange(len(strings)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = raw[bounds[row] + at]
    return out


def interleave(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the merged order of all entries, and each one's common prefix in bytes with the one before it.

    `group` numbers the intervals at the start; entries come in the order of the shards' runs, each of which is
    sorted, so the stable sort of a round is a merge of runs. Round h looks only at intervals of several
    entries, by their h-th word of eight bytes; common is -1 where a group begins.
    """
    n = len(group)
    order = np.argsort(group, kind="stable")
    g = group[order]
    new = np.r_[True, g[1:] != g[:-1]]
    common = np.full(n, words.shape[1] * 8, np.int64)
    common[new] = -1
    for h in range(words.shape[1]):
        interval = np.cumsum(new) - 1
        size = np.bincount(interval)
        live = np.flatnonzero(size[interval] > 1)
        if not len(live):
            break
        word = words[order[live], h]
        moved = np.lexsort([word, interval[live]])
        order[live] = order[live][moved]
        word = word[moved]
        # within an interval's span the entries moved among themselves, so spans stay where they were
        part = np.flatnonzero((word[1:] != word[:-1]) & (interval[live][1:] == interval[live][:-1])) + 1
        x = word[part] ^ word[part - 1]
        common[live[part]] = h * 8 + _zero_bytes(x)
        new[live[part]] = True
    return order, common


def step_back(order: np.ndarray, common: np.ndarray, group: np.ndarray, symbol: np.ndarray, goes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of the suffixes one byte further back: the stable deal of an interleave by its preceding bytes.

    `symbol` and `goes` (whether an entry goes on) are in the interleave's order, `group` is by entry.
    """
    at = np.flatnonzero(goes)
    key = group[order[at]] * 256 + symbol[at]
    dealt = np.argsort(key, kind="stable")
    at, key = at[dealt], key[dealt]
    out = np.zeros(len(at), np.int64)
    if len(at):
        g = key >> 8
        out[np.r_[True, g[1:] != g[:-1]]] = -1
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        if len(same):
            bounds = np.stack([at[same - 1] + 1, at[same] + 1], 1).ravel()
            out[same] = 1 + np.minimum.reduceat(np.r_[common, 0], bounds)[::2]
    return order[at], out


def _zero_bytes(x: np.ndarray) -> np.ndarray:
    """The leading zero bytes of 64-bit values."""
    n = np.zeros(len(x), np.int64)
    open_ = np.ones(len(x), bool)
    for shift in range(56, -8, -8):
        open_ &= (x >> np.uint64(shift)) & np.uint64(255) == 0
        n += open_
    return n


def repeated_windows(table: pa.Table, cuts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, d): the windows of a merge's entries, by how far before their anchor they start, that are repeated."""
    wide = core_bytes(width)
    group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    lo, hi = (table.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
    n, _ = tk.pairs_of(table.column("places"))
    after, before = (_padded(table.column(c).combine_chunks(), most) for c, most in (("after", width - wide), ("before", SPREAD)))
    order, common = interleave(group, after.view(">u8").astype(np.uint64))
    common = np.where(common < 0, -1, wide + np.minimum(common, width - wide))
    entries, depths = [], []
    for d in range(int(lo.max(initial=-1)) + 1):
        if d:
            beside = np.maximum(common, np.r_[common[1:], -1])
            goes = (lo[order] >= d) & ((beside >= wide + d - 1) | (n[order] > 1))  # else a preceding byte has parted it from all others
            order, common = step_back(order, common, group, before[order, d - 1], goes)
        if not len(order):
            break
        who = hi[order] <= d
        interval = np.cumsum(common < width)[who]
        entry = order[who]
        again = np.bincount(interval, n[entry], minlength=1)[interval] > 1
        entries.append(entry[again])
        depths.append(np.full(int(again.sum()), d))
    if not entries:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(entries), np.concatenate(depths)


def _spread(places: pa.Array | pa.ChunkedArray, entry: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, lo, hi): the windows of all places of the entries, as runs of starts."""
    if not len(entry):
        return
    order = np.lexsort([-d, entry])
    entry, d = entry[order], d[order]
    first = np.flatnonzero(np.r_[True, (entry[1:] != entry[:-1]) | (d[1:] != d[:-1] - 1)])
    last = np.r_[first[1:], len(entry)] - 1
    e, far, near = entry[first], d[first], d[last]
    counts, place = tk.pairs_of(places)
    begin = np.cumsum(counts) - counts
    count = counts[e]
    which = np.repeat(np.arange(len(e)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[e], count)
    yield pa.RecordBatch.from_arrays([pa.array(place[at, 0]), pa.array((place[at, 1] - far[which]).astype(np.int32)), pa.array((place[at, 1] - near[which]).astype(np.int32))], ["doc_id", "lo", "hi"])


RUNS = "doc_id long, lo int, hi int"


def merged(entries: DataFrame, width: int = WIDTH) -> DataFrame:
    """RUNS of the starts of repeated windows, from shards' transforms."""

    def merge(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from _spread(table.column("places"), *repeated_windows(table, cuts, width))

    dealt = entries.repartition("core", "check").sortWithinPartitions("core", "check", "stored")
    return dealt.mapInArrow(tk.by_group(merge, ("core", "check"), 1 << 23), RUNS)


def counted(entries: DataFrame, width: int = WIDTH) -> DataFrame:
    """As merged(), by counting windows one by one: for cores that too many entries share."""
    rest = width - core_bytes(width)
    one = entries.select("core", "check", "before", "after", "places", F.explode(F.sequence("hi", "lo")).alias("d"))
    parts = [F.col("core"), F.col("check"), F.col("d"), F.substring("before", F.lit(1), F.col("d")), F.substring("after", F.lit(1), rest - F.col("d"))]
    keyed = one.select("places", "d", F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2"))
    twice = keyed.groupBy("h1", "h2").agg(F.sum(F.length("places")).alias("n")).filter("n > 16").select("h1", "h2")
    # joined by a key that the sums aren't dealt by: then both sides are exchanged for the join, and a hot window may be split
    both = lambda df: df.withColumn("both", F.xxhash64("h1", "h2"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _spread(b.column("places"), np.arange(b.num_rows), b.column("d").to_numpy(zero_copy_only=False).astype(np.int64))

    return both(keyed).join(both(twice), ["both", "h1", "h2"], "left_semi").select("places", "d").mapInArrow(spread, RUNS)


def repeated_runs(docs: DataFrame, dealt: DataFrame, width: int = WIDTH, most_in_core: int = MOST_IN_CORE) -> DataFrame:
    """(doc_id, runs): by document, array<struct<lo,hi>> of the starts of windows that are met at least twice.

    `dealt` are the same docs by doc_id, for the join that comes after the first pass.
    """
    ats = checkpointed(repeated_anchors(docs, width, most_in_core))
    entries = transforms(dealt.join(ats, "doc_id"), width)
    if ats.filter(F.exists("ats", lambda x: x["hot"])).limit(1).count():
        found = merged(entries.filter("NOT hot"), width).unionAll(counted(entries.filter("hot"), width))
    else:
        found = merged(entries, width)
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))


def dedup(docs: DataFrame, width: int = WIDTH, most_in_core: int = MOST_IN_CORE) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): each text without the bytes of repeated windows; spans are the runs removed."""
    named = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    base = named.repartition("doc_id")
    runs = repeated_runs(named, base, width, most_in_core)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches):
            texts = block.column("text").to_pylist()
            spans, kept = [], []
            for text, runs in zip(texts, block.column("runs").to_pylist()):
                raw = (text or "").encode()
                own: list[list[int]] = []
                for lo, hi in sorted((r["lo"], r["hi"] + width) for r in runs or ()):
                    if own and lo <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], hi)
                    else:
                        own.append([lo, hi])
                spans.append([{"s": a, "e": b} for a, b in own])
                ends = [0, *(b for _, b in own)]
                kept.append(b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in own), len(raw)])) if own else raw)
            kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    nameless = docs.filter(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("runs"))
    return base.join(runs, "doc_id", "left").select("doc_id", "text", "runs").unionAll(nameless).mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<s:long,e:long>>, kept binary")


def op5(docs: DataFrame) -> DataFrame:
    """The digest of each document's text without its repeated 200-byte strings."""
    out = dedup(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
