"""SimHash fingerprints, linked within a few bits by BK-trees of shards.

1. A text's fingerprint has each bit that over half of its shingle hashes have. Rows of one fingerprint are one node.
2. Two fingerprints that differ in at most `radius` of 64 bits agree in all of some pieces: with the bits cut into
   `radius` + c pieces, in c of them at least. Every choice of c pieces is a shard of all fingerprints with the same bits
   there; more pieces are taken where there are more fingerprints, so that shards stay small. None is lost by that.
3. Members of a shard are dealt into blocks of about BLOCK, and every pair of blocks is a group: the tree of the one
   block is sent to the members of the other. In a BK-tree a child hangs on its parent by their distance; a search
   only follows the edges within the radius of its own distance to the node. The trees of all groups in a task are
   built and searched level by level at once.
4. A group's links leave it as edges to the least member of its parts, at most one for each member, however dense the
   links are. Components over all edges give the classes.

Trees are sent by exchange with their shard and never to every task, as no count bounds them. Work in a shard of n
fingerprints in a small ball is that of n ** 2 / 2 pairs, dealt to (n / BLOCK) ** 2 / 2 groups; equal fingerprints are
one from the start.

Texts of fewer words than a shingle are one shingle of them all; null texts and texts without words have fingerprint
zero, which links like any other. Texts of any length are read whole, in pieces. Rows that repeat a doc_id are judged
each by its own text. Rows with a null doc_id have a fingerprint but no component, and link nothing. Columns besides
doc_id and text are not read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textkit as tk
from riskloom.operators.stars import components
from riskloom.session import forget, stored

SIZE = 3
SEED = 42
RADIUS = 3
#: Members of a shard's block, and those a shard should have at most on average before more pieces are taken.
BLOCK = 4096
SHARD = 256
#: Bytes of a text hashed at once, and pairs of a search and a node.
PIECE = 1 << 20
PAIRS = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: What a group is told by.
GROUP = ("key", "one", "two")


def shingles(raw: bytes, size: int = SIZE, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The word shingles of a text, repeats included, in lists of about `piece` bytes of text."""
    at, held, none = 0, [], True
    raw = raw.lower()  # A-Z alone, as these are bytes
    while at < len(raw):
        end = at + piece
        cut = _BLANK.search(raw, end) if end < len(raw) else None
        end = cut.start() if cut else len(raw)
        words = held + raw[at:end].split()  # at the six blanks of _BLANK
        if len(words) >= size:
            none = False
            yield [b" ".join(x) for x in zip(*(words[k:] for k in range(size)))]
        held = words[-(size - 1) :] if size > 1 else []
        at = end
    if none and held:
        yield [b" ".join(held)]


def fingerprint(text: str | None, size: int = SIZE) -> int:
    """The SimHash of a text, unsigned."""
    ones, n = np.zeros(64, np.int64), 0
    for some in shingles((text or "").encode(), size):
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in some), np.uint64, len(some))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(some)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]) if n else 0


def signed(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, code) of every row; code is the fingerprint as a signed number."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in batches:
            codes = np.fromiter((fingerprint(x.as_py(), size) for x in block.column("text")), np.uint64, block.num_rows)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(codes.view(np.int64))], ["doc_id", "code"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, code long")


def masks(radius: int, pieces: int) -> list[int]:
    """The bits of every choice of pieces that two codes within the radius may agree in; one choice at least fits any such two."""
    bounds = [64 * k // pieces for k in range(pieces + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(bounds, bounds[1:])]
    return [sum(c) for c in itertools.combinations(own, pieces - radius)]


def pieces_for(n: int, radius: int, shard: int = SHARD) -> int:
    """The fewest pieces with which n random codes come to at most `shard` a shard, and at most three pieces to agree in."""
    for agree in (1, 2, 3):
        if n <= shard * 2 ** (64 * agree // (radius + agree)):
            break
    return radius + agree


def _shard(c: int, mask: int) -> Column:
    return F.xxhash64(F.lit(c), F.col("code").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))


def forest(codes: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(link, child), sorted by link: BK-trees of distinct codes whose root is each code's head; link is 65 * parent + distance."""
    rest = np.flatnonzero(head != np.arange(len(codes)))
    parent = head[rest]
    links, children = [], []
    while len(rest):
        link = parent * 65 + np.bitwise_count(codes[rest] ^ codes[parent])
        order = np.argsort(link, kind="stable")
        rest, link = rest[order], link[order]
        first = np.r_[True, link[1:] != link[:-1]]
        links.append(link[first])
        children.append(rest[first])
        parent = rest[first][np.cumsum(first) - 1][~first]
        rest = rest[~first]
    if not links:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    link, child = np.concatenate(links), np.concatenate(children)
    order = np.argsort(link)
    return link[order], child[order]


def search(codes: np.ndarray, link: np.ndarray, child: np.ndarray, query: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) pairs within the radius, level by level: each query goes down the tree of its root."""
    node = root
    while len(query):
        d = np.bitwise_count(codes[query] ^ codes[node]).astype(np.int64)
        near = d <= radius
        yield query[near], node[near]
        a = np.searchsorted(link, node * 65 + np.maximum(d - radius, 0), "left")
        b = np.searchsorted(link, node * 65 + np.minimum(d + radius, 64), "right")
        n = b - a
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        query, node = np.repeat(query, n), child[at]


def join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The roots of a forest, each the least of its tree, after the links a - b."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _linker(radius: int, pairs: int) -> Callable:
    """Edges from each linked member of a group to the least member of its part of the group."""

    def link(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        one, two, block = (table.column(c).to_numpy() for c in ("one", "two", "block"))
        code = table.column("code").to_numpy().view(np.uint64)
        n = len(code)
        group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        inner = block == one  # members of the tree; the others only search
        held = np.flatnonzero(inner)
        head = np.full(len(cuts) - 1, -1)
        head[group[held[::-1]]] = held[::-1]
        own = np.where(inner, head[group], np.arange(n))
        links, child = forest(code, own)
        asks = np.flatnonzero((block == two) & (head[group] >= 0))
        size = np.bincount(group[held], minlength=len(cuts) - 1)[group[asks]]
        part = (np.cumsum(size) - size) // pairs
        root = np.arange(n)
        for asked in np.split(asks, np.flatnonzero(np.diff(part)) + 1):
            for q, node in search(code, links, child, asked, head[group[asked]], radius):
                root = join(root, q, node)
        moved = np.flatnonzero(root != np.arange(n))
        yield pa.RecordBatch.from_arrays([pa.array(code[moved].view(np.int64)), pa.array(code[root[moved]].view(np.int64))], ["a", "b"])

    return link


def links(codes: DataFrame, radius: int = RADIUS, pieces: int | None = None, block: int = BLOCK, pairs: int = PAIRS) -> DataFrame:
    """(a, b): edges over distinct codes (code) whose components are those of all pairs within the radius."""
    pieces = pieces or pieces_for(codes.count(), radius)
    keys = F.array(*[_shard(c, m) for c, m in enumerate(masks(radius, pieces))])
    keyed = codes.select("code", F.explode(keys).alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))  # written, so that hot sides of joins may be split
    placed = keyed.join(shared, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("code", F.lit(1)), F.col("blocks")).cast("int"))
    paired = placed.select("key", "code", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    grouped = paired.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "code").repartition(*GROUP).sortWithinPartitions(*GROUP)
    found = stored(grouped.mapInArrow(tk.by_group(_linker(radius, pairs), GROUP), "a long, b long"))
    forget(shared)
    return found


def near_fingerprints(docs: DataFrame, size: int = SIZE, radius: int = RADIUS, **how) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_same): a row for each of docs; fingerprint is 16 hexadecimal digits, component_id the
    smallest doc_id reachable over links of fingerprints, and n_same the named rows of an equal fingerprint."""
    all_rows = stored(signed(docs, size))
    codes = stored(all_rows.filter(F.col("doc_id").isNotNull()).groupBy("code").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_same")))
    edges = links(codes.select("code"), radius, **how)
    roots = components(edges).select(F.col("id").alias("code"), "root")
    linked = codes.join(roots, "code", "left").withColumn("root", F.coalesce("root", "code"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(linked.select("code", "root", "n_same").join(least, "root").select("code", "component_id", "n_same"))
    forget(edges, codes)
    named = all_rows.join(classes, "code", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return named.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), own, F.when(F.col("doc_id").isNotNull(), F.col("n_same")).alias("n_same"))


def op11(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint and the smallest doc_id that links of fingerprints lead to."""
    return near_fingerprints(docs)
