"""Connected components by alternating star joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import stored

#: Edges that a task hangs on their least nodes at a time, and nodes that it holds at most.
_HUNG, _HELD = 2**20, 2**21


def hung(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs that connect the same nodes, but not more in a task than it has met nodes.

    A task hangs every node on the least that its own edges connect it with.
    """
    return edges.select("a", "b").mapInArrow(_hanging, "a long, b long").distinct()


def _hanging(batches):
    v = root = np.empty(0, np.int64)
    parts, n = [], 0
    for batch in batches:
        parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= _HUNG:
            v, root = _least(v, root, parts)
            parts, n = [], 0
            if len(v) > _HELD:
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(root)], names=["a", "b"])
                v = root = np.empty(0, np.int64)
    v, root = _least(v, root, parts)
    yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(root)], names=["a", "b"])


def _least(v: np.ndarray, root: np.ndarray, parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(v, root): nodes other than their roots, the least ones that these pairs and the edges in `parts` connect them with."""
    a, b = (np.concatenate(x) for x in zip((v, root), *parts, strict=True))
    v, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, to = at[: len(a)], at[len(a) :], np.arange(len(v))
    while len(x):
        low, high = np.minimum(to[x], to[y]), np.maximum(to[x], to[y])
        apart = low < high
        x, y = x[apart], y[apart]
        np.minimum.at(to, high[apart], low[apart])
        while (to[to] != to).any():
            to = to[to]
    hangs = to < np.arange(len(v))
    return v[hangs], v[to[hangs]]


def components(edges: DataFrame) -> DataFrame:
    """(id, root): for every id of the edges (a, b), of one ordered type, the smallest id it is connected with.

    Large-star and small-star rounds in turn: each hangs the neighbours of a node on their minimum, so the
    edges turn into stars in a few rounds and never grow beyond their number at the start. A round is a
    partial minimum and a join; its result is written. Self-loops and repeated edges are allowed; edges with a
    null end join nothing, and ids only met in these or in self-loops are not returned.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.filter("a <> b").groupBy("a").agg(F.min("b").alias("m"))
        small = large.filter("a <> b").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        edges = stored(small.filter("a <> b").distinct(), over=edges)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
