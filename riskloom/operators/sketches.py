"""Sketches of the sets of nodes that reach a node (HyperLogLog), merged by numpy in the tasks of graph.closeness_by_sketches().

A sketch is 2 ** lg_k registers of a byte; a set of few nodes is kept as its ids as well, so its size is exact.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Sketches that share a row, edges that share a row (pulled, pushed), and merged sketches at a time.
TOGETHER, PULLED, PUSHED, _AT_ONCE = 256, 65_536, 262_144, 1024
#: Sketches of nodes with more edges than this are merged node by node.
_MANY = 64
#: What a row of a block holds: its edges, its nodes' sketches, or sketches sent to it by another block.
SCHEMA = pa.schema([("to", pa.int32()), ("kind", pa.string()), ("other", pa.int32()), ("v", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("deg", pa.list_(pa.int32())),
                    ("regs", pa.binary()), ("lens", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("t", pa.list_(pa.int64())), ("grown", pa.int64())])
DDL = "to int, kind string, other int, v array<long>, b array<long>, at array<int>, deg array<int>, regs binary, lens array<int>, ids array<long>, n array<long>, t array<long>, grown long"


@dataclass
class Sketches:
    """Registers of nodes v; the sizes `lens` of sets that are held as ids (-1: too many), and these ids one after the other."""

    v: np.ndarray
    regs: np.ndarray
    lens: np.ndarray
    ids: np.ndarray

    def take(self, rows: np.ndarray) -> Sketches:
        return Sketches(self.v[rows], self.regs[rows], self.lens[rows], self.ids[_places(self.lens, rows)])


def _places(lens: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where the ids of `rows` lie."""
    held = np.maximum(lens, 0).astype(np.int64)
    first, some = (np.cumsum(held) - held)[rows], held[rows]
    return np.repeat(first - (np.cumsum(some) - some), some) + np.arange(some.sum())


def alone(v: np.ndarray, lg_k: int) -> Sketches:
    """Each node's set of itself. Numbers are mixed (splitmix64), as they needn't be hashes."""
    x = v.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    rest = (x << np.uint64(lg_k)) | np.uint64(1 << (lg_k - 1))
    regs = np.zeros((len(v), 1 << lg_k), np.uint8)
    regs[np.arange(len(v)), (x >> np.uint64(64 - lg_k)).astype(np.int64)] = 65 - np.frexp(rest.astype(np.float64))[1]
    return Sketches(v, regs, np.ones(len(v), np.int32), v)


def sizes(regs: np.ndarray) -> np.ndarray:
    """Estimated set sizes, by Ertl's improved estimator, which has no bias for small or large sets."""
    m = regs.shape[1]
    share = np.ldexp(1.0, -np.arange(256))
    share[0] = 0
    out = np.empty(len(regs))
    for i in range(0, len(regs), TOGETHER):
        x = regs[i : i + TOGETHER]
        z, y = (x == 0).sum(axis=1) / m, 1.0
        sigma, before = z.copy(), np.full(len(z), -1.0)
        while (sigma != before).any() and (z < 1).all():
            z, before = z * z, sigma
            sigma, y = sigma + z * y, 2 * y
        out[i : i + TOGETHER] = m * m / (2 * np.log(2)) / (share[x].sum(axis=1) + m * sigma)
    return out


def _united(k: np.ndarray, lens: np.ndarray, ids: np.ndarray, regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lens, ids) of the nodes with these registers, each the union of the sets whose row says k; -1 where any is, or the union is large."""
    most = regs.shape[1] // 16
    few = np.empty(len(regs), bool)
    for i in range(0, len(regs), TOGETHER):
        few[i : i + TOGETHER] = (regs[i : i + TOGETHER] != 0).sum(axis=1) <= most
    few[k[lens < 0]] = False
    rows = np.flatnonzero(few[k])
    pairs = np.stack([np.repeat(k[rows], lens[rows]), ids[_places(lens, rows)]])
    pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
    if pairs.shape[1]:
        pairs = pairs[:, np.concatenate(([True], (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)))]
    n = np.bincount(pairs[0], minlength=len(regs))
    few &= n <= most
    return np.where(few, n, -1).astype(np.int32), pairs[1][few[pairs[0]]]


def merged(of: Sketches, at: np.ndarray, deg: np.ndarray, v: np.ndarray) -> Sketches:
    """The sketches of v: each the union of as many rows of `of` as its degree, taken from `at` one after the other."""
    keep = deg > 0
    v, deg = v[keep], deg[keep].astype(np.int64)
    regs = np.empty((len(v), of.regs.shape[1]), np.uint8)
    first, order = np.cumsum(deg) - deg, np.argsort(-deg, kind="stable")
    many = int((deg > _MANY).sum())
    for k in order[:many]:
        regs[k] = 0
        for i in range(first[k], first[k] + deg[k], _AT_ONCE):
            np.maximum(regs[k], of.regs[at[i : min(i + _AT_ONCE, first[k] + deg[k])]].max(axis=0), out=regs[k])
    for i in range(many, len(order), _AT_ONCE):
        some = order[i : i + _AT_ONCE]
        sums = of.regs[at[first[some]]]
        for j in range(1, deg[some[0]]):
            more = some[deg[some] > j]
            np.maximum(sums[: len(more)], of.regs[at[first[more] + j]], out=sums[: len(more)])
        regs[some] = sums
    small = np.flatnonzero(np.bincount(np.repeat(np.arange(len(v)), deg), of.lens[at] < 0, len(v)) == 0)
    lens, ids = np.full(len(v), -1, np.int32), np.empty(0, np.int64)
    if len(small):
        rows = at[_places(deg, small)]
        lens[small], ids = _united(np.repeat(np.arange(len(small)), deg[small]), of.lens[rows], of.ids[_places(of.lens, rows)], regs[small])
    return Sketches(v, regs, lens, ids)


def arranged(group: pa.Table) -> pa.Table:
    """Rows of the edges (p, q, a, b) from block p to block q, in the form that sends fewer sketches.

    Pulled: sketches of their a's go to q. Pushed: p merges those of each b and sends the sum.
    """
    p, q = group["p"][0].as_py(), group["q"][0].as_py()
    (a, x), (b, y) = (np.unique(group[c].to_numpy(), return_inverse=True) for c in ("a", "b"))
    pull = np.bincount(x)[x] > np.bincount(y)[y]
    rows = [{"to": p, "other": q, "kind": "send", "v": a[np.bincount(x[pull], minlength=len(a)) > 0]}]
    order = np.argsort(y, kind="stable")
    for kind, own, other, these, most in (("pull", q, p, order[pull[order]], PULLED), ("push", p, q, order[~pull[order]], PUSHED)):
        for i in range(0, len(these), most):
            some = these[i : i + most]
            met, deg = np.bincount(x[some], minlength=len(a)) > 0, np.bincount(y[some], minlength=len(b))
            rows.append({"to": own, "other": other, "kind": kind, "v": a[met], "b": b[deg > 0], "at": (np.cumsum(met) - 1)[x[some]], "deg": deg[deg > 0]})
    return pa.Table.from_batches([_row(x) for x in rows if len(x["v"])], SCHEMA)


def _row(x: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.get(f.name)], f.type) for f in SCHEMA], schema=SCHEMA)


def _packed(s: Sketches, **more):
    """Rows of sketches, compressed, like ones next to each other; columns of `more` that are arrays go along."""
    order = np.argsort(np.ascontiguousarray(s.regs[:, :8]).view(">u8")[:, 0], kind="stable")
    held = np.maximum(s.lens, 0).astype(np.int64)
    first = np.cumsum(held) - held
    for i in range(0, len(order), TOGETHER):
        rows = order[i : i + TOGETHER]
        some = held[rows]
        ids = s.ids[np.repeat(first[rows] - (np.cumsum(some) - some), some) + np.arange(some.sum())]
        cut = {k: x[rows] if isinstance(x, np.ndarray) else x for k, x in more.items()}
        cut["grown"] = int(cut["grown"].sum()) if "grown" in cut else None
        yield _row({"v": s.v[rows], "regs": pa.compress(s.regs[rows].tobytes(), codec="zstd", asbytes=True), "lens": s.lens[rows], "ids": ids} | cut)


def _unpacked(rows: list[dict], lg_k: int) -> Sketches:
    """The sketches of rows, by v."""
    v, lens, ids = (np.concatenate([x[c] for x in rows]) for c in ("v", "lens", "ids"))
    order, m, i = np.argsort(v), 1 << lg_k, 0
    regs, place = np.empty((len(v), m), np.uint8), np.empty(len(v), np.int64)
    place[order] = np.arange(len(v))
    for x in rows:
        k = len(x["v"])
        regs[place[i : i + k]] = np.frombuffer(pa.decompress(x["regs"], k * m, "zstd"), np.uint8).reshape(k, m)
        i += k
    return Sketches(v[order], regs, lens[order], ids[_places(lens, order)])


def _rows(batch: pa.RecordBatch):
    for i in range(batch.num_rows):
        cells = ((f.name, batch.column(f.name)[i]) for f in SCHEMA)
        yield {k: x.values.to_numpy() if isinstance(x, pa.ListScalar) else x.as_buffer() if isinstance(x, pa.BinaryScalar) and not isinstance(x, pa.StringScalar) else x.as_py() for k, x in cells if x.is_valid}


def _incoming(rows: dict, lg_k: int):
    """Sketches sent to the block: sums, and those that its own edges merge."""
    for x in rows["sum"]:
        yield _unpacked([x], lg_k)
    sent = defaultdict(list)
    for x in rows["sent"]:
        sent[x["other"]].append(x)
    edges = defaultdict(list)
    for x in rows["pull"]:
        edges[x["other"]].append(x)
    for other, some in sent.items():
        of = _unpacked(some, lg_k)
        for x in edges[other]:
            k = np.minimum(np.searchsorted(of.v, x["v"]), len(of.v) - 1)
            yield _along(of, np.where(of.v[k] == x["v"], k, -1), x)


def _along(of: Sketches, k: np.ndarray, x: dict) -> Sketches:
    """The sketches of a row of edges merged by its b's; k are the rows of its a's in `of`, -1 for those left out."""
    at = k[x["at"]]
    kept = at >= 0
    return merged(of, at[kept], np.add.reduceat(kept, np.cumsum(x["deg"]) - x["deg"], dtype=np.int64), x["b"])


def stepped(step: int, lg_k: int, send: bool):
    """A function of a block's rows in a step: its nodes' sketches after it, and what they send along edges if they grew."""

    def of(batches):
        rows = defaultdict(list)
        for batch in batches:
            for x in _rows(batch):
                rows[x["kind"]].append(x)
                to = x["to"]
        if not rows["node"] and not rows["state"]:
            return
        if step == 0:
            s = alone(np.sort(np.concatenate([x["v"] for x in rows["node"]])), lg_k)
            n, t, grown = np.ones(len(s.v), np.int64), np.zeros(len(s.v), np.int64), np.ones(len(s.v), bool)
        else:
            s, n, t, grown = _grown(rows, step, lg_k)
        yield from _packed(s, to=to, kind="state", n=n, t=t, grown=grown)
        if not send or not grown.any():
            return
        for x in rows["push"]:
            k = np.searchsorted(s.v, x["v"])
            yield from _packed(_along(s, np.where(grown[k], k, -1), x), to=x["other"], other=to, kind="sum")
        for x in rows["send"]:
            k = np.searchsorted(s.v, x["v"])
            yield from _packed(s.take(k[grown[k]]), to=x["other"], other=to, kind="sent")

    return of


def _grown(rows: dict, step: int, lg_k: int) -> tuple[Sketches, np.ndarray, np.ndarray, np.ndarray]:
    """(sketches, n, t, which grew) of a block's nodes with what was sent to them."""
    s = _unpacked(rows["state"], lg_k)
    order = np.argsort(np.concatenate([x["v"] for x in rows["state"]]))
    n, t = (np.concatenate([x[c] for x in rows["state"]])[order] for c in ("n", "t"))
    grown, sets = np.zeros(len(s.v), bool), [(np.arange(len(s.v)), s.lens, s.ids)]
    for x in _incoming(rows, lg_k):
        k = np.searchsorted(s.v, x.v)
        for i in range(0, len(k), TOGETHER):
            some, y = k[i : i + TOGETHER], x.regs[i : i + TOGETHER]
            grown[some] |= (y > s.regs[some]).any(axis=1)
            s.regs[some] = np.maximum(s.regs[some], y)
        sets.append((k, x.lens, x.ids))
    before = s.lens
    s.lens, s.ids = _united(*(np.concatenate(x) for x in zip(*sets, strict=True)), s.regs)
    grown |= s.lens != before
    now = n.copy()
    k = np.flatnonzero(grown)
    now[k] = np.maximum(n[k], np.where(s.lens[k] >= 0, s.lens[k], np.rint(sizes(s.regs[k])))).astype(np.int64)
    return s, now, t + step * (now - n), grown
