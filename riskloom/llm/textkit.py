"""Arrow text columns as byte arrays: blocks of rows, word bounds, rolling hashes and sliding minima.

Everything is a few array passes over a block of about `most` bytes, so memory is bounded by the block
(or the longest text, where one row is larger).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Space, tab, line feed, vertical tab, form feed, carriage return.
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batches' rows, in blocks of about `most` bytes of text, a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds): the column's UTF-8 bytes end to end, row i at bounds[i]:bounds[i + 1]; nulls are empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, powers) with which span_hash() gives the hash of any span of `values` modulo 2 ** 64."""
    n = len(values)
    powers = np.empty(n + 1, np.uint64)
    powers[0] = 1
    with np.errstate(over="ignore"):
        np.cumprod(np.full(n, base, np.uint64), out=powers[1:])
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * powers[:n], out=sums[1:])
    return sums, powers


def span_hash(sums: np.ndarray, inverses: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span start:end, equal for spans of equal content and length."""
    with np.errstate(over="ignore"):
        raw = (sums[end] - sums[start]) * inverses[start]
        return mix(raw + (end - start).astype(np.uint64) * _ODD)


def rolling(values: np.ndarray, base: int = 0xD6E8FEB86659FD93) -> tuple[np.ndarray, np.ndarray]:
    """(sums, inverses) for span_hash(); base is odd, so its powers have inverses modulo 2 ** 64."""
    sums, _ = prefix_sums(values, base)
    inverse = pow(base, -1, 1 << 64)
    inverses = np.empty(len(values) + 1, np.uint64)
    inverses[0] = 1
    with np.errstate(over="ignore"):
        np.cumprod(np.full(len(values), inverse, np.uint64), out=inverses[1:])
    return sums, inverses


def words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte bounds of every word, and the first word of each row (one more at the end)."""
    solid = ~_BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = solid
    here = np.zeros(len(raw) + 1, bool)
    here[:-1] = solid
    starts = np.flatnonzero(here & (~before | edge))
    ends = np.flatnonzero(before & (~here | edge))
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes: the sum of its scrambled eight-byte pieces, each with its place; other salts give independent ones."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    count = (sizes + 7) >> 3
    first = np.cumsum(count) - count
    which = np.repeat(np.arange(len(starts)), count)
    step = np.arange(len(which)) - first[which]
    place = starts[which] + 8 * step
    left = np.minimum(ends[which] - place, 8).astype(np.uint64)
    piece = byte_grams(raw)[place] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
    with np.errstate(over="ignore"):
        keyed = mix(piece + (step.astype(np.uint64) + np.uint64(1)) * _ODD + np.uint64(salt))
        keyed = mix(keyed ^ (left + np.uint64(salt >> 7)))
        return mix(np.add.reduceat(keyed, first) + sizes.astype(np.uint64))


def byte_grams(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; beyond the end come zeros."""
    n = len(raw)
    x = np.zeros(n + 8, np.uint64)
    x[:n] = raw
    for step in (1, 2, 4):
        x[:-step] |= x[step:] << np.uint64(8 * step)
    return x[:n]


def sliding_argmin(values: np.ndarray, width: int, bits: int = 26) -> np.ndarray:
    """For each start p the place of the first least value in p:p + width; the lowest `bits` bits of values don't count.

    Places share a number with the values, so arrays of 2 ** bits values and more go in pieces that overlap by `width`.
    """
    most = (1 << bits) - width
    if len(values) > most + width:
        return np.concatenate([sliding_argmin(values[a : a + most + width - 1], width, bits)[:most] + a for a in range(0, len(values), most)])
    low = np.uint64((1 << bits) - 1)
    m = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    done = 1
    while done < width:
        step = min(done, width - done)
        m[:-step] = np.minimum(m[:-step], m[step:]) if step < len(m) else m[:-step]
        done += step
    return (m & low).astype(np.int64)


def by_group(work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], keys: tuple[str, ...], most: int = 1 << 24) -> Callable:
    """A mapInArrow function over rows sorted by `keys`: work(rows, bounds of groups) on whole groups, of about `most` bytes at once.

    Tables given to work have their own buffers, from offset 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size < most:
                continue
            table = pa.Table.from_batches(held)
            cuts = bounds(table)
            if len(cuts) > 2:
                yield from work(_own(table.slice(0, cuts[-2])), cuts[:-1])
                table = _own(table.slice(cuts[-2]))
            held, size = table.to_batches(), table.nbytes
        if held and sum(b.num_rows for b in held):
            table = _own(pa.Table.from_batches(held))
            yield from work(table, bounds(table))

    def bounds(table: pa.Table) -> np.ndarray:
        columns = [table.column(c).to_numpy() for c in keys]
        return np.r_[0, np.flatnonzero(np.any([k[1:] != k[:-1] for k in columns], axis=0)) + 1, table.num_rows]

    return run


def _own(table: pa.Table) -> pa.Table:
    return table.combine_chunks().take(pa.array(np.arange(table.num_rows)))


def binary_pairs(first: np.ndarray, pairs: np.ndarray) -> pa.Array:
    """A binary column of int64 pairs: row i holds those from first[i] to the next row's."""
    ends = np.r_[first, len(pairs)].astype(np.int32) * np.int32(16)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(pairs, np.int64))])


def pairs_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, pairs) of such a column."""
    raw = column.to_pylist()
    return np.array([len(x) // 16 for x in raw], np.int64), np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
