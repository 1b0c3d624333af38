"""Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, with a linear hinge-loss model.

Features are hashed indicators of byte 4-grams, words, word pairs and the share of words equal to the one
before. The model is fitted on a sample of labelled rows of at most SAMPLE_ROWS (those of the smallest
hash of their key), dealt into BLOCKS: each block runs dual coordinate descent on its own rows against
the common weights, and the blocks' changes are averaged after each round. What the driver holds is
bounded by parameters: 2 ** BITS weights and a dual variable a sample row. Scoring is one narrow pass.

Null and empty texts have no features and get the intercept's score; texts of any length are read whole;
repeated rows and null keys are scored row by row, and a null key is never held out. Labels without a key, text
or value are left out; of equal hashes the smaller key is sampled first. Other columns are not read. With labels
of one class only, every score is that class's; without any it is a half.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textkit as tk
from riskloom.llm.common import checkpointed

BITS = 18
SAMPLE_ROWS = 12_000
BLOCKS = 8
ROUNDS = 6
#: The model's costs of a mistake, by class; a row that should stay weighs as much as one that should go.
COST = 1.0


def features(block: pa.RecordBatch, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature): the distinct features of a block's texts, by row."""
    raw, bounds = tk.text_bytes(block.column("text"))
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(len(sizes)), sizes)
    shift = np.uint64(64 - bits)
    ok = np.arange(len(raw)) + 4 <= bounds[1:][row]
    grams = tk.mix(tk.byte_grams(raw)[ok] & np.uint64(0xFFFFFFFF)) >> shift
    starts, ends, first = tk.words(raw, bounds)
    words = tk.word_hashes(raw, starts, ends)
    at = np.repeat(np.arange(len(sizes)), np.diff(first))
    pair = at[1:] == at[:-1]
    with np.errstate(over="ignore"):
        pairs = tk.mix(words[1:] * np.uint64(3) + words[:-1])[pair] >> shift
    same = np.bincount(at[1:][pair & (words[1:] == words[:-1])], minlength=len(sizes))
    some = np.flatnonzero(np.diff(first) > 1)
    again = tk.mix((np.uint64(977) + (10 * same[some] // np.diff(first)[some]).astype(np.uint64))) >> shift
    code = np.concatenate([(row[ok] << bits) | grams.astype(np.int64), (at << bits) | (words >> shift).astype(np.int64), (at[1:][pair] << bits) | pairs.astype(np.int64), (some << bits) | again.astype(np.int64)])
    code = np.unique(code)
    return code >> bits, code & ((1 << bits) - 1)


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))), margin = sum of weights / sqrt(features) + intercept."""

    weights: np.ndarray  # log-count ratios times fitted weights
    intercept: float
    slope: float
    shift: float
    bits: int = BITS

    def margins(self, block: pa.RecordBatch) -> np.ndarray:
        row, f = features(block, self.bits)
        n = np.bincount(row, minlength=block.num_rows)
        return np.bincount(row, self.weights[f], block.num_rows) / np.sqrt(np.maximum(n, 1)) + self.intercept

    def scores(self, block: pa.RecordBatch) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(block) + self.shift, -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, key: str, label: str, rows: int, bits: int) -> DataFrame:
    """(y, f): the sample's labels and features (int32 bytes), in BLOCKS partitions.

    The keys are chosen from the labels alone, at most `rows` of them, and so can be broadcast; only their
    texts are moved.
    """
    given = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("__key"), F.col(label).cast("int").alias("y"))
    chosen = given.orderBy(F.xxhash64("__key"), "__key", "y").limit(rows)
    own = docs.select(F.col(key).alias("__key"), "text").join(F.broadcast(chosen), "__key").select("y", "text")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.blocks(batches):
            row, f = features(b, bits)
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))
            data = f.astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([data[x:y].tobytes() for x, y in zip(ends, ends[1:])], pa.binary())], ["y", "f"])

    return checkpointed(own.repartition(BLOCKS).mapInArrow(featured, "y int, f binary"))


def _each_block(sample: DataFrame, work: Callable[[int, np.ndarray, list[np.ndarray]], dict], schema: str) -> list:
    """work(block, labels, features) on every partition of the sample, where it lies; a row from each, BLOCKS in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]  # a block is at most the bounded sample
        if held:
            table = pa.Table.from_batches(held)
            fs = [np.frombuffer(x, np.int32) for x in table.column("f").to_pylist()]
            out = work(TaskContext.get().partitionId(), table.column("y").to_numpy(), fs)
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in out.items()})

    return sample.mapInArrow(run, schema).collect()


def _descent(ratio: np.ndarray, costs: dict[int, float], w0: np.ndarray, b0: float, duals: dict, turn: int) -> Callable:
    """A round of dual coordinate descent on a block's rows, from the common weights."""

    def descend(block: int, y: np.ndarray, fs: list[np.ndarray]) -> dict:
        alpha = np.zeros(len(y)) if duals[block] is None else duals[block].copy()
        w, b = w0.copy(), b0
        for i in np.random.default_rng(turn * 1000 + block).permutation(len(y)):
            f = fs[i]
            if not len(f):
                continue
            x = ratio[f] / np.sqrt(len(f))
            s = 1.0 if y[i] else -1.0
            gain = 1 - s * (w[f] @ x + b)
            new = min(max(alpha[i] + gain / (x @ x + 1), 0.0), costs[int(y[i])])
            step = (new - alpha[i]) * s
            if step:
                alpha[i] = new
                w[f] += step * x
                b += step
        margins = np.array([w0[f] @ (ratio[f] / np.sqrt(max(len(f), 1))) + b0 for f in fs])
        return {"block": block, "dw": (w - w0).tobytes(), "db": float(b - b0), "alpha": alpha.tobytes(), "margin": margins.tobytes(), "y": y.astype(np.int8).tobytes()}

    return descend


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", rows: int = SAMPLE_ROWS, bits: int = BITS, rounds: int = ROUNDS, cost: float = COST) -> Model:
    """Fit on the labelled rows of docs, `rows` at most. Rows without a text or label are left out."""
    sample = _sample(docs, labels, key, label, rows, bits)
    size = 1 << bits

    def count(block: int, y: np.ndarray, fs: list[np.ndarray]) -> dict:
        sums = [np.bincount(np.concatenate([f for f, v in zip(fs, y) if v == c] or [np.zeros(0, np.int32)]), minlength=size).astype(np.int64).tobytes() for c in (0, 1)]
        return {"block": block, "p": sums[1], "q": sums[0], "pos": int(y.sum()), "neg": int((1 - y).sum())}

    counted = _each_block(sample, count, "block long, p binary, q binary, pos long, neg long")
    p, q = (sum((np.frombuffer(r[c], np.int64) for r in counted), np.zeros(size, np.int64)) + 1.0 for c in ("p", "q"))
    pos, neg = sum(r.pos for r in counted), sum(r.neg for r in counted)
    if not pos or not neg:
        return Model(np.zeros(size), 0.0, 0.0, 8.0 if pos else -8.0 if neg else 0.0, bits)
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    costs = {1: cost * (pos + neg) / (2 * pos), 0: cost * (pos + neg) / (2 * neg)}

    weights, bias, duals = np.zeros(size), 0.0, {r.block: None for r in counted}
    for turn in range(rounds):
        out = _each_block(sample, _descent(ratio, costs, weights, bias, duals, turn), "block long, dw binary, db double, alpha binary, margin binary, y binary")
        share = 1 / len(out)
        weights = weights + share * sum(np.frombuffer(r.dw, np.float64) for r in out)
        bias += share * sum(r.db for r in out)
        # the averaged step keeps weights = sum of alpha * y * x
        duals = {r.block: (np.frombuffer(r.alpha, np.float64) * share + (duals[r.block] if duals[r.block] is not None else 0) * (1 - share)) for r in out}
    margin = np.concatenate([np.frombuffer(r.margin, np.float64) for r in out])
    y = np.concatenate([np.frombuffer(r.y, np.int8) for r in out])
    slope, shift = _sigmoid(margin, y)
    return Model(ratio * weights, bias, slope, shift, bits)


def _sigmoid(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and shift, by Newton steps on smoothed targets."""
    pos, neg = int((y == 1).sum()), int((y == 0).sum())
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    w = np.array([1.0, np.log((pos + 1) / (neg + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p))
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(w[0], 0.0)), float(w[1])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row of docs."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.blocks(batches):
            yield pa.RecordBatch.from_arrays([b.column("key").cast(pa.int64()), pa.array(model.scores(b))], [key, "score"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(scored, f"{key} long, score double")


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each document's quality score, from a model of the labelled documents that aren't held out."""
    held = lambda: F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = fit(docs.select("doc_id", "text"), labels.filter(~held()))
    out = score(docs, model)
    return out.select("doc_id", held().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
