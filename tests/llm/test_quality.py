"""The quality classifier against plain versions of its parts, and its edge cases."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from riskloom.llm import quality_model as Q
from riskloom.llm import textkit as tk

U = np.uint64


def one_hash(word: bytes) -> int:
    raw = np.frombuffer(word, np.uint8)
    return int(tk.word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def mixed(x: int) -> int:
    return int(tk.mix(np.array([x % 2**64], U))[0])


def plain_features(text: str | None, bits: int) -> set[int]:
    raw = (text or "").encode()
    shift = 64 - bits
    out = {mixed(int.from_bytes(raw[i : i + 4], "little")) >> shift for i in range(len(raw) - 3)}
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    h = [one_hash(w) for w in words]
    out |= {x >> shift for x in h}
    out |= {mixed(b * 3 + a) >> shift for a, b in zip(h, h[1:])}
    if len(words) > 1:
        out.add(mixed(977 + 10 * sum(a == b for a, b in zip(words, words[1:])) // len(words)) >> shift)
    return out


def texts(n: int, seed: int = 1) -> list[tuple[str, int]]:
    rnd = random.Random(seed)
    good, bad = [f"fine{i}" for i in range(30)], [f"poor{i}" for i in range(30)]
    both = [f"word{i}" for i in range(60)]
    out = []
    for i in range(n):
        y = i % 2
        out.append((" ".join(rnd.choice((good if y else bad) if rnd.random() < 0.15 else both) for _ in range(40)), y))
    return out


def test_features():
    some = [None, "", "a", "abc", "abcd", "one one two one one", "é漢字 \n\t x", "x" * 500]
    some += [t for t, _ in texts(10)]
    block = pa.RecordBatch.from_pydict({"text": pa.array(some, pa.string())})
    for bits in (12, 18):
        row, f = Q.features(block, bits)
        assert [set(f[row == i].tolist()) for i in range(len(some))] == [plain_features(t, bits) for t in some]


def test_descent_reaches_the_optimum():
    """Dual coordinate descent closes the gap between the primal and the dual of the scaled indicators' hinge loss."""
    bits, rows = 12, texts(80)
    fs = [np.array(sorted(plain_features(t, bits)), np.int32) for t, _ in rows]
    y = np.array([y for _, y in rows])
    count = lambda c: np.bincount(np.concatenate([f for f, v in zip(fs, y) if v == c]), minlength=1 << bits) + 1.0
    p, q = count(1), count(0)
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    costs, w, b, duals = {1: 1.0, 0: 1.0}, np.zeros(1 << bits), 0.0, {0: None}
    for turn in range(60):
        out = Q._descent(ratio, costs, w, b, duals, turn)(0, y, fs)
        w, b = w + np.frombuffer(out["dw"], np.float64), b + out["db"]
        duals = {0: np.frombuffer(out["alpha"], np.float64)}
    alpha, s = duals[0], np.where(y == 1, 1.0, -1.0)
    x = np.array([np.bincount(f, minlength=1 << bits) * ratio / np.sqrt(len(f)) for f in fs])
    assert np.allclose(w, (alpha * s) @ x) and np.isclose(b, alpha @ s) and (alpha >= 0).all() and (alpha <= 1).all()
    norm = (w @ w + b * b) / 2
    primal = norm + np.maximum(0, 1 - s * (x @ w + b)).sum()
    dual = alpha.sum() - norm
    assert abs(primal - dual) < 1e-3 * primal


def test_scores_by_hand(spark):
    """A fitted model's scores are the sigmoid of its scaled weights' mean over the plain features."""
    rows = texts(200)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int")
    model = Q.fit(docs, labels.filter("doc_id < 150"), bits=12)
    got = {r.doc_id: r.score for r in Q.score(docs, model).collect()}
    for i, (t, _) in enumerate(rows):
        f = sorted(plain_features(t, 12))
        margin = sum(model.weights[k] for k in f) / len(f) ** 0.5 + model.intercept
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30)))) < 1e-9
    assert sum((got[i] > 0.5) == rows[i][1] for i in range(150, 200)) >= 47
    same = Q.fit(docs, labels.filter("doc_id < 150"), bits=12)
    assert np.allclose(sorted(got.values()), sorted(r.score for r in Q.score(docs, same).collect()), atol=0.05)


def test_edges(spark):
    rows = texts(60)
    odd = [(100, None), (101, ""), (102, "fine1 word2 " * 100_000), (103, rows[1][0]), (103, rows[1][0]), (None, rows[1][0]), (None, None)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + odd, "doc_id long, text string").withColumn("score", F.lit("mine")).withColumn("key", F.lit(1)).withColumn("y", F.lit(2)).withColumn("quality", F.lit(0))
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(None, 1), (1, None), (100, 1), (10**6, 0)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    out = Q.op2(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out is not None for r in out)
    by = {r.doc_id: r.score for r in out}
    assert by[100] == by[101] and len({r.score for r in out if r.doc_id == 103}) == 1 and not any(r.held_out for r in out if r.doc_id is None)
    assert Q.op2(docs.limit(0), labels).count() == 0
    assert {r.score for r in Q.op2(docs, labels.limit(0)).collect()} == {0.5}
    assert min(r.score for r in Q.op2(docs, labels.filter("quality = 1")).collect()) > 0.9
