"""Ranked search against a plain version."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import ranking
from tests import oracle


def plain_terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(docs, items, most=10):
    own = [(i, plain_terms(t)) for i, t in docs]
    held = [len(w) for _, w in own if w]
    df = Counter(t for _, w in own for t in set(w))
    out = []
    for item, text in items:
        found = []
        for at, (i, w) in enumerate(own):
            if i is None or not w:
                continue
            tf = Counter(w)
            m = 100 - 90 + (90 * len(w) * len(held)) // sum(held)
            score = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in set(plain_terms(text)) if tf[t])
            if score > 0:
                found.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:most])]
    return sorted(out, key=str)


def tables():
    rnd = random.Random(9)
    words = [f"W{k}é" if k % 7 == 0 else f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    some = lambda n: rnd.choices(words, weights, k=n)
    docs = [(i, " ".join(some(rnd.choice([0, 1, 3, 30, 200])))) for i in range(400)]
    items = [(i, "; ".join(some(rnd.choice([1, 5, 40])))) for i in range(25)]
    docs += [(1000 + i, "x " + items[3][1] + " y") for i in range(15)]  # ties
    docs += [(2000, None), (2001, ""), (2002, "..-- \n"), (2003, "\x00w1\x7fw2"), (7, "w1 w2"), (7, "w1 w2"), (None, "w1 w2 w3")]
    items += [(100, None), (101, " ?"), (102, "nowhere"), (103, "w1"), (103, "w2"), (None, "w3 w3")]
    return docs, items


@pytest.mark.parametrize("shard, block, most_terms, probes", [(10**6, 1000, 10**6, 4), (700, 1000, 0, 1), (500, 7, 10**6, 2), (2000, 10, 3, 0)])
def test_ranked(spark, shard, block, most_terms, probes):
    docs, items = tables()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("at", F.lit(1)).withColumn("terms", F.lit("x")).repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(1)).withColumn("item", F.lit(1))
    got = ranking.ranked(df, it, shard=shard, items_in_block=block, most_terms=most_terms, probes=probes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items)


def test_search_opens_few_documents(monkeypatch):
    """A rare term's documents come first, and the bounds end the search without opening the rest."""
    rnd = np.random.default_rng(3)
    n = 20_000
    term = np.r_[np.zeros(n, np.int64), np.ones(20, np.int64)]
    doc = np.r_[np.arange(n), rnd.choice(n, 20, replace=False)]
    impact = np.r_[rnd.integers(1, 100, n), rnd.integers(10_000, 20_000, 20)]
    term *= 1 << 42  # ids may be far apart
    shard = ranking.Shard(term, doc, impact, n)
    opened = []
    peak = shard.peak
    monkeypatch.setattr(shard, "peak", lambda lo, hi: opened.append(len(lo)) or peak(lo, hi))
    score, found = shard.search(np.array([0, 1 << 42, 1 << 50]), 10)
    total = np.zeros(n, np.int64)
    np.add.at(total, doc, impact)
    want = np.lexsort([np.arange(n), -total])[:10]
    assert found.tolist() == want.tolist() and score.tolist() == total[want].tolist() and sum(opened) < 3000


def test_range_maxima():
    rnd = np.random.default_rng(4)
    impact = rnd.integers(1, 9, 300)
    term = np.sort(rnd.integers(0, 3, 300))
    doc = np.concatenate([np.arange((term == t).sum()) for t in range(3)])
    shard = ranking.Shard(term, doc, impact, 300)
    lo = rnd.integers(0, 300, 2000)
    hi = np.minimum(lo + rnd.integers(0, 90, 2000), 300)
    hi = np.where(term[np.maximum(hi - 1, 0)] == term[np.minimum(lo, 299)], hi, lo)
    got = shard.peak(lo, hi)
    for a, b, p in zip(lo, hi, got):
        assert p == (a + impact[a:b].argmax() if b > a else 300)


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ranking.op12(docs, items).count() == ranking.op12(one, items).count() == ranking.op12(docs, one.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_sql(spark):
    from riskloom.llm import queries

    assert oracle.check(spark, queries.QUERIES["op12_ranked_search"], queries.ORACLES["op12_ranked_search"]) > 0
