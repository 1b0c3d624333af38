"""Byte strings, passages and near duplicates against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import debruijn, jaccard_join, suffix_dedup
from riskloom.llm import textkit as tk
from riskloom.llm.components import components
from tests.llm import brute
from tests.oracle import DATA

SCHEMA = "doc_id long, text string"


def frame(spark, docs):
    """Documents over several partitions, with columns whose names the operators use themselves."""
    return spark.createDataFrame(docs, SCHEMA).withColumn("core", F.lit("x")).withColumn("key", F.lit(1)).withColumn("places", F.lit(2)).repartition(3)


def letters():
    rnd = random.Random(1)
    docs = [(i, "".join(rnd.choice("ab") for _ in range(rnd.choice([0, 10, 199, 200, 201, 400, 900])))) for i in range(20)]
    docs += [(100, None), (101, ""), (102, "a" * 199), (103, "a" * 200), (104, "a" * 201), (105, "a" * 3000), (106, "ab" * 600), (107, docs[5][1] + "x" + docs[6][1]), (108, "é" * 300), (109, "\0" * 250 + "é" * 120)]
    long = "".join(d[1] for d in docs[:9])
    for i in range(20):
        x = list(long + "q" * 300)
        for _ in range(3):
            x[rnd.randrange(len(x))] = "Z"
        docs.append((200 + i, "".join(x)))
    return docs


def tokens():
    rnd = random.Random(2)
    some = lambda n, k: " ".join(f"w{rnd.randrange(k)}" for _ in range(n))
    docs = [(i, some(rnd.choice([0, 4, 5, 49, 50, 51, 100, 300]), rnd.choice([2, 1000]))) for i in range(20)]
    docs += [(100, None), (101, ""), (102, "a " * 49), (103, "a " * 50), (104, "a\t" * 51), (105, "a\n" * 700), (106, "a b " * 200), (110, "a b " * 200), (111, " \n "), (112, "a b"), (113, "a  b")]
    base = (" ".join(d[1] for d in docs[:10]) + " " + some(250, 500)).split(" ")
    for i in range(30):
        x = list(base)
        for _ in range(rnd.randrange(6)):
            x[rnd.randrange(len(x))] = f"Z{rnd.randrange(3)}"
        docs.append((200 + i, " ".join(x + (["q"] + x[30:150] if i % 3 == 0 else []))))
    rnd.shuffle(docs)
    return docs


def thue_morse(n: int) -> str:
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


@pytest.mark.parametrize("most", [suffix_dedup.MOST_IN_CORE, 1])
def test_bytes(spark, most):
    docs = letters()
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    out = suffix_dedup.dedup(frame(spark, docs), most_in_core=most).select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256))
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == brute.repeated_bytes(docs)


@pytest.mark.parametrize("most", [suffix_dedup.MOST_IN_CORE, 50])
def test_one_core_in_every_row(spark, most):
    """A passage that all documents hold, each among other bytes; some also share what is around it."""
    rnd = random.Random(13)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(150))
    around = ["".join(rnd.choice("xyz ") for _ in range(120)) for _ in range(40)]
    docs = [(i, around[rnd.randrange(40)][rnd.randrange(60) :] + passage + around[rnd.randrange(40)][: rnd.randrange(60, 120)]) for i in range(300)]
    docs += [(900, thue_morse(512)), (901, thue_morse(512).translate(str.maketrans("ab", "ba")))]
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    out = suffix_dedup.dedup(frame(spark, docs), most_in_core=most).select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256))
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == brute.repeated_bytes(docs)


def test_interleave_by_steps():
    """Stepping back gives the order and common prefixes of a plain sort, from runs that are sorted one by one."""
    rnd = random.Random(14)
    whole = ["".join(rnd.choice("ab") for _ in range(40)).encode() for _ in range(60)]
    whole += [rnd.choice(whole)[:20] + rnd.choice(whole)[20:] for _ in range(200)]
    back, entries = 16, []
    for run in range(7):  # seven shards, each in the order of what follows the anchor
        entries += sorted(whole[run::7], key=lambda x: x[back:])
    rows = np.frombuffer(b"".join(entries), np.uint8).reshape(len(entries), 40)
    group = np.arange(len(entries)) % 2
    order, common = suffix_dedup.interleave(group, np.ascontiguousarray(rows[:, back:]).view(">u8").astype(np.uint64))
    for d in range(back + 1):
        if d:
            order, common = suffix_dedup.step_back(order, common, group, rows[order, back - d], np.ones(len(order), bool))
        got = [(group[i], entries[i][back - d :]) for i in order]
        assert got == sorted(got)
        for (g, x), (h, y), n in zip(got, got[1:], common[1:]):
            assert n == (-1 if g != h else next((k for k in range(len(x)) if x[k] != y[k]), len(x)))


def test_bytes_without_id(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(700))
    docs = [(1, text), (None, text), (None, text), (2, "x" * 100 + text[:300]), (3, None)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.op5(frame(spark, docs)).collect()), key=str)
    assert [x for x in got if x[0] is None] == [(None, 700, 0)] * 2 and len(got) == 5
    want = brute.repeated_bytes([d for d in docs if d[0] is not None])
    assert all(x[1:] == want[x[0]][:2] for x in got if x[0] is not None)


def test_bytes_of_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = brute.repeated_bytes([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert {r[0]: tuple(r)[1:] for r in suffix_dedup.op5(docs).collect()} == want


def test_passages(spark):
    docs = tokens()
    assert {r[0]: tuple(r)[1:] for r in debruijn.op7(frame(spark, docs)).collect()} == brute.repeated_words(docs)


def test_one_passage_in_every_row(spark):
    """Words that all documents hold, more or less than a window, each among other words."""
    rnd = random.Random(15)
    passage = [f"p{i}" for i in range(70)]
    docs = []
    for i in range(300):
        a, b = rnd.randrange(25), rnd.randrange(45, 70)
        docs.append((i, " ".join([f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(40))] + passage[a:b] + [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(40))])))
    assert {r[0]: tuple(r)[1:] for r in debruijn.op7(frame(spark, docs)).collect()} == brute.repeated_words(docs)


def test_passages_without_id(spark):
    text = " ".join(f"w{i}" for i in range(120))
    docs = [(1, text), (None, text), (None, text), (2, "x y " + text), (3, None), (-4, "w1 w2")]
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in debruijn.op7(frame(spark, docs)).collect()), key=str)
    assert got == sorted([(1, 120, 0), (None, 120, 0), (None, 120, 0), (2, 122, 120), (3, 0, 0), (-4, 2, 0)], key=str)


def test_words_that_defeat_polynomials(spark):
    word = thue_morse(4096)
    other = word.translate(str.maketrans("ab", "ba"))
    head = " ".join(f"w{i}" for i in range(49))
    docs = [(1, f"{head} {word}"), (2, f"{head} {other}"), (3, f"{head} {word}")]
    got = {r.doc_id: r.n_removed for r in debruijn.op7(frame(spark, docs)).collect()}
    assert got == {1: 0, 2: 0, 3: 50}
    near = {r.doc_id: r.class_id for r in jaccard_join.op8(frame(spark, [(i, f"a b c d {w}") for i, w in ((1, word), (2, other), (3, word))])).collect()}
    assert near == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("bits, width", [(10, 26), (9, 128), (26, 128)])
def test_sliding_minima(bits, width):
    values = np.random.default_rng(0).integers(0, 1 << 63, 3000, np.uint64)
    values[500:900] = values[500]
    high = values >> np.uint64(bits)
    want = [p + int(np.argmin(high[p : p + width])) for p in range(len(values) - width + 1)]
    assert tk.sliding_argmin(values, width, bits)[: len(want)].tolist() == want


def test_minima_beyond_64_mib():
    n = (1 << 26) + 2000
    values = np.arange(n, dtype=np.uint64)[::-1] << np.uint64(27)
    got = tk.sliding_argmin(values, 26)
    assert got[0] == 25 and got[n - 26] == n - 1 and (np.diff(got[: n - 25]) == 1).all()


def test_paths(spark):
    edges = spark.createDataFrame([(1, 10, 11, 3), (2, 11, 12, 4), (3, 12, 13, 5), (4, 13, 14, 1), (5, 13, 15, 1), (7, 20, 21, 2), (8, 21, 20, 2), (9, 30, 30, 1)], "id long, src long, dst long, windows int")
    got = {r.id: (r.path, r.offset) for r in debruijn.compact(edges).collect()}
    assert got == {1: (1, 0), 2: (1, 3), 3: (1, 7), 4: (4, 0), 5: (5, 0), 7: (7, 0), 8: (8, 0), 9: (9, 0)}


@pytest.mark.parametrize("block", [jaccard_join.BLOCK, 8])
def test_near(spark, block):
    docs = tokens()
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(frame(spark, docs), block=block).collect()}
    assert got == brute.near(docs)


def test_near_edges(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "a b c d e f"), (3, None), (3, None), (4, "z " * 100_000), (5, "z " * 90_000)]
    got = sorted(map(tuple, jaccard_join.op8(frame(spark, docs)).collect()), key=str)
    assert got == [(1, 1, 1, 1), (2, 1, 1, 1), (3, 3, 0, 0), (4, 4, 1, 1), (5, 4, 1, 1), (None, None, 0, 0), (None, None, 0, 0)]
    kept = jaccard_join.keep_one(frame(spark, docs))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, None, None] and kept.columns == ["doc_id", "text", "core", "key", "places"]


def test_recall_at_the_threshold(spark):
    """Of pairs with a similarity between 0.8 and 0.86 none is lost."""
    rnd = random.Random(12)
    docs, close = [], set()
    for i in range(300):
        words = [f"v{rnd.randrange(10**6)}" for _ in range(rnd.randrange(60, 140))]
        other = list(words)
        for _ in range(rnd.randrange(1, 4)):
            other[rnd.randrange(len(other))] = "other"
        a, b = " ".join(words), " ".join(other)
        x, y = brute.shingles(a), brute.shingles(b)
        if 0.8 <= len(x & y) / len(x | y) < 0.86:
            close.add(2 * i)
        docs += [(2 * i, a), (2 * i + 1, b)]
    got = {r.doc_id: r.class_id for r in jaccard_join.op8(frame(spark, docs)).collect()}
    assert len(close) > 50 and all(got[i + 1] == i for i in close)


def test_banding():
    for least, recall in ((0.8, 0.9999), (0.5, 0.99)):
        bands, rows = jaccard_join.banding(least, recall, 400)
        assert 1 - (1 - least**rows) ** bands >= recall


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.op5(none).count() == debruijn.op7(none).count() == jaccard_join.op8(none).count() == 0


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r.id: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
