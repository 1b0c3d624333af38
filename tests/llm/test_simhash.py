"""Fingerprints and their links against plain versions."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskloom.llm import simhash
from riskloom.llm.common import table
from tests.oracle import DATA


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(codes: dict[int, int], radius=3) -> dict[int, int]:
    """The least key reachable from each, over codes at most `radius` bits apart."""
    distinct = sorted(set(codes.values()))
    near = {x: [y for y in distinct if (x ^ y).bit_count() <= radius] for x in distinct}
    least = {x: min(i for i, c in codes.items() if c == x) for x in distinct}
    seen: dict[int, int] = {}
    for x in sorted(distinct, key=least.get):
        todo = [x] if x not in seen else []
        while todo:
            y = todo.pop()
            if y not in seen:
                seen[y] = least[x]
                todo += near[y]
    return {i: seen[c] for i, c in codes.items()}


def codes_around(rnd, n=60) -> list[int]:
    """Random codes, a dense ball, chains of three bits a step, and codes four bits apart."""
    out = [rnd.getrandbits(64) for _ in range(n)]
    centre = rnd.getrandbits(64)
    out += [centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, 4))) for _ in range(3 * n)]
    x = rnd.getrandbits(64)
    for k in range(20):
        x ^= 0b111 << 3 * k
        out.append(x)
    x = rnd.getrandbits(64)
    for k in range(15):
        x ^= 0b1111 << 4 * k
        out.append(x)
    return list(dict.fromkeys(out))


def test_masks_lose_nothing():
    rnd = random.Random(4)
    for pieces in (4, 5, 6):
        m = simhash.masks(3, pieces)
        for _ in range(2000):
            apart = sum(1 << b for b in rnd.sample(range(64), 3))
            assert any(apart & x == 0 for x in m)
    assert [simhash.pieces_for(n, 3) for n in (10, 10**6, 10**8, 10**12, 10**15)] == [4, 4, 5, 6, 6]


@pytest.mark.parametrize("pieces, block, pairs", [(None, simhash.BLOCK, simhash.PAIRS), (4, 16, 50), (5, 4096, 1000), (6, 8, 10**6)])
def test_links(spark, pieces, block, pairs):
    codes = codes_around(random.Random(5))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in codes], "code long").repartition(3)
    from riskloom.operators.stars import components

    got = {r.id: r.root for r in components(simhash.links(df, pieces=pieces, block=block, pairs=pairs)).collect()}
    as_signed = {int(np.array(x, np.uint64).view(np.int64)): x for x in codes}
    want = plain_components({s: x for s, x in as_signed.items()})
    assert {s: got.get(s, s) for s in as_signed} == want


def test_tree_search_equals_scan():
    rnd = random.Random(6)
    codes = np.array(codes_around(rnd), np.uint64)
    head = np.zeros(len(codes), np.int64)
    link, child = simhash.forest(codes, head)
    assert len(child) == len(codes) - 1 == len(set(child.tolist()))
    found = {(int(a), int(b)) for q, n in simhash.search(codes, link, child, np.arange(len(codes)), head, 3) for a, b in zip(q, n)}
    assert found == {(i, j) for i in range(len(codes)) for j in range(len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 3}


def test_pieces_of_long_texts():
    rnd = random.Random(7)
    raw = " \t\n".join(f"Wörd{rnd.randrange(50)}" * rnd.randrange(1, 4) for _ in range(500)).encode()
    whole = [s for some in simhash.shingles(raw) for s in some]
    for piece in (1, 7, 100, 10**6):
        assert [s for some in simhash.shingles(raw, piece=piece) for s in some] == whole
    assert simhash.fingerprint("ÀB c " * 300_000) == plain_fingerprint("ÀB c " * 3000)  # the same share of each shingle


def odd():
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(400)}" for _ in range(300)]
    docs = [(10, None), (11, ""), (12, " \n\t"), (13, "One"), (14, "one"), (15, "one two"), (16, "É x y"), (17, "é x y"), (18, "a\x0bb\x0cc d")]
    for i in range(60):
        x = list(base)
        for _ in range(i % 4):
            x[rnd.randrange(300)] = "Changed"
        docs.append((100 + i, " ".join(x)))
    docs += [(20 + i, " ".join(f"v{rnd.randrange(30)}" for _ in range(rnd.randrange(1, 9)))) for i in range(60)]
    return docs


def test_whole(spark):
    docs = odd()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("code", F.lit(1)).withColumn("key", F.lit("x")).withColumn("root", F.lit(2)).repartition(3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op11(df).collect()}
    codes = {i: plain_fingerprint(t) for i, t in docs}
    comp = plain_components(codes)
    assert got == {i: (f"{codes[i]:016x}", comp[i]) for i, _ in docs}
    assert got[10][1] == got[11][1] == got[12][1] == 10 and got[10][0] == "0" * 16


def test_rows_without_or_with_repeated_ids(spark):
    docs = [(None, "a b c"), (None, "a b c"), (5, "a b c"), (5, "a b c"), (5, "quite other words here"), (3, "quite other words here")]
    got = sorted(((r.doc_id, r.component_id, r.n_same) for r in simhash.op11(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    assert got == [(3, 3, 2), (5, 3, 2), (5, 5, 2), (5, 5, 2), (None, None, None), (None, None, None)]
    assert simhash.op11(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_table(spark):
    docs = table(spark, DATA, "documents")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op11(docs).collect()}
    codes = {r.doc_id: plain_fingerprint(r.text) for r in docs.select("doc_id", "text").collect()}
    comp = plain_components(codes)
    assert got == {i: (f"{c:016x}", comp[i]) for i, c in codes.items()}
