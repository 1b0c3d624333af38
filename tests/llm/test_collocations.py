"""Collocations against a plain version."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskloom.llm import collocations
from tests import oracle

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(docs, least=10, longest=3, shown=2000):
    f, n = {}, Counter()
    for lang, text in docs:
        lang = lang if lang is not None else "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = []
        big = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in big.items():
            if any(100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in big.items() if len(q) > len(p)):
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:shown])]
    return sorted(out)


def texts():
    rnd = random.Random(3)
    docs = [("en", None), (None, "Und UND und. " * 12), ("und", "und und"), ("fr", ""), ("fr", " \t.,\n"), ("en", "a.a,a a\x0ba b\x0ca " * 40), ("x" * 50, "ÀÉ àé" * 30)]
    for i in range(80):
        k = rnd.choice([3, 20, 200])
        words = [f"W{rnd.randrange(k)}" if rnd.random() < 0.7 else "new york city" for _ in range(rnd.choice([0, 1, 5, 60, 400]))]
        docs.append((rnd.choice(["en", "fr", "de", None]), "".join(w + rnd.choice([" ", " ", " \t", ", ", ".\n"]) for w in words)))
    docs += [("de", "the quick brown fox jumps over it. " * 3)] * 9
    return docs


@pytest.mark.parametrize("shards, bits, block, longest, shown", [(2, 24, 1 << 22, 3, 2000), (1, 16, 100, 3, 2000), (3, 16, 1000, 4, 7), (5, 6, 1 << 22, 3, 2000), (2, 4, 500, 2, 3)])
def test_collocations(spark, shards, bits, block, longest, shown):
    docs = texts()
    df = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(docs)], "doc_id long, lang string, text string").withColumn("shard", F.lit("s")).withColumn("phrase", F.lit(1)).repartition(3)
    got = collocations.collocations(df, longest=longest, shown=shown, shards=shards, bits=bits, block=block)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == plain(docs, longest=longest, shown=shown)


def test_phrases_are_not_counted_before_their_parts(spark):
    """Counting is pruned: of words met once each no pair is ever active."""
    import numpy as np
    import pyarrow as pa

    block = pa.RecordBatch.from_arrays([pa.array(["en", "fr"]), pa.array(["a b a b c d", "a b"])], ["lang", "text"])
    words = collocations.Words(block)
    tables = [np.full(1 << 16, 255, np.uint8) for _ in range(3)]
    assert len(collocations.active(words, tables, 2, 1, 2)[0]) == 0 and len(collocations.active(words, tables, 1, 2, 2)[0]) == 0
    one = words.phrases(1)[1]
    for h in one[:2]:  # a and b of en
        for slot in (int(h) >> 8 & 0xFFFF, int(h) >> 48):
            tables[0][slot] = 0
    h, since = collocations.active(words, tables, 2, 1, 2)
    assert len(h) == 3 and set(since.tolist()) == {1} and len(collocations.active(words, tables, 2, 3, 2)[0]) == 0


def test_equal_hashes_are_told_apart():
    import numpy as np

    first, n = collocations._distinct(np.array([5, 5, 7, 5, 5], np.uint64), np.array([1, 2, 3, 1, 2], np.uint64))
    assert sorted(zip(first.tolist(), n.tolist())) == [(0, 2), (1, 2), (2, 1)]


def test_products_beyond_64_bits(spark):
    df = spark.range(1).select(F.lit(3 * 10**12).alias("a"), F.lit(3 * 10**12 + 1).alias("l"), F.lit(10**13).alias("r"))
    assert df.select(collocations._score("a", "l", "r")).first()[0] == 1000000 * (3 * 10**12) ** 2 // ((3 * 10**12 + 1) * 10**13)


def test_empty(spark):
    assert collocations.op13(spark.createDataFrame([], "doc_id long, lang string, text string")).count() == 0


def test_sql(spark):
    from riskloom.llm import queries

    assert oracle.check(spark, queries.QUERIES["op13_collocations"], queries.ORACLES["op13_collocations"]) > 0
