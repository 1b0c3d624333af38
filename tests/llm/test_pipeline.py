"""The pipeline's stages against plain versions that share no code with them."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import quality_rules
from tests.llm import brute
from tests.oracle import DATA

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good(text: str | None) -> bool:
    """The threshold table, word by word."""
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = len(words)
    if n < 10:
        return False
    grams = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    inside = {i + k for i in range(n - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    stop = {w for ws in quality_rules.STOP_WORDS.values() for w in ws}
    fails = [len(inside) / n > 0.2, not 2 <= sum(map(len, words)) / n <= 15, sum(t.count(c) for c in "#*$%&|<>") / n > 0.25, t.count("!") / n > 0.3]
    fails += [n >= 60 and sum(w in stop for w in words) / n < 0.02, (len(lines) - len(set(lines))) / len(lines) > 0.5]
    return not any(fails)


def tokens(text: str | None) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def leaks(text: str | None, items: list[list[str]]) -> bool:
    """Whether 13 of 16 words in a row (or four fifths of a shorter item) agree with an item at some alignment."""
    words = tokens(text)
    where = {}
    for i, w in enumerate(words):
        where.setdefault(w, []).append(i)
    for item in items:
        m = min(16, len(item))
        for start, hits in Counter(p - i for i, w in enumerate(item) for p in where.get(w, ())).items():
            if hits >= 0.8 * m:
                equal = [0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(item)]
                if any(sum(equal[i : i + m]) >= 0.8 * m for i in range(len(item) - m + 1)):
                    return True
    return False


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    items = [tokens(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert all(len(x) >= 8 for x in items)
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA).cache()
        ids = {r.doc_id for r in out.collect()}
        if name == "quality_rules":
            assert ids == {i for i, r in rows.items() if good(r.text)} != set(rows)
        if name == "near_duplicates":
            assert ids == {i for i, (c, _) in brute.near([(i, r.text) for i, r in rows.items()]).items() if i == c} != set(rows)
        if name == "decontamination":
            assert ids == {i for i, r in rows.items() if not leaks(r.text, items)} != set(rows)
        if name == "secret_scan":
            assert ids == set(rows)
            for r in out.collect():
                bare = re.sub(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", "[secret]", rows[r.doc_id].text)
                assert r.n_chars == len(r.text) and not re.search(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}", r.text)
                if bare == rows[r.doc_id].text and not re.search(r"(?i)password|passwd|secret|token|api_?key", bare):
                    assert tuple(r) == tuple(rows[r.doc_id])
        if name != "best_fit_packing":
            assert out.columns == COLUMNS
            docs, rows = out, {r.doc_id: r for r in out.collect()}
    packed(out.collect(), rows)


def packed(pieces, rows) -> None:
    """Every document's ids are there, in whole pieces, and sequences hold no more than 1024."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by, bins = {}, {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(by) == set(rows)
    for i, own in by.items():
        ids = [*tok.encode(rows[i].text or "", add_special_tokens=False).ids, 2]
        assert [(p.start, p.ids_crc32) for p in sorted(own, key=lambda p: p.piece)] == [(p.start, zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())) for p in sorted(own, key=lambda p: p.piece)]
        assert sum(p.length for p in own) == len(ids)
    for own in bins.values():
        own.sort()
        assert all(b[0] == a[0] + a[1] for a, b in zip([(0, 0), *own], own)) and own[-1][0] + own[-1][1] <= 1024


def test_run(spark):
    """run() gives the rows of the stages one by one, and leaves only the last stage's files."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, DATA).cache()
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    packed(out.collect(), {r.doc_id: r for r in docs.collect()})


def test_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties and clashing columns, in every stage."""
    text = " ".join(f"the word{i} of" for i in range(40))
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    rows = [(1, text, "en", "s", 10), (1, text, "en", "s", 10), (2, text, None, None, None), (None, text, "en", "s", 1), (None, None, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    rows += [(5, " ".join(f"the x{i} and" for i in range(100_000)), "en", "s", 1), (6, f"{text} y {item}", "en", "s", 1), (7, " ".join(f"is z{i}" for i in range(30)) + " password=hunter2hunter2", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["q_n_words", "__row", "__text", "__spans", "spans", "bands", "rep", "key", "class_id", "__hits", "h", "item_id"]
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)]).repartition(3)
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        got[name] = sorted((r.doc_id for r in out.collect()), key=str)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
    every = sorted((r[0] for r in rows), key=str)
    assert got["quality_rules"] == sorted([1, 1, 2, None, 5, 6, 7], key=str)
    assert got["near_duplicates"] == sorted([1, 3, 4, 5, 6, 7, None, None], key=str)
    assert got["decontamination"] == sorted([1, 1, 2, 3, 4, 5, 7, None, None], key=str)
    assert got["secret_scan"] == every and set(got["best_fit_packing"]) == set(every)
    hidden = corpus_pipeline.redacted(spark, docs, DATA).filter("doc_id = 7").first()
    assert hidden.text.endswith(" [secret]") and hidden.n_chars == len(hidden.text) and hidden.key == 7
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0
