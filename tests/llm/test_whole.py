"""What is found must not hang on table size, common words or where a text was changed."""

from __future__ import annotations

import itertools
import math
import random
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskloom.llm import decontam, license_scan
from tests import oracle


def cosine(a: dict, b: dict) -> float:
    norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    return round(sum(x * b.get(t, 0) for t, x in a.items()) / norm, 6) if norm else 0


def best_units(texts: dict[int, str | None]) -> dict[int, str | None]:
    """The licence of each text's best unit: every run of terms as long as a notice, and the whole text, with true frequencies of all terms."""
    words = {i: license_scan.terms_of(t or "") for i, t in texts.items()}
    df = Counter(t for w in words.values() for t in set(w))
    weigh = lambda own: {t: c * license_scan.weight(df[t], len(texts)) for t, c in Counter(own).items()}
    shapes = [(k, license_scan.terms_of(x), False) for k, own in license_scan.TEMPLATES.items() for x in own]
    shapes += [(k, license_scan.terms_of(x), True) for k, x in license_scan.LICENCE_FILES.items()]
    rare = {t for _, own, _ in shapes for t in own if df[t] < len(texts) / 20}
    out = {}
    for i, w in words.items():
        found = []
        for k, own, whole in shapes if rare & set(w) else []:
            least = license_scan.LEAST if len(own) >= license_scan.SHORT else license_scan.LEAST_SHORT
            m = len(w) if whole else min(len(own), len(w))
            b = weigh(own)
            found += [(-s, k) for at in range(len(w) - m + 1) if agrees(k, own, w, at, m, whole) and (s := cosine(weigh(w[at : at + m]), b)) >= least]
        out[i] = min(found)[1] if found else None
    return out


def agrees(licence: str, own: list[str], w: list[str], at: int, m: int, whole: bool) -> bool:
    """Whether the terms that tell a family apart are those of the template, and the clauses behind fit."""
    family = "ISC" if licence == "0BSD" else next((f for f in license_scan.TELLING if f in licence), None)
    unit = w[at : at + m]
    for t in license_scan.TELLING.get(family, ()):
        if not (whole and t in "1234") and (t in unit) != (t in own):
            return False
    if licence == "0BSD" and "provided" in w[at + m : at + m + 3]:
        return False
    if own[0] == "redistribution" and not whole:
        ahead = w[at + m : at + m + license_scan.AHEAD]
        return ("retain" in ahead and "reproduce" in ahead and "neither" not in ahead) == (licence == "BSD-2-Clause")
    return True


def wrapped() -> list[tuple[str, str]]:
    """(licence, text): every template hard-wrapped as a comment, and every licence file."""
    out = []
    for name, notices in license_scan.TEMPLATES.items():
        for notice in notices:
            out += [(name, "import os\n" + "\n".join(lead + x for x in textwrap.wrap(notice, 60)) + "\n\nqword zword foo(bar)\n") for lead in ("# ", " * ", "// ", "")]
    out = [(n, t) for n, t in out if not (n == "BSD-2-Clause" and "Redistribution" in t)]  # alone, the shared sentence is the three clauses
    return out + [(name, "Copyright (c) 2020 Someone\n\n" + "\n".join(textwrap.wrap(t, 70))) for name, t in license_scan.LICENCE_FILES.items()]


def test_licences_of_wrapped_notices(spark):
    rows = [*wrapped(), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."), *((None, t) for t in (None, "", "Licensed under CC BY-ND 2.0.", "Released under the XYZ License.", "licensed driver wanted"))]
    some = [(i, "d", t) for i, (_, t) in enumerate(rows)] + [(10_000 + i, "d", f"word{i} and the other{i % 7}") for i in range(300)]
    docs = spark.createDataFrame(some, "doc_id long, path string, text string").withColumn("unit", F.lit(1)).withColumn("key", F.lit("x"))
    got = {r.doc_id: r.own_licence for r in license_scan.scan(docs).collect()}
    assert [(got[i], *rows[i]) for i in range(len(rows)) if got[i] != rows[i][0]] == [] and not any(got[i] for i in got if i >= 10_000)


NEIGHBOURS = {
    "LGPL-2.1": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "BSD-3-Clause": "Copyright (c) 2019, Some One\nAll rights reserved.\n\n" + license_scan.LICENCE_FILES["BSD-3-Clause"] + " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS",
    "BSD-2-Clause": "Copyright (c) 2019, Some One\n" + license_scan.LICENCE_FILES["BSD-2-Clause"].split("THIS SOFTWARE")[0],
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License. To view a copy of this license, visit the site.",
    "CC0-1.0": "To the extent possible under law, Some One has waived all copyright and related or neighboring rights to this work.",
    "0BSD": license_scan.TEMPLATES["0BSD"][0] + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
    None: "This work is licensed under the GNU General Public License, version 1.",
}


def test_families_keep_their_names(spark):
    """Every template of a family, in a file with other words around it, keeps its own licence; so do other members' usual forms."""
    rows = [(k, f"some words before it {t} and after it") for k, own in license_scan.TEMPLATES.items() if license_scan.family_of(k) for t in own if not (k == "BSD-2-Clause" and "Redistribution" in t)]
    rows += list(NEIGHBOURS.items())
    docs = spark.createDataFrame([(i, "d", t) for i, (_, t) in enumerate(rows)] + [(1000 + i, "d", f"word{i} and the other{i % 7} version 2 3") for i in range(300)], "doc_id long, path string, text string")
    docs = docs.withColumn("mark", F.lit("m")).withColumn("shape", F.lit(1)).withColumn("unit", F.lit("u")).withColumn("score", F.lit(9.0)).withColumn("licence", F.lit("z"))
    got = {r.doc_id: r.own_licence for r in license_scan.scan(docs).collect()}
    assert [(i, got[i], rows[i][1]) for i in range(len(rows)) if got[i] != rows[i][0]] == []


def plain_inheritance(own: dict[int, tuple[str | None, str | None]]) -> dict[int, tuple[str | None, str | None]]:
    """(licence, directory it is from) of each file, from (path, own licence)."""
    dirs = {}
    for path, licence in own.values():
        if path is not None and licence is not None:
            d = path.rpartition("/")[0]
            dirs[d] = min(dirs.get(d, licence), licence)
    out = {}
    for i, (path, licence) in own.items():
        above = path.split("/")[:-1] if path is not None and licence is None else None
        near = [d for k in range(len(above), -1, -1) if (d := "/".join(above[:k])) in dirs] if above is not None else []
        out[i] = (dirs[near[0]], near[0]) if near else (licence, None)
    return out


def test_inheritance_over_a_tree(spark):
    rnd = random.Random(21)
    notices = {None: "nothing here", "MIT": "Released under the MIT License.", "CC-BY-4.0": "Licensed under CC BY 4.0."}
    paths = ["/".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 6))) + f"/f{i}" for i in range(200)] + ["top", "a", "", None]
    own = {i: (p, rnd.choice([None] * 8 + ["MIT", "CC-BY-4.0"])) for i, p in enumerate(paths)}
    docs = spark.createDataFrame([(i, p, notices[k]) for i, (p, k) in own.items()], "doc_id long, path string, text string")
    got = {r.doc_id: (r.licence, r.inherited_from) for r in license_scan.scan(docs).collect()}
    assert got == plain_inheritance(own)


def test_licences_with_common_words(spark):
    texts = {i: t for i, t in enumerate([None, "", "text\nReleased under the MIT License en.\nmore en", "en Licensed under CC BY 4.0. en und", "Released under the MIT qwxz1 qwxz2 qwxz3 License qwxz4."])}
    texts |= {r.doc_id + 10: r.text for r in spark.read.parquet(f"{oracle.DATA}/documents.parquet").select("doc_id", "text").collect()}
    texts |= {i: "en und so" if i % 3 else "other words" for i in range(100_000, 110_000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("path", F.lit(None).cast("string"))
    got = {r.doc_id: r.own_licence for r in license_scan.scan(docs).collect()}
    assert got == best_units(texts)
    assert got[2] == "MIT" and got[3] == "CC-BY-4.0" and got[4] is None


def test_licences_edges(spark):
    none = spark.createDataFrame([], "doc_id long, path string, text string")
    assert license_scan.scan(none).count() == 0
    rows = [(1, "a/x", "word " * 200_000 + "Released under the MIT License. " + "word " * 200_000), (2, "a/y", None), (2, "a/y", None), (None, "a/z", "Licensed under CC BY 4.0.")]
    got = sorted((tuple(r) for r in license_scan.scan(spark.createDataFrame(rows, none.schema)).select("doc_id", "own_licence", "licence", "inherited_from").collect()), key=str)
    assert got == [(1, "MIT", "MIT", None), (2, None, "MIT", "a"), (2, None, "MIT", "a"), (None, None, "MIT", "a")]


def substituted(m: int) -> int:
    """Tokens of an item or window of m that may be substituted."""
    return m - math.ceil(0.8 * m - 1e-9) if m >= decontam.TOLERANT else 0


@pytest.mark.parametrize("m", range(decontam.SHORTEST, 17))
def test_masks_lose_nothing(m):
    masks = decontam.MASKS[max(g for g in decontam.MASKS if g <= m)]
    seeds = [{at + j for j, bit in enumerate(mask) if bit == "1"} for mask in masks for at in range(m - len(mask) + 1)]
    assert all(any(not seed & set(gone) for seed in seeds) for gone in itertools.combinations(range(m), substituted(m)))


def leaking(words: list[str], item: list[str]) -> bool:
    m = min(16, len(item))
    if len(item) < decontam.SHORTEST:
        return False
    for start in range(-len(item) + 1, len(words)):
        equal = [0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(item)]
        if any(sum(equal[i : i + m]) >= m - substituted(m) for i in range(len(item) - m + 1)):
            return True
    return False


def test_leaks_with_substitutions(spark):
    rnd = random.Random(8)
    word = lambda: f"t{rnd.randrange(3000)}"
    items = {n: [word() for _ in range(n)] for n in (3, 5, 6, 7, 8, 9, 10, 12, 13, 14, 15, 16, 17, 40, 60)}
    texts = [[], ["t1"], items[7][:6], *([word()] * n + items[n] + [word()] for n in (3, 5, 6, 7))]
    for item in items.values():
        for k in range(5):
            texts.append([w if j % 5 != k else "other" for j, w in enumerate(item)])
        for _ in range(12):
            gone = set(rnd.sample(range(len(item)), substituted(len(item)) + rnd.randrange(2)))
            texts.append([word() for _ in range(9)] + ["other" if j in gone else w for j, w in enumerate(item)] + [word()])
    want = {(i, n) for i, t in enumerate(texts) for n, item in items.items() if leaking(t, item)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string")
    assert {n for _, n in want} == set(items) - {3}
    for rows in (decontam.BROADCAST_ROWS, 0):
        assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench, broadcast_rows=rows).collect()} == want
    long = bench.filter("item_id >= 14")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, long).collect()} == {x for x in want if x[1] >= 14}
    assert decontam.leaks(docs, bench.filter("item_id = 3")).count() == 0


def test_leaks_of_every_placement(spark):
    """All 560 ways to substitute three of sixteen tokens."""
    item = [f"w{i}" for i in range(16)]
    texts = [" ".join("other" if j in gone else w for j, w in enumerate(item)) for gone in itertools.combinations(range(16), 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert decontam.leaks(docs, bench).filter("n_window_equal = 13 AND n_equal = 13").count() == 560


STEM = "which of the following is true about".split()


def test_common_stems_give_few_diagonals(spark):
    """Texts with the stem of many items' questions don't meet all of them, while real overlaps are found."""
    rnd = random.Random(31)
    items = [STEM + [f"i{i}x{j}" for j in range(rnd.randrange(9, 20))] for i in range(300)]
    texts = [[f"t{i}x{j}" for j in range(5)] + STEM[:6] + [f"u{i}x{j}" for j in range(9)] for i in range(300)]
    planted = {}
    for i in range(0, 300, 10):
        item = list(items[i])
        for j in rnd.sample(range(16), 3):
            item[j] = "other"
        planted[1000 + i] = i
        texts.append(["before"] * 3 + item)
    docs = spark.createDataFrame([(i if i < 300 else sorted(planted)[i - 300], " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    for rows in (decontam.BROADCAST_ROWS, 0):
        got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench, broadcast_rows=rows).collect()}
        assert got >= set(planted.items()) and {k for k, _ in got} == set(planted)
    named = bench.select(F.col("item_id").alias("__item"), F.col("text").alias("__text"))
    pairs = decontam.diagonals(docs.select(F.col("doc_id").alias("__key"), F.col("text").alias("__text")), named, decontam.MASKS)
    assert pairs.count() < 1000


@pytest.mark.parametrize("stem, rare", [(6, 2), (9, 2), (12, 3), (16, 2), (0, 1)])
def test_leaks_with_shared_stems(spark, stem, rare):
    """Whatever seeds are common, the pairs are those of brute force."""
    rnd = random.Random(stem)
    shared = [f"s{j}" for j in range(stem)]
    items = {i: shared + [f"w{rnd.randrange(30)}" for _ in range(rnd.choice([2, 4, 9, 12]))] for i in range(8)}
    items |= {20: ["w1", "w2", "w3", "w4", "w5"], 21: ["w1", "w2", "w3", "w4", "w5"], 22: ["w1"] * 9, 23: ["w1"] * 20}
    texts = [["w1"] * 30]
    for item in items.values():
        for _ in range(8):
            gone = set(rnd.sample(range(len(item)), min(len(item), substituted(min(16, len(item))) + rnd.randrange(2))))
            texts.append([f"w{rnd.randrange(30)}" for _ in range(rnd.randrange(20))] + ["other" if j in gone else w for j, w in enumerate(item)] + [f"w{rnd.randrange(30)}"])
    want = {(i, n) for i, t in enumerate(texts) for n, item in items.items() if leaking(t, item)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench, rare=rare).collect()} == want


def test_short_items_where_asked(spark):
    bench = spark.createDataFrame([(1, "One"), (2, "two three"), (3, "a b c d"), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "oneness two, three"), (2, "x one"), (3, "a b c"), (4, "z a b c d")], "doc_id long, text string")
    assert decontam.leaks(docs, bench).count() == 0
    found = lambda n: sorted((r.doc_id, r.item_id) for r in decontam.leaks(docs, bench, shortest=n).collect())
    assert found(1) == [(1, 2), (2, 1), (4, 3)] and found(2) == [(1, 2), (4, 3)] and found(4) == [(4, 3)]


def test_leaks_edges(spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (None, "alpha beta gamma delta epsilon")], "item_id long, text string")
    long = "word " * 300_000
    rows = [(1, long + item + " " + long), (2, item), (2, item), (None, item), (3, None), (4, ""), (5, "so Alpha, beta; gamma: delta epsilon!"), (6, item.replace("five", "5")), (7, f"{item} x {item}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(9)).withColumn("h", F.lit(1)).withColumn("__words", F.lit("x"))
    want = [(1, 1, 300_000, 10), (2, 1, 0, 10), (5, None, 1, 5), (6, 1, 0, 9), (7, 1, 0, 10)]
    for most in (decontam.BROADCAST_ROWS, 0):
        got = decontam.leaks(docs, bench, broadcast_rows=most).select("doc_id", "item_id", "start", "n_equal").collect()
        assert sorted(map(tuple, got)) == want
        kept = decontam.drop_leaks(docs, bench, broadcast_rows=most)
        assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 4, None] and kept.columns == docs.columns
    assert decontam.leaks(docs.limit(0), bench).count() == decontam.leaks(docs, bench.limit(0)).count() == 0
