"""Benchmark decontamination by spaced seeds.

A mask marks positions of a token window that count; the others are ignored, so one substituted token
leaves some seeds intact. Seeds of the texts meet seeds of the benchmark in an equi-join on their hash,
and each diagonal (text position less item position) with a hit is verified token by token: some window
of `window` item tokens, or the whole item if it is shorter, must agree in at least `agree` of them.

The masks lose no overlap that the check accepts: wherever the substitutions fall in a window of 16 tokens,
or in a shorter item of at least TOLERANT, some seed is intact (tests enumerate the placements). Shorter
items are too short to tell a substitution from chance: they go by their whole hash and must be met verbatim.
Items below `shortest` tokens, or without any, have no seeds and are never found; one word more or less can't tell
these from chance, so they are only looked up where `shortest` says so. Masks for short items are used only if the
benchmark has such items.

Seeds that many items share, such as a question's usual stem, would make every text with the stem meet all of them.
They are common from `rare` entries of the benchmark on, and don't give diagonals by themselves: a common seed in a text is
extended by single tokens and pairs of tokens around it, within a window, and the extended seeds that are rare are joined.
An item's windows that rare seeds and rare extensions don't cover, because some allowed substitutions break all of
them, keep their common seeds, so nothing is lost; placements are enumerated to tell which these are.

A text's hits are gathered in parts of about PART, so a text is split again once a part, and only texts with a hit are.
Seeds and the keys of texts with hits are broadcast only up to a checked count; beyond it both sides are shuffled.

Tokens are the lower-cased runs of letters and digits, compared by their 64-bit hashes. Null, empty and short texts have no
leaks; texts of any length are read whole; repeated rows count as one through their key; rows with a null key are not looked
up and stay in drop_leaks(); items with a null text are never found, and those with a null key give pairs with
a null item. Of a pair's diagonals with equally many equal tokens the first is given. Columns besides the
named ones are not read.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import checkpointed

#: The seeds' masks by the least tokens of an item; 1 counts, 0 is ignored.
MASKS = {5: ("11111",), 6: ("111111",), 7: ("1111111",), 8: ("1111", "10111"), 14: ("11111", "110111")}
SHORTEST = min(MASKS)
#: From so many tokens on an item may be met with substitutions.
TOLERANT = 8
#: Seed rows of a benchmark, and keys with a hit, up to which they are broadcast (16 bytes each and a hash table); beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Entries of the benchmark up to which a seed is rare, tokens of a window, and the share of them that must be equal.
RARE = 16
WINDOW = 16
AGREE = 0.8
#: Diagonals of a text that are verified together.
PART = 2000


def tokens(text: Column) -> Column:
    """array<string> of the lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def hashes(text: Column) -> Column:
    """array<long>: the tokens' hashes."""
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def seeds(hashed: Column, masks: tuple[str, ...] = MASKS[14], group: int = 0) -> Column:
    """array<struct<at,h,bits,span>>: the hash of every mask at every place of an array of token hashes; bits are the mask's positions."""
    n = F.size(hashed)
    every = []
    for k, mask in enumerate(masks):
        every.append(_masked(hashed, n, mask, f"{group}/{k}"))
    return F.concat(*every)


def _masked(hashed: Column, n: Column, mask: str, k: str) -> Column:
    ones = [j for j, bit in enumerate(mask) if bit == "1"]
    starts = F.when(n >= len(mask), F.sequence(F.lit(0), n - len(mask))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(k), *[hashed[i + j] for j in ones]).alias("h"), F.lit(sum(1 << j for j in ones)).cast("long").alias("bits"), F.lit(len(mask)).alias("span")))


def _group(n: Column, masks: dict[int, tuple[str, ...]]) -> Column:
    """The key in `masks` that an item of n tokens goes by; null if it is too short."""
    return F.greatest(F.lit(None).cast("int"), *[F.when(n >= least, F.lit(least)) for least in masks])


def _seeded(df: DataFrame, key: str, text: str, masks: dict[int, tuple[str, ...]], by_size: bool = False) -> DataFrame:
    """(key, at, h), by size also bits and span: the seeds of each text by all masks, or, by size, by those of its own group."""
    hashed = df.select(F.col(key), hashes(F.col(text)).alias("w"))

    def every(w: Column) -> Column:
        own = lambda g, s: F.when(_group(F.size(w), masks) == g, s).otherwise(F.slice(s, 1, 0)) if by_size else s
        return F.concat(*[own(g, seeds(w, m, g)) for g, m in sorted(masks.items())])

    return hashed.select(F.col(key), F.explode(F.transform(F.array("w"), every)[0]).alias("s")).select(key, *[F.col(f"s.{c}").alias(c) for c in (("at", "h", "bits", "span") if by_size else ("at", "h"))])


def extensions(w: str, at: str, h: str, bits: str, window: int) -> Column:
    """array<struct<x,low,bits,high>> of a seed h at place `at` of token hashes w: the seed with one token, or two in a row, that lie
    within a window of it and aren't its own; low and high bound all its places, and bits are those from low on."""
    single = f"transform(filter(sequence(-{window - 1}, {window - 1}), d -> {at} + d >= 0 AND {at} + d < size({w}) AND NOT (d BETWEEN 0 AND 62 AND shiftright({bits}, greatest(d, 0)) & 1 = 1)), d -> named_struct('d', d, 'n', 1, 'x', xxhash64({h}, 1, d, {w}[{at} + d])))"
    pair = f"transform(filter(sequence(-{window - 1}, {window - 2}), d -> {at} + d >= 0 AND {at} + d + 1 < size({w}) AND NOT (d BETWEEN -1 AND 62 AND (shiftright({bits}, greatest(d, 0)) & 1 = 1 AND d >= 0 OR shiftright({bits}, greatest(d + 1, 0)) & 1 = 1))), d -> named_struct('d', d, 'n', 2, 'x', xxhash64({h}, 2, d, {w}[{at} + d], {w}[{at} + d + 1])))"
    low = f"({at} + least(e.d, 0))"
    both = f"shiftleft({bits}, - least(e.d, 0)) | shiftleft(cast(if(e.n = 1, 1, 3) as bigint), greatest(e.d, 0))"
    return F.expr(f"transform(concat({single}, {pair}), e -> named_struct('x', e.x, 'low', {low}, 'bits', {both}, 'high', {low} + length(bin({both}))))")


def placements(size: int, agree: float) -> list[int]:
    """Every choice of positions of a window, as bits, that may be substituted; the largest choices suffice."""
    n = size - math.ceil(agree * size - 1e-9) if size >= TOLERANT else 0
    return [sum(1 << j for j in c) for c in itertools.combinations(range(size), n)]


def _plan(items: DataFrame, bench: DataFrame, rare: int, window: int, agree: float) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(direct, common, extended): the entries (h, __item, __at) that give diagonals by themselves, the seeds (h) that texts
    extend, and the rare extensions (x, __item, __at, h); None where no seed is common."""
    counts = bench.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    many = checkpointed(counts.filter(F.col("c") > rare).select("h"))
    if many.isEmpty():
        return bench.select("h", "__item", "__at"), None, None
    often = bench.join(many, "h", "left_semi")
    few = bench.join(many, "h", "left_anti")
    some = often.select("__item").distinct()
    w = checkpointed(items.join(some, "__item", "left_semi").select("__item", hashes(F.col("__text")).alias("w")))
    own = often.join(w, "__item")
    every = own.select("__item", "__at", "h", F.inline(extensions("w", "__at", "h", "bits", window))).distinct()
    told = every.groupBy("x").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") <= rare).select("x")
    extended = checkpointed(every.join(told, "x", "left_semi"))
    feature = F.struct("low", "bits", "high")
    features = few.join(some, "__item", "left_semi").select("__item", F.col("__at").alias("low"), "bits", (F.col("__at") + F.col("span")).alias("high")).unionAll(extended.select("__item", "low", "bits", "high"))
    held = features.groupBy("__item").agg(F.collect_set(feature).alias("f"))
    joined = w.join(held, "__item", "left").select("__item", F.least(F.size("w"), F.lit(window)).alias("size"), F.size("w").alias("n"), F.coalesce("f", F.array().cast("array<struct<low:int,bits:bigint,high:int>>")).alias("f"))
    broken = F.array(*[F.lit(placements(k, agree)).cast("array<bigint>") for k in range(1, window + 1)])
    joined = joined.withColumn("broken", F.element_at(broken, F.col("size")))
    inside = "transform(filter(f, x -> x.low >= a AND x.high <= a + size), x -> shiftleft(x.bits, x.low - a))"
    bare = F.expr(f"filter(sequence(0, n - size), a -> exists(transform(array({inside}), g -> exists(broken, p -> forall(g, b -> b & p != 0))), y -> y))")
    uncovered = checkpointed(joined.select("__item", "size", F.explode(bare).alias("a")))
    kept = often.join(uncovered, "__item").filter((F.col("__at") >= F.col("a")) & (F.col("__at") + F.col("span") <= F.col("a") + F.col("size")))
    direct = few.select("h", "__item", "__at").unionAll(kept.select("h", "__item", "__at").distinct())
    return direct, extended.select("h").distinct(), extended.select("x", "__item", "__at", "h").distinct()


def diagonals(docs: DataFrame, items: DataFrame, masks: dict[int, tuple[str, ...]], rare: int = RARE, window: int = WINDOW, agree: float = AGREE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(__key, __item, __start), distinct and written: where texts (__key, __text) may overlap with items (__item, __text)."""
    bench = checkpointed(_seeded(items, "__item", "__text", masks, by_size=True).withColumnRenamed("at", "__at").distinct())
    direct, common, extended = _plan(items, bench, rare, window, agree)
    looked = direct.select("h", "__item", "__at", F.lit(True).alias("__whole"))
    if common is not None:
        looked = checkpointed(looked.unionAll(common.select("h", F.lit(None).cast("long").alias("__item"), F.lit(0).alias("__at"), F.lit(False).alias("__whole"))))
    if looked.limit(broadcast_rows + 1).count() <= broadcast_rows:
        looked = F.broadcast(looked)
    met = _seeded(docs, "__key", "__text", masks).join(looked, "h")
    if common is None:
        return checkpointed(met.select("__key", "__item", (F.col("at") - F.col("__at")).alias("__start")).distinct())
    met = checkpointed(met.select("__key", "h", "at", "__item", "__at", "__whole").distinct())
    found = met.filter("__whole").select("__key", "__item", (F.col("at") - F.col("__at")).alias("__start"))
    places = met.filter("NOT __whole").groupBy("__key").agg(F.collect_set(F.struct("at", "h")).alias("__places"))  # a text's own places
    bits = bench.groupBy("h").agg(F.first("bits").alias("bits"))
    hashed = _with(docs, checkpointed(places), "__key", broadcast_rows).select("__key", hashes(F.col("__text")).alias("w"), "__places")
    around = hashed.select("__key", F.explode(F.expr(f"transform(__places, p -> struct(p.h as h, p.at as at, least(p.at, {window - 1}) as own, slice(w, greatest(p.at - {window - 1}, 0) + 1, {2 * window + 6}) as w))")).alias("e")).select("__key", "e.*")
    around = around.join(bits, "h").select("__key", "at", F.explode(F.transform(extensions("w", "own", "h", "bits", window), lambda e: e["x"])).alias("x"))
    if extended.limit(broadcast_rows + 1).count() <= broadcast_rows:
        extended = F.broadcast(extended)
    more = around.join(extended, "x").select("__key", "__item", (F.col("at") - F.col("__at")).alias("__start"))
    return checkpointed(found.unionAll(more).distinct())


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", masks: dict[int, tuple[str, ...]] | None = None, window: int = WINDOW, agree: float = AGREE, broadcast_rows: int = BROADCAST_ROWS, rare: int = RARE, shortest: int = SHORTEST) -> DataFrame:
    """(key, item, start, n_item_words, n_equal, n_window_equal): a row for each text and item that overlap.

    Of a pair's diagonals the one with the most equal tokens is given (ties: the first); start is the text
    position of the item's first token and may be negative.
    """
    named = checkpointed(benchmark.select(F.col(item).alias("__name"), F.col(text).alias("__text")).distinct().withColumn("__item", F.monotonically_increasing_id()))
    items = named.select("__item", "__text")
    if masks is None:
        masks = {k: ("1" * k,) for k in range(shortest, SHORTEST)} | {k: m for k, m in MASKS.items() if k >= shortest or k >= TOLERANT}
    sizes = items.select(_group(F.size(tokens(F.col("__text"))), masks).alias("g")).distinct().collect()
    least = min(masks)
    masks = {g: m for g, m in masks.items() if any(r.g == g for r in sizes)} or {least: masks[least]}
    own = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    hits = diagonals(own, items, masks, rare, window, agree, broadcast_rows)
    sizes = hits.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
    part = F.pmod(F.xxhash64("__item", "__start"), F.ceil(F.col("__n") / PART))
    hits = checkpointed(hits.join(sizes, "__key").groupBy("__key", part.alias("__part")).agg(F.collect_list(F.struct("__item", "__start")).alias("__hits")))
    full = _with(own, hits, "__key", broadcast_rows).select("__key", "__hits", hashes(F.col("__text")).alias("__words")).select("__key", F.explode("__hits").alias("__hit"), "__words")
    sized = items.select("__item", hashes(F.col("__text")).alias("__theirs"))
    sizes = sized.select(F.col("__item").alias("__of"), F.size("__theirs").alias("__size"))
    # only the words beside an item travel on
    beside = full.join(sizes, F.col("__hit.__item") == F.col("__of")).select("__key", "__hit.*", F.slice("__words", F.greatest(F.col("__hit.__start"), F.lit(0)) + 1, F.col("__size") + F.least(F.col("__hit.__start"), F.lit(0))).alias("__beside"))
    full = beside.join(sized, "__item")
    size = F.size("__theirs")
    back = F.least(F.col("__start"), F.lit(0))
    equal = F.transform("__theirs", lambda w, i: F.coalesce((back + i >= 0) & (F.get("__beside", back + i) == w), F.lit(False)).cast("int"))
    full = full.select("__key", "__item", "__start", size.alias("__size"), equal.alias("__equal"))
    need = F.least(F.lit(window), F.col("__size"))
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("best"), F.lit(0).alias("i"))

    def slide(acc: Column, x: Column) -> Column:
        total = acc["sum"] + x - F.when(acc["i"] >= need, F.get("__equal", acc["i"] - need)).otherwise(F.lit(0))
        return F.struct(total.alias("sum"), F.greatest(acc["best"], total).alias("best"), (acc["i"] + 1).alias("i"))

    best = F.aggregate("__equal", zero, slide, lambda acc: acc["best"])
    least = F.when(F.col("__size") < TOLERANT, F.col("__size")).otherwise(agree * need)
    found = full.select("__key", "__item", "__start", "__size", F.aggregate("__equal", F.lit(0), lambda a, x: a + x).alias("__n"), best.alias("__best")).filter(F.col("__best") >= least)
    top = found.join(named.select("__item", "__name"), "__item").groupBy("__key", "__name").agg(F.max(F.struct("__n", (-F.col("__start")).alias("__back"), "__size", "__best")).alias("m"))
    return top.select(F.col("__key").alias(key), F.col("__name").alias(item), (-F.col("m.__back")).cast("long").alias("start"), F.col("m.__size").cast("long").alias("n_item_words"), F.col("m.__n").cast("long").alias("n_equal"), F.col("m.__best").cast("long").alias("n_window_equal"))


def _with(docs: DataFrame, keyed: DataFrame, key: str, broadcast_rows: int, how: str = "inner") -> DataFrame:
    """docs joined with a written table of keys, which is broadcast if it is small: then docs aren't shuffled."""
    small = keyed.limit(broadcast_rows + 1).count() <= broadcast_rows
    return docs.join(F.broadcast(keyed) if small else keyed, key, how)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS, **how) -> DataFrame:
    """The rows of docs without a leak."""
    bad = checkpointed(leaks(docs, benchmark, key, broadcast_rows=broadcast_rows, **how).select(key).distinct())
    return _with(docs, bad, key, broadcast_rows, "left_anti").select(*docs.columns)


def op4(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every pair of a document and a benchmark item that it leaks."""
    return leaks(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
