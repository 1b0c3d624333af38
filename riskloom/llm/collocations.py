"""Phrase collocations by dynamic itemset counting.

1. Rows are dealt to `shards` of documents, which are scanned in turn, round and round. Words count from the first
   scan on. A longer phrase becomes active with the scan after both its subphrases (all words but the last, all but
   the first) have reached `least`, and counts for one full cycle of shards from there, so lengths interleave and most
   phrases are never counted. Scans end when no active phrase is short of its cycle.
2. Counts go by 60-bit hashes with a tag of length and first scan, summed in partial counts by block, task and exchange.
   What has reached `least`, and in which scan, is kept in a table of 2 ** BITS one-byte slots a length, two slots a hash,
   whose values never change once set. It is built from bitmaps by aggregation, is the only thing sent to every task, and
   has a fixed size: a false positive activates a phrase too early or in vain, for a full cycle too, and loses nothing.
3. A last scan counts the phrases themselves that the tables hold; words and phrases below `least` drop out there, so
   the frequencies are exact and no result hangs on hashes. Scores are joins of these counts, in decimals.

Pieces end at `[.,;:!?]` and line ends; words are what blanks and tabs separate in a piece. Only A-Z is lowered.
A null text has no words; a null lang is `und`, together with rows that say so. Texts of any length are read whole. Rows
count one by one, repeated ones too; doc_id is only used to deal rows to shards and may be null. Columns besides doc_id, lang
and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm import textkit as tk
from riskloom.session import forget, stored

LEAST = 10
LONGEST = 3
SHARDS = 2
SHOWN = 2000
#: Slots of a table, as a power of two.
BITS = 23
#: Bytes of text in a block.
BLOCK = 1 << 21
#: Bits of a count's key that hold the phrase's length less one (2) and its first scan (6).
_TAG = 8
_NEVER = 255
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 1: between words, 2: between pieces
_KIND[[32, 9]] = 1
_KIND[[*b".,;:!?\n\x0b\x0c\r"]] = 2


class Words:
    """The words of a block of rows: hashes, and for each place how many words its piece has from there on."""

    def __init__(self, block: pa.RecordBatch, salts: tuple[int, ...] = (0,)):
        raw, bounds = tk.text_bytes(block.column("text"))
        self.raw = _LOWER[raw]
        kind = _KIND[raw]
        cut = np.zeros(len(raw) + 1, np.int32)
        cut[:-1] = kind == 2
        cut[bounds] += 1
        solid = np.zeros(len(raw) + 2, bool)
        solid[1:-1] = kind == 0
        edge = np.zeros(len(raw) + 1, bool)
        edge[bounds] = True
        self.starts = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
        self.ends = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
        self.solid = solid[1:-1]
        self.row = np.repeat(np.arange(block.num_rows), np.diff(np.searchsorted(self.starts, bounds)))
        self.langs = [x.as_py() for x in block.column("lang")]
        piece = np.cumsum(cut)[self.starts]
        n = len(piece)
        last = np.r_[piece[1:] != piece[:-1], True] if n else np.zeros(0, bool)
        ends = np.flatnonzero(last)
        self.left = np.repeat(ends + 1, np.diff(np.r_[-1, ends])) - np.arange(n)
        of = {x: tk.word_hashes(np.frombuffer(b := x.encode(), np.uint8), np.array([0]), np.array([len(b)]))[0] if x else np.uint64(0) for x in set(self.langs)}
        lang = np.array([of[x] for x in self.langs], np.uint64)[self.row] if n else np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            self.hashes = [tk.mix(tk.word_hashes(self.raw, self.starts, self.ends, salt) + lang * np.uint64(3)) for salt in salts]

    def phrases(self, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every phrase of k words."""
        at = np.flatnonzero(self.left >= k)
        h = self.hashes[salt]
        with np.errstate(over="ignore"):
            x = np.full(len(at), k, np.uint64)
            for j in range(k):
                x = tk.mix(x * np.uint64(0x9E3779B97F4A7C15) + h[at + j])
        return at, x

    def spelled(self) -> pa.Array:
        """The words."""
        bounds = np.r_[0, np.cumsum(self.ends - self.starts)]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(bounds), pa.py_buffer(self.raw[self.solid])])

    @staticmethod
    def texts(words: pa.Array, at: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words from each of the words `at`, joined by single blanks."""
        parts = [words.take(pa.array(at + j)) for j in range(k)]
        return pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())).cast(pa.binary()).cast(pa.string())


def scan_of(tables: list[np.ndarray], h: np.ndarray, k: int) -> np.ndarray:
    """The scan in which each hashed phrase of k words reached the threshold; _NEVER if it hasn't."""
    table = tables[k - 1]
    if table is None:
        return np.full(len(h), _NEVER, np.uint8)
    low = np.uint64(len(table) - 1)
    return np.maximum(table[(h >> np.uint64(_TAG)) & low], table[(h >> np.uint64(64 - int(len(table)).bit_length() + 1))])


def active(words: Words, tables: list[np.ndarray], k: int, turn: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first scan) of the phrases of k words that count in scan `turn`."""
    at, h = words.phrases(k)
    if k == 1:
        return (h, np.zeros(len(h), np.int64)) if turn < shards else (h[:0], np.zeros(0, np.int64))
    part_at, part = words.phrases(k - 1)
    reached = np.full(len(words.starts), _NEVER, np.uint8)
    reached[part_at] = scan_of(tables, part, k - 1)
    since = np.maximum(reached[at], reached[at + 1]).astype(np.int64) + 1
    now = (since <= turn) & (turn < since + shards)
    return h[now], since[now]


def _counter(sent, turn: int, shards: int, longest: int, block: int) -> Callable:
    """Counts by block of the phrases that are active in this scan."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value
        for b in tk.blocks(batches, most=block):
            words = Words(b)
            for k in range(1, longest + 1):
                h, since = active(words, tables, k, turn, shards)
                if len(h):
                    tagged = ((h >> np.uint64(_TAG)) << np.uint64(_TAG)) | (since.astype(np.uint64) << np.uint64(2)) | np.uint64(k - 1)
                    keys, n = np.unique(tagged, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["h", "c"])

    return count


def _speller(sent, longest: int, block: int) -> Callable:
    """Counts by block of the words and phrases that the tables hold, spelled out; an empty phrase counts all words of a lang."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value
        for b in tk.blocks(batches, most=block):
            words = Words(b, (0, 0x5BD1E995))
            names = list(dict.fromkeys(words.langs))
            code = np.array([names.index(x) for x in words.langs])[words.row]
            n = np.bincount(code, minlength=len(names)).astype(np.int64)
            spelled = words.spelled()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([""] * len(names)), pa.array(n)], ["lang", "phrase", "c"])
            for k in range(1, longest + 1):
                at, h = words.phrases(k)
                held = np.flatnonzero(scan_of(tables, h, k) != _NEVER)
                if not len(held):
                    continue
                at, h, other = at[held], h[held], words.phrases(k, 1)[1][held]
                first, n = _distinct(h, other)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(code[at[first]])), words.texts(spelled, at[first], k), pa.array(n)], ["lang", "phrase", "c"])

    return spell


def _distinct(h: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place, count) of each distinct pair of hashes."""
    order = np.argsort(h)
    same = (h[order][1:] == h[order][:-1]) & (other[order][1:] == other[order][:-1])
    if not (same == (h[order][1:] == h[order][:-1])).all():  # two phrases share a hash
        order = np.lexsort([other, h])
        same = (h[order][1:] == h[order][:-1]) & (other[order][1:] == other[order][:-1])
    first = np.flatnonzero(np.r_[True, ~same])
    return order[first], np.diff(np.r_[first, len(h)])


def _set(tables: list[np.ndarray]) -> list[np.ndarray | None]:
    """The tables worth sending."""
    return [t if (t != _NEVER).any() else None for t in tables]


def _slots(h: Column, bits: int) -> Column:
    return F.array(F.shiftrightunsigned(h, _TAG).bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned(h, 64 - bits))


def _enter(counts: DataFrame, tables: list[np.ndarray], turn: int, least: int, bits: int) -> bool:
    """Set the free slots of all phrases that have reached the threshold by now to this scan; whether longer phrases may follow."""
    reached = counts.filter(F.col("c") >= least).select((F.col("h").bitwiseAND(F.lit(3))).alias("k"), F.explode(_slots(F.col("h"), bits)).alias("slot"))
    place = F.col("slot") + 1
    maps = reached.groupBy("k", F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m"))
    longer = False
    for r in maps.collect():  # at most 2 ** bits bits a length
        a = (r.bucket - 1) * 32768
        table = tables[r.k][a : a + 32768]
        bit = np.unpackbits(np.frombuffer(r.m, np.uint8), bitorder="little")[: len(table)].astype(bool)
        bit &= table == _NEVER
        table[bit] = turn
        longer |= r.k < len(tables) - 1 and bool(bit.any())
    return longer


def frequencies(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(lang, phrase, f): every word and phrase of at most `longest` words that a lang has at least `least` times; with the
    phrase empty, all words of the lang."""
    context = docs.sparkSession.sparkContext
    dealt = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"))
    dealt = stored(dealt.filter("text <> ''"), by=("shard",))
    tables = [np.full(1 << bits, _NEVER, np.uint8) for _ in range(longest)]
    state = held = None
    turn, going = 0, True
    while going:
        sent = context.broadcast(_set(tables))
        new = dealt.filter(F.col("shard") == turn % shards).select("lang", "text").mapInArrow(_counter(sent, turn, shards, longest, block), "h long, c long")
        merged = (new if held is None else new.unionAll(held)).groupBy("h").agg(F.sum("c").alias("c"))
        unfinished = F.shiftright(F.col("h").bitwiseAND(F.lit(255)), 2) + shards - 1 > turn
        state = stored(merged.filter(unfinished | (F.col("c") >= least)), over=state)
        sent.destroy()
        held = state.filter(unfinished)
        going = _enter(state, tables, turn, least, bits) or held.limit(1).count() > 0
        turn += 1
    forget(state)
    sent = context.broadcast(_set(tables))
    counted = dealt.select("lang", "text").mapInArrow(_speller(sent, longest, block), "lang string, phrase string, c long").groupBy("lang", "phrase").agg(F.sum("c").alias("f"))
    out = stored(counted.filter((F.col("f") >= least) | (F.col("phrase") == "")))
    sent.destroy()
    forget(dealt)
    return out


def _score(a: str, l: str, r: str) -> Column:
    return F.expr(f"(1000000BD * cast({a} as decimal(38,0)) * cast({a} as decimal(38,0))) div (cast({l} as decimal(38,0)) * cast({r} as decimal(38,0)))")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shown: int = SHOWN, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's first `shown` phrases of 2 to `longest` words that no longer one explains."""
    freq = frequencies(docs, least, longest, **how)
    w = F.split("phrase", " ")
    cand = freq.withColumn("w", w).filter("size(w) > 1 AND phrase <> ''").select("lang", "phrase", F.col("f").alias("a"), "w")
    words = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cut = F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("cut")
    halves = cand.select("lang", "phrase", "a", "w", cut)
    halves = halves.select("lang", "phrase", "a", "cut", F.explode(F.array(F.struct(F.lit(0).alias("side"), words(F.lit(1), F.col("cut")).alias("part")), F.struct(F.lit(1).alias("side"), words(F.col("cut") + 1, F.size("w")).alias("part")))).alias("p"))
    halves = halves.select("lang", "phrase", "a", "cut", "p.side", F.col("p.part").alias("part"))
    met = halves.join(freq.filter("phrase <> ''").select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    sides = [F.max(F.when((F.col("cut") == k) & (F.col("side") == s), F.col("f"))).alias(f"{x}{k}") for k in range(1, longest) for s, x in enumerate("lr")]
    cuts = met.groupBy("lang", "phrase").agg(F.max("a").alias("a"), *sides)
    options = F.array_compact(F.array(*[F.when(F.col(f"l{k}").isNotNull(), F.struct(_score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]))
    scored = cuts.select("lang", "phrase", "a", F.array_min(options).alias("m"))
    inner = F.expr("flatten(transform(sequence(2, size(w) - 1), n -> transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))))")
    longer = cand.filter("size(w) > 2").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left = scored.join(longer, ["lang", "phrase"], "left").filter("most IS NULL OR 100 * most < 50 * a")
    top = first_rows(stored(left.select("lang", "phrase", "a", "m.l", "m.r", "m.score")), shown)
    totals = stored(freq.filter("phrase = ''").select("lang", F.col("f").alias("n")))
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def first_rows(scored: DataFrame, shown: int) -> DataFrame:
    """scored with `rank`, each lang's first `shown` rows by score, a and phrase.

    Counts by cells of the order, coarse ones first, tell which rows can be among them; the rest drops out before
    rows are ordered, and what is left is ordered in parts first, so that a lang is never ordered in one task.
    """
    kept = _cut(scored, -F.expr("score div 1000"), shown)
    kept = _cut(kept, -(F.col("score") * 1000 + F.floor(F.log2("a") * 10)), shown)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    kept = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= shown)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= shown).drop("part")


def _cut(scored: DataFrame, cell: Column, shown: int) -> DataFrame:
    """The rows of scored in each lang's first cells that have `shown` rows together."""
    cells = scored.groupBy("lang", cell.alias("g")).agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("lang").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = stored(cells.withColumn("before", before).filter(F.col("before") < shown).groupBy("lang").agg(F.max("g").alias("last")))
    return scored.join(last, "lang").filter(cell <= F.col("last")).drop("last")


def op13(docs: DataFrame) -> DataFrame:
    """Each lang's first 2000 collocations."""
    return collocations(docs)


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(x, '[\x20\x09]+'), lambda w: w <> '') AS w FROM (SELECT lang, unnest(string_split_regex(s, '[.,;:!?\x0A-\x0D]')) AS x FROM d)),
o AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p CROSS JOIN (VALUES (1), (2), (3)) v(k))),
n AS (SELECT lang, count(*) AS n FROM o WHERE k = 1 GROUP BY 1),
f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS f FROM o GROUP BY 1, 2, 3 HAVING count(*) >= 10),
c AS MATERIALIZED (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
h AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT h.lang, h.phrase, a, j, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM h JOIN f x ON x.lang = h.lang AND x.phrase = h.x JOIN f y ON y.lang = h.lang AND y.phrase = h.y),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS q FROM s) WHERE q = 1),
g AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM c WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE k = 3) GROUP BY 1, 2),
r AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score FROM b LEFT JOIN g ON g.lang = b.lang AND g.phrase = b.phrase WHERE most IS NULL OR 100 * most < 50 * a)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000"""
