"""Ranked lexical search, best first over intervals of documents with range-maximum tables.

1. A document's terms are counted in one pass that keeps the terms of the items; the statistics N, L and df are sums
   over all documents, and a posting's impact is its whole part of the score.
2. Documents are dealt to shards of about SHARD postings, items to blocks of at most ITEMS; a shard and a block make a
   group. There every posting list is ordered by document and has a sparse table of the places of its range maxima.
3. A search keeps intervals of documents, each bounded by the sum of its terms' range maxima. The intervals of the
   highest bounds are taken (BATCH at a time), the document of the largest impact in each is scored in full, and what lies
   left and right of it are new intervals with smaller bounds. It ends when no bound reaches the last of the `most` best
   scores so far; an interval that only ties with it is still searched, so ties go by doc_id.
4. A first, short search of every shard (PROBES rounds) gives each item a floor under its last best score over all
   shards, below which the second search, which is exact, opens nothing.
5. Each shard gives its best rows of an item; the best of those are the item's.

Terms are runs of ASCII letters and digits and of everything beyond ASCII; only A-Z is lowered. A null text has no
terms and isn't found; items with a null or termless text have no rows. Texts of any length are read whole. Each row counts
by itself: rows that repeat a doc_id are ranked each, and rows with a null doc_id count in the statistics but are not
ranked, as nothing names them. Items that repeat an item_id are searched each, so their ranks appear once a row; a null
item_id stays null. Columns besides the named ones are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.session import forget, stored

MOST = 10
#: Postings of a shard, items of a block.
SHARD = 500_000
ITEMS = 1000
#: Distinct terms of all items up to which documents are read with a set of them; beyond, all terms go to a join.
TERMS = 1_000_000
#: Intervals opened at once, and rounds of the first search.
BATCH = 64
PROBES = 4
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, repeats included."""
    return (text or "").encode().translate(_TABLE).split()


def counted(docs: DataFrame, key: str, text: str, sent=None) -> DataFrame:
    """(key, n, terms, tfs): each row's number of terms, and its distinct terms with their counts; only those of sent.value, if given."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, of, tf, ends = [], [], [], [0]
            for x in b.column("text"):
                own = terms(x.as_py())
                n.append(len(own))
                some = Counter(own)
                held = sorted(some if sent is None else some.keys() & sent.value)
                of += held
                tf += [some[t] for t in held]
                ends.append(len(of))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n, pa.int64()), lists(pa.array(of, pa.binary()).cast(pa.string())), lists(pa.array(tf, pa.int64()))], ["key", "n", "terms", "tfs"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(count, f"key {kind}, n long, terms array<string>, tfs array<long>")


class Shard:
    """Posting lists of a shard: for each term its documents' places in order, impacts, and a table of range maxima."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int):
        self.terms, term = np.unique(term, return_inverse=True)
        order = np.lexsort([doc, term])
        self.impact, self.width = impact[order], n_docs + 1
        self.code = term[order] * self.width + doc[order]
        self.doc = doc[order]
        n = len(order)
        longest = int(np.bincount(term).max()) if n else 0
        best = np.arange(n, dtype=np.int32)
        self.best = [best]
        k = 0
        while 2 << k <= longest:
            half = 1 << k
            a, b = best[:-half], best[half:]
            best = np.where(self.impact[a] >= self.impact[b], a, b)  # of equal ones the first
            self.best.append(best)
            k += 1
        self.levels = np.zeros(longest + 2, np.int64)
        for k in range(1, len(self.best)):
            self.levels[1 << k :] = k
        # a place beyond the last posting has no impact
        self.impact = np.append(self.impact, 0)

    def span(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place of each list, by its term's place among the shard's, and the one after its last."""
        return np.searchsorted(self.code, term * self.width), np.searchsorted(self.code, (term + 1) * self.width)

    def peak(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The place of the largest impact in each lo:hi; one beyond all postings where it is empty."""
        n = hi - lo
        out = np.full(lo.shape, len(self.impact) - 1, np.int64)
        level = self.levels[np.maximum(n, 0)]
        for k, best in enumerate(self.best):
            at = (level == k) & (n > 0)
            if at.any():
                a, b = best[lo[at]], best[hi[at] - (1 << k)]
                out[at] = np.where(self.impact[a] >= self.impact[b], a, b)
        return out

    def search(self, own: np.ndarray, most: int, floor: int = 1, rounds: int | None = None, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
        """(score, document) of the `most` best for the terms `own`, at least `floor` high, in order; of so many rounds only, if given."""
        own = np.flatnonzero(np.isin(self.terms, own))  # by their place among the shard's terms
        lo, hi = (x[None, :] for x in self.span(own))
        peaks = self.peak(lo, hi)
        bound = self.impact[peaks].sum(axis=1)
        live = bound >= max(floor, 1)
        lo, hi, peaks, bound = lo[live], hi[live], peaks[live], bound[live]
        score, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(bound) and (rounds is None or rounds > 0):
            rounds = None if rounds is None else rounds - 1
            top = np.argpartition(-bound, min(batch, len(bound)) - 1)[:batch]
            rest = np.ones(len(bound), bool)
            rest[top] = False
            a, b, p = lo[top], hi[top], peaks[top]
            best = p[np.arange(len(p)), self.impact[p].argmax(axis=1)]
            doc = self.doc[best]
            at = np.searchsorted(self.code, own[None, :] * self.width + doc[:, None])
            at = np.clip(at, a, b)
            hit = (at < b) & (self.doc[np.minimum(at, len(self.doc) - 1)] == doc[:, None])
            score = np.append(score, np.where(hit, self.impact[np.minimum(at, len(self.doc) - 1)], 0).sum(axis=1))
            found = np.append(found, doc)
            if len(score) > most:
                first = np.lexsort([found, -score])[:most]
                score, found = score[first], found[first]
            least = max(floor, int(score.min())) if len(score) == most else floor
            new_lo, new_hi = np.concatenate([a, at + hit]), np.concatenate([at, b])
            new_peaks = self.peak(new_lo, new_hi)
            new_bound = self.impact[new_peaks].sum(axis=1)
            lo, hi, peaks, bound = (np.concatenate([x[rest], y]) for x, y in ((lo, new_lo), (hi, new_hi), (peaks, new_peaks), (bound, new_bound)))
            live = bound >= least
            lo, hi, peaks, bound = lo[live], hi[live], peaks[live], bound[live]
        order = np.lexsort([found, -score])
        order = order[score[order] >= floor]
        return score[order], found[order]


def _searcher(most: int, rounds: int | None):
    """The best rows of every item of a block in one shard."""

    def search(postings: pa.Table, items: pa.Table) -> pa.Table:
        ids, place = np.unique(postings.column("at").to_numpy(), return_inverse=True)
        # documents in the order of ties
        key = np.zeros(len(ids), np.int64)
        key[place] = postings.column("doc_id").to_numpy()
        order = np.lexsort([ids, key])
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        shard = Shard(postings.column("term").to_numpy(), rank[place], postings.column("impact").to_numpy(), len(ids)) if len(ids) else None
        out: list[tuple] = []
        for x in items.to_pylist() if shard is not None else []:
            score, doc = shard.search(np.array(x["terms"], np.int64), most, x["floor"], rounds)
            out += [(x["item"], int(key[order[d]]), int(ids[order[d]]), int(s)) for s, d in zip(score, doc)]
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("item", "doc_id", "at", "score"), columns)})

    return search


def ranked(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", most: int = MOST, shard: int = SHARD, items_in_block: int = ITEMS, most_terms: int = TERMS, probes: int = PROBES) -> DataFrame:
    """(item, rank, key, score): the `most` highest-scoring rows of docs with a score above 0 for each row of benchmark."""
    spark = docs.sparkSession
    asked = stored(counted(benchmark, item, text).withColumn("item", F.monotonically_increasing_id()).select("item", F.col("key").alias("name"), "terms"))
    vocabulary = stored(asked.select(F.explode("terms").alias("term")).distinct())
    sent = None
    if vocabulary.limit(most_terms + 1).count() <= most_terms:
        sent = spark.sparkContext.broadcast({r.term.encode() for r in vocabulary.toLocalIterator()})
    read = stored(counted(docs, key, text, sent).select(F.monotonically_increasing_id().alias("at"), F.col("key").cast("long").alias("doc_id"), "n", "terms", "tfs"))
    if sent is not None:
        sent.destroy()
    whole = read.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    met = read.filter("n > 0").select("at", "doc_id", "n", F.inline(F.arrays_zip("terms", "tfs"))).withColumnsRenamed({"terms": "term", "tfs": "tf"})
    df = met.join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = df.select("term", F.floor(F.lit(1000.0) * F.log((F.lit(2 * whole.N + 2) / (2 * F.col("df") + 1)))).alias("w"), "df")
    weighed = stored(weighed.withColumn("id", F.monotonically_increasing_id()))
    total = weighed.agg(F.sum("df")).first()[0] or 0
    shards = max(1, -(-total // shard))
    n_items = asked.count()
    blocks = max(1, -(-n_items // items_in_block))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    of_item = asked.select("item", block.alias("block"), F.explode("terms").alias("term")).join(weighed.select("term", "id"), "term")
    items = stored(of_item.groupBy("item", "block").agg(F.collect_list("id").alias("terms")))
    wanted = weighed.crossJoin(F.broadcast(spark.range(blocks).select(F.col("id").cast("int").alias("block")))) if blocks == 1 else weighed.join(of_item.select("term", "block").distinct(), "term")
    m = F.expr(f"100 - 90 + ((90 * n * {whole.N}L) div {max(whole.L, 1)}L)")
    impact = F.expr("w * ((1000000000 * tf) div (1000 * tf + 8 * m))")
    postings = met.filter("doc_id IS NOT NULL").withColumn("m", m).join(wanted.select("term", "id", "w", "block"), "term").select(F.pmod(F.xxhash64("at"), F.lit(shards)).cast("int").alias("shard"), "block", F.col("id").alias("term"), "doc_id", "at", impact.alias("impact")).filter("impact > 0")
    postings = stored(postings)

    def best(items: DataFrame, rounds: int | None) -> DataFrame:
        spread = items.select("item", "block", "terms", "floor", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
        found = postings.groupBy("shard", "block").cogroup(spread.groupBy("shard", "block")).applyInArrow(_searcher(most, rounds), "item long, doc_id long, at long, score long")
        w = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "at")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)

    floors = None
    asks = items.withColumn("floor", F.lit(1).cast("long"))
    if shards > 1 and probes:
        floors = stored(best(asks, probes).filter(F.col("rank") == most).select("item", F.col("score").alias("f")))
        asks = items.join(floors, "item", "left").select("item", "block", "terms", F.coalesce("f", F.lit(1)).cast("long").alias("floor"))
    top = stored(best(asks, None))
    out = top.join(asked.select("item", "name"), "item").select(F.col("name").alias(item), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(key), "score")
    forget(postings, read, *([floors] if floors is not None else []))
    return out


def op12(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each benchmark item's ten best documents."""
    return ranked(docs, benchmark)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(t)) AS BIGINT) AS L FROM d WHERE len(t) > 0),
i AS (SELECT item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT item_id, unnest(t) AS term FROM i),
f AS (SELECT doc_id, 100 - 90 + ((90 * nt * nd) // L) AS m, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(t) AS BIGINT) AS nt, unnest(t) AS term FROM d) CROSS JOIN c GROUP BY doc_id, nt, nd, L, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY 1) CROSS JOIN c),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN w USING (term) GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
