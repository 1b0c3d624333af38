"""Cleaning, de-duplication and tagging of article tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import text as T
from riskloom.session import small


def first_by(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The row of the least `order` of each key.

    An aggregate of the whole row by its order, with partial minima before the shuffle: a key that holds
    a third of all rows costs one row a task, where a ranking window would sort them in one.
    """
    return df.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("__row")).select("__row.*")


def dedup_content(df: DataFrame, text: str = "content", order: str = "ingest_seq", empty_key: str = "collapse") -> DataFrame:
    """First row of each distinct text. empty_key: 'collapse' makes all empty texts one, 'keep' keeps each."""
    if empty_key == "keep":
        blank = T.given(F.col(text)) == ""
        return first_by(df.filter(~blank), F.md5(F.col(text)), order).unionByName(df.filter(blank))
    return first_by(df, F.md5(T.given(F.col(text))), order)


def dedup_url(df: DataFrame, url: str = "url", order: str = "ingest_seq", empty_key: str = "drop") -> DataFrame:
    """First row of each URL without closing slashes. empty_key: 'drop' drops rows without a URL, 'keep_one' keeps one."""
    key = T.canonical_url(F.col(url))
    if empty_key == "drop":
        df = df.filter(key != "")
    return first_by(df, key, order)


def merge_new(existing: DataFrame, incoming: DataFrame, url: str = "url", order: str = "ingest_seq", empty_key: str = "drop") -> DataFrame:
    """existing and the incoming rows of URLs that it lacks, the first of each."""
    return existing.unionByName(unseen(dedup_url(incoming, url, order, empty_key), existing, url), allowMissingColumns=True)


def unseen(df: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose canonical URL isn't among those seen."""
    keys = seen.select(T.canonical_url(F.col(url)).alias("__url")).distinct()
    return df.withColumn("__url", T.canonical_url(F.col(url))).join(keys, "__url", "left_anti").drop("__url")


def newest_keys(seen: DataFrame, key: str = "url", cap: int = 10_000, last_seen: str | None = None) -> DataFrame:
    """The `cap` keys seen last; without a time, those of the greatest text."""
    one = seen.groupBy(key).agg(F.max(last_seen).alias(last_seen)) if last_seen else seen.select(key).distinct()
    return one.orderBy(*([F.desc(last_seen)] if last_seen else []), F.desc(key)).limit(cap)


def preprocess(df: DataFrame, as_of: Column, title: str = "title", content: str = "content", published: str = "pub_time", order: str = "ingest_seq") -> DataFrame:
    """Clean title and content, normalise the date, keep the first of equal contents, drop rows with neither."""
    df = df.withColumn(title, T.clean_text(F.col(title))).withColumn(content, T.clean_text(F.col(content))).withColumn("pub_date", T.normalize_date(F.col(published), as_of))
    return dedup_content(df, content, order).filter((F.col(title) != "") | (F.col(content) != ""))


def valid_input(df: DataFrame, text: str = "text", most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): non-blank texts of at most `most` characters, and the rest."""
    ok = (F.length(T.trimmed(T.given(F.col(text)))) > 0) & (F.length(T.given(F.col(text))) <= most)
    return df.filter(ok), df.filter(~ok)


#: A unit of tagging: a single CJK character, or a run of other letters and digits.
UNIT = r"[\x{4E00}-\x{9FFF}]|(?:[^\P{L}\x{4E00}-\x{9FFF}]|\p{N})+"


def units(text: Column) -> Column:
    """array<string>: the units of a text, in lower case."""
    return F.regexp_extract_all(F.lower(T.given(text)), F.lit(UNIT), F.lit(0))


#: Bits of the filter of alias heads, as a power of two.
HEAD_BITS = 18


def _maybe_heads(names: DataFrame):
    """A test of whether a unit may begin an alias: a bitmap of the heads' hashes, built by aggregation and of a fixed size."""
    bit = F.xxhash64("head").bitwiseAND(F.lit((1 << HEAD_BITS) - 1))
    words = names.select(F.shiftright(bit, 6).alias("w"), F.lit(1).cast("long").alias("one"), bit.bitwiseAND(F.lit(63)).alias("b"))
    found = words.groupBy("w").agg(F.expr("bit_or(shiftleft(one, cast(b as int)))").alias("m")).collect()  # at most 2 ** HEAD_BITS bits
    table = [0] * (1 << HEAD_BITS - 6)
    for r in found:
        table[r.w] = r.m
    literal = F.from_json(F.lit(json.dumps(table)), "array<bigint>")

    def maybe(unit: Column) -> Column:
        h = F.xxhash64(unit).bitwiseAND(F.lit((1 << HEAD_BITS) - 1))
        return T.bound(h, lambda x: F.call_function("getbit", F.get(literal, F.shiftright(x, 6).cast("int")), x.bitwiseAND(F.lit(63)).cast("int")) == 1)

    return maybe


def tag_entities(df: DataFrame, gazetteer: DataFrame, key: str = "doc_id", text: str = "text", types: Sequence[str] = ("location", "organization", "person"), longest: int = 16) -> DataFrame:
    """(key, one array column a type): the gazetteer's entities in each text, first met first, each once.

    An alias (alias, entity, type) is a sequence of up to `longest` units, so several words and names in CJK
    script are found; longer ones are refused. Units that may begin an alias, by a filter of fixed size inside the
    projection, are exploded with the units behind them and joined with the aliases that begin with them; the dictionary
    never becomes one pattern, and is broadcast only if it is small.
    """
    parts = units(F.col("alias"))
    names = gazetteer.select(parts.alias("__u"), "entity", "type").filter(F.size("__u") > 0)
    names = names.select(F.get("__u", F.lit(0)).alias("head"), F.array_join("__u", " ").alias("whole"), F.size("__u").alias("n"), "entity", "type").distinct()
    too_long = names.filter(F.col("n") > longest).limit(1).collect()
    if too_long:
        raise ValueError(f"an alias of {too_long[0].n} units; at most {longest} are looked up")
    held = names.agg(F.max("n")).first()[0] or 1
    maybe = _maybe_heads(names)
    own = lambda u: F.filter(F.transform(u, lambda x, i: F.struct(x.alias("head"), i.alias("at"))), lambda x: maybe(x["head"]))
    whole = lambda u: F.transform(own(u), lambda x: F.struct(x["head"].alias("head"), x["at"].alias("at"), F.array_join(F.slice(u, x["at"] + 1, F.lit(held)), " ").alias("window")))
    windows = T.bound(units(F.col(text)), whole)
    met = df.select(key, F.inline(windows)).join(small(names), "head")
    fits = (F.col("window") == F.col("whole")) | F.startswith("window", F.concat("whole", F.lit(" ")))
    hits = met.filter(fits).groupBy(key, "type", "entity").agg(F.min("at").alias("at"))
    ordered = lambda t: F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == t, F.struct("at", "entity")))), lambda x: x["entity"]).alias(f"{t}s")
    return df.select(key).join(hits, key, "left").groupBy(key).agg(*[ordered(t) for t in types])


def query_articles(df: DataFrame, since: Column | None = None, country: str | None = None, language: str | None = None, most: int | None = None, date: str = "date", order: str = "ingest_seq") -> DataFrame:
    """Landed articles by time span, country and language, newest first, `most` rows if given."""
    if since is not None:
        df = df.filter(F.col(date) >= since)
    if country is not None:
        df = df.filter(F.col("country") == country)
    if language is not None:
        df = df.filter(F.col("language") == language)
    return df if most is None else df.orderBy(F.desc(date), order).limit(most)


#: Queries matched in one pass over the rows, and passes that a union of queries may take.
QUERY_BLOCK = 10_000
MOST_BLOCKS = 100


def query_many(df: DataFrame, queries: DataFrame, text: str = "text", url: str = "url", order: str = "ingest_seq", language: str | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """Rows that contain a query's text (queries: query_no, query), one for each URL: the first query's, then the first row.

    With `language`, a column of df of 'zh', 'en' and so on, a query meets only rows of its own language: zh if it
    has any CJK character, else en. Queries are a stated set, matched in blocks against all rows; it is read by the driver, so
    more than MOST_BLOCKS blocks are refused.
    """
    most = block * MOST_BLOCKS
    asked = queries.select("query_no", "query", T.any_cjk_language(F.col("query")).alias("query_language")).filter(F.col("query").isNotNull()).limit(most + 1).collect()
    if len(asked) > most:
        raise ValueError(f"more than {most} queries")
    parts = [_hits(df, asked[i : i + block], text, url, language) for i in range(0, max(len(asked), 1), block)]
    hits = reduce(DataFrame.unionAll, parts)
    return hits.groupBy(url).agg(F.min_by(F.struct(*hits.columns), F.struct("query_no", order)).alias("r")).select("r.*")


def _hits(df: DataFrame, asked: list, text: str, url: str, language: str | None) -> DataFrame:
    every = F.array(*[F.struct(F.lit(r.query_no).alias("query_no"), F.lit(r.query).alias("query"), F.lit(r.query_language).alias("query_language")) for r in asked]) if asked else F.array().cast("array<struct<query_no:int,query:string,query_language:string>>")

    def met(low: Column) -> Column:
        same = (lambda q: F.col(language) == q["query_language"]) if language else (lambda q: F.lit(True))
        return F.filter(every, lambda q: F.contains(low, F.lower(q["query"])) & same(q))

    return df.filter(T.given(F.col(url)) != "").select("*", F.inline(T.bound(F.lower(F.col(text)), met)))


def enabled(df: DataFrame, sources: DataFrame, source: str = "source") -> DataFrame:
    """Rows of the enabled ones of the known sources (source, enabled: null counts as enabled); unknown sources are skipped."""
    on = sources.filter(F.coalesce("enabled", F.lit(True))).select(F.col("source").alias(source)).distinct()
    return df.join(on, source, "left_semi")


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], most: int, name: str | None = None) -> DataFrame:
    """The first `most` rows of each group, in order."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    out = df.withColumn(name or "__rank", rank).filter(F.col(name or "__rank") <= most)
    return out if name else out.drop("__rank")
