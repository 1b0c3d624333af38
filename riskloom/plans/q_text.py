"""Queries of text, cleaning and page operators."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from riskloom.functions import params
from riskloom.functions import text as T
from riskloom.functions.seeds import ENTITIES, rows
from riskloom.operators import clean, html
from riskloom.operators.seen import SeenKeys
from riskloom.plans.bindings import L, R
from riskloom.session import shared_folder, table
from riskloom.sources import seeds

WS = "[\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0B}\\x{1C}-\\x{1F}\\x{85}]"
NOISE = "'(?:" + "|".join(params.NOISE_MARKS) + ").*'"
AS_OF = "DATE '2024-02-01'"


def docs(spark, d):
    """Documents with markup, a URL, odd spaces and noise added to the whole text, so that every rule has work."""
    t = table(spark, d, "documents")
    return t.select("doc_id", "source", "lang", F.concat(F.lit("<p>\t"), F.col("text"), F.lit("　</p> https://e.x/"), F.col("doc_id").cast("string"), F.lit(" end"), F.when(F.col("doc_id") % 3 == 0, " 版权声明 tail").otherwise("")).alias("text"))


DOCS = "SELECT doc_id, source, lang, '<p>' || chr(9) || text || chr(12288) || '</p> https://e.x/' || doc_id || ' end' || CASE WHEN doc_id % 3 = 0 THEN ' 版权声明 tail' ELSE '' END AS text FROM documents"


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def clean_sql(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), '<[^>]+>', '', 'g')"
    t = trim_sql(f"regexp_replace({t}, '{WS}+', ' ', 'g')")
    t = f"regexp_replace({t}, {NOISE}, '')"
    return trim_sql(f"regexp_replace({t}, 'https?://[^\\s\\x{{3000}}\\x{{A0}}]+', '', 'g')")


def _articles(spark, d):
    """Documents as landed articles with a title, a date in one of many forms and a sequence number."""
    t = table(spark, d, "documents")
    k = F.col("doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int"))
    forms = F.when(k % 5 == 0, F.date_format(day, "yyyy-M-d")).when(k % 5 == 1, F.date_format(day, "d/M/yyyy")).when(k % 5 == 2, F.concat(F.year(day), F.lit("年"), F.month(day), F.lit("月"), F.dayofmonth(day), F.lit("日"))).when(k % 5 == 3, F.lit("Mon, 01 Jan 2024"))
    return t.select(k.alias("ingest_seq"), F.when(k % 7 == 0, "").otherwise(F.substring("text", 1, 20)).alias("title"), F.when(k % 11 == 0, F.lit("")).otherwise(F.col("text")).alias("content"), forms.alias("pub_time"), "source")


ARTICLE_SQL = """SELECT doc_id AS ingest_seq, CASE WHEN doc_id % 7 = 0 THEN '' ELSE substring(text, 1, 20) END AS title, CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END AS content, source,
  CASE doc_id % 5 WHEN 0 THEN year(dd) || '-' || month(dd) || '-' || day(dd) WHEN 1 THEN day(dd) || '/' || month(dd) || '/' || year(dd) WHEN 2 THEN year(dd) || '年' || month(dd) || '月' || day(dd) || '日' WHEN 3 THEN 'Mon, 01 Jan 2024' END AS pub_time,
  dd FROM (SELECT *, DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS dd FROM documents)"""
DATE_SQL = f"CAST(coalesce(try_strptime(pub_time, ['%Y-%m-%d', '%Y年%m月%d日', '%Y/%m/%d', '%d/%m/%Y', '%m/%d/%Y', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M']), CAST({AS_OF} AS TIMESTAMP)) AS DATE)"


def as_of():
    return F.lit("2024-02-01").cast("date")



def _mixed(spark, d):
    """Documents with a known share of CJK characters in front."""
    return table(spark, d, "documents").select("doc_id", F.concat(F.repeat(F.lit("冲突"), (F.col("doc_id") % 4).cast("int") * 10), F.lit(" attack "), F.col("text")).alias("text"))


MIXED = "SELECT doc_id, repeat('冲突', CAST(doc_id % 4 AS INT) * 10) || ' attack ' || text AS text FROM documents"
CJK = "[^\\x{4E00}-\\x{9FFF}]"
ZH = f"(length({trim_sql('text')}) = 0 OR length(regexp_replace({trim_sql('text')}, '{CJK}', '', 'g')) > 0.3 * length({trim_sql('text')}))"
LOW = "lower(text)"
KW = L([w.lower() for w in params.CONFLICT_WORDS_ZH + params.CONFLICT_WORDS_EN])
PRE = f"""SELECT ingest_seq, {clean_sql('title')} AS title, {clean_sql('content')} AS content, {DATE_SQL} AS pub_date FROM ({ARTICLE_SQL})"""


def _held(words, x):
    return f"list_filter({L(words)}, lambda w: contains({x}, w))"


POS, NEG = f"len({_held(params.POSITIVE_WORDS, LOW)})", f"len({_held(params.NEGATIVE_WORDS, LOW)})"


def gazetteer(spark):
    return seeds.gazetteer(seeds.entities(spark))


ALIASES = [(x, n, seeds.TAG_TYPES.get(t)) for n, t, a in rows(ENTITIES) for x in [n, *filter(None, a.split(","))]]


def mentions(s, d):
    """Documents with names of the seed entities before and behind them."""
    name = lambda k: F.get(F.lit([a for a, _, _ in ALIASES]), k.cast("int"))
    k = F.col("doc_id")
    return table(s, d, "documents").select("doc_id", F.concat(name(k % len(ALIASES)), F.lit(" attack "), F.col("text"), F.lit(" "), F.upper(name((k * 7) % len(ALIASES)))).alias("text"))


_NAMES = L([a for a, _, _ in ALIASES])
MENTIONS = f"SELECT doc_id, {_NAMES}[CAST(doc_id % {len(ALIASES)} AS INT) + 1] || ' attack ' || text || ' ' || upper({_NAMES}[CAST((doc_id * 7) % {len(ALIASES)} AS INT) + 1]) AS text FROM documents"


def tags_sql(source: str) -> str:
    """SQL of clean.tag_entities over (doc_id, text)."""
    parts = [(re.findall("[一-鿿]|[a-z0-9]+", a.lower()), e, t) for a, e, t in ALIASES if t]
    known = "(VALUES " + ", ".join(f"('{u[0]}', '{' '.join(u)}', {len(u)}, '{e}', '{t}')" for u, e, t in parts) + ") g(head, whole, n, entity, type)"
    return f"""SELECT doc_id, {', '.join(f"coalesce(list(entity ORDER BY pos, entity) FILTER (type = '{t}'), []) AS {t}s" for t in ('location', 'organization', 'person'))} FROM (
  SELECT d.doc_id, type, entity, min(pos) AS pos FROM ({source}) d LEFT JOIN (SELECT doc_id, pos, entity, type FROM (SELECT doc_id, u, unnest(range(1, len(u) + 1)) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '{clean.UNIT}') AS u FROM ({source})))
  JOIN {known} ON u[pos] = head AND array_to_string(u[pos:pos + n - 1], ' ') = whole) h ON h.doc_id = d.doc_id GROUP BY 1, 2, 3) GROUP BY 1"""


TAGS = tags_sql(MENTIONS)

STRIP = "regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?si)<script[^>]*>.*?</script>', '', 'g'), '(?si)<style[^>]*>.*?</style>', '', 'g')"


def plain_sql(x: str) -> str:
    t = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    for a, b in html._PAIRS:
        t = f"replace({t}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({t}, '[\\s]+', ' ', 'g'))"


PARAS = f"list_filter(list_transform(regexp_extract_all(h, '(?s)<p(?: [^>]*)?>(.*?)</p>', 1), lambda x: {plain_sql('x')}), lambda x: length(x) >= 5)"
CONTAINERS = [r"(?s)<article[^>]*>(.*?)</article>", r"(?s)<main[^>]*>(.*?)</main>", r'(?s)<div class="(?:content|article|post)[^"]*"[^>]*>(.*?)</div>']
ITEM = r'(?si)<(?:article|div class="(?:news-item|post)[^"]*"|li class="(?:news-item|post)[^"]*")[^>]*>(.*?)</(?:article|div|li)>'
TITLE = "coalesce(" + ", ".join(f"nullif(regexp_extract(i, '(?si)<{t}[^>]*>(.*?)</{t}>', 1), '')" for t in ("h1", "h2", "h3", "a")) + ", '')"


def _body(x: str) -> str:
    return f"array_to_string(list_filter(list_transform(regexp_extract_all({x}, '(?s)<p(?: [^>]*)?>(.*?)</p>', 1), lambda y: {plain_sql('y')}), lambda y: length(y) >= 1), chr(10))"


LINK = "'(?si)<a\\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>'"
PAGES = f"SELECT page_id, url, {STRIP} AS h FROM pages"

QUERIES = {
    "clean_text": lambda s, d: docs(s, d).select("doc_id", T.clean_text(F.col("text")).alias("text")),
    "normalize_date": lambda s, d: _articles(s, d).select("ingest_seq", T.normalize_date(F.col("pub_time"), as_of()).alias("pub_date")),
    "lang_ratio": lambda s, d: _mixed(s, d).select("doc_id", T.script_language(F.col("text")).alias("by_share"), T.any_cjk_language(F.col("text")).alias("by_any")),
    "kw_flag": lambda s, d: _mixed(s, d).select("doc_id", T.contains_any(F.col("text"), params.CONFLICT_WORDS_ZH + params.CONFLICT_WORDS_EN).alias("flag")),
    "event_keywords": lambda s, d: _mixed(s, d).select("doc_id", F.array_join(T.event_words(F.col("text"), T.script_language(F.col("text"))), ",").alias("words")),
    "lexicon_sentiment": lambda s, d: _mixed(s, d).select("doc_id", T.lexicon_sentiment(F.col("text")).alias("sentiment")),
    "compound_sentiment": lambda s, d: table(s, d, "events").select("event_id", T.compound_sentiment(F.col("value") / 250 - 1).alias("sentiment")),
    "preprocess": lambda s, d: clean.preprocess(_articles(s, d), as_of()).select("ingest_seq", "title", F.md5("content").alias("content_md5"), "pub_date"),
    "dedup_content": lambda s, d: clean.dedup_content(table(s, d, "documents"), "text", "doc_id").select("doc_id", "lang"),
    "input_validation": lambda s, d: clean.valid_input(table(s, d, "documents"), "text")[0].select("doc_id", F.length("text").alias("n")),
    "input_rejects": lambda s, d: clean.valid_input(table(s, d, "documents"), "text")[1].select("doc_id", F.length("text").alias("n")),
    "entity_tags": lambda s, d: clean.tag_entities(mentions(s, d), gazetteer(s)),
    "enabled_sources": lambda s, d: clean.enabled(table(s, d, "documents"), _sources(s, d)).groupBy("source").agg(F.count(F.lit(1)).alias("n")),
    "ingest_counts": lambda s, d: table(s, d, "documents").rollup("source").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("longest")),
    "first_per_source": lambda s, d: clean.ranked(table(s, d, "documents"), ["source"], [F.col("doc_id")], 3, "rank").select("source", "rank", "doc_id", F.md5("text").alias("text_md5")),
    "query_many": lambda s, d: clean.query_many(table(s, d, "documents").select("doc_id", "text", "lang", F.concat(F.lit("http://d/"), (F.col("doc_id") % 300).cast("string")).alias("url")), s.createDataFrame(ASKED, "query_no int, query string"), order="doc_id", language="lang").select("url", "doc_id", "query"),
    "canonical_urls": lambda s, d: table(s, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"), T.canonical_url(F.regexp_replace("url", "^https?://[^/]+", ""), "http://base").alias("rebased")),
    "page_extract": lambda s, d: html.article_pages(table(s, d, "pages")).select("page_id", "title", F.size(F.split("content", "\n")).alias("paragraphs"), F.md5("content").alias("content_md5")),
    "page_body": lambda s, d: table(s, d, "pages").select("page_id", html.body_text(F.col("html")).alias("body")),
    "page_items": lambda s, d: html.page_items(table(s, d, "pages")).select("page_id", F.col("at").alias("at_"), "title", F.length("content").alias("n_chars")),
    "page_links": lambda s, d: html.links(table(s, d, "pages").select("page_id", "html")).select("page_id", F.col("at").alias("at_"), "url", "title"),
    "new_urls": lambda s, d: _new_urls(s, d),
    "seen_store": lambda s, d: _seen_store(s, d),
    "seen_urls": lambda s, d: clean.newest_keys(table(s, d, "pages").select(T.canonical_url(F.col("url")).alias("url")), "url", 100),
    "merge_urls": lambda s, d: _merge(s, d),
    "json_extract": lambda s, d: _json(s, d),
    "json_completeness": lambda s, d: table(s, d, "events").select("event_id", T.completeness(F.coalesce(F.size(F.json_object_keys("props")), F.lit(0))).alias("confidence")),
    "feed_items": lambda s, d: html.feed_items(_feeds(s, d)).select("source", "part", F.col("at").alias("at_"), "title", "url", "published", "summary"),
}


ASKED = [(0, "licensed"), (1, "tion"), (2, "冲突"), (3, "the")]
FEED = 1000


def _sources(s, d):
    """Sources by number: a third switched off, a third without a word, and those from src6 on unknown."""
    k = F.substring("source", 4, 9).cast("int")
    return table(s, d, "documents").select("source").distinct().filter(k < 6).select("source", F.when(k % 3 == 1, False).when(k % 3 == 2, True).alias("enabled"))


def _feeds(s, d):
    """Feeds of a source's documents, in order of id, as RSS: one for each FEED ids, so that no feed grows with the table."""
    t = table(s, d, "documents").withColumn("part", F.floor(F.col("doc_id") / FEED))
    item = F.concat(F.lit("<item><title>"), F.concat(F.lit("T"), F.col("doc_id").cast("string")), F.lit("</title><link>http://d/"), F.col("doc_id").cast("string"), F.lit("</link><pubDate>2024-01-01</pubDate><description><![CDATA[<b>"), F.col("source"), F.lit("</b> x]]></description></item>"))
    return t.groupBy("source", "part").agg(F.concat(F.lit("<rss><channel><title>c</title>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("x")))), lambda x: x["x"]), ""), F.lit("</channel></rss>")).alias("xml"))


def _new_urls(s, d):
    p = table(s, d, "pages").select("page_id", "url")
    return clean.unseen(p.filter("page_id % 2 = 0"), p.filter("page_id % 3 = 0")).select("page_id", "url")


def _seen_store(s, d):
    """The new keys of a second merge into a store of seen URLs."""
    store = SeenKeys(s, f"{shared_folder(s)}/seen-{uuid.uuid4().hex}")
    p = table(s, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))
    store.merge(p.filter("page_id % 3 = 0"), "url")
    return store.merge(p, "url").withColumnRenamed("key", "url")


def _merge(s, d):
    p = table(s, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"))
    return clean.merge_new(clean.dedup_url(p.filter("page_id % 2 = 0"), order="page_id"), p.filter("page_id % 2 = 1"), order="page_id").select("page_id", "url")


def _json(s, d):
    e = table(s, d, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("so: "), F.col("props"), F.lit(" done"))).otherwise(F.lit("no object"))
    got = T.json_object(text)
    return e.select("event_id", F.when(F.col("event_id") % 3 == 2, F.get_json_object(got, "$.event_type")).otherwise(got).alias("json"))


ORACLES = {
    "clean_text": f"SELECT doc_id, {clean_sql('text')} AS text FROM ({DOCS})",
    "normalize_date": f"SELECT ingest_seq, {DATE_SQL} AS pub_date FROM ({ARTICLE_SQL})",
    "lang_ratio": f"SELECT doc_id, CASE WHEN {ZH} THEN 'zh' ELSE 'en' END AS by_share, CASE WHEN length(regexp_replace(text, '{CJK}', '', 'g')) > 0 THEN 'zh' ELSE 'en' END AS by_any FROM ({MIXED})",
    "kw_flag": f"SELECT doc_id, len(list_filter({KW}, lambda w: contains({LOW}, w))) > 0 AS flag FROM ({MIXED})",
    "event_keywords": f"SELECT doc_id, array_to_string(CASE WHEN {ZH} THEN {_held(params.EVENT_WORDS_ZH, 'text')} ELSE {_held(params.EVENT_WORDS_EN, LOW)} END, ',') AS words FROM ({MIXED})",
    "lexicon_sentiment": f"SELECT doc_id, CASE WHEN {POS} + {NEG} = 0 THEN 0.5 ELSE {R(f'CAST({POS} AS DOUBLE) / greatest({POS} + {NEG}, 1)', 4)} END AS sentiment FROM ({MIXED})",
    "compound_sentiment": f"SELECT event_id, coalesce({R('(value / 250 - 1 + 1) / 2', 4)}, 0.5) AS sentiment FROM events",
    "preprocess": f"SELECT ingest_seq, title, md5(content) AS content_md5, pub_date FROM (SELECT *, row_number() OVER (PARTITION BY md5(content) ORDER BY ingest_seq) AS r FROM ({PRE})) WHERE r = 1 AND (title <> '' OR content <> '')",
    "dedup_content": "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) AS r FROM documents) WHERE r = 1",
    "input_validation": f"SELECT doc_id, CAST(length(text) AS INT) AS n FROM documents WHERE length({trim_sql('text')}) > 0 AND length(text) <= 10000",
    "input_rejects": f"SELECT doc_id, CAST(length(text) AS INT) AS n FROM documents WHERE NOT (length({trim_sql('text')}) > 0 AND length(text) <= 10000)",
    "entity_tags": TAGS,
    "enabled_sources": "SELECT source, count(*) AS n FROM documents WHERE CAST(substring(source, 4) AS INT) < 6 AND CAST(substring(source, 4) AS INT) % 3 <> 1 GROUP BY 1",
    "ingest_counts": "SELECT source, count(*) AS n, CAST(max(length(text)) AS INT) AS longest FROM documents GROUP BY ROLLUP (source)",
    "first_per_source": "SELECT source, CAST(r AS INT) AS rank, doc_id, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 3",
    "query_many": "SELECT url, doc_id, query FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY query_no, doc_id) AS r FROM (SELECT doc_id, text, lang, 'http://d/' || (doc_id % 300) AS url FROM documents) JOIN (VALUES (0, 'licensed', 'en'), (1, 'tion', 'en'), (2, '冲突', 'zh'), (3, 'the', 'en')) q(query_no, query, asked) ON contains(lower(text), query) AND lang = asked) WHERE r = 1",
    "canonical_urls": "SELECT page_id, regexp_replace(url, '/+$', '') AS url, CASE WHEN starts_with(u, 'http') THEN u ELSE 'http://base' || u END AS rebased FROM (SELECT *, regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '/+$', '') AS u FROM pages)",
    "page_extract": f"SELECT page_id, title, CAST(len(p) AS INT) AS paragraphs, md5(array_to_string(p, chr(10))) AS content_md5 FROM (SELECT page_id, {plain_sql('''regexp_extract(h, '(?s)<h1[^>]*>(.*?)</h1>', 1)''')} AS title, {PARAS} AS p FROM ({PAGES})) WHERE length(title) > 3 AND len(p) > 0",
    "page_body": f"SELECT page_id, CASE WHEN length(b1) > 50 THEN b1 WHEN length(b2) > 50 THEN b2 WHEN length(b3) > 50 THEN b3 ELSE {_body('h')} END AS body FROM (SELECT page_id, h, {', '.join(_body(f"regexp_extract(h, '{c}', 1)") + f' AS b{i}' for i, c in enumerate(CONTAINERS, 1))} FROM ({PAGES}))",
    "page_items": f"SELECT page_id, CAST(pos AS INT) AS at_, title, CAST(length({_body('i')}) AS INT) AS n_chars FROM (SELECT page_id, pos, i, {plain_sql(TITLE)} AS title FROM (SELECT page_id, unnest(f) AS i, unnest(range(len(f))) AS pos FROM (SELECT page_id, CASE WHEN len(f) > 0 THEN f ELSE [h] END AS f FROM (SELECT page_id, h, regexp_extract_all(h, '{ITEM}', 1) AS f FROM ({PAGES}))))) WHERE title <> ''",
    "page_links": f"SELECT page_id, CAST(pos AS INT) AS at_, CASE WHEN starts_with(u, 'http') THEN u ELSE 'http://example.com' || u END AS url, title FROM (SELECT page_id, pos, regexp_replace(u, '/+$', '') AS u, {plain_sql('t')} AS title FROM (SELECT page_id, unnest(regexp_extract_all(h, {LINK}, 1)) AS u, unnest(regexp_extract_all(h, {LINK}, 2)) AS t, unnest(range(len(regexp_extract_all(h, {LINK}, 1)))) AS pos FROM ({PAGES}))) WHERE length(title) >= 1",
    "seen_store": "SELECT DISTINCT regexp_replace(url, '/+$', '') AS url FROM pages WHERE url IS NOT NULL EXCEPT SELECT regexp_replace(url, '/+$', '') FROM pages WHERE page_id % 3 = 0",
    "new_urls": "SELECT page_id, url FROM pages WHERE page_id % 2 = 0 AND regexp_replace(url, '/+$', '') NOT IN (SELECT regexp_replace(url, '/+$', '') FROM pages WHERE page_id % 3 = 0)",
    "seen_urls": "SELECT DISTINCT regexp_replace(url, '/+$', '') AS url FROM pages ORDER BY 1 DESC LIMIT 100",
    "merge_urls": "WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages), k AS (SELECT *, regexp_replace(url, '/+$', '') AS u, row_number() OVER (PARTITION BY regexp_replace(url, '/+$', ''), page_id % 2 ORDER BY page_id) AS r FROM p) SELECT page_id, url FROM k WHERE r = 1 AND (page_id % 2 = 0 OR u NOT IN (SELECT u FROM k WHERE page_id % 2 = 0))",
    "json_extract": "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'parse failed' ELSE props END AS json FROM events",
    "json_completeness": f"SELECT event_id, CASE WHEN n > 0 THEN {R('least(1.0, CAST(n AS DOUBLE) / 4 * 0.8 + 0.2)', 4)} ELSE 0.0 END AS confidence FROM (SELECT event_id, coalesce(len(json_keys(props)), 0) AS n FROM events)",
    "feed_items": "SELECT source, part, CAST(r - 1 AS INT) AS at_, 'T' || doc_id AS title, 'http://d/' || doc_id AS url, '2024-01-01' AS published, source || ' x' AS summary FROM (SELECT *, row_number() OVER (PARTITION BY source, part ORDER BY doc_id) AS r FROM (SELECT *, doc_id // 1000 AS part FROM documents)) WHERE r <= 30",
}
