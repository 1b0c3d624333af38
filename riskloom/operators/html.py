"""Article pages, list pages and feeds, by JVM-side expressions over whole pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import canonical_url, given

_PAIRS = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def stripped(html: Column) -> Column:
    """html without comments, scripts and styles."""
    t = F.regexp_replace(given(html), r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?si)<script[^>]*>.*?</script>", "")
    return F.regexp_replace(t, r"(?si)<style[^>]*>.*?</style>", "")


def plain(fragment: Column) -> Column:
    """A fragment's text: tags off, common references decoded, white space to single spaces, trimmed."""
    t = F.regexp_replace(fragment, "<[^>]+>", "")
    for a, b in _PAIRS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"[\s]+", " "))


def paragraphs(html: Column, least: int = 5) -> Column:
    """array<string>: the texts of closed paragraphs of at least `least` characters."""
    found = F.regexp_extract_all(html, F.lit(r"(?s)<p(?: [^>]*)?>(.*?)</p>"), F.lit(1))
    return F.filter(F.transform(found, plain), lambda p: F.length(p) >= least)


def article_pages(pages: DataFrame, html: str = "html", title_over: int = 3, lead: int = 200) -> DataFrame:
    """pages with title, published, content, author and summary; only those with a title and content.

    published is the first date-time, else date, after a published marker, else anywhere; the byline, a first
    paragraph 'source ... author', is cut from the content.
    """
    df = pages.withColumn("__h", stripped(F.col(html)))
    title = plain(F.regexp_extract("__h", r"(?s)<h1[^>]*>(.*?)</h1>", 1))
    stamp = r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}(?::\d{2})?"
    day = r"\d{4}-\d{1,2}-\d{1,2}"
    mark = r"(?s)(?:发布|发布时间|[Pp]ublished)[^0-9]{0,40}"
    pick = lambda pattern, group=1: F.nullif(F.regexp_extract("__h", pattern, group), F.lit(""))
    published = F.coalesce(pick(f"{mark}({stamp})"), pick(f"{mark}({day})"), pick(f"({stamp})"), pick(f"({day})"))
    df = df.withColumn("__p", paragraphs(F.col("__h")))
    byline = r"^(?:来源|[Ss]ource)[:：]\s*(\S+)\s+(?:作者|[Aa]uthor)[:：]\s*(\S+)"
    first = F.coalesce(F.get("__p", F.lit(0)), F.lit(""))
    by = first.rlike(byline)
    body = F.when(by, F.slice("__p", F.lit(2), F.greatest(F.size("__p") - 1, F.lit(0)))).otherwise(F.col("__p"))
    df = df.select(*pages.columns, title.alias("title"), published.alias("published"), F.array_join(body, "\n").alias("content"), F.nullif(F.regexp_extract(first, byline, 2), F.lit("")).alias("author"), F.substring(F.array_join(body, " "), 1, lead).alias("summary"))
    return df.filter((F.length("title") > title_over) & (F.col("content") != ""))


def body_text(html: Column, containers: tuple[str, ...] = (r"(?s)<article[^>]*>(.*?)</article>", r"(?s)<main[^>]*>(.*?)</main>", r"(?s)<div class=\"(?:content|article|post)[^\"]*\"[^>]*>(.*?)</div>"), least: int = 50, most: int | None = None) -> Column:
    """The paragraphs of the first container with more than `least` characters of them, else all; cut to `most` characters if given."""
    clean = stripped(html)
    tries = [F.array_join(paragraphs(F.regexp_extract(clean, c, 1), 1), "\n") for c in containers]
    kept = [F.when(F.length(t) > least, t) for t in tries]
    whole = F.coalesce(*kept, F.array_join(paragraphs(clean, 1), "\n"))
    return whole if most is None else F.substring(whole, 1, most)


def links(pages: DataFrame, html: str = "html", base: str = "http://example.com", path: str | None = None, least_title: int = 1) -> DataFrame:
    """(page columns but html, at, url, title): each link, absolute, by its path and title length."""
    keep = [c for c in pages.columns if c != html]
    pattern = r"(?si)<a\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>"
    clean = stripped(F.col(html))
    both = F.arrays_zip(F.regexp_extract_all(clean, F.lit(pattern), F.lit(1)).alias("u"), F.regexp_extract_all(clean, F.lit(pattern), F.lit(2)).alias("t"))
    df = pages.select(*keep, F.posexplode(both).alias("at", "l")).select(*keep, "at", canonical_url(F.col("l.u"), base).alias("url"), plain(F.col("l.t")).alias("title"))
    df = df.filter(F.length("title") >= least_title)
    return df if path is None else df.filter(F.contains("url", F.lit(path)))


def page_items(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page columns but html, at, title, content): items of a list page: articles, else the whole body as one."""
    keep = [c for c in pages.columns if c != html]
    clean = stripped(F.col(html))
    found = F.regexp_extract_all(clean, F.lit(r"(?si)<(?:article|div class=\"(?:news-item|post)[^\"]*\"|li class=\"(?:news-item|post)[^\"]*\")[^>]*>(.*?)</(?:article|div|li)>"), F.lit(1))
    df = pages.select(*keep, F.posexplode(F.when(F.size(found) > 0, found).otherwise(F.array(clean))).alias("at", "__i"))
    title = plain(F.coalesce(*[F.nullif(F.regexp_extract("__i", rf"(?si)<{t}[^>]*>(.*?)</{t}>", 1), F.lit("")) for t in ("h1", "h2", "h3", "a")], F.lit("")))
    return df.select(*keep, "at", title.alias("title"), F.array_join(paragraphs(F.col("__i"), 1), "\n").alias("content")).filter("title <> ''")


def feed_items(feeds: DataFrame, xml: str = "xml", most: int = 30, longest: int = 2000) -> DataFrame:
    """(feed columns but xml, at, title, url, published, summary): the first `most` items or entries of each feed."""
    keep = [c for c in feeds.columns if c != xml]
    x = given(F.col(xml))
    items, entries = (F.regexp_extract_all(x, F.lit(rf"(?s)<{t}[ >].*?</{t}>"), F.lit(0)) for t in ("item", "entry"))
    df = feeds.select(*keep, F.posexplode(F.slice(F.when(F.size(items) > 0, items).otherwise(entries), 1, most)).alias("at", "__i"))
    bare = lambda c: F.regexp_replace(c, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    tag = lambda *names: F.coalesce(*[F.nullif(F.trim(bare(F.regexp_extract("__i", rf"(?s)<{n}(?: [^>]*)?>(.*?)</{n}>", 1))), F.lit("")) for n in names])
    url = F.coalesce(F.nullif(F.regexp_extract("__i", r"<link[^>]*href=\"([^\"]*)\"", 1), F.lit("")), tag("link", "guid", "id"))
    return df.select(*keep, "at", plain(tag("title")).alias("title"), url.alias("url"), tag("pubDate", "published", "updated", "dc:date").alias("published"), F.substring(plain(F.coalesce(tag("description", "summary", "content"), F.lit(""))), 1, longest).alias("summary")).filter("title <> ''")
