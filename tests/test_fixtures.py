"""Values worked out by hand from the rules."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.functions import events as E
from riskloom.functions import params
from riskloom.functions import text as T
from riskloom.operators import align, clean, graph, html, score, spatial, timeseries

KEYS = list(params.WEIGHTS)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(v):
    return F.lit(v).cast("string")


@pytest.mark.parametrize("given, want", [("<p>a  b</p> http://x.y/z c", "a b  c"), ("x 版权声明 tail\nmore", "x"), (None, ""), ("　a b　", "a b"), ("", "")])
def test_clean_text(spark, given, want):
    assert one(spark, T.clean_text(lit(given))) == want


@pytest.mark.parametrize("given, want", [("2024-1-5", "2024-01-05"), ("05/13/2024", "2024-05-13"), ("03/04/2024", "2024-04-03"), ("2024年1月5日", "2024-01-05"), ("Mon, 01 Jan 2024", "2024-02-01"), (None, "2024-02-01"), ("2024-01-05 10:20", "2024-01-05")])
def test_normalize_date(spark, given, want):
    assert str(one(spark, T.normalize_date(lit(given), F.lit("2024-02-01").cast("date")))) == want


@pytest.mark.parametrize("given, want", [("缅甸ab", "zh"), ("缅甸abcdefgh", "en"), ("", "zh"), (None, "zh")])
def test_language(spark, given, want):
    assert one(spark, T.script_language(lit(given))) == want


def test_lexicon(spark):
    assert one(spark, T.lexicon_sentiment(lit("peace talks after attack"))) == 0.5
    assert one(spark, T.lexicon_sentiment(lit(None))) == 0.5


@pytest.mark.parametrize("n, want", [(3, 0.8), (4, 1.0), (0, 0.0)])
def test_completeness(spark, n, want):
    assert one(spark, T.completeness(F.lit(n))) == want


@pytest.mark.parametrize("given, want", [('```json\n{"a": 1}\n```', '{"a": 1}'), ('x {"a": {"b": 2}} y {"c": 1}', '{"a": {"b": 2}}')])
def test_json_object(spark, given, want):
    assert one(spark, T.json_object(lit(given))) == want


def test_json_object_failed(spark):
    assert "parse failed" in one(spark, T.json_object(lit("no object {bad")))


@pytest.mark.parametrize("given, norm, risk", [("-3.5,1,4", 0.4825, 0.5175), ("abc", 0.5, 0.5), ("", 0.5, 0.5), (None, 0.5, 0.5)])
def test_tone(spark, given, norm, risk):
    x = one(spark, E.tone(lit(given)))
    assert (x.normalized_score, x.risk_score) == (norm, risk)


@pytest.mark.parametrize("given, most, categories", [(["190", "POLITICAL_X"], 0.9, ["conflict", "unrest"]), (["1900A"], 0.2, []), (["SANCTIONS_1"], 0.6, ["humanitarian"]), ([], 0.2, [])])
def test_severity(spark, given, most, categories):
    x = one(spark, E.severity(F.array(*map(F.lit, given)).cast("array<string>")))
    assert (x.max_severity, x.event_categories) == (most, categories)


def test_locations(spark):
    x = one(spark, E.locations(F.lit("4#BM#Shan#BM11#21.5#98.0#x;bad#1;3#TH#Mae#T#x#9#f")))
    assert [tuple(p) for p in x] == [("Shan", 21.5, 98.0, "4", "BM")]


def _wide(spark, rows):
    return spark.createDataFrame([(f"s{i}", dt.date(2024, 1, 1), *map(float, r)) for i, r in enumerate(rows)], ["series_key", "date", *KEYS])


def test_scores_and_attribution(spark):
    wide = _wide(spark, [(1.0, 0.85, 0, 0, 0.8), (0.2, 0.5, 0.6, 0.7, 0.3)])
    values, weights = score.unpivot(wide, ("series_key", "date"), KEYS), score.weight_table(spark)
    got = {r.series_key: r for r in score.risk_scores(values, weights).collect()}
    assert (got["s0"].risk_score, got["s0"].risk_level, got["s0"].rebalanced) == (91.15, "高风险", True)
    assert (got["s1"].risk_score, got["s1"].risk_level, got["s1"].rebalanced) == (44.0, "中风险", False)
    detail = score.details(values, weights)
    shares = [r.share for r in score.drivers(detail).filter("series_key = 's0'").orderBy("rank").collect()]
    assert shares == pytest.approx([50.63, 35.86, 13.51], abs=0.01)
    a = {r.series_key: r for r in score.attribution(detail, score.risk_scores(values, weights).select("series_key", "date", "risk_score")).collect()}
    assert a["s0"].concentration == pytest.approx(0.4032, abs=1e-4) and a["s1"].concentration == pytest.approx(0.2353, abs=1e-4)
    assert a["s1"].primary_driver == params.INDICATOR_NAMES["sentiment_avg"]


def test_weights_are_checked(spark):
    with pytest.raises(ValueError):
        score.weight_table(spark, {"a": 0.5})


def test_normalize(spark):
    hist = spark.createDataFrame([("a", "k", v) for v in (0.1, 0.2, 0.3, 0.4, 0.9)] + [("b", "k", v) for v in (0.1, 0.2, 0.3, 0.4)], "series_key string, indicator string, value double")
    new = spark.createDataFrame([("a", "k", 0.5), ("b", "k", 1.3)], "series_key string, indicator string, value double")
    got = {r.series_key: r.value for r in score.normalize(new, score.percentiles(hist)).collect()}
    assert got == {"a": pytest.approx(0.5588, abs=1e-4), "b": 1.0}


def test_macro(spark):
    assert one(spark, score.activity_proxy(F.lit(68.5), F.lit(15.2))) == pytest.approx(0.6006, abs=1e-4)
    assert one(spark, score.displacement(F.lit(-2.0), F.lit(18.3))) == pytest.approx(0.6744, abs=1e-4)


@pytest.fixture(scope="module")
def s21(spark):
    s = [40 + 0.5 * i + (5 if i % 7 == 6 else 0) + (20 if i == 10 else 0) for i in range(21)]
    return spark.createDataFrame([("a", dt.date(2024, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(s)], "series_key string, date date, score double")


def test_series(s21):
    ma = [r.ma for r in timeseries.moving_average(s21).orderBy("date").collect()]
    assert len(ma) == 15 and ma[:4] == [42.2143, 42.7143, 43.2143, 43.7143]
    assert [r.wma for r in timeseries.weighted_moving_average(s21).orderBy("date").collect()][:3] == [43.25, 43.5714, 43.8929]
    line = timeseries.regression(s21).first()
    assert (line.slope, line.intercept, line.r_squared, line.trend) == (0.558442, 41.0823, 0.3671, "上升")
    odd = timeseries.anomalies(s21).collect()
    assert [(r.idx, r.score, r.z, r.kind) for r in odd] == [(10, 65.0, 3.2848, "peak")]
    f = timeseries.forecast(s21).orderBy("step").collect()
    assert [r.forecast for r in f] == [51.32, 51.65, 51.97, 52.3, 52.62, 52.95, 53.27] and (f[0].slope, f[0].r_squared, f[0].confidence) == (0.324176, 0.0594, "低")


def test_decomposition(s21):
    x = timeseries.decompose(s21).orderBy("date").collect()
    assert [r.trend for r in x[:4]] == [40.0, 40.0, 42.2143, 42.2143] and [r.trend for r in x[-4:]] == [49.2143] * 4
    assert [r.seasonal for r in x[:7]] == [-1.6395, -1.4728, -2.0442, 4.7891, -1.7109, -1.5442, 3.6224]
    assert [r.residual for r in x[:4]] == pytest.approx([1.6395, 1.9728, 0.8299, -5.5034], abs=1e-4)
    assert all(abs(r.trend + r.seasonal + r.residual - r.score) < 1e-3 for r in x)
    assert all((r.trend, r.seasonal) == (r.score, 0.0) for r in timeseries.decompose(s21.limit(13)).collect())


@pytest.mark.parametrize("given, want", [([None, 5, 0, None, 7], [5, 5, 5, 5, 7]), ([0, 3], [0, 3]), ([None, None, 4], [0, 0, 4])])
def test_fill_missing(spark, given, want):
    df = spark.createDataFrame([("a", i, None if v is None else float(v)) for i, v in enumerate(given)], "series_key string, date int, score double")
    assert [r.filled for r in timeseries.fill_missing(df).orderBy("date").collect()] == want


def test_pearson(spark):
    df = spark.createDataFrame([("a", x, y, 1.0) for x, y in zip([-0.02, 0.01, 0.0, 0.03], [15.0, 8.0, 9.0, 2.0])], "series_key string, x double, y double, c double")
    assert align.pearson(df, "x", "y").first().r == -0.9927 and align.pearson(df, "x", "c").first().r == 0.0


def test_alert_bands(spark):
    from riskloom.functions.num import banded

    df = spark.createDataFrame([(v,) for v in (80.0, 79.99, 60.0, 40.0, 39.99)], "s double")
    assert [r.x for r in df.select(banded(F.col("s"), params.ALERT_BANDS).alias("x")).collect()] == ["red", "orange", "orange", "yellow", "green"]


PLACES = [("仰光省", 16.87, 96.20), ("曼德勒省", 21.97, 96.08), ("内比都", 19.76, 96.07), ("掸邦", 21.50, 98.00), ("克钦邦", 25.00, 97.50), ("克伦邦", 17.00, 97.75), ("钦邦", 21.50, 93.50), ("克耶邦", 19.50, 97.50), ("孟邦", 16.30, 97.70), ("若开邦", 20.50, 93.20), ("勃固省", 18.00, 96.50), ("马圭省", 20.00, 95.00), ("实皆省", 23.50, 95.00), ("德林达依省", 12.25, 99.00), ("伊洛瓦底省", 15.50, 95.50)]
BORDER = {"掸邦", "克钦邦", "克伦邦", "若开邦", "钦邦"}
CENTERS = [("瑞丽", 24.01, 97.85, 1.0), ("皎漂港", 19.43, 93.55, 0.9), ("内比都", 19.76, 96.07, 0.8), ("妙瓦底", 16.69, 98.50, 0.7), ("仰光", 16.87, 96.20, 0.75)]


def test_spatial(spark):
    p = spark.createDataFrame([(n, a, o, 65.0 if n in BORDER else 40.0) for n, a, o in PLACES], "place string, lat double, lon double, risk double")
    c = spark.createDataFrame(CENTERS, "center string, lat double, lon double, weight double")
    top = spatial.potential(p, c).orderBy(F.desc("potential")).limit(3).collect()
    assert [(r.place, r.potential, r.total_influence, r.potential_normalized) for r in top] == [("内比都", 32.1106, 80.2765, 100.0), ("仰光省", 30.106, 75.2649, 93.76), ("克伦邦", 0.8537, 1.3133, 2.66)]
    m = spatial.morans_i(p).first()
    assert (m.morans_i, m.mean_risk) == (-0.0561, 48.33) and m.interpretation.startswith("空间随机")
    hot = {r.place: r for r in spatial.hotspots(p).collect()}
    assert set(hot) == {"克钦邦", "钦邦", "若开邦"} and all(r.neighbor_avg_risk == 48.33 and r.cluster_type == "高风险孤岛" for r in hot.values())
    same = p.withColumn("risk", F.lit(50.0))
    assert spatial.morans_i(same).first().morans_i == 0.0
    near, every = spatial.pairs(p, within_km=300.0), spatial.pairs(p).filter("km <= 300")
    assert {(r.a, r.b) for r in near.collect()} == {(r.a, r.b) for r in every.collect()}


@pytest.fixture(scope="module")
def diamond(spark):
    return spark.createDataFrame([("a", "b", "t", 1), ("b", "c", "t", 2), ("a", "c", "t", 3), ("c", "d", "t", 4)], "src string, dst string, type string, seq long")


def test_graph(spark, diamond):
    t = graph.totals(diamond).first()
    assert (t.n, t.m, t.density, t.average_degree) == (4, 4, 0.3333, 2.0)
    of = lambda df, c: {r.id: r[c] for r in df.collect()}
    assert of(graph.degree_centrality(diamond), "centrality") == {"a": 0.6667, "b": 0.6667, "c": 1.0, "d": 0.3333}
    assert of(graph.betweenness(diamond), "betweenness") == {"a": 0.0, "b": 0.0, "c": 0.3333, "d": 0.0}
    assert of(graph.closeness(diamond), "closeness") == {"a": 0.0, "b": 0.3333, "c": 0.6667, "d": 0.6}
    assert set(of(graph.components(diamond), "component").values()) == {"a"}
    empty = diamond.filter("false")
    assert graph.totals(empty).first().n == 0 and graph.components(empty).count() == 0 and graph.betweenness(empty).count() == 0


def _brandes(edges):
    nodes = sorted({x for e in edges for x in e})
    out = {n: sorted({b for a, b in edges if a == n and b != n}) for n in nodes}
    score_ = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        order, sigma, dist, before = [], {s: 1.0}, {s: 0}, {n: [] for n in nodes}
        todo = [s]
        while todo:
            v = todo.pop(0)
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] = sigma.get(w, 0) + sigma[v]
                    before[w].append(v)
        delta = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in before[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score_[w] += delta[w]
    n = len(nodes)
    return {v: score_[v] / ((n - 1) * (n - 2)) for v in nodes}


def test_betweenness_and_communities(spark):
    import random

    rnd = random.Random(5)
    pairs = {(f"n{rnd.randrange(12)}", f"n{rnd.randrange(12)}") for _ in range(26)}
    edges = spark.createDataFrame([(a, b, "t", i) for i, (a, b) in enumerate(sorted(pairs))], "src string, dst string, type string, seq long")
    got = {r.id: r.betweenness for r in graph.betweenness(edges).collect()}
    assert got == pytest.approx(_brandes(pairs), abs=1e-4)
    labels = graph.communities(edges)
    assert labels.count() == labels.select("id").distinct().count() == graph.vertices(edges).count()
    single = graph.vertices(edges).select("id", F.col("id").alias("community"))
    assert graph.modularity(edges, labels).first()[0] >= graph.modularity(edges, single).first()[0]
    inside = labels.join(graph.components(edges), "id").groupBy("community").agg(F.countDistinct("component").alias("n"))
    assert inside.filter("n > 1").count() == 0


def test_dedup(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "", "a", ""])], "ingest_seq long, content string")
    assert sorted(r.ingest_seq for r in clean.dedup_content(df).collect()) == [0, 1]
    assert sorted(r.ingest_seq for r in clean.dedup_content(df, empty_key="keep").collect()) == [0, 1, 3]
    once = clean.dedup_content(df)
    assert clean.dedup_content(once).count() == once.count()


ARTICLE = """<html><body><h1> Border  news </h1><div class="topcont"><span>发布时间：2026-06-15 20:01:13</span></div><div><p>来源：Daily 作者：Smith</p>
<p>First part of it.</p><script>var x = "<p>no</p>"</script><p>Second &amp; last.</p><p>x</p></div></body></html>"""
LISTING = '<ul><li><h2><a href="http://h/news/1.html">First long title</a></h2></li><li><h2><a href="/news/2.html/">Second long title</a></h2></li><li><a href="/about">About</a></li></ul>'
FEED = "<rss><channel><item><title>A &lt;b&gt;</title><link>http://x/1</link><pubDate>2024-01-01</pubDate><description><![CDATA[<p>hi   there</p>]]></description></item><item><title></title></item></channel></rss>"
ATOM = '<feed><entry><title>B</title><link href="http://x/2"/><updated>2024-01-02</updated><summary>s</summary></entry></feed>'


def test_pages(spark):
    page = spark.createDataFrame([(1, ARTICLE), (2, "<p>no title here</p>"), (3, None)], "id long, html string")
    (r,) = html.article_pages(page).collect()
    assert (r.title, r.published, r.content, r.author) == ("Border news", "2026-06-15 20:01:13", "First part of it.\nSecond & last.", "Smith")
    links = html.links(spark.createDataFrame([(1, LISTING)], "id long, html string"), base="http://h", path="/news/", least_title=10).orderBy("at").collect()
    assert [(x.url, x.title) for x in links] == [("http://h/news/1.html", "First long title"), ("http://h/news/2.html", "Second long title")]
    items = html.feed_items(spark.createDataFrame([("r", FEED), ("a", ATOM)], "feed string, xml string")).orderBy("feed").collect()
    assert [(x.feed, x.title, x.url, x.published, x.summary) for x in items] == [("a", "B", "http://x/2", "2024-01-02", "s"), ("r", "A <b>", "http://x/1", "2024-01-01", "hi there")]
