"""Operators against plain versions and values worked out by hand."""

from __future__ import annotations

import math
import random
import time
from collections import Counter, defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import params
from riskloom.functions import text as T
from riskloom.operators import alerts, clean, graph, html, score, searches, sketches, spatial, stars
from riskloom.plans import bindings, q_space
from riskloom.session import shared_folder, small, stored
from riskloom.sources import seeds
from tests.oracle import DATA


def test_entities_of_both_scripts(spark):
    texts = ["缅甸国防军在缅甸。", "the Three   brotherhood ALLIANCE and Tatmadaw", "PDFs and pdf", "敏昂莱x昂山素季", None, "", "three brotherhood"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.locations, r.organizations, r.persons) for r in clean.tag_entities(docs, seeds.gazetteer(seeds.entities(spark))).collect()}
    none = ([], [], [])
    assert got == {
        0: (["缅甸"], ["缅甸国防军"], []), 1: ([], ["三兄弟联盟", "缅甸国防军"], []), 2: ([], ["人民防卫军"], []), 3: ([], [], ["敏昂莱", "昂山素季"]), 4: none, 5: none, 6: none,
    }
    own = spark.createDataFrame([("aung san", "A", "person"), ("san", "B", "person")], "alias string, entity string, type string")
    said = spark.createDataFrame([(1, "Aung San and San")], "doc_id long, text string")
    assert clean.tag_entities(said, own).first().persons == ["A", "B"]
    with pytest.raises(ValueError):
        clean.tag_entities(docs, spark.createDataFrame([("a " * 30, "A", "person")], "alias string, entity string, type string"))


def test_seeds(spark):
    assert seeds.places(spark).count() == 15 and seeds.places(spark).filter("border").count() == 5 and seeds.centers(spark).count() == 5
    assert seeds.past_events(spark).count() == 48 and seeds.past_events(spark).filter("severity = 5").count() == 13
    known, relations = seeds.entities(spark), seeds.relations(spark)
    assert known.count() == 34 and relations.count() == 36
    nodes = spark.createDataFrame([("Organization", "若开军", 1, {"aliases": "AA,Arakan Army"}), ("x", "n", 1, {})], "type string, id string, seq int, props map<string,string>")
    rel = spark.createDataFrame([("n", "MENTIONS", "缅甸")], "src string, type string, dst string")
    v, r = graph.seed_load(nodes, rel, seeds.vertices(known), relations.unionByName(spark.createDataFrame([("n", "LEADS", "nobody")], relations.schema)))
    props = {x.id: x.props for x in v.collect()}
    assert len(props) == 35 and props["若开军"]["aliases"] == "AA,Arakan Army" and props["缅甸国防军"]["aliases"] == "缅军,Tatmadaw"
    assert r.count() == 37


def test_queries_of_a_language(spark):
    rows = [(1, "a peace talk", "en", "u1"), (2, "peace", "fr", "u2"), (3, "冲突 peace", "zh", "u3"), (4, "冲突", "zh", "u3"), (5, "war", "en", ""), (6, "WAR and peace", "en", "u6")]
    df = spark.createDataFrame(rows, "ingest_seq int, text string, language string, url string")
    asked = spark.createDataFrame([(0, "war"), (1, "Peace"), (2, "冲突")], "query_no int, query string")
    assert sorted((r.ingest_seq, r.query) for r in clean.query_many(df, asked, language="language").collect()) == [(1, "Peace"), (3, "冲突"), (6, "war")]
    assert sorted((r.ingest_seq, r.query) for r in clean.query_many(df, asked).collect()) == [(1, "Peace"), (2, "Peace"), (3, "Peace"), (6, "war")]
    assert sorted((r.ingest_seq, r.query) for r in clean.query_many(df, asked, block=1).collect()) == [(1, "Peace"), (2, "Peace"), (3, "Peace"), (6, "war")]
    with pytest.raises(ValueError, match="queries"):
        clean.query_many(df, spark.range(101).select(F.col("id").cast("int").alias("query_no"), F.lit("q").alias("query")), block=1)
    assert clean.query_many(df, asked.limit(0)).count() == 0


def test_enabled_sources(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "source string")
    on = spark.createDataFrame([("a", True), ("b", False), ("c", None), ("e", True)], "source string, enabled boolean")
    assert sorted(r.source for r in clean.enabled(df, on).collect()) == ["a", "c"]


def test_roll_up(spark):
    event = '{"event_type": "coup", "key_actors": ["x", "y"], "severity": "%s"}'
    rows = [(1, "event_identification", event % 4), (1, "impact_analysis", '{"a": 1}'), (1, "recommendation", '{"policy_recommendations": ["r"]}')]
    rows += [(2, "event_identification", event % 1), (2, "impact_analysis", '{"a": 1}'), (3, "event_identification", event % "high"), (3, "impact_analysis", '{"a": 1}')]
    rows += [(4, "event_identification", event % 5), (4, "impact_analysis", "{}"), (5, "recommendation", "{}"), (6, "event_identification", None), (6, "impact_analysis", '{"a": 1}')]
    got = {r.key: (r.event_type, r.key_actors, r.risk_level, r.recommendations) for r in score.roll_up(spark.createDataFrame(rows, "key int, step string, result string")).collect()}
    u = params.UNKNOWN
    assert got == {1: ("coup", ["x", "y"], "高", ["r"]), 2: ("coup", ["x", "y"], "低", []), 3: ("coup", ["x", "y"], "中", []), 4: ("coup", ["x", "y"], u, []), 5: (u, [], u, []), 6: (u, [], "中", [])}


def test_records(spark):
    docs = spark.createDataFrame([(1, "<b>Armed attack</b> near 仰光 by the KIA"), (2, ""), (3, None), (4, "peace and trade")], "doc_id long, text string")
    got = {r.doc_id: r for r in score.analysis_records(docs, seeds.gazetteer(seeds.entities(spark))).collect()}
    one = got[1]
    assert (one.text, one.locations, one.organizations, one.events) == ("Armed attack near 仰光 by the KIA...", ["仰光"], ["克钦独立军"], ["attack"])
    # weights without the two placeholders: 0.30, 0.25 and 0.10 of 0.65
    assert one.risk_score == round(100 * (0.3 * 1.0 + 0.25 * 1.0 + 0.1 * 0.8) / 0.65, 2) and one.alert == "red" and one.risk_sentiment == 1.0
    assert got[4].risk_score == round(100 * (0.3 * 0.2 + 0.25 * 0.0 + 0.1 * 0.3) / 0.65, 2) and got[4].alert == "green"
    assert got[2].risk_score == got[3].risk_score and got[3].locations == [] and set(got) == {1, 2, 3, 4}


def test_records_read_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    rows = [(i, f"<b>Armed attack</b> near 仰光 no {i}" if i % 2 else "peace") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", counted("text").alias("text"))
    assert len(score.analysis_records(docs, seeds.gazetteer(seeds.entities(spark))).collect()) == read.value == 40


def km(a, b) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize("within", [30.0, 100.0, 900.0, 12_000.0])
def test_near_pairs_around_the_globe(spark, within):
    rnd = random.Random(int(within))
    pts = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(150)]
    pts += [(lat + rnd.uniform(-0.5, 0.5), (lon + rnd.uniform(-1.5, 1.5) / max(0.02, math.cos(math.radians(lat))) + 180) % 360 - 180) for lat, lon in pts if abs(lat) < 89]
    pts += [(0.0, 179.9), (0.0, -179.9), (80.0, 10.0), (80.0, 15.0), (89.99, 0.0), (89.99, 180.0), (-90.0, 0.0), (-89.9, 77.0), (0.0, 180.0), (0.0, -180.0)]
    df = spark.createDataFrame([(str(i), a, b, 1.0) for i, (a, b) in enumerate(pts)], "place string, lat double, lon double, risk double")
    got = [(r.a, r.b) for r in spatial.pairs(df, within_km=within).collect()]
    want = {(str(i), str(j)) for i, a in enumerate(pts) for j, b in enumerate(pts) if i != j and km(a, b) <= within}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_near_pairs_of_a_crowd(spark, monkeypatch):
    """Places at two points: each pair of points is measured once, and a cell's pairs are dealt to several tasks."""
    monkeypatch.setattr(spatial, "DEALT", 2_000, raising=False)
    monkeypatch.setattr(spatial, "TOGETHER", 16, raising=False)
    rows = [(f"p{i}", 10.0 + i % 2 / 10, 20.0, 1.0) for i in range(200)]
    got = spatial.pairs(spark.createDataFrame(rows, "place string, lat double, lon double, risk double"), within_km=100.0)
    met = got.select("a", "b", F.spark_partition_id().alias("task")).collect()
    assert len(met) == len({(r.a, r.b) for r in met}) == 200 * 199
    assert max(Counter(r.task for r in met).values()) < 200 * 199 / 3


def globe(kind: str) -> list[tuple[str, float, float, float]]:
    rnd = random.Random(kind)
    if kind == "uniform":
        pts = [(math.degrees(math.asin(rnd.uniform(-1, 1))), rnd.uniform(-180, 180)) for _ in range(250)]
    elif kind == "clusters":
        pts = [(10 + rnd.gauss(0, 0.001), 20 + rnd.gauss(0, 0.001)) for _ in range(150)] + [(10.0, 20.0)] * 40 + [(10 + rnd.gauss(0, 3), 20 + rnd.gauss(0, 3)) for _ in range(60)] + [(-80.0, 5.0)]
    else:
        pts = [(90.0, 0.0), (90.0, 50.0), (89.9, 180.0), (89.9, -180.0), (0.0, 180.0), (0.0, -180.0), (0.0, 179.9), (-90.0, 1.0)]
    return [(f"p{i}", a, b, rnd.uniform(0, 100)) for i, (a, b) in enumerate(pts)]


@pytest.mark.parametrize("kind, k", [("uniform", 3), ("clusters", 3), ("clusters", 1), ("poles", 3), ("poles", 20)])
def test_nearest_of_all(spark, kind, k):
    """The k nearest without a radius are those of brute force."""
    pts = globe(kind)
    df = spark.createDataFrame([*pts, ("nowhere", None, None, 1.0)], "place string, lat double, lon double, risk double")
    got = {(r.a, r["rank"]): (r.b, r.km) for r in spatial.nearest(df, k).collect()}
    want = {}
    for a, lat, lon, _ in pts:
        order = sorted((round(km((lat, lon), (y, x)), 6), b) for b, y, x, _ in pts if b != a)[:k]
        want |= {(a, i + 1): (b, round(d, 3)) for i, (d, b) in enumerate(order)}
    assert set(got) == set(want)
    far = [(key, got[key], want[key]) for key in want if abs(got[key][1] - want[key][1]) > 0.0011 or (got[key][0] != want[key][0] and abs(got[key][1] - want[key][1]) > 0)]
    assert not far


@pytest.mark.parametrize("kind", ["uniform", "clusters", "poles"])
@pytest.mark.parametrize("leaf", [4096, 20])
def test_moran_by_cells(spark, kind, leaf):
    """Far cells by their sums come within 1e-3 of all pairs one by one."""
    pts = [(p, lat, lon, r + (50 if kind == "uniform" and lat > 0 else 0)) for p, lat, lon, r in globe(kind)]
    df = spark.createDataFrame(pts, "place string, lat double, lon double, risk double")
    got, want = (spatial.morans_i(df, **how).first() for how in ({"leaf": leaf, "exact": False}, {"exact": True}))
    assert abs(got.morans_i - want.morans_i) <= 1e-3 and (got.mean_risk, got.n) == (want.mean_risk, want.n)
    assert spatial.morans_i(df.limit(2), exact=False).first().morans_i == 0 and spatial.morans_i(df.limit(0), exact=False).first().n == 0 and spatial.morans_i(df).first() == want


def test_spatial_report(spark):
    p = seeds.places(spark).withColumn("risk", F.when(F.col("border"), 65.0).otherwise(40.0))
    rows = spatial.full_report(p, seeds.centers(spark)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.section].append(r)
    assert len(by["potential"]) == 5 and len(by["autocorrelation"]) == 1
    assert [r.place for r in sorted(by["potential"], key=lambda r: r.rank)] == [r.place for r in spatial.potential(p, seeds.centers(spark)).orderBy(F.desc("potential"), "place").limit(5).collect()]
    assert {r.place: r.value for r in by["hotspot"]} == {r.place: r.risk for r in spatial.hotspots(p).collect()}


def plain_betweenness(edges, sources, nodes):
    out = defaultdict(set)
    for a, b in edges:
        if a != b:
            out[a].add(b)
    total = dict.fromkeys(nodes, 0.0)
    for s in sources:
        dist, sigma, order, queue = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while queue:
            x = queue.popleft()
            order.append(x)
            for y in out[x]:
                if y not in dist:
                    dist[y] = dist[x] + 1
                    queue.append(y)
                if dist[y] == dist[x] + 1:
                    sigma[y] += sigma[x]
        delta = defaultdict(float)
        for x in reversed(order):
            for y in out[x]:
                if dist.get(y) == dist[x] + 1:
                    delta[x] += sigma[x] / sigma[y] * (1 + delta[y])
            if x != s:
                total[x] += delta[x]
    n = len(nodes)
    return {x: t / ((n - 1) * (n - 2)) * n / len(sources) for x, t in total.items()}


def test_betweenness(spark):
    rnd = random.Random(3)
    pairs = {(f"v{rnd.randrange(25)}", f"v{rnd.randrange(25)}") for _ in range(60)}
    edges = spark.createDataFrame(list(pairs), "src string, dst string")
    nodes = {x for p in pairs for x in p}
    for chosen in (sorted(nodes), sorted(nodes)[:4]):
        got = {r.id: r.betweenness for r in graph.betweenness(edges, spark.createDataFrame([(x,) for x in [*chosen, "absent"]], "id string")).collect()}
        want = plain_betweenness(pairs, chosen, nodes)
        assert set(got) == nodes and all(abs(got[x] - want[x]) < 1e-4 for x in nodes)


def test_betweenness_from_all_nodes(spark):
    """The registered query takes every node as a source, not some for all."""
    pairs = {(r.src, r.dst) for r in q_space.built(spark, DATA).collect()}
    nodes = {x for p in pairs for x in p}
    got = {r.id: r.betweenness for r in q_space.QUERIES["betweenness"](spark, DATA).collect()}
    want = plain_betweenness(pairs, sorted(nodes), nodes)
    assert set(got) == nodes and all(abs(got[x] - want[x]) < 1e-4 for x in nodes)


def test_closeness_of_some(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    whole = {r.id: r.closeness for r in graph.closeness(edges).collect()}
    some = {r.id: r.closeness for r in graph.closeness(edges, spark.createDataFrame([("d",), ("a",)], "id string")).collect()}
    # d is reached from c, b, a in 1, 2, 3 steps; all others reach it
    assert whole["d"] == 0.5 and some == {"d": whole["d"], "a": whole["a"]}


@pytest.mark.parametrize("measure", ["betweenness", "distances", "closeness"])
def test_sources_share_rows(spark, monkeypatch, measure):
    """80 sources that reach 80 nodes by way of one: rows written follow the nodes, not pairs of source and node."""
    rows = []
    monkeypatch.setattr(graph, "stored", lambda df, **k: (out := stored(df, **k), rows.append(out.count()))[0])
    pairs = [(f"a{i}", "hub") for i in range(80)] + [("hub", f"b{i}") for i in range(80)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    some = spark.createDataFrame([(f"{'b' if measure == 'closeness' else 'a'}{i}",) for i in range(80)], "id string")
    got = getattr(graph, measure)(edges, some).collect()
    if measure == "distances":
        assert {(r.source, r.id, r.dist) for r in got} == {(f"a{i}", *x) for i in range(80) for x in [(f"a{i}", 0), ("hub", 1), *[(f"b{j}", 2) for j in range(80)]]}
    elif measure == "betweenness":
        assert {r.id: r.betweenness for r in got if r.betweenness} == {"hub": 0.5063}  # 80 * 80 of 160 * 159, scaled from 80 to 161 sources
    else:
        assert {r.id: r.closeness for r in got} == {f"b{i}": 0.2547 for i in range(80)}  # from 81 of 160 others, in 1 + 160 steps
    assert sum(rows) < 1500


@pytest.mark.parametrize("measure", ["closeness", "distances"])
def test_searches_deal_edges_once(spark, measure):
    """24,000 edges, 1,200 sources: what is shuffled is the edges dealt to tasks, not edges and rows of bits at every distance."""
    rnd = random.Random(6)
    pairs = [(f"c{i}", f"s{rnd.randrange(200)}") for i in range(1000) for _ in range(16)] + [(f"s{i}", f"c{rnd.randrange(1000)}") for i in range(200) for _ in range(40)]
    edges = stored(spark.createDataFrame(pairs, "src string, dst string"))
    some = edges.select(F.col("src").alias("id")).distinct()
    sent = lambda: spark._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        start = sent()
        assert getattr(graph, measure)(edges, some).count() >= 1200
        assert sent() - start < 2e6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_closeness_counts_bits(spark, monkeypatch):
    """Sums by source come from counted bits, over several words and groups, without a row for each pair of source and node."""
    edges = spark.createDataFrame([(f"v{i:03}", f"v{(i * k + 1) % 300:03}") for i in range(300) for k in (1, 3)], "src string, dst string")
    far = graph.distances(edges).filter("dist > 0").groupBy("id").agg(F.count("*").alias("r"), F.sum("dist").alias("t"))
    want = {r.id: r.r / r.t * r.r / 299 for r in far.collect()}
    monkeypatch.setattr(graph, "_by_source", None)
    for words in (16, 1):
        monkeypatch.setattr(graph, "WORDS", words)
        got = {r.id: r.closeness for r in graph.closeness(edges).collect()}
        assert len(got) == 300 and all(abs(got[x] - want.get(x, 0)) < 1e-4 for x in got)


def test_numbers_that_collide(spark, monkeypatch):
    """Ids that share a hash are numbered anew: results don't depend on the hash."""
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "dd"), ("dd", "dd"), ("ee", "f")], "src string, dst string")
    want = {r.id: r.closeness for r in graph.closeness(edges).collect()}
    monkeypatch.setattr(graph, "_hashed", lambda name: F.length(name).cast("long"))
    nodes, out = graph._numbered(edges)
    assert nodes.select("v").distinct().count() == 6 and out.count() == 5
    assert {r.id: r.closeness for r in graph.closeness(edges).collect()} == want


def some_components():
    """Edges of a few components: a dense one, a path, one in which an edge repeats, a self-loop alone."""
    rnd = random.Random(5)
    return [(f"v{rnd.randrange(30)}", f"v{rnd.randrange(30)}") for _ in range(90)] + [(f"p{i}", f"p{i + 1}") for i in range(9)] + [("x", "y"), ("x", "y"), ("y", "w"), ("z", "z")]


def test_betweenness_within_tasks(spark, monkeypatch):
    """Components that fit a task need no exchange of path counts; hubs, repeated edges and several tasks to a component."""
    pairs = some_components() + [(f"l{i}", "hub") for i in range(70)] + [("hub", f"r{i}") for i in range(70)]
    edges, nodes = spark.createDataFrame(pairs, "src string, dst string"), {x for p in pairs for x in p}
    monkeypatch.setattr(graph, "_paths", None)
    monkeypatch.setattr(graph, "_PACKED", 12, raising=False)
    monkeypatch.setattr("riskloom.operators.searches.COLUMNS", 16)
    got = {r.id: r.betweenness for r in graph.betweenness(edges).collect()}
    want = plain_betweenness(set(pairs), sorted(nodes), nodes)
    assert set(got) == nodes and all(abs(got[x] - want[x]) < 1e-4 for x in nodes)


@pytest.mark.parametrize("measure", ["betweenness", "distances", "closeness"])
def test_components_beyond_a_task(spark, monkeypatch, measure):
    """Components with more edges than a task holds are searched by exchanges, beside those that fit one."""
    edges = spark.createDataFrame(some_components(), "src string, dst string")
    some = spark.createDataFrame([(x,) for x in ("v1", "v2", "v3", "p2", "p9", "y", "z", "none")], "id string")
    want = {tuple(r) for r in getattr(graph, measure)(edges, some).collect()}
    monkeypatch.setattr(graph, "_WITHIN", 20)
    monkeypatch.setattr(graph, "_AT_A_TIME", 2)
    assert {tuple(r) for r in getattr(graph, measure)(edges, some).collect()} == want and len(want) >= 7


@pytest.mark.parametrize("n", [1, 40, 3000])
def test_rows_added_up(n):
    """Nodes of any number of edges, a few of them with many."""
    rnd = np.random.RandomState(n)
    b = np.sort(np.concatenate([rnd.randint(0, n, 3 * n), np.full(2500, n // 2), np.full(40, 0)]))
    a, x = rnd.randint(0, n, len(b)), rnd.rand(n, 3)
    want = np.zeros((n, 3))
    np.add.at(want, b, x[a])
    to, sums = searches._along(x, a, b)
    assert (to == np.unique(b)).all() and np.allclose(sums, want[to])


def test_edges_are_hung(spark, monkeypatch):
    """Components are the same from what tasks leave of the edges, which is no more than they have nodes."""
    rnd = random.Random(8)
    pairs = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(300)] + [(500 + i % 7, 500 + i % 5) for i in range(2000)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    want = {tuple(r) for r in stars.components(edges).collect()}
    for at_once, held in ((2**20, 2**21), (50, 20)):
        monkeypatch.setattr(stars, "_HUNG", at_once)
        monkeypatch.setattr(stars, "_HELD", held)
        assert {tuple(r) for r in stars.components(stars.hung(edges)).collect()} == want
    monkeypatch.undo()
    assert stars.hung(edges).count() < 3 * 407


def random_graph(seed: int, groups: int, size: int, inner: float, outer: float) -> list[tuple[str, str]]:
    rnd = random.Random(seed)
    names = [(g, f"g{g}n{i}") for g in range(groups) for i in range(size)]
    return [(a, b) for i, (g, a) in enumerate(names) for h, b in names[:i] if rnd.random() < (inner if g == h else outer)]


def plain_louvain(pairs) -> float:
    """Modularity of one-by-one moves over levels."""
    adj = defaultdict(lambda: defaultdict(float))
    for a, b in {tuple(sorted(p)) for p in pairs if p[0] != p[1]}:
        adj[a][b] += 1
        adj[b][a] += 1
    m2 = sum(sum(x.values()) for x in adj.values())
    while True:
        k = {a: sum(x.values()) for a, x in adj.items()}
        label, total, moved = {a: a for a in adj}, dict(k), False
        going = True
        while going:
            going = False
            for a in sorted(adj, key=str):
                links = defaultdict(float)
                for b, w in adj[a].items():
                    if b != a:
                        links[label[b]] += w
                total[label[a]] -= k[a]
                best = max([label[a], *sorted(links, key=str)], key=lambda c: round(links[c] - k[a] * total[c] / m2, 9))
                total[best] += k[a]
                if best != label[a]:
                    label[a], going, moved = best, True, True
        if not moved:
            return sum(adj[a].get(a, 0.0) / m2 - (k[a] / m2) ** 2 for a in adj)
        new = defaultdict(lambda: defaultdict(float))
        for a, x in adj.items():
            for b, w in x.items():
                new[label[a]][label[b]] += w
        adj = new


@pytest.mark.parametrize("seed, groups, size, inner, outer", [(1, 4, 15, 0.5, 0.03), (2, 6, 10, 0.6, 0.05), (3, 1, 60, 0.06, 0.0), (4, 8, 8, 0.7, 0.02), (5, 3, 25, 0.2, 0.05)])
def test_communities_of_random_graphs(spark, seed, groups, size, inner, outer):
    pairs = random_graph(seed, groups, size, inner, outer)
    edges = spark.createDataFrame(pairs, "src string, dst string")
    labels = stored(graph.communities(edges))
    assert graph.modularity(edges, labels).first()[0] >= plain_louvain(pairs) - 0.02
    of = {r.id: r.community for r in labels.collect()}
    near = defaultdict(set)
    for a, b in pairs:
        if of[a] == of[b]:
            near[a].add(b)
            near[b].add(a)
    for c in set(of.values()):
        members = {x for x in of if of[x] == c}
        seen, todo = set(), [c]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        assert seen == members and min(members) == c


def test_sizes_stay_true(spark):
    """Thirty rounds of joins of a stored table with itself keep the planner's estimate of size small."""
    df = stored(spark.range(50).withColumn("x", F.col("id") % 7))
    for _ in range(30):
        df = stored(df.join(df.select("id", F.col("x").alias("y")), "id").select("id", F.greatest("x", "y").alias("x")), over=df)
    assert int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 2**30 and df.count() == 50


def test_closeness_by_sketches(spark):
    """Within 10 % of exact closeness for every node, and exact on few nodes."""
    small = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("z", "z")], "src string, dst string")
    assert {r.id: r.closeness for r in graph.closeness_by_sketches(small).collect()} == {r.id: r.closeness for r in graph.closeness(small).collect()}
    pairs = random_graph(7, 1, 300, 0.02, 0.0)
    rnd = random.Random(2)
    edges = spark.createDataFrame([p if rnd.random() < 0.5 else p[::-1] for p in pairs], "src string, dst string")
    want = {r.id: r.closeness for r in graph.closeness(edges).collect()}
    got = {r.id: r.closeness for r in graph.closeness_by_sketches(edges, lg_k=12).collect()}
    assert set(got) == set(want) and all(abs(got[x] - want[x]) <= 0.1 * want[x] + 1e-3 for x in want)


def test_sketches_in_blocks(spark, monkeypatch):
    """Blocks don't change the estimates; sets of few nodes are exact, whatever the distance; hubs and no edges at all."""
    rnd = random.Random(4)
    pairs = random_graph(9, 1, 150, 0.03, 0.0) + [(f"x{i}", f"x{i + 1}") for i in range(6)] + [(f"y{rnd.randrange(400)}", f"h{rnd.randrange(2)}") for _ in range(500)] + [("h0", f"y{i}") for i in range(0, 400, 7)]
    edges = stored(spark.createDataFrame(pairs, "src string, dst string"))
    one = {(r.id, r.closeness, r.reached) for r in graph.closeness_by_sketches(edges).collect()}
    monkeypatch.setattr(graph, "_SKETCHED", 2**17)  # 128 nodes
    assert {(r.id, r.closeness, r.reached) for r in graph.closeness_by_sketches(edges).collect()} == one
    exact = {r.id: r.closeness for r in graph.closeness(edges).collect()}
    assert len(one) == len(exact) and all(c == exact[x] for x, c, _ in one if x[0] == "x") and all(abs(c - exact[x]) <= 0.2 * exact[x] + 1e-3 for x, c, _ in one)
    assert {r for x, _, r in one if x == "x6"} == {6}
    assert graph.closeness_by_sketches(edges.limit(0)).count() == 0
    assert {r.closeness for r in graph.closeness_by_sketches(spark.createDataFrame([("a", "a")], "src string, dst string")).collect()} == {0.0}


def test_sketch_sizes():
    for n in (1, 60, 700, 3000, 100_000):
        one = sketches.alone(np.arange(n, dtype=np.int64), 10)
        assert abs(sketches.sizes(one.regs.max(axis=0)[None])[0] - n) <= 0.1 * n


def test_sketches_follow_nodes_not_edges(spark, monkeypatch):
    """24,000 edges between 1,200 nodes in both directions: what is shuffled is a few sketches a node, not one an edge."""
    rnd = random.Random(6)
    pairs = [(f"c{i}", f"s{rnd.randrange(200)}") for i in range(1000) for _ in range(16)] + [(f"s{i}", f"c{rnd.randrange(1000)}") for i in range(200) for _ in range(40)]
    edges = stored(spark.createDataFrame(pairs, "src string, dst string"))
    monkeypatch.setattr(graph, "_SKETCHED", 2**19, raising=False)
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    sent = lambda: spark._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    for k, x in held.items():
        spark.conf.set(k, x)
    try:
        start = sent()
        assert graph.closeness_by_sketches(edges).count() == 1200
        assert sent() - start < 4e6
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


def test_betweenness_within_its_bound(spark):
    for seed in (1, 2):
        pairs = random_graph(seed, 1, 120, 0.05, 0.0)
        edges = spark.createDataFrame(pairs + [("a", "b")], "src string, dst string")
        nodes = {x for p in pairs for x in p} | {"a", "b"}
        want = plain_betweenness(pairs, sorted(nodes), nodes)
        rows = graph.betweenness_within(edges, error=1.0, first=64).collect()
        assert {r.id for r in rows} == nodes and {r.n_sources for r in rows} == {64} and all(0 < r.bound <= 1.0 and abs(r.betweenness - want[r.id]) <= r.bound for r in rows)
        exact = graph.betweenness_within(edges, error=0.001, first=40).collect()
        assert all(r.n_sources == len(nodes) and r.bound == 0 and abs(r.betweenness - want[r.id]) < 1e-4 for r in exact)


def test_links_are_refined_once(spark, monkeypatch):
    """Links within a community come to its refinement once, not from either end, and leave the cliques whole."""
    given, whole = [], graph.stars.components
    told = lambda e: (e.count(), e.select(F.least("a", "b"), F.greatest("a", "b")).distinct().count())
    monkeypatch.setattr(graph.stars, "components", lambda e: (given.append(told(e)), whole(e))[1])
    rows = [(f"{c}{a}", f"{c}{b}") for c in "xy" for a in range(5) for b in range(a)]
    labels = graph.communities(spark.createDataFrame(rows, "src string, dst string"), rounds=2, levels=1).collect()
    assert given and all(n == once > 0 for n, once in given)
    assert len(labels) == 10 and all(r.id[0] == r.community[0] for r in labels)


@pytest.mark.parametrize("within", [True, False])
def test_communities_within_tasks(spark, monkeypatch, within):
    """Components that fit a task need no exchange of labels; larger ones beside them do. Modularity counts links of all."""
    pairs = random_graph(1, 3, 12, 0.6, 0.03) + [(f"{c}{a}", f"{c}{b}") for c in "xy" for a in range(5) for b in range(a)] + [("x0", "x1"), ("x1", "x0"), ("z", "z")]
    edges = stored(spark.createDataFrame(pairs, "src string, dst string"))
    if within:
        monkeypatch.setattr(graph, "_moves", None)
        monkeypatch.setattr(graph, "_PACKED", 4, raising=False)
    else:
        monkeypatch.setattr(graph, "_WITHIN", 40, raising=False)
    labels = stored(graph.communities(edges))
    of = {r.id: r.community for r in labels.collect()}
    assert set(of) == {x for p in pairs for x in p} and of["z"] == "z" and {of[f"{c}{i}"] for c in "xy" for i in range(5)} == {"x0", "y0"}
    assert graph.modularity(edges, labels).first()[0] >= plain_louvain(pairs) - 0.02


def test_tasks_find_what_exchanges_find(spark):
    """Communities of one large component keep the modularity of one-by-one moves."""
    pairs = random_graph(11, 10, 30, 0.3, 0.01)
    edges = stored(spark.createDataFrame(pairs, "src string, dst string"))
    assert graph.modularity(edges, graph.communities(edges)).first()[0] >= plain_louvain(pairs) - 0.02


def test_communities_over_levels(spark):
    """Two cliques with one edge between them: one level finds them, and a second leaves them as they are."""
    rows = [(f"{c}{a}", f"{c}{b}") for c in "xy" for a in range(5) for b in range(a)] + [("x0", "y0"), ("z", "z")]
    labels = stored(graph.communities(spark.createDataFrame(rows, "src string, dst string"), rounds=2, levels=2))
    by = defaultdict(set)
    for r in labels.collect():
        by[r.community].add(r.id[0])
    assert {"z"} in by.values() and all(len(x) == 1 for x in by.values()) and len(by) < 7


def test_trailing_counts_and_changes(spark):
    rnd = random.Random(4)
    rows = [(f"s{rnd.randrange(2)}", 1_700_000_000 + rnd.randrange(500_000), rnd.choice([10.0, 50.0, 65.0, 90.0])) for _ in range(300)]
    rows = list({(a, b): (a, b, c) for a, b, c in rows}.values())
    df = spark.createDataFrame(rows, "series_key string, sec long, risk_score double").withColumn("ts", F.timestamp_seconds("sec"))
    got = {(r.series_key, r.sec): r.n for r in alerts.trailing_counts(df).collect()}
    assert got == {(a, b): sum(x == a and b - 86400 <= y <= b for x, y, _ in rows) for a, b, _ in rows}
    level = lambda s: next(n for v, n in params.ALERT_BANDS if s >= v)
    want, last = set(), {}
    for a, b, s in sorted(rows):
        if level(s) != last.get(a, "green") and level(s) != "green":
            want.add((a, b))
        last[a] = level(s)
    changed = alerts.level_changes(df).withColumn("sec", F.unix_seconds("ts")).collect()
    assert {(r.series_key, r.sec) for r in changed} == want and len(changed) == len(want)


def test_whole_bodies(spark):
    page = "<article>" + "".join(f"<p>paragraph {i} of this page</p>" for i in range(300)) + "</article>"
    df = spark.createDataFrame([(page,)], "html string")
    whole = df.select(html.body_text(F.col("html"))).first()[0]
    assert whole.count("\n") == 299 and len(whole) > 2000
    assert df.select(html.body_text(F.col("html"), most=2000)).first()[0] == whole[:2000]


def test_bindings_keep_all_rows(spark):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert bindings.edges(spark, DATA).count() == lines
    assert bindings.places(spark, DATA).count() == spark.read.parquet(f"{DATA}/supplier.parquet").count()


def test_shared_folder(spark):
    assert spark.conf.get("spark.checkpoint.dir") == shared_folder(spark)
    few, many = spark.range(5), spark.range(50)
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(small(few, 10)).lower() and "broadcast" not in plan(small(many, 10)).lower()


def test_long_white_space_is_linear(spark):
    """Five million blanks, and as many open brackets, in every text function take seconds."""
    n = 5_000_000
    df = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), n), F.lit("b")).alias("text"), F.concat(F.lit("x> "), F.repeat(F.lit("<"), n)).alias("open"))
    began = time.time()
    r = df.select(T.trimmed(F.col("text")).alias("t"), T.clean_text(F.col("text")).alias("c"), T.clean_text(F.col("open")).alias("o"), T.normalize_date(F.col("text"), F.lit("2024-01-01").cast("date")).alias("d"), T.script_language(F.col("text")).alias("l"), T.compound_sentiment(F.lit(0.5), F.col("text")).alias("s")).first()
    assert len(r.t) == n + 2 and r.c == "a b" and len(r.o) == n + 3 and r.l == "en" and str(r.d) == "2024-01-01" and r.s == 0.75
    ok, rejected = clean.valid_input(df)
    assert ok.count() == 0 and rejected.count() == 1
    assert time.time() - began < 60


@pytest.mark.parametrize("text, want", [("<<a>b", "b"), ("a<>b", "a<>b"), ("a > b < c", "a > b < c"), ("<a\n>x <b>", "x"), ("x\u3000 \xa0y", "x y"), ("see https://a.b/c d http://e", "see  d"), ("one 版权声明 two", "one"), ("\u2003a\x85", "a")])
def test_cleaning_keeps_its_meaning(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.clean_text(F.col("t")).alias("t")).first().t == want


def test_merged_percentiles(spark):
    """Sketches a day, merged, within 1.65 % of the ranks of all values; days come in any number and order."""
    rnd = random.Random(17)
    rows = [(k, i % 30, rnd.gauss(0, 1) * (k == "a") + rnd.random() ** 3 * (k == "b")) for k in "ab" for i in range(20_000)] + [("c", 0, 5.0), ("d", 0, None), ("d", 1, float("nan"))]
    df = spark.createDataFrame(rows, "series_key string, date int, value double").withColumn("indicator", F.lit("x"))
    got = {r.series_key: r for r in score.merged_percentiles(score.percentile_sketches(df)).collect()}
    assert set(got) == {"a", "b", "c"} and (got["c"].p5, got["c"].p95, got["c"].n) == (5.0, 5.0, 1)
    for k in "ab":
        own = sorted(v for s, _, v in rows if s == k)
        assert got[k].n == len(own)
        for q, x in ((0.05, got[k].p5), (0.95, got[k].p95)):
            assert abs(sum(v <= x for v in own) / len(own) - q) <= 0.0165
    assert score.merged_percentiles(score.percentile_sketches(df.limit(0))).count() == 0


def test_numeric_entries(spark):
    df = spark.createDataFrame([({"a": "1.5", "b": "high", "c": '{"x":1}', "d": None, "e": "-2", "f": "NaN", "g": " 3 "},), (None,), ({},)], "m map<string,string>")
    assert [r.n for r in df.select(score.numeric_entries(F.col("m")).alias("n")).collect()] == [{"a": 1.5, "e": -2.0, "g": 3.0}, None, {}]
