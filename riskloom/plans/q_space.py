"""Queries of places and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import params
from riskloom.functions import seeds as seed_rows
from riskloom.functions.num import banded, rounded
from riskloom.operators import align as AL
from riskloom.operators import graph as G
from riskloom.operators import score as S
from riskloom.operators import spatial as SP
from riskloom.plans import q_text as QT
from riskloom.plans.bindings import CENTERS, EDGES, HISTORY, NATIONS, PLACES, TYPED_NODES, C, R, centers, edges, history, nations, places, typed_nodes
from riskloom.session import table
from riskloom.sources import seeds

#: The risk from which a place is a hotspot.
HOT_FROM = 40.0
KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
POTENTIAL = f"""SELECT place, {R('risk')} AS risk, {R('t', 4)} AS total_influence, p AS potential, dominant_center, {R('CASE WHEN max(p) OVER () > 0 THEN p / max(p) OVER () ELSE 0 END * 100')} AS potential_normalized FROM (SELECT place, max(risk) AS risk, sum(i) AS t, {R('sum(i) * max(risk) / 100', 4)} AS p, arg_max(center, i) AS dominant_center FROM (
  SELECT place, coalesce(risk, 50) AS risk, center, weight / pow(greatest({KM.replace('b.lat', 'c.clat').replace('b.lon', 'c.clon')}, 10.0) / 100, 2) AS i FROM ({PLACES}) a CROSS JOIN ({CENTERS}) c) GROUP BY 1)"""
PAIRS = f"SELECT a.place AS a, b.place AS b, {KM} AS km, a.risk AS arisk, b.risk AS brisk FROM (SELECT place, lat, lon, coalesce(risk, 50) AS risk FROM ({PLACES})) a JOIN (SELECT place, lat, lon, coalesce(risk, 50) AS risk FROM ({PLACES})) b ON a.place <> b.place"
MORAN = f"""WITH m AS (SELECT avg(risk) AS m, count(*) AS n, var_pop(risk) * count(*) AS den FROM (SELECT coalesce(risk, 50) AS risk FROM ({PLACES}))), w AS (SELECT sum(1 / greatest(km, 1.0)) AS w, sum((arisk - m) * (brisk - m) / greatest(km, 1.0)) AS num FROM ({PAIRS}) CROSS JOIN m),
i AS (SELECT CASE WHEN n < 3 OR den < 1e-9 OR w < 1e-9 THEN 0 ELSE n / w * (num / den) END AS i, m, n FROM m CROSS JOIN w)
SELECT {R('i', 4)} AS morans_i, CASE WHEN i > 0.3 THEN '{params.MORAN_WORDS[0.3]}' WHEN i > 0.1 THEN '{params.MORAN_WORDS[0.1]}' WHEN i < -0.1 THEN '{params.MORAN_WORDS[-0.1]}' ELSE '{params.MORAN_WORDS[None]}' END AS interpretation, {R('m')} AS mean_risk, n FROM i"""
KNN = f"SELECT a, b, {R('km', 3)} AS km, arisk, brisk, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY {R('km', 6)}, b) AS r FROM ({PAIRS})) WHERE r <= 3"
HOT = f"SELECT a AS place, {R('max(arisk)')} AS risk, {R('avg(brisk)')} AS neighbor_avg_risk, CASE WHEN avg(brisk) >= {HOT_FROM} THEN '{params.CLUSTERED}' ELSE '{params.ISOLATED}' END AS cluster_type, list(b ORDER BY rank) AS neighbors FROM ({KNN}) WHERE arisk >= {HOT_FROM} GROUP BY 1 HAVING avg(brisk) >= {HOT_FROM * 0.8}"


def place_risk(s, d):
    """Each place's risk from the mean score of the regions' last rows, by its border flag."""
    from riskloom.operators.timeseries import last_rows

    base = last_rows(history(s, d), 7).agg(F.coalesce(F.avg("risk_score"), F.lit(50.0)).alias("base"))
    p = places(s, d).join(F.broadcast(base)).withColumn("risk", rounded(S.place_multiplier(F.col("base"), F.col("border")), 2))
    return p.select("place", "lat", "lon", "risk", banded(F.col("risk"), ((70.0, "高风险"), (40.0, "中风险"), (float("-inf"), "低风险"))).alias("level"))


PLACE_RISK = f"SELECT place, lat, lon, risk, CASE WHEN risk >= 70 THEN '高风险' WHEN risk >= 40 THEN '中风险' ELSE '低风险' END AS level FROM (SELECT place, lat, lon, {R('CASE WHEN border THEN least(base * 1.3, 100.0) ELSE base * 0.8 END')} AS risk FROM ({PLACES}) CROSS JOIN (SELECT avg(risk_score) AS base FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY date DESC) AS r FROM ({HISTORY})) WHERE r <= 7))"


def _located(s, d):
    c = table(s, d, "customer").join(table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("place")), "c_nationkey", "left")
    rows = c.select("c_custkey", F.when(F.col("c_custkey") % 10 > 0, F.col("place")).alias("place"), F.when(F.col("c_custkey") % 4 == 0, 1.5).alias("lat"), F.when(F.col("c_custkey") % 4 == 0, 2.5).alias("lon"), rounded(F.col("c_acctbal") / 10000, 4).alias("risk"))
    return SP.locate(rows, nations(s, d))


LOCATED = f"SELECT c_custkey, place, lat, lon, risk FROM (SELECT c_custkey, x.place, coalesce(x.lat, p.lat) AS lat, coalesce(x.lon, p.lon) AS lon, x.risk FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 > 0 THEN n_name END AS place, CASE WHEN c_custkey % 4 = 0 THEN 1.5 END AS lat, CASE WHEN c_custkey % 4 = 0 THEN 2.5 END AS lon, {R('c_acctbal / 10000', 4)} AS risk FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey) x LEFT JOIN ({NATIONS}) p ON p.place = x.place) WHERE lat IS NOT NULL AND lon IS NOT NULL"


def _popups(s, d):
    r = places(s, d).withColumn("risk", F.coalesce("risk", F.lit(50.0)))
    return r.select("place", rounded(F.col("lat"), 2).alias("lat"), rounded(F.col("lon"), 2).alias("lon"), F.when(F.col("risk") > 60, "↑").when(F.col("risk") < 40, "↓").otherwise("→").alias("arrow"), banded(F.col("risk"), ((70.0, "red"), (40.0, "orange"), (float("-inf"), "green"))).alias("color"))


def _alignment(s, d):
    cust = table(s, d, "customer").join(table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("place")), "c_nationkey")
    counts = cust.filter("c_mktsegment = 'BUILDING' AND c_nationkey % 4 > 0").groupBy("place").agg((F.count(F.lit(1)) % 20).alias("event_count"))
    act = cust.filter("c_nationkey % 3 > 0").groupBy("place").agg(rounded(F.avg("c_acctbal") / 10000, 4).alias("activity"))
    return AL.place_alignment(nations(s, d), counts, act)


ALIGN = f"SELECT p.place, lat, lon, {R('coalesce(a, 0.5)', 4)} AS activity, coalesce(n, 3) AS event_count, CASE WHEN coalesce(n, 3) > 10 THEN '高' WHEN coalesce(n, 3) > 3 THEN '中' ELSE '低' END AS level FROM ({NATIONS}) p LEFT JOIN (SELECT n_name AS place, count(*) % 20 AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING' AND c_nationkey % 4 > 0 GROUP BY 1) x ON x.place = p.place LEFT JOIN (SELECT n_name AS place, {R('avg(c_acctbal) / 10000', 4)} AS a FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey % 3 > 0 GROUP BY 1) y ON y.place = p.place"
BUILT = f"SELECT src, dst, max(struct_pack(s := seq, t := coalesce(type, 'UNKNOWN'))).t AS type FROM ({EDGES}) GROUP BY 1, 2"
NODES = f"SELECT src AS id FROM ({BUILT}) UNION SELECT dst FROM ({BUILT})"


def built(s, d):
    return G.build(edges(s, d))


def _upserts(s, d):
    n = typed_nodes(s, d)
    a = n.select("type", "id", F.lit(1).alias("seq"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.col("id")).alias("props"))
    b = n.filter("id > 'C5'").select("type", "id", F.lit(2).alias("seq"), F.create_map(F.lit("b"), F.lit("new")).alias("props"))
    return G.upsert(a, b).select("type", "id", F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("props"))


def _merge(s, d):
    e = built(s, d)
    nodes = G.vertices(e).filter("id < 'C3' OR id >= 'S'")
    return G.merge_relations(e.filter("src < 'C15'"), edges(s, d), nodes)


def _pivots(s, d):
    """The nodes whose number is divisible by 100, the stated set of sources."""
    return typed_nodes(s, d).filter(F.substring("id", 2, 20).cast("long") % 100 == 0)


def _seeded(s, d):
    """Counts by type of a graph of the tables with the seeds merged in."""
    known = seeds.entities(s)
    nodes = typed_nodes(s, d).select("type", "id", F.lit(1).alias("seq"), F.create_map().cast("map<string,string>").alias("props"))
    v, r = G.seed_load(nodes, built(s, d), seeds.vertices(known), seeds.relations(s))
    count = lambda df, what: df.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "type", "n")
    aliased = v.filter("props['aliases'] IS NOT NULL").agg(F.count(F.lit(1)).alias("n")).select(F.lit("entity").alias("what"), F.lit("with aliases").alias("type"), "n")
    return count(v, "entity").unionAll(count(r, "relation")).unionAll(aliased)


def _report(s, d):
    return SP.full_report(places(s, d).withColumn("risk", F.coalesce("risk", F.lit(50.0))), centers(s, d), HOT_FROM)


def _article_graph(s, d):
    tags = QT.QUERIES["entity_tags"](s, d)
    words = QT.QUERIES["event_keywords"](s, d).select("doc_id", F.split("words", ",").alias("events"))
    return G.article_graph(tags.join(words, "doc_id"), "doc_id")


def _seed_sql(text, names):
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in seed_rows.rows(text)) + f") t({names})"


_ENTITIES, _RELATIONS = _seed_sql(seed_rows.ENTITIES, "id, type, aliases"), _seed_sql(seed_rows.RELATIONS, "src, type, dst")
#: More steps than the longest shortest path of these graphs.
STEPS = 12
_PIVOTS = "SELECT id FROM n WHERE CAST(substring(id, 2) AS BIGINT) % 100 = 0"
_GRAPH = f"b AS MATERIALIZED ({BUILT}), n AS MATERIALIZED (SELECT src AS id FROM b UNION SELECT dst FROM b)"


def _reach(a="src", b="dst", sources=_PIVOTS):
    """WITH clauses that end in d(source, id, dist), along edges from column a to b."""
    return f"WITH RECURSIVE {_GRAPH}, p AS MATERIALIZED ({sources}), e AS MATERIALIZED (SELECT DISTINCT {a} AS src, {b} AS dst FROM b WHERE src <> dst), r(source, id, dist) AS (SELECT id, id, 0 FROM p UNION SELECT source, dst, dist + 1 FROM r JOIN e ON e.src = r.id WHERE dist < {STEPS}), d AS MATERIALIZED (SELECT source, id, min(dist) AS dist FROM r GROUP BY 1, 2)"


def _between():
    """Path counts from all nodes forward and shares backward, a clause a step."""
    steps = [f"{_reach(sources='SELECT id FROM n')}, dag AS MATERIALIZED (SELECT x.source, e.src, e.dst, y.dist AS k FROM d x JOIN e ON e.src = x.id JOIN d y ON y.source = x.source AND y.id = e.dst WHERE y.dist = x.dist + 1), s0 AS (SELECT source, id, CAST(1 AS DOUBLE) AS sigma FROM d WHERE dist = 0)"]
    steps += [f"s{k} AS MATERIALIZED (SELECT source, dst AS id, sum(sigma) AS sigma FROM dag JOIN s{k - 1} USING (source) WHERE k = {k} AND src = s{k - 1}.id GROUP BY 1, 2)" for k in range(1, STEPS + 1)]
    steps.append(f"t{STEPS} AS (SELECT source, id, CAST(0 AS DOUBLE) AS delta FROM s{STEPS} WHERE false)")
    steps += [f"t{k} AS MATERIALIZED (SELECT g.source, g.src AS id, sum(a.sigma / z.sigma * (1 + coalesce(w.delta, 0))) AS delta FROM dag g JOIN s{k} a ON a.source = g.source AND a.id = g.src JOIN s{k + 1} z ON z.source = g.source AND z.id = g.dst LEFT JOIN t{k + 1} w ON w.source = g.source AND w.id = g.dst WHERE g.k = {k + 1} GROUP BY 1, 2)" for k in range(STEPS - 1, -1, -1)]
    every = " UNION ALL ".join(f"FROM t{k}" for k in range(STEPS))
    total = f"SELECT id, sum(delta) AS x FROM ({every}) WHERE source <> id GROUP BY 1"
    return ", ".join(steps) + f" SELECT n.id, {R('coalesce(x / nullif((c - 1) * (c - 2), 0), 0)', 4)} AS betweenness FROM n LEFT JOIN ({total}) q ON q.id = n.id CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS c FROM n)"


def _labels(rounds=STEPS):
    """The least label around, a clause a round."""
    steps = [f"WITH {_GRAPH}, p AS MATERIALIZED ({_PIVOTS}), e AS MATERIALIZED (SELECT src, dst FROM b UNION SELECT dst, src FROM b), l0 AS (SELECT id, id AS label FROM n)"]
    steps += [f"l{k} AS MATERIALIZED (SELECT id, least(any_value(l.label), min(m.label)) AS label FROM l{k - 1} l JOIN e ON e.src = l.id JOIN (SELECT id AS dst, label FROM l{k - 1}) m USING (dst) GROUP BY 1)" for k in range(1, rounds + 1)]
    return ", ".join(steps) + f" SELECT id, label AS component FROM l{rounds}"


QUERIES = {
    "potential": lambda s, d: SP.potential(places(s, d), centers(s, d)),
    "moran": lambda s, d: SP.morans_i(places(s, d)),
    "knn": lambda s, d: SP.nearest(places(s, d).withColumn("risk", F.coalesce("risk", F.lit(50.0)))),
    "near_pairs": lambda s, d: SP.pairs(places(s, d), within_km=100.0, places_km=3).select("a", "b", "km"),
    "hotspots": lambda s, d: SP.hotspots(places(s, d), HOT_FROM),
    "place_risk": place_risk,
    "locate": lambda s, d: _located(s, d).select("c_custkey", "place", "lat", "lon", "risk"),
    "heat_points": lambda s, d: SP.heat_points(_located(s, d)).select("lat", "lon", rounded(F.col("heat"), 4).alias("heat")),
    "place_popups": _popups,
    "place_ranking": lambda s, d: place_risk(s, d).select("place", "risk", "level").orderBy(F.desc("risk"), "place"),
    "place_alignment": _alignment,
    "graph_build": built,
    "graph_totals": lambda s, d: G.totals(built(s, d)),
    "degree": lambda s, d: G.degree_centrality(built(s, d)),
    "relation_types": lambda s, d: G.type_histogram(edges(s, d)),
    "neighbors": lambda s, d: G.neighbors(built(s, d), "S1"),
    "subgraph": lambda s, d: G.subgraph(built(s, d), most=30),
    "subgraph_center": lambda s, d: G.subgraph(built(s, d), "S1", 30),
    "top_actors": lambda s, d: G.top_actors(built(s, d), typed_nodes(s, d)),
    "graph_upsert": _upserts,
    "graph_merge": _merge,
    "article_graph": _article_graph,
    "components": lambda s, d: G.components(built(s, d)),
    "distances": lambda s, d: G.distances(edges(s, d), _pivots(s, d)),
    "closeness": lambda s, d: G.closeness(edges(s, d), _pivots(s, d)),
    "betweenness": lambda s, d: G.betweenness(edges(s, d)),
    "seed_load": _seeded,
    "spatial_report": _report,
    "closeness_all": lambda s, d: G.closeness_by_sketches(edges(s, d)),
    "communities": lambda s, d: G.community_members(G.communities(edges(s, d))),
}

ORACLES = {
    "potential": POTENTIAL,
    "moran": MORAN,
    "knn": KNN,
    "near_pairs": f"SELECT a, b, {R('km', 3)} AS km FROM ({PAIRS}) WHERE km <= 100",
    "hotspots": HOT,
    "place_risk": PLACE_RISK,
    "locate": LOCATED,
    "heat_points": f"SELECT lat, lon, {R('coalesce(risk, 0.5) * 10', 4)} AS heat FROM ({LOCATED})",
    "place_popups": f"SELECT place, {R('lat')} AS lat, {R('lon')} AS lon, CASE WHEN r > 60 THEN '↑' WHEN r < 40 THEN '↓' ELSE '→' END AS arrow, CASE WHEN r >= 70 THEN 'red' WHEN r >= 40 THEN 'orange' ELSE 'green' END AS color FROM (SELECT *, coalesce(risk, 50) AS r FROM ({PLACES}))",
    "place_ranking": f"SELECT place, risk, level FROM ({PLACE_RISK})",
    "place_alignment": ALIGN,
    "graph_build": BUILT,
    "graph_totals": f"SELECT n, m, {R('coalesce(m / nullif(n * (n - 1), 0), 0)', 4)} AS density, {R('coalesce(2 * m / nullif(n, 0), 0)', 4)} AS average_degree FROM (SELECT count(*) AS n FROM ({NODES})) CROSS JOIN (SELECT count(*) AS m FROM ({BUILT}))",
    "degree": f"SELECT id, CAST(i AS BIGINT) AS in_degree, CAST(o AS BIGINT) AS out_degree, {R('coalesce((i + o) / nullif(n - 1, 0), 0)', 4)} AS centrality FROM (SELECT id, coalesce(i, 0) AS i, coalesce(o, 0) AS o, count(*) OVER () AS n FROM ({NODES}) LEFT JOIN (SELECT dst AS id, count(*) AS i FROM ({BUILT}) GROUP BY 1) USING (id) LEFT JOIN (SELECT src AS id, count(*) AS o FROM ({BUILT}) GROUP BY 1) USING (id))",
    "relation_types": f"SELECT coalesce(type, 'UNKNOWN') AS type, count(*) AS n FROM ({EDGES}) GROUP BY 1",
    "neighbors": f"SELECT DISTINCT * FROM (SELECT dst AS neighbor, type FROM ({BUILT}) WHERE src = 'S1' UNION ALL SELECT src, type FROM ({BUILT}) WHERE dst = 'S1') ORDER BY 1, 2 LIMIT 50",
    "subgraph": f"SELECT src, dst, type FROM ({BUILT}) ORDER BY 1, 2, 3 LIMIT 30",
    "subgraph_center": f"SELECT src, dst, type FROM ({BUILT}) WHERE src = 'S1' OR dst = 'S1' ORDER BY 1, 2, 3 LIMIT 30",
    "graph_upsert": f"SELECT type, id, 'a=1,b=' || CASE WHEN id > 'C5' THEN 'new' ELSE id END AS props FROM ({TYPED_NODES})",
    "graph_merge": f"WITH b AS MATERIALIZED ({BUILT}), n AS MATERIALIZED (SELECT id FROM (SELECT src AS id FROM b UNION SELECT dst FROM b) WHERE id < 'C3' OR id >= 'S') SELECT src, type, dst FROM b WHERE src < 'C15' UNION SELECT src, type, dst FROM ({EDGES}) WHERE src IN (FROM n) AND dst IN (FROM n)",
    "seed_load": f"SELECT 'entity' AS what, type, count(*) AS n FROM (SELECT type FROM ({TYPED_NODES}) UNION ALL SELECT type FROM {_ENTITIES}) GROUP BY 2 UNION ALL SELECT 'entity', 'with aliases', count(*) FROM {_ENTITIES} WHERE aliases <> '' UNION ALL SELECT 'relation', type, count(*) FROM (SELECT DISTINCT src, type, dst FROM ({BUILT}) UNION ALL SELECT * FROM {_RELATIONS}) GROUP BY 2",
    "spatial_report": f"SELECT 'potential' AS section, CAST(r AS INT) AS rank, place, potential AS value, dominant_center AS detail FROM (SELECT *, row_number() OVER (ORDER BY potential DESC, place) AS r FROM ({POTENTIAL})) WHERE r <= 5 UNION ALL SELECT 'autocorrelation', 1, NULL, morans_i, interpretation FROM ({MORAN}) UNION ALL SELECT 'hotspot', NULL, place, risk, cluster_type || ' ' || array_to_string(neighbors, ',') FROM ({HOT})",
    "article_graph": "SELECT 'event:' || doc_id AS src, type, dst FROM (" + " UNION ALL ".join(f"SELECT doc_id, 'MENTIONS_{t.upper()}' AS type, unnest({t}s) AS dst FROM ({QT.TAGS})" for t in ("location", "organization", "person")) + f" UNION ALL SELECT doc_id, 'CLASSIFIED_AS', unnest(string_split(words, ',')) FROM ({QT.ORACLES['event_keywords']}))",
    "components": _labels(),
    "distances": f"{_reach()} SELECT source, id, CAST(dist AS INT) AS dist FROM d",
    "closeness": f"{_reach('dst', 'src')} SELECT id, {R('coalesce(r / nullif(s, 0) * (r / nullif(c - 1, 0)), 0)', 4)} AS closeness FROM (SELECT p.id, count(dist) AS r, sum(dist) AS s, (SELECT count(*) FROM n) AS c FROM p LEFT JOIN (SELECT * FROM d WHERE dist > 0) d ON d.source = p.id GROUP BY 1)",
    "betweenness": _between(),
    "top_actors": f"SELECT id, role, centrality FROM (SELECT id, type AS role, {R('(coalesce(i, 0) + coalesce(o, 0)) / (count(*) OVER () - 1)', 4)} AS centrality FROM ({TYPED_NODES}) LEFT JOIN (SELECT dst AS id, count(*) AS i FROM ({BUILT}) GROUP BY 1) USING (id) LEFT JOIN (SELECT src AS id, count(*) AS o FROM ({BUILT}) GROUP BY 1) USING (id)) ORDER BY centrality DESC, id LIMIT 10",
}
