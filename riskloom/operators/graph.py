"""Property graphs as edge tables (src, dst, type, seq) and vertex tables (id, type, props)."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.num import rounded
from riskloom.operators import moves, searches, sketches, stars
from riskloom.session import forget, small, stored


def build(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst): the last type by seq wins. Edges with a blank end drop out."""
    named = edges.filter("coalesce(src, '') <> '' AND coalesce(dst, '') <> ''")
    return named.groupBy("src", "dst").agg(F.max_by(F.coalesce("type", F.lit("UNKNOWN")), F.struct("seq", "type")).alias("type"))


def vertices(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id): the ends of all edges, and the named nodes."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
    return (ids if nodes is None else ids.union(nodes.select("id"))).filter("coalesce(id, '') <> ''").distinct()


def totals(edges: DataFrame) -> DataFrame:
    """(n, m, density, average_degree); zeros for an empty graph."""
    v = vertices(edges).agg(F.count(F.lit(1)).alias("n"))
    m = edges.agg(F.count(F.lit(1)).alias("m"))
    ratio = lambda a, b: rounded(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    return v.join(F.broadcast(m)).select("n", "m", ratio(F.col("m"), F.col("n") * (F.col("n") - 1)).alias("density"), ratio(2 * F.col("m"), F.col("n")).alias("average_degree"))


def degree_centrality(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, in_degree, out_degree, centrality), in plus out over n - 1."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    v = vertices(edges, nodes)
    n = v.agg(F.count(F.lit(1)).alias("n"))
    d = v.join(ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o")), "id", "left").join(F.broadcast(n))
    i, o = F.coalesce("i", F.lit(0)), F.coalesce("o", F.lit(0))
    return d.select("id", i.alias("in_degree"), o.alias("out_degree"), rounded(F.coalesce(F.try_divide(i + o, F.col("n") - 1), F.lit(0.0)), 4).alias("centrality"))


def type_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.coalesce("type", F.lit("UNKNOWN")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def neighbors(edges: DataFrame, center: str, most: int = 50) -> DataFrame:
    """(neighbor, type): along edges of either direction, `most` at most, by name."""
    out = edges.filter(F.col("src") == center).select(F.col("dst").alias("neighbor"), "type")
    back = edges.filter(F.col("dst") == center).select(F.col("src").alias("neighbor"), "type")
    return out.union(back).distinct().orderBy("neighbor", "type").limit(most)


def subgraph(edges: DataFrame, center: str | None = None, most: int = 100) -> DataFrame:
    """At most `most` edges, of a centre if given, by their ends."""
    if center is not None:
        edges = edges.filter((F.col("src") == center) | (F.col("dst") == center))
    return edges.orderBy("src", "dst", "type").limit(most)


def upsert(existing: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """Vertices by (type, id): properties of all rows merged, the latest seq's value of each."""
    rows = existing.unionByName(incoming, allowMissingColumns=True)
    props = rows.select("type", "id", seq, F.explode("props").alias("k", "v")).groupBy("type", "id", "k").agg(F.max_by("v", seq).alias("v"))
    maps = props.groupBy("type", "id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    return rows.select("type", "id").distinct().join(maps, ["type", "id"], "left").select("type", "id", F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"))


def seed_load(nodes: DataFrame, relations: DataFrame, known: DataFrame, known_relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, relations) with the seeds merged in: entities by type and name, whose properties (aliases too) give way to
    later ones; relations whose ends both exist, one for each (src, type, dst)."""
    merged = upsert(known, nodes)
    return merged, merge_relations(relations, known_relations, merged)


def merge_relations(existing: DataFrame, incoming: DataFrame, nodes: DataFrame) -> DataFrame:
    """existing and the incoming relations whose ends both exist, one for each (src, type, dst)."""
    ids = nodes.select("id").distinct()
    ok = incoming.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    cols = ["src", "type", "dst"]
    return existing.select(cols).unionAll(ok.select(cols)).distinct()


def article_graph(articles: DataFrame, key: str = "doc_id", kinds: dict[str, str] | None = None) -> DataFrame:
    """(src, type, dst): an event node for each article, MENTIONS edges to its entities and CLASSIFIED_AS to its event words."""
    kinds = kinds or {"locations": "MENTIONS_LOCATION", "organizations": "MENTIONS_ORGANIZATION", "persons": "MENTIONS_PERSON", "events": "CLASSIFIED_AS"}
    held = F.flatten(F.array(*[F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), _edge_to(label)) for c, label in kinds.items()]))
    return articles.select(F.concat(F.lit("event:"), F.col(key).cast("string")).alias("src"), F.inline(held)).select("src", "type", "dst")


def _edge_to(label: str):
    return lambda x: F.struct(F.lit(label).alias("type"), x.alias("dst"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): connected components of the undirected view by the least id."""
    nodes, out = _numbered(edges)
    roots = stars.components(stars.hung(out))
    named = nodes.join(roots.withColumnRenamed("id", "v"), "v", "left").select("id", F.coalesce("root", "v").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component"))
    return named.join(least, "root").select("id", "component")


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, v, degree), (a, b)): every node with a number and the edges that leave it, and the edges between different nodes
    by number, as often as given.

    Numbers are hashes of the ids, worked out where edges are read. Where two ids share one, all are numbered anew.
    """
    named = stored(edges.select("src", "dst").filter("coalesce(src, '') <> '' AND coalesce(dst, '') <> ''"))
    ends = named.select(F.inline(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("n")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("n")))))
    nodes = stored(ends.groupBy("id").agg(F.sum("n").alias("degree")).select("id", _hashed("id").alias("v"), "degree"))
    if nodes.groupBy("v").count().filter("count > 1").isEmpty():
        return nodes, named.select(_hashed("src").alias("a"), _hashed("dst").alias("b")).filter("a <> b")
    nodes = stored(nodes.select("id", F.monotonically_increasing_id().alias("v"), "degree"), over=nodes)
    a, b = nodes.select(F.col("id").alias("src"), F.col("v").alias("a")), nodes.select(F.col("id").alias("dst"), F.col("v").alias("b"))
    return nodes, stored(named.filter("src <> dst").join(a, "src").join(b, "dst").select("a", "b"), over=named)


def _hashed(name: str) -> Column:
    return F.xxhash64(name)


#: Edges up to which a component is searched within tasks, and edges of smaller ones that share a task.
_WITHIN, _PACKED = 2**22, 2**16


def _within(nodes: DataFrame, out: DataFrame, some: DataFrame | None, most: int, named: bool = False) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """(rows for searches by group, (edges, sources) of what is left): components whose edges a task can hold, with their sources.

    Sources are the nodes named in `some` (id), or all. A component with many of them, or much work, goes to several tasks, `most`
    sources and more to each; small components share one. What is left are components with more edges, if there are any.
    """
    roots = stars.components(stars.hung(out)).withColumnRenamed("id", "v")
    is_source = F.lit(1).alias("source")
    of = nodes.withColumn("source", F.lit(1)) if some is None else nodes.join(some.select("id", is_source).distinct(), "id", "left")
    labels = stored(of.join(roots, "v", "left").select("v", "id", "degree", F.coalesce("root", "v").alias("root"), F.coalesce("source", F.lit(0)).alias("source")))
    sizes = labels.groupBy("root").agg(F.sum("degree").alias("m"), F.sum("source").alias("k")).filter("k > 0")
    is_small, is_held = F.col("m") <= _PACKED, F.col("m") <= _WITHIN
    work = F.col("m").cast("double") * F.col("k")
    packed, all_work, largest = sizes.agg(F.sum(F.when(is_small, F.col("m") + 1)), F.sum(F.when(~is_small & is_held, work)), F.max("m")).first()
    cores = nodes.sparkSession.sparkContext.defaultParallelism
    unit = F.when(is_small, F.pmod(F.xxhash64("root"), F.lit(math.ceil((packed or 1) / _PACKED)))).otherwise(F.col("root"))
    parts = F.when(is_small, 1).otherwise(F.greatest(F.lit(1), F.least(F.ceil(F.col("k") / most), F.ceil(work * 4 * cores / (all_work or 1.0))))).cast("int")
    placed = stored(labels.join(sizes.select("root", "m", unit.alias("unit"), parts.alias("parts")), "root"), over=labels)
    held = placed.filter(is_held)
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    turn = (F.col("source") * (F.pmod(F.xxhash64("v", F.lit(1)), F.col("parts")) == F.col("part")).cast("int")).alias("source")
    points = held.select("*", part).select("unit", "part", F.col("v").alias("node"), "root", "id" if named else F.lit(None).cast("string").alias("id"), turn)
    points = points if named else points.filter("source > 0")
    links = out.join(held.select(F.col("v").alias("a"), "unit", "parts"), "a").select("unit", "parts", "a", "b").mapInArrow(searches.packed, searches.LINKS)
    none = {"node": F.lit(0).cast("long"), "root": F.lit(0).cast("long"), "id": F.lit(None).cast("string"), "source": F.lit(0)}
    links = links.select("unit", part, "v", "a", "b").withColumns(none)
    points = points.withColumns({c: F.lit(None).cast(t) for c, t in (("v", "array<long>"), ("a", "array<int>"), ("b", "array<int>"))})
    rows = points.unionByName(links).repartition(8 * cores, "unit", "part").groupBy("unit", "part")
    if (largest or 0) <= _WITHIN:
        return rows, None
    left = stored(placed.filter(~is_held).select("v", "source"))
    return rows, (stored(out.join(left.select(F.col("v").alias("a")), "a", "left_semi").distinct()), left.filter("source > 0").select("v"))


#: Sources whose searches share a row: so many words of 64 bits, and so many counts of paths.
WORDS, COLUMNS = 16, 128
#: Sources that one task numbers.
_NUMBERED = 65_536
#: Steps in which sources are looked for that reach the same nodes.
_TOGETHER = 4


def _tasks(df: DataFrame) -> int:
    context = df.sparkSession
    return max(2 * context.sparkContext.defaultParallelism, int(context.conf.get("spark.sql.shuffle.partitions")))


def _dealt(out: DataFrame, sources: DataFrame, held: int) -> tuple[DataFrame, int]:
    """((v, g, at), the most in a group): sources in groups of up to `held`, a power of two, numbered in them from 0.

    Sources met by the same least source within a few steps are dealt together, so that a group stays within as few
    nodes as it can. That is for speed alone: any grouping gives the same distances.
    """
    n = sources.count()
    lead = sources.select("v", F.col("v").alias("lead"))
    if n > held:
        met = stored(lead)
        for _ in range(_TOGETHER):
            sent = met.join(out.withColumnRenamed("a", "v"), "v").select(F.col("b").alias("v"), "lead")
            met = stored(met.unionAll(sent).groupBy("v").agg(F.min("lead").alias("lead")), over=met)
        lead = sources.join(met, "v").select("v", "lead")
    tasks = math.ceil(n / _NUMBERED)
    lead = lead.repartitionByRange(tasks, "lead", "v") if tasks > 1 else lead.coalesce(1)
    k = lead.sortWithinPartitions("lead", "v").select("v", F.monotonically_increasing_id().alias("k"))
    return stored(k.select("v", F.shiftright("k", held.bit_length() - 1).alias("g"), F.col("k").bitwiseAND(held - 1).cast("int").alias("at"))), max(1, min(n, held))


def _bits(words: int) -> list[str]:
    return [f"b{i}" for i in range(words)]


def _levels(out: DataFrame, dealt: DataFrame, width: int, most: int | None = None) -> list[DataFrame]:
    """(g, v, b0, b1, ...) by distance, from 0 on: the nodes met first at that distance, with a bit for each source of the group.

    A level is one join and one OR of the words of bits: work is edges times groups of sources, not times sources.
    A level is written once and only read from then on.
    """
    bits = _bits(max(1, math.ceil(width / 64)))
    levels = [stored(dealt.select("g", "v", *[F.when(F.shiftright("at", 6) == i, F.expr("shiftleft(1L, at & 63)")).otherwise(F.lit(0).cast("long")).alias(b) for i, b in enumerate(bits)]))]
    while most is None or len(levels) <= most:
        seen = levels[0]
        for x in levels[1:]:
            seen = seen.unionAll(x)
        seen = seen.groupBy("g", "v").agg(*[F.bit_or(b).alias(f"o{b}") for b in bits])
        sent = levels[-1].repartition(_tasks(out), "v").join(out.withColumnRenamed("a", "v"), "v")
        reached = sent.groupBy("g", F.col("b").alias("v")).agg(*[F.bit_or(b).alias(b) for b in bits])
        new = reached.join(seen, ["g", "v"], "left").select("g", "v", *[F.col(b).bitwiseAND(F.bitwise_not(F.coalesce(f"o{b}", F.lit(0).cast("long")))).alias(b) for b in bits])
        new = stored(new.filter(" OR ".join(f"{b} <> 0" for b in bits)))
        if new.isEmpty():
            forget(new)
            break
        levels.append(new)
    return levels


def _with_distance(levels: list[DataFrame]) -> DataFrame:
    """(g, v, b0, b1, ..., dist) of all levels."""
    every = [x.withColumn("dist", F.lit(e)) for e, x in enumerate(levels)]
    all_levels = every[0]
    for x in every[1:]:
        all_levels = all_levels.unionAll(x)
    return all_levels


def _by_source(met: DataFrame, keep: list[str]) -> DataFrame:
    """(g, at, keep): a row for each bit that is set."""
    bits = [c for c in met.columns if c.startswith("b")]
    words = met.select("g", *keep, F.inline(F.array(*[F.struct(F.lit(i).alias("word"), F.col(b).alias("bits")) for i, b in enumerate(bits)]))).filter("bits <> 0")
    each = words.withColumn("bit", F.explode(F.array(*[F.lit(i) for i in range(64)]))).filter("getbit(bits, bit) = 1")
    return each.select("g", (F.col("word") * 64 + F.col("bit")).alias("at"), *keep)


#: Groups whose counts by source a task holds at once.
_TALLIED = 1024


def _tally(batches):
    """(g, at, r, t): of the task's rows (g, dist, b0, b1, ...), how many have the bit, and the sum of their distances."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            g, dist, *words = (part.column(k).to_numpy(zero_copy_only=False) for k in range(part.num_columns))
            order = np.lexsort((dist, g))
            g, dist = g[order], dist[order]
            bits = np.unpackbits(np.stack(words, axis=1)[order].astype("<i8").view(np.uint8), axis=1, bitorder="little")
            first = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (dist[1:] != dist[:-1]))))
            for k, n in zip(first, np.add.reduceat(bits, first, axis=0, dtype=np.int64), strict=True):
                sums = held.setdefault(int(g[k]), np.zeros((2, len(n)), np.int64))
                sums[0] += n
                sums[1] += n * int(dist[k])
        if len(held) > _TALLIED:
            yield from _tallied(held)
            held = {}
    yield from _tallied(held)


def _tallied(held: dict[int, np.ndarray]):
    for g, (r, t) in held.items():
        at = np.flatnonzero(r)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, np.int64)), pa.array(at.astype(np.int32)), pa.array(r[at]), pa.array(t[at])], names=["g", "at", "r", "t"])


def distances(edges: DataFrame, sources: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(source, id, dist): shortest directed distances from each source (all by default), within tasks for components that
    fit one, by frontier joins for larger ones."""
    nodes, out = _numbered(edges)
    rows, left = _within(nodes, out, sources, 64 * WORDS, named=True)
    near = rows.applyInArrow(searches.distances(most), "source string, id string, dist int")
    return near if left is None else near.unionAll(_far(nodes, *left, most))


def _far(nodes: DataFrame, out: DataFrame, sources: DataFrame, most: int | None) -> DataFrame:
    dealt, width = _dealt(out, sources, 64 * WORDS)
    named = dealt.join(nodes, "v").select("g", "at", F.col("id").alias("source"))
    met = _with_distance(_levels(out, dealt, width, most)).join(nodes.select("v", F.col("id").alias("name")), "v").drop("v")
    return _by_source(met, ["name", "dist"]).join(small(named), ["g", "at"]).select("source", F.col("name").alias("id"), "dist")


def _share(r: Column, s: Column, n: Column) -> Column:
    return rounded(F.coalesce(F.try_divide(r, s) * F.try_divide(r, n - 1), F.lit(0.0)), 4).alias("closeness")


def closeness(edges: DataFrame, some: DataFrame | None = None) -> DataFrame:
    """(id, closeness) by incoming distances, scaled by the reachable share; of the named nodes (id) only, if given.

    Distances to a node are those from it along turned edges, so work follows the number of nodes asked for;
    for all nodes of a large graph there is closeness_by_sketches().
    """
    nodes, out = _numbered(edges)
    asked = nodes if some is None else nodes.join(some.select("id").distinct(), "id", "left_semi")
    rows, left = _within(nodes, out, some, 64 * WORDS)
    sums = rows.applyInArrow(searches.incoming, "v long, r long, t long").filter("r > 0")
    if left is not None:
        sums = sums.unionAll(_incoming(*left))
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    return asked.join(sums, "v", "left").join(F.broadcast(n)).select("id", _share(F.col("r"), F.col("t"), F.col("n")))


def _incoming(out: DataFrame, asked: DataFrame) -> DataFrame:
    """(v, r, t) of the nodes asked for: how many others reach them, and the sum of their distances, by frontier joins."""
    turned = out.select(F.col("b").alias("a"), F.col("a").alias("b"))
    dealt, width = _dealt(turned, asked, 64 * WORDS)
    met = _with_distance(_levels(turned, dealt, width)).filter("dist > 0")
    parts = met.select("g", "dist", *[c for c in met.columns if c.startswith("b")]).mapInArrow(_tally, "g long, at int, r long, t long")
    sums = parts.groupBy("g", "at").agg(F.sum("r").alias("r"), F.sum("t").alias("t"))
    return dealt.join(sums, ["g", "at"]).select("v", "r", "t")


#: Bytes of sketches that a task holds at most, and the nodes from which on there are more tasks, up to one a core.
_SKETCHED, _SHARED = 2**27, 4096


def closeness_by_sketches(edges: DataFrame, lg_k: int = 10, most: int | None = None) -> DataFrame:
    """(id, closeness, reached) of every node, estimated: closeness() with the sizes of neighbourhoods by sketches.

    A node's sketch counts the nodes that reach it within t steps; a round merges those of its predecessors into it, and
    what its count grows by lies at distance t. Only sketches that have grown are sent again, so rounds end at the
    longest distance and work is edges times rounds, not nodes times edges. A count's standard error is
    1.04 / sqrt(2 ** lg_k), about 3 % at 10; sketches of few nodes are exact.

    Nodes are dealt to blocks. A task holds a block's sketches; between two blocks go the sketches of either the edges'
    sources or their targets, summed, whichever are fewer, so what is sent follows the nodes, not the edges.
    """
    nodes, out = _numbered(edges)
    n = nodes.count()
    blocks = max(1, min(nodes.sparkSession.sparkContext.defaultParallelism, math.ceil(n / _SHARED)), math.ceil(n * 2**lg_k / _SKETCHED))
    block = lambda c: F.pmod(F.col(c), F.lit(blocks)).cast("int")
    along = stored(out.distinct().select(block("a").alias("p"), block("b").alias("q"), "a", "b").groupBy("p", "q").applyInArrow(sketches.arranged, sketches.DDL), by=("to",))
    state, step = stored(nodes.groupBy(block("v").alias("to")).agg(F.collect_list("v").alias("v")).withColumn("kind", F.lit("node")), by=("to",)), 0
    while True:
        held = state.unionByName(along, True).select(*sketches.SCHEMA.names)
        # A part a block; the first is empty, as a union of single partitions alone would run as one task.
        parts = [held.filter("to < 0"), *[held.filter(F.col("to") == i).coalesce(1) for i in range(blocks)]]
        each = [x.mapInArrow(sketches.stepped(step, lg_k, most is None or step < most), sketches.DDL) for x in parts]
        state = stored(functools.reduce(DataFrame.unionAll, each), over=state, by=("to",))
        if (step == most) or state.filter("grown > 0").isEmpty():
            break
        step += 1
    forget(along)
    counts = state.filter("kind = 'state'").select(F.inline(F.arrays_zip("v", "n", "t")))
    r = F.least("n", F.lit(n)) - 1
    return nodes.join(counts, "v").select("id", _share(r, F.col("t"), F.lit(n)), r.alias("reached"))


_SUMMED = "g long, v long, old int, p array<double>"
#: Rows of sums that a task holds before it adds up those of the same node.
_HELD = 50_000


def _reduced(parts: list[tuple]) -> tuple:
    """(g, v, old, p) sorted, the rows p of the same (g, v, old) added up."""
    g, v, old, p = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((old, v, g))
    g, v, old = g[order], v[order], old[order]
    first = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (v[1:] != v[:-1]) | (old[1:] != old[:-1]))))
    return g[first], v[first], old[first], np.add.reduceat(p[order], first, axis=0)


def _added_up(batches, whole: bool):
    """Sums of the task's rows by (g, v, old): all of them if `whole`, else as far as they are held at once."""
    parts, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            g, v, old = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            parts.append(_reduced([(g, v, old, batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(g), -1))]))
            rows += len(parts[-1][0])
            if rows > _HELD:
                parts = [_reduced(parts)]
                if not whole:
                    yield parts.pop()
                rows = 2 * len(parts[0][0]) // 3 if parts else 0
    if parts:
        yield _reduced(parts)


def _batches(g, v, old, p):
    for i in range(0, len(g), 4096):
        x = p[i : i + 4096]
        ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * p.shape[1], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(g[i : i + 4096]), pa.array(v[i : i + 4096]), pa.array(old[i : i + 4096]), pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1)))], names=["g", "v", "old", "p"])


def _partly(batches):
    for x in _added_up(batches, whole=False):
        yield from _batches(*x)


def _newly(batches):
    """Whole sums of what is new, 0 where the old sums of the same node aren't; rows of zeros drop out."""
    for g, v, old, p in _added_up(batches, whole=True):
        at = np.flatnonzero(old == 0)
        after = np.minimum(at + 1, len(g) - 1)
        known = (after > at) & (g[after] == g[at]) & (v[after] == v[at])
        new = p[at] * np.where(known[:, None], p[after] == 0, True)
        kept = new.any(axis=1)
        yield from _batches(g[at][kept], v[at][kept], old[at][kept], new[kept])


def _sent(rows: DataFrame, along: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """(g, v, p): the vectors p of rows (g, v, p) sent along edges (v, to) and added up, 0 where those `met` before aren't.

    Spark joins and deals out the rows; a task adds up vectors, before the exchange and after it.
    """
    tasks = _tasks(along)
    sent = rows.repartition(tasks, "v").join(along, "v").select("g", F.col("to").alias("v"), F.lit(0).alias("old"), "p").mapInArrow(_partly, _SUMMED)
    if met is not None:
        sent = sent.unionAll(met.select("g", "v", F.lit(1).alias("old"), "p"))
    return sent.repartition(tasks, "g", "v").mapInArrow(_newly, _SUMMED).drop("old")


def _paths(out: DataFrame, dealt: DataFrame, width: int) -> list[DataFrame]:
    """(g, v, p) by distance: how many shortest paths lead to the nodes met first at that distance, from each source of the group
    (0: not met here)."""
    along = out.select(F.col("a").alias("v"), F.col("b").alias("to"))
    levels = [stored(dealt.select("g", "v", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i == F.col("at"), 1.0).otherwise(0.0)).alias("p")))]
    while True:
        met = levels[0]
        for x in levels[1:]:
            met = met.unionAll(x)
        new = stored(_sent(levels[-1], along, met))
        if new.isEmpty():
            forget(new)
            break
        levels.append(new)
    return levels


def _dependencies(out: DataFrame, sources: DataFrame) -> tuple[DataFrame | None, list[DataFrame]]:
    """((v, shares), the tables it reads): how much each node lies on shortest paths from each source of a group, without the
    source itself; path counts forward by distance, shares backward. None if no path has an inner node."""
    dealt, width = _dealt(out, sources, COLUMNS)
    levels = _paths(out, dealt, width)
    parts: list[DataFrame] = []
    back = out.select(F.col("b").alias("v"), F.col("a").alias("to"))
    for e in range(len(levels) - 1, 1, -1):
        w = levels[e]
        if parts:
            w = w.join(parts[-1], ["g", "v"], "left")
            due = F.zip_with("p", F.coalesce("shares", F.transform("p", lambda _: F.lit(0.0))), lambda x, d: F.when(x > 0, (1 + d) / x).otherwise(0.0))
        else:
            due = F.transform("p", lambda x: F.when(x > 0, 1 / x).otherwise(0.0))
        got = _sent(w.select("g", "v", due.alias("p")), back).withColumnRenamed("p", "c")
        parts.append(stored(got.join(levels[e - 1], ["g", "v"]).select("g", "v", F.zip_with("c", "p", lambda c, x: c * x).alias("shares"))))
    forget(dealt, *levels)
    if not parts:
        return None, []
    every = parts[0]
    for x in parts[1:]:
        every = every.unionAll(x)
    return every.select("v", "shares"), parts


def _added(column: str, of) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda so_far, x: so_far + of(x))


#: Sources whose path counts are written at once where components don't fit a task.
_AT_A_TIME = 4096


def betweenness(edges: DataFrame, pivots: DataFrame | None = None) -> DataFrame:
    """(id, betweenness) of the directed graph, over (n - 1)(n - 2), from all nodes.

    With `pivots` (id) only these are sources and the sum is scaled up to n. Components are searched within tasks where
    they fit one; larger ones by exchanges, some sources at a time, so that what is written stays bounded.
    """
    nodes, out = _numbered(edges)
    rows, left = _within(nodes, out, pivots, searches.COLUMNS)
    found = rows.applyInArrow(searches.dependencies, "v long, x double")
    if left is not None:
        found = found.unionAll(_summed(*left))
    total = found.groupBy("v").agg(F.sum("x").alias("b"))
    k = nodes if pivots is None else nodes.join(pivots.select("id").distinct(), "id", "left_semi")
    n = nodes.agg(F.count(F.lit(1)).alias("n")).join(k.agg(F.count(F.lit(1)).alias("k")))
    x = nodes.join(total, "v", "left").join(F.broadcast(n))
    return x.select("id", rounded(F.coalesce(F.try_divide(F.col("b"), (F.col("n") - 1) * (F.col("n") - 2)) * F.try_divide(F.col("n"), F.col("k")), F.lit(0.0)), 4).alias("betweenness"))


def _summed(out: DataFrame, sources: DataFrame) -> DataFrame:
    """(v, x): dependencies of all sources, summed batch by batch."""
    batches = math.ceil(sources.count() / _AT_A_TIME)
    sums = None
    for i in range(batches):
        batch = stored(sources.filter(F.pmod(F.xxhash64("v"), F.lit(batches)) == i))
        deltas, parts = _dependencies(out, batch)
        if deltas is not None:
            new = deltas.groupBy("v").agg(F.sum(_added("shares", lambda x: x)).alias("x"))
            sums = stored(new) if sums is None else stored(new.unionAll(sums).groupBy("v").agg(F.sum("x").alias("x")), over=sums)
            forget(*parts)
        forget(batch)
    return sums if sums is not None else sources.select("v", F.lit(0.0).alias("x")).limit(0)


def betweenness_within(edges: DataFrame, error: float = 0.05, failure: float = 0.1, first: int = 64, seed: int = 1) -> DataFrame:
    """(id, betweenness, bound, n_sources): betweenness from as many sampled sources as its error needs.

    Sources are drawn without replacement, in batches that double. After each, the observed variance of every node's
    share gives an empirical Bernstein bound on its error; with probability 1 - failure all bounds hold, over all nodes
    and batches. It ends when the largest is at most `error`, or with all sources, when the result is exact (bound 0).
    """
    nodes, out = _numbered(edges)
    out = stored(out.distinct())
    n = nodes.count()
    if n < 3:
        return nodes.select("id", F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("bound"), F.lit(n).cast("long").alias("n_sources"))
    drawn = stored(nodes.select("v", F.xxhash64("v", F.lit(seed)).alias("h")))
    log = math.log(3 * n * max(1, math.ceil(math.log2(max(2, n / first))) + 1) / failure)
    top = n / (n - 1)  # the largest share: all pairs of a source, scaled from n to n - 1 sources
    done, sums, size = 0, None, first
    while True:
        batch = stored(drawn.orderBy("h", "v").offset(done).limit(size).select("v"))
        done = min(n, done + size)
        deltas, parts = _dependencies(out, batch)
        if deltas is not None:
            by = top / (n - 2)
            new = deltas.groupBy("v").agg(F.sum(_added("shares", lambda x: x * by)).alias("x"), F.sum(_added("shares", lambda x: x * by * x * by)).alias("xx"))
            sums = stored(new if sums is None else new.unionAll(sums).groupBy("v").agg(F.sum("x").alias("x"), F.sum("xx").alias("xx")), over=sums)
            forget(*parts)
        forget(batch)
        mean = F.coalesce("x", F.lit(0.0)) / done
        spread = F.greatest(F.coalesce("xx", F.lit(0.0)) / done - mean * mean, F.lit(0.0))
        bound = F.lit(0.0) if done == n else F.sqrt(2 * spread * log / done) + 3 * log * top / done
        told = nodes.select("id", "v").join(sums, "v", "left") if sums is not None else nodes.select("id", "v", F.lit(0.0).alias("x"), F.lit(0.0).alias("xx"))
        told = told.select("id", rounded(mean, 4).alias("betweenness"), rounded(bound, 4).alias("bound"), F.lit(done).cast("long").alias("n_sources"))
        if done == n or told.agg(F.max("bound")).first()[0] <= error:
            return told
        size = done


#: Share of the nodes up to which moves in two turns count as none.
_FEW = 0.001


def communities(edges: DataFrame, rounds: int = 6, levels: int = 6) -> DataFrame:
    """(id, community): communities of high modularity of the undirected view, each connected, named by the least of its nodes.

    A level moves nodes to neighbouring communities by modularity gain until few gain. Then communities are refined:
    what isn't connected inside becomes communities of its own, which can only raise modularity. Every community
    becomes a node of the next level, with the weights between and within them summed. It ends when a level
    leaves its nodes alone or makes modularity no better. Components that fit a task are worked on within tasks, each
    until its own nodes stay; larger ones by exchanges.
    """
    nodes, out = _numbered(edges)
    rows, left = _within(nodes, out, None, _WITHIN)
    held = stored(rows.applyInArrow(moves.links, moves.DDL))
    m2 = 2.0 * (held.agg(F.sum("m")).first()[0] or 0)
    adj = degree = None
    if left is not None:
        both = left[0].select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        adj = stored(_both_ways(both.select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(1.0).alias("w"))))
        degree = stored(adj.groupBy("v").agg(F.sum("w").alias("k")))
        m2 += degree.agg(F.sum("k")).first()[0]
    found = held.mapInArrow(moves.communities(m2, rounds, levels, _FEW), "v long, c long")
    if left is not None:
        found = found.unionAll(_between_tasks(adj, degree, m2, rounds, levels))
    names = stored(nodes.join(found, "v", "left").select("id", F.coalesce("c", "v").alias("c")))
    least = names.groupBy("c").agg(F.min("id").alias("community"))
    return names.join(least, "c").select("id", "community")


def _between_tasks(adj: DataFrame, degree: DataFrame, m2: float, rounds: int, levels: int) -> DataFrame:
    """(v, c): communities() of components that don't fit a task, by exchanges."""
    names = degree.select("v", F.col("v").alias("c"))
    loops, best = None, None
    for _ in range(levels):
        labels, moved = _moves(adj, degree, m2, rounds)
        if not moved:
            break
        at = lambda v, x: labels.select(F.col("v").alias(v), F.col("label").alias(x))
        half = adj.filter("v < to")
        inner = stored(half.join(at("v", "x"), "v").join(at("to", "y"), "to").filter("x = y").select(F.col("v").alias("a"), F.col("to").alias("b")))
        roots = stars.components(inner)
        parts = stored(labels.join(roots.withColumnRenamed("id", "v"), "v", "left").select("v", F.coalesce("root", "v").alias("label")))
        of = lambda v, x: parts.select(F.col("v").alias(v), F.col("label").alias(x))
        between = half.join(of("v", "x"), "v").join(of("to", "y"), "to").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        between = stored(between.agg(F.sum("w").alias("w")))
        own = between.filter("x = y").select(F.col("x").alias("v"), (2 * F.col("w")).alias("w"))
        own = own if loops is None else own.unionAll(loops.join(parts, "v").select(F.col("label").alias("v"), "w"))
        loops = stored(own.groupBy("v").agg(F.sum("w").alias("w")))
        degree = stored(degree.join(parts, "v").groupBy(F.col("label").alias("v")).agg(F.sum("k").alias("k")))
        quality = degree.join(loops, "v", "left").agg(F.sum(F.coalesce("w", F.lit(0.0)) / m2 - F.pow(F.col("k") / m2, 2))).first()[0]
        if best is not None and quality <= best + 1e-9:
            break
        best = quality
        names = stored(names.join(of("c", "n"), "c", "left").select("v", F.coalesce("n", "c").alias("c")))
        adj = _both_ways(between.filter("x <> y").select("x", "y", "w"))
    return names


def _both_ways(links: DataFrame) -> DataFrame:
    """(v, to, w): links (x, y, w) from either end."""
    return links.select(F.inline(F.array(F.struct(F.col("x").alias("v"), F.col("y").alias("to"), "w"), F.struct(F.col("y").alias("v"), F.col("x").alias("to"), "w"))))


def _moves(adj: DataFrame, degree: DataFrame, m2: float, rounds: int, few: float = _FEW) -> tuple[DataFrame, bool]:
    """((v, label), whether any node has moved): local moves of a level.

    A node moves to the neighbouring community of the largest gain, ties to the least label. Half of the nodes, drawn
    anew each turn, move at once, so that two neighbours don't swap labels for ever. It ends when two turns
    together move no more than a share of `few` of the nodes. A label travels along the links with its community's sum, so
    that links are exchanged twice a turn: by the neighbour, for its label, and by the node, where the rest is done.
    """
    labels = stored(degree.select("v", "k", F.col("v").alias("label"), F.lit(False).alias("changed")))
    n, before, moved = labels.count(), None, False
    for turn in range(2 * rounds):
        drawn = lambda v: F.pmod(F.xxhash64(v, F.lit(turn)), F.lit(2)) == 0  # noqa: E731, B023
        sized = labels.join(labels.groupBy("label").agg(F.sum("k").alias("tot")), "label").select("v", "label", "tot")
        mine = labels.filter(drawn("v")).select("v", "k", F.col("label").alias("own"))
        sent = adj.filter(drawn("v")).join(sized.withColumnRenamed("v", "to"), "to").select("v", "label", "tot", "w")
        stay = sized.filter(drawn("v")).withColumn("w", F.lit(0.0))
        options = sent.unionAll(stay).repartition("v").groupBy("v", "label").agg(F.sum("w").alias("l"), F.max("tot").alias("tot")).join(mine, "v")
        gain = F.col("l") - F.col("k") * (F.col("tot") - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(0.0)) / m2
        best = options.groupBy("v").agg(F.min(F.struct((-rounded(gain, 8)).alias("g"), (F.col("label") != F.col("own")).alias("s"), "label")).alias("b"))
        to = F.coalesce("b.label", "label")
        labels = stored(labels.drop("changed").join(best, "v", "left").select("v", "k", to.alias("label"), (to != F.col("label")).alias("changed")), over=labels)
        changed = labels.filter("changed").count()
        moved |= changed > 0
        if before is not None and before + changed <= few * n:
            break
        before = changed
    return labels.select("v", "label"), moved


def modularity(edges: DataFrame, labels: DataFrame, label: str = "community") -> DataFrame:
    """(modularity) of a labelling of the undirected view."""
    both = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    la, lb = labels.select(F.col("id").alias("a"), F.col(label).alias("x")), labels.select(F.col("id").alias("b"), F.col(label).alias("y"))
    e = both.join(la, "a").join(lb, "b")
    ends = e.select(F.inline(F.array(F.struct(F.col("x").alias("c"), (F.col("x") == F.col("y")).cast("int").alias("i")), F.struct(F.col("y").alias("c"), F.lit(0).alias("i")))))
    m = both.agg(F.count(F.lit(1)).alias("m"))
    per = ends.groupBy("c").agg(F.count(F.lit(1)).alias("d"), F.sum("i").alias("i")).join(F.broadcast(m))
    return per.agg(rounded(F.sum(F.col("i") / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)), 6).alias("modularity"))


def community_members(labels: DataFrame, label: str = "community", shown: int = 8, most: int = 5, least: int = 2) -> DataFrame:
    """(community, size, members): the largest communities and the first names of each."""
    sizes = labels.groupBy(label).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least).orderBy(F.desc("size"), label).limit(most)
    w = Window.partitionBy(label).orderBy("id")
    few = labels.join(F.broadcast(sizes), label).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= shown)
    return few.groupBy(label, "size").agg(F.array_sort(F.collect_list("id")).alias("members"))


def top_actors(edges: DataFrame, nodes: DataFrame | None = None, most: int = 10) -> DataFrame:
    """(id, role, centrality) of the nodes of the highest degree centrality; role is the node's type or 'unknown'."""
    d = degree_centrality(edges, nodes)
    roles = d.withColumn("role", F.lit("unknown")) if nodes is None else d.join(nodes.select("id", F.col("type").alias("role")), "id", "left").fillna("unknown", ["role"])
    return roles.orderBy(F.desc("centrality"), "id").limit(most).select("id", "role", "centrality")
