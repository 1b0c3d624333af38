"""Spatial operators over places (place, lat, lon, risk)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import params
from riskloom.functions.num import haversine, rounded
from riskloom.session import bounded, forget, stored


#: Centres up to which every place meets each of them.
MOST_CENTERS = 10_000


def locate(rows: DataFrame, places: DataFrame, place: str = "place") -> DataFrame:
    """rows with lat and lon: their own first, then the place's; rows without either drop out."""
    dim = places.select(place, F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    own = [c if c in rows.columns else None for c in ("lat", "lon")]
    df = rows.join(dim, place, "left")
    lat = F.coalesce(F.col("lat"), F.col("__lat")) if own[0] else F.col("__lat")
    lon = F.coalesce(F.col("lon"), F.col("__lon")) if own[1] else F.col("__lon")
    return df.withColumn("lat", lat).withColumn("lon", lon).drop("__lat", "__lon").filter("lat IS NOT NULL AND lon IS NOT NULL")


def potential(places: DataFrame, centers: DataFrame, place: str = "place", floor_km: float = 10.0) -> DataFrame:
    """(place, risk, total_influence, potential, dominant_center, potential_normalized): centres' weights over squared distances, times risk.

    Centres (center, lat, lon, weight) are a dimension of at most MOST_CENTERS rows, as every place meets each of them.
    """
    c = centers.select("center", F.col("lat").alias("clat"), F.col("lon").alias("clon"), "weight")
    km = F.greatest(haversine(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")), F.lit(floor_km))
    pairs = places.select(place, "lat", "lon", F.coalesce("risk", F.lit(50.0)).alias("risk")).crossJoin(bounded(c, "centres", MOST_CENTERS)).withColumn("influence", F.col("weight") / F.pow(km / 100, 2))
    g = pairs.groupBy(place).agg(F.max("risk").alias("risk"), F.sum("influence").alias("__t"), F.min(F.struct((-F.col("influence")).alias("i"), "center")).alias("__d"))
    g = g.select(place, F.col("risk"), F.col("__t"), rounded(F.col("__t") * F.col("risk") / 100, 4).alias("potential"), F.col("__d.center").alias("dominant_center"))
    top = g.agg(F.max("potential").alias("__max"))
    return g.join(F.broadcast(top)).select(place, rounded(F.col("risk"), 2).alias("risk"), rounded(F.col("__t"), 4).alias("total_influence"), "potential", "dominant_center", rounded(F.coalesce(F.try_divide("potential", "__max"), F.lit(0.0)) * 100, 2).alias("potential_normalized"))


def pairs(places: DataFrame, place: str = "place", within_km: float | None = None, places_km: int | None = None) -> DataFrame:
    """Ordered pairs of different places with their distance: those within a distance, or all of them if none is given.

    With `within_km`, places meet by cells of a grid: bands of latitude at least that wide, each cut into equal
    cells of longitude that are wide enough at the band's end nearest to a pole, around the globe. Places at one point go
    together and are measured once; a crowded cell's places are dealt to parts by the pairs that it may give, so tasks stay even.
    km has `places_km` decimals if given. All pairs is what an exact Moran's I of a small set asks for; it is a nested loop.
    """
    km = haversine(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))
    if within_km is None:
        a = places.select(F.col(place).alias("a"), F.col("lat").alias("alat"), F.col("lon").alias("alon"), F.col("risk").alias("arisk"))
        b = places.select(F.col(place).alias("b"), F.col("lat").alias("blat"), F.col("lon").alias("blon"), F.col("risk").alias("brisk"))
        return a.join(b, F.col("a") != F.col("b")).withColumn("km", km)
    arc = within_km / 6371.0 * 1.000001
    band = max(math.degrees(arc), 0.01)
    y = lambda lat: F.floor((lat + 90) / band).cast("int")
    # a pair's longitudes differ by no more than this where the band and those beside it come nearest to a pole
    pole = lambda k: F.least(F.greatest(F.abs(k * band - band - 90), F.abs(k * band + 2 * band - 90)), F.lit(90.0))
    ratio = lambda k: math.sin(min(arc / 2, math.pi / 2)) / F.greatest(F.cos(F.radians(pole(k))), F.lit(1e-9))
    cells = lambda k: F.when(ratio(k) >= 1, 1).otherwise(F.greatest(F.floor(F.lit(360.0) / F.degrees(2 * F.asin(F.least(ratio(k), F.lit(1.0))))), F.lit(1))).cast("int")
    x = lambda lon, k: F.pmod(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * cells(k)), cells(k)).cast("int")
    beside = F.array(F.lit(-1), F.lit(0), F.lit(1))
    points = _points(places, place)
    one = lambda t: points.select(F.col("lat").alias(f"{t}lat"), F.col("lon").alias(f"{t}lon"), F.col("held").alias(f"{t}held"))
    a = one("a").withColumn("y", F.explode(F.transform(beside, lambda i: y(F.col("alat")) + i)))
    a = a.withColumn("x", F.explode(F.array_distinct(F.transform(beside, lambda i: F.pmod(x(F.col("alon"), F.col("y")) + i, cells(F.col("y")))))))
    b = one("b").withColumn("y", y(F.col("blat"))).withColumn("x", x(F.col("blon"), F.col("y")))
    sized = lambda df, t: df.groupBy("y", "x").agg(F.sum(F.size(f"{t}held")).alias(f"{t}n"))
    cell = stored(sized(a, "a").join(sized(b, "b"), ["y", "x"]).select("y", "x", F.ceil(F.col("an") * F.col("bn") / DEALT).cast("int").alias("deals")))
    deals = cell.agg(F.sum("deals")).first()[0] or 1
    tasks = max(2 * places.sparkSession.sparkContext.defaultParallelism, math.ceil(deals / 4))
    a = a.join(cell, ["y", "x"]).withColumn("deal", F.pmod(F.xxhash64("alat", "alon", F.get("aheld", F.lit(0))["p"]), F.col("deals"))).drop("deals")
    b = b.join(cell, ["y", "x"]).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1))).drop("deals")
    near = a.repartition(tasks, "y", "x", "deal").join(b.repartition(tasks, "y", "x", "deal"), ["y", "x", "deal"]).withColumn("km", km).filter(F.col("km") <= within_km)
    if places_km is not None:
        near = near.withColumn("km", rounded(F.col("km"), places_km))
    out = near.withColumn("m", F.explode("aheld")).withColumn("o", F.explode("bheld"))
    return out.select(F.col("m.p").alias("a"), "alat", "alon", F.col("m.risk").alias("arisk"), F.col("o.p").alias("b"), "blat", "blon", F.col("o.risk").alias("brisk"), "km").filter("a <> b")


#: Places at one point that travel together, and pairs that a cell deals to one of its parts.
TOGETHER, DEALT = 256, 2_000_000


def _points(places: DataFrame, place: str) -> DataFrame:
    """(lat, lon, held): places at one point in arrays of about TOGETHER at most, so that a pair of points is measured once."""
    p = places.filter("lat IS NOT NULL AND lon IS NOT NULL").select("lat", "lon", F.col(place).alias("p"), "risk")
    parts = p.groupBy("lat", "lon").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("parts"))
    dealt = p.join(parts, ["lat", "lon"]).withColumn("part", F.pmod(F.xxhash64("p"), F.col("parts")))
    return dealt.groupBy("lat", "lon", "part").agg(F.collect_list(F.struct("p", "risk")).alias("held")).drop("part")


#: Places whose pairs are summed one by one sooner than by cells.
FEW_PLACES = 2000
#: Levels of the cube grid around the globe; cells of the last have sides under a metre.
DEEPEST = 24


def _on_sphere(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df with x, y, z on the unit sphere, where poles and the date line are places like others; rows without a place drop out."""
    p, q = F.radians(lat), F.radians(lon)
    return df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumns({"x": F.cos(p) * F.cos(q), "y": F.cos(p) * F.sin(q), "z": F.sin(p)})


def _cell(level: Column | int, dx: Column | int = 0, dy: Column | int = 0, dz: Column | int = 0) -> Column:
    """(i, j, k) of the cell of a level that holds (x, y, z), or of one beside it; a level's cells have sides of 4 / 2 ** level."""
    along = lambda c, d: (F.floor((F.col(c) + 2) * F.pow(F.lit(2.0), level) / 4) + d).cast("long")
    return F.struct(along("x", dx).alias("i"), along("y", dy).alias("j"), along("z", dz).alias("k"))


def morans_i(places: DataFrame, place: str = "place", within_km: float | None = None, exact: bool | None = None, open_from: float = 0.2, leaf: int = 4096) -> DataFrame:
    """(morans_i, interpretation, mean_risk, n) with weights 1 / max(km, 1), not standardised; a missing risk is 50.

    All pairs count. Far ones go by cells: pairs of cells of a hierarchy are opened from the whole globe down, until the
    larger cell's extent is at most `open_from` of their distance, when the sums of both stand for their places, or they hold
    at most `leaf` pairs of places, which are then summed one by one. Work is near n log n. With `exact`, or `within_km`, all
    pairs (within that distance) are summed one by one; by default so are those of at most FEW_PLACES places.
    """
    if exact is None:
        exact = places.limit(FEW_PLACES + 1).count() <= FEW_PLACES
    p = places.withColumn("risk", F.coalesce("risk", F.lit(50.0)))
    mean = p.agg(F.avg("risk").alias("m"), F.count(F.lit(1)).alias("n"), (F.var_pop("risk") * F.count(F.lit(1))).alias("den"))
    if exact or within_km is not None:
        w = 1 / F.greatest(F.col("km"), F.lit(1.0))
        # sum w (a - m)(b - m) = sum w ab - m sum w (a + b) + m^2 sum w, so pairs are read once and only sums leave the tasks
        sums = pairs(p, place, within_km).select(w.alias("w"), "arisk", "brisk").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("arisk") * F.col("brisk")).alias("wab"), F.sum(F.col("w") * (F.col("arisk") + F.col("brisk"))).alias("wa"))
        r = mean.join(F.broadcast(sums)).withColumn("num", F.col("wab") - F.col("m") * F.col("wa") + F.col("m") * F.col("m") * F.col("w"))
    else:
        r = mean.join(F.broadcast(_pair_sums(p, mean, open_from, leaf)))
    i = F.when((F.col("n") < 3) | (F.col("den") < 1e-9) | (F.coalesce("w", F.lit(0.0)) < 1e-9), 0.0).otherwise(F.try_divide(F.col("n"), F.col("w")) * F.try_divide(F.col("num"), F.col("den")))
    r = r.withColumn("__i", i)
    words = params.MORAN_WORDS
    told = F.when(F.col("__i") > 0.3, words[0.3]).when(F.col("__i") > 0.1, words[0.1]).when(F.col("__i") < -0.1, words[-0.1]).otherwise(words[None])
    return r.select(rounded(F.col("__i"), 4).alias("morans_i"), told.alias("interpretation"), rounded(F.col("m"), 2).alias("mean_risk"), "n")


#: The deepest level of cells that Moran's I opens: their extent is below a kilometre, where all weights are 1.
_KM_LEVEL = 16


def _pair_sums(p: DataFrame, mean: DataFrame, open_from: float, leaf: int) -> DataFrame:
    """(w, num): the sums over ordered pairs of weights, and of weights times both deviations from the mean."""
    points = stored(_on_sphere(p.join(F.broadcast(mean.select("m")))).select("x", "y", "z", (F.col("risk") - F.col("m")).alias("u"), F.monotonically_increasing_id().alias("p")))
    levels = F.explode(F.sequence(F.lit(0), F.lit(_KM_LEVEL))).alias("level")
    cells = points.select("*", levels).groupBy("level", _cell(F.col("level")).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("q"), *[F.avg(a).alias(a) for a in "xyz"])
    cells = stored(cells)
    half = lambda c: F.struct(*[F.shiftright(F.col(f"{c}.{a}"), 1).alias(a) for a in "ijk"])
    under = lambda t: [F.col(c).alias(t + c) for c in ("c", "n", "s", "q", "x", "y", "z")]
    named = lambda df, t: df.select(*under(t))
    chord = F.sqrt(sum((F.pow(F.col("a" + c) - F.col("b" + c), 2) for c in "xyz"), F.lit(0.0)))
    weight = lambda d: 1 / F.greatest(2 * 6371.0 * F.asin(F.least(d / 2, F.lit(1.0))), F.lit(1.0))
    total = []
    front = stored(cells.filter("level = 0").select(*under("a"), *under("b")))  # one cell holds all
    level = 0
    while not front.isEmpty():
        same = F.col("ac") == F.col("bc")
        size = math.sqrt(3) * 4 / 2**level
        last = F.lit(level == _KM_LEVEL)
        far = (~same) & ((F.lit(size) <= open_from * chord) | (last & (F.col("an") * F.col("bn") > leaf)))
        within = same & last  # all weights are 1
        few = ~far & ~within & (F.col("an") * F.col("bn") <= leaf)
        w = weight(chord)
        total.append(stored(front.filter(far).agg(F.sum(2 * w * F.col("an") * F.col("bn")).alias("w"), F.sum(2 * w * F.col("as") * F.col("bs")).alias("num"))))
        total.append(stored(front.filter(within).agg(F.sum(F.col("an") * (F.col("an") - 1)).cast("double").alias("w"), F.sum(F.col("as") * F.col("as") - F.col("aq")).alias("num"))))
        at = points.withColumn("c", _cell(level))
        one = front.filter(few).select("ac", "bc").join(at.select(F.col("c").alias("ac"), "p", *[F.col(c).alias("a" + c) for c in "xyzu"]), "ac")
        both = one.join(at.select(F.col("c").alias("bc"), F.col("p").alias("o"), *[F.col(c).alias("b" + c) for c in "xyzu"]), "bc").filter("ac <> bc OR p < o")
        total.append(stored(both.agg(F.sum(2 * weight(chord)).alias("w"), F.sum(2 * weight(chord) * F.col("au") * F.col("bu")).alias("num"))))
        if level == _KM_LEVEL:
            break
        level += 1
        below = stored(cells.filter(F.col("level") == level).withColumn("up", half("c")))
        opened = front.filter(~(far | within | few)).select(F.col("ac").alias("aup"), F.col("bc").alias("bup"))
        wider = opened.join(named(below, "a").withColumn("aup", half("ac")), "aup").join(named(below, "b").withColumn("bup", half("bc")), "bup")
        front = stored(wider.filter("aup <> bup OR ac <= bc").drop("aup", "bup"), over=front)
    every = mean.select(F.lit(0.0).alias("w"), F.lit(0.0).alias("num"))
    for t in total:
        every = every.unionAll(t)
    forget(points, cells)
    return every.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"), F.coalesce(F.sum("num"), F.lit(0.0)).alias("num"))


def nearest(places: DataFrame, k: int = 3, place: str = "place", within_km: float | None = None) -> DataFrame:
    """(a, b, km, arisk, brisk, rank): the k nearest other places of each, by distance to a millimetre, ties by name.

    Each place looks in the smallest cell of its own, of a hierarchy of grids, that holds more than k places: these are no
    farther than the cell's diagonal, so the k nearest lie in the cells of twice that side around it. At most 8 k
    places of a cell look that far, so sparse places beside dense ones don't make work grow with its square. Of places at one
    point only the k + 1 first by name can be among anyone's nearest. With `within_km`, those within a distance only.
    """
    w = Window.partitionBy("a").orderBy(rounded(F.col("km"), 6), "b")
    shown = ("a", "b", rounded(F.col("km"), 3).alias("km"), "arisk", "brisk", "rank")
    if within_km is not None:
        return pairs(places, place, within_km).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(*shown)
    points = stored(_on_sphere(places.select(F.col(place).alias("a"), "lat", "lon", F.col("risk").alias("arisk"))))
    first = Window.partitionBy("lat", "lon").orderBy("a")
    others = stored(points.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).drop("r"))
    level = F.explode(F.sequence(F.lit(0), F.lit(DEEPEST))).alias("level")
    held = others.select("*", level).groupBy("level", _cell(F.col("level")).alias("c")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k)
    own = points.select("*", level).withColumn("c", _cell(F.col("level"))).join(held, ["level", "c"]).groupBy("a", "lat", "lon").agg(F.max("level").alias("level"))
    asked = points.join(own, ["a", "lat", "lon"], "left").withColumn("level", F.greatest(F.coalesce("level", F.lit(0)) - 1, F.lit(0)))
    beside = F.array(*[_cell(F.col("level"), i, j, h) for i in (-1, 0, 1) for j in (-1, 0, 1) for h in (-1, 0, 1)])
    asked = stored(asked.select("a", "lat", "lon", "arisk", "level", F.explode(beside).alias("c")))
    looked = stored(asked.select("level", "c").distinct())
    there = others.select(F.col("a").alias("b"), F.col("lat").alias("blat"), F.col("lon").alias("blon"), F.col("arisk").alias("brisk"), "x", "y", "z", level)
    there = there.withColumn("c", _cell(F.col("level"))).drop("x", "y", "z").join(looked, ["level", "c"], "left_semi")
    met = asked.join(there, ["level", "c"]).filter("a <> b").withColumn("km", haversine(F.col("lat"), F.col("lon"), F.col("blat"), F.col("blon")))
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(*shown)


def hotspots(places: DataFrame, threshold: float = 60.0, k: int = 3, place: str = "place", within_km: float | None = None) -> DataFrame:
    """(place, risk, neighbor_avg_risk, cluster_type, neighbors) of risky places whose k nearest reach 0.8 of the threshold on average."""
    near = nearest(places.withColumn("risk", F.coalesce("risk", F.lit(50.0))), k, place, within_km).filter(F.col("arisk") >= threshold)
    g = near.groupBy("a").agg(F.max("arisk").alias("r"), F.avg("brisk").alias("m"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "b"))), lambda x: x["b"]).alias("neighbors"))
    return g.filter(F.col("m") >= threshold * 0.8).select(F.col("a").alias(place), rounded(F.col("r"), 2).alias("risk"), rounded(F.col("m"), 2).alias("neighbor_avg_risk"), F.when(F.col("m") >= threshold, params.CLUSTERED).otherwise(params.ISOLATED).alias("cluster_type"), "neighbors")


def heat_points(rows: DataFrame, score: str = "risk") -> DataFrame:
    """(lat, lon, heat) of located rows with a score of 0..1, 0.5 where it is missing."""
    return rows.select("lat", "lon", (F.coalesce(score, F.lit(0.5)) * 10).alias("heat"))


def full_report(places: DataFrame, centers: DataFrame, threshold: float = 60.0, top: int = 5, k: int = 3, within_km: float | None = None) -> DataFrame:
    """(section, rank, place, value, detail): the places of the highest potential, the spatial autocorrelation, and all hotspots."""
    p = potential(places, centers)
    first = p.orderBy(F.desc("potential"), "place").limit(top)
    order = lambda *by: F.row_number().over(Window.orderBy(*by))
    best = first.select(F.lit("potential").alias("section"), order(F.desc("potential"), "place").alias("rank"), "place", "potential", F.col("dominant_center").alias("detail"))
    i = morans_i(places, within_km=within_km).select(F.lit("autocorrelation"), F.lit(1), F.lit(None).cast("string"), "morans_i", "interpretation")
    hot = hotspots(places, threshold, k, within_km=within_km).select(F.lit("hotspot"), F.lit(None).cast("int"), "place", "risk", F.concat_ws(" ", "cluster_type", F.array_join("neighbors", ",")))
    return best.unionAll(i).unionAll(hot).toDF("section", "rank", "place", "value", "detail")
