"""The given tables as the inputs that operators expect, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import params
from riskloom.functions.num import clamp, rounded
from riskloom.session import table

AS_OF = "2024-02-01"


def R(x: str, places: int = 2) -> str:
    """SQL of functions.num.rounded."""
    return f"CAST(round(CAST({x} AS DECIMAL(28,10)), {places}) AS DOUBLE)"


def C(x: str, low: float = 0.0, high: float = 1.0) -> str:
    """SQL of functions.num.clamp."""
    return f"greatest({low}, least({high}, {x}))"


def L(words: list[str]) -> str:
    """A SQL list of strings."""
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def series(spark: SparkSession, d: str) -> DataFrame:
    """Daily mean value of each event type."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("series_key"), F.to_date("ts").alias("date")).agg(rounded(F.avg("value"), 2).alias("score"))


SERIES = f"SELECT event_type AS series_key, CAST(ts AS DATE) AS date, {R('avg(value)')} AS score FROM events GROUP BY 1, 2"


def history(spark: SparkSession, d: str) -> DataFrame:
    """Daily indicators of five regions (users by remainder); placeholders are 0 on even days."""
    share = lambda *kinds: rounded(F.avg(F.col("event_type").isin(*kinds).cast("double")), 4)
    odd = lambda c: F.when(F.dayofmonth("date") % 2 == 0, 0.0).otherwise(c)
    g = table(spark, d, "events").groupBy(F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")).alias("series_key"), F.to_date("ts").alias("date")).agg(
        share("error").alias("conflict_frequency"), rounded(clamp(F.avg("value") / 100), 4).alias("sentiment_avg"), share("signup").alias("__s"), share("view").alias("__v"), share("error", "purchase").alias("event_severity"), rounded(F.avg("value"), 2).alias("risk_score")
    )
    return g.select("series_key", "date", "conflict_frequency", "sentiment_avg", odd(F.col("__s")).alias("nightlight_change"), odd(F.col("__v")).alias("refugee_change"), "event_severity", "risk_score")


def _share(*kinds: str) -> str:
    return R("avg(CASE WHEN event_type IN (" + ", ".join(f"'{k}'" for k in kinds) + ") THEN 1.0 ELSE 0.0 END)", 4)


HISTORY = f"""SELECT series_key, date, conflict_frequency, sentiment_avg,
  CASE WHEN day(date) % 2 = 0 THEN 0.0 ELSE s END AS nightlight_change, CASE WHEN day(date) % 2 = 0 THEN 0.0 ELSE v END AS refugee_change, event_severity, risk_score
FROM (SELECT 'r' || CAST(user_id % 5 AS VARCHAR) AS series_key, CAST(ts AS DATE) AS date, {_share('error')} AS conflict_frequency, {R(C('avg(value) / 100'), 4)} AS sentiment_avg,
  {_share('signup')} AS s, {_share('view')} AS v, {_share('error', 'purchase')} AS event_severity, {R('avg(value)')} AS risk_score FROM events GROUP BY 1, 2)"""

_THEMES = {"error": ["190", "CONFLICT_WAR_X"], "click": ["POLITICAL"], "view": ["REFUGEES", "ECONOMIC_A"], "purchase": ["04"], "signup": []}


def articles(spark: SparkSession, d: str) -> DataFrame:
    """Events as raw coded articles: url, seendate, title, themes, tone, locations."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("nk"), "n_name")
    themes = F.create_map(*[x for k, v in _THEMES.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    e = table(spark, d, "events").withColumn("nk", (F.col("user_id") % 25).cast("int")).join(F.broadcast(nation), "nk")
    where = F.concat(F.lit("4#"), F.upper(F.substring("n_name", 1, 2)), F.lit("#"), F.col("n_name"), F.lit("#A#"), (9.5 + (F.col("nk") * 7) % 19).cast("string"), F.lit("#"), (92 + (F.col("nk") * 5) % 10).cast("string"), F.lit("#f;bad#1"))
    return e.select(
        F.col("event_id").alias("ingest_seq"), "ts", F.to_date("ts").alias("date"), F.concat(F.lit("http://x/"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "/").otherwise("")).alias("url"), F.date_format("ts", "yyyyMMddHHmmss").alias("seendate"),
        F.concat(F.lit("news "), F.col("event_type")).alias("title"), F.col("event_type").alias("series_key"), F.try_element_at(themes, F.col("event_type")).alias("themes"), F.concat((F.round(F.col("value") - 50, 2)).cast("decimal(10,2)").cast("string"), F.lit(",0,0")).alias("tone"), where.alias("locations"),
    )


ARTICLES = """SELECT event_id AS ingest_seq, ts, CAST(ts AS DATE) AS date, 'http://x/' || user_id || CASE WHEN event_id % 2 = 0 THEN '/' ELSE '' END AS url, strftime(ts, '%Y%m%d%H%M%S') AS seendate,
  'news ' || event_type AS title, event_type AS series_key, CASE event_type WHEN 'error' THEN ['190', 'CONFLICT_WAR_X'] WHEN 'click' THEN ['POLITICAL'] WHEN 'view' THEN ['REFUGEES', 'ECONOMIC_A'] WHEN 'purchase' THEN ['04'] ELSE [] END AS themes,
  CAST(round(value - 50, 2) AS DECIMAL(10,2)) || ',0,0' AS tone, n_name AS place, n_nationkey AS nk, value
FROM events JOIN nation ON n_nationkey = user_id % 25"""

#: Severity, tone and categories of ARTICLES' themes, worked out by its cases.
CODED = f"""SELECT *, CASE series_key WHEN 'error' THEN 0.9 WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.6 ELSE 0.2 END AS severity,
  series_key = 'error' AS has_conflict, series_key = 'click' AS has_unrest, series_key IN ('view', 'purchase') AS has_diplomacy,
  CASE series_key WHEN 'error' THEN ['conflict'] WHEN 'click' THEN ['unrest'] WHEN 'view' THEN ['humanitarian', 'diplomacy'] WHEN 'purchase' THEN ['diplomacy'] ELSE [] END AS categories,
  {C("(CAST(split_part(tone, ',', 1) AS DOUBLE) + 100) / 200")} AS norm FROM ({ARTICLES})"""


def nations(spark: SparkSession, d: str) -> DataFrame:
    """Nations as places, with the mean balance of their suppliers as risk."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("place"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(rounded(clamp(F.avg("s_acctbal") / 100, 0.0, 100.0), 4).alias("risk"))
    return n.join(s, "k", "left").select("place", (9.5 + (F.col("k") * 7) % 19).cast("double").alias("lat"), (92.0 + (F.col("k") * 5) % 10).cast("double").alias("lon"), "risk", (F.col("k") % 3 == 0).alias("border"))


NATIONS = f"""SELECT n_name AS place, CAST(9.5 + (n_nationkey * 7) % 19 AS DOUBLE) AS lat, CAST(92.0 + (n_nationkey * 5) % 10 AS DOUBLE) AS lon, risk, n_nationkey % 3 = 0 AS border
FROM nation LEFT JOIN (SELECT s_nationkey, {R(C('avg(s_acctbal) / 100', 0.0, 100.0), 4)} AS risk FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey"""


def places(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as places, with their balance as risk."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(F.concat(F.lit("S"), k.cast("string")).alias("place"), (9.5 + (k * 7) % 1900 / 100).alias("lat"), (92.0 + (k * 5) % 1000 / 100).alias("lon"), rounded(clamp(F.col("s_acctbal") / 100, 0.0, 100.0), 4).alias("risk"), (k % 3 == 0).alias("border"))


PLACES = f"""SELECT 'S' || s_suppkey AS place, 9.5 + CAST((s_suppkey * 7) % 1900 AS DOUBLE) / 100 AS lat, 92.0 + CAST((s_suppkey * 5) % 1000 AS DOUBLE) / 100 AS lon, {R(C('CAST(s_acctbal AS DOUBLE) / 100', 0.0, 100.0), 4)} AS risk, s_suppkey % 3 = 0 AS border FROM supplier"""


def centers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("r_regionkey")
    return table(spark, d, "region").select(F.col("r_name").alias("center"), (10.0 + (k * 7) % 19).cast("double").alias("lat"), (91.0 + (k * 5) % 10).cast("double").alias("lon"), (1.0 - k / 10).alias("weight"))


CENTERS = "SELECT r_name AS center, CAST(10.0 + (r_regionkey * 7) % 19 AS DOUBLE) AS clat, CAST(91.0 + (r_regionkey * 5) % 10 AS DOUBLE) AS clon, 1.0 - r_regionkey / 10 AS weight FROM region"


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Trade by line item, typed by return flag: from customers to suppliers, and back for returned items."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag")
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("c"))
    x = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("s", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
    back = F.col("l_returnflag") == "R"
    return x.select(F.when(back, F.col("s")).otherwise(F.col("c")).alias("src"), F.when(back, F.col("c")).otherwise(F.col("s")).alias("dst"), F.col("l_returnflag").alias("type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


EDGES = """SELECT CASE WHEN l_returnflag = 'R' THEN s ELSE c END AS src, CASE WHEN l_returnflag = 'R' THEN c ELSE s END AS dst, type, seq FROM (
  SELECT 'C' || o_custkey AS c, 'S' || l_suppkey AS s, l_returnflag, l_returnflag AS type, l_orderkey * 10 + l_linenumber AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def typed_nodes(spark: SparkSession, d: str) -> DataFrame:
    """(id, type): customers and suppliers."""
    one = lambda t, c, k: table(spark, d, t).select(F.concat(F.lit(c), F.col(k).cast("string")).alias("id"), F.lit(t).alias("type"))
    return one("customer", "C", "c_custkey").unionAll(one("supplier", "S", "s_suppkey"))


TYPED_NODES = "SELECT 'C' || c_custkey AS id, 'customer' AS type FROM customer UNION ALL SELECT 'S' || s_suppkey, 'supplier' FROM supplier"


def monthly(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """(series_key, month, value) of orders and shipments by month, and a spine over all of them."""
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("series_key"), F.trunc("o_orderdate", "MM").alias("month"), "o_totalprice", "o_orderpriority")
    one = lambda df, v: df.groupBy("series_key", "month").agg(v.alias("value"))
    spine = o.groupBy("series_key").agg(F.min("month").alias("a"), F.max("month").alias("b")).select("series_key", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return {
        "spine": spine,
        "light": one(o, rounded(clamp(F.avg("o_totalprice") / 500_000), 4)),
        "conflicts": one(o, F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("double")),
        "sentiment": one(o.filter("o_totalprice > 100000"), rounded(clamp(F.avg("o_totalprice") / 300_000), 4)),
        "events": one(o.filter("o_orderpriority = '5-LOW'"), F.count(F.lit(1)).cast("double")),
    }


_MONTH = "SELECT o_orderstatus AS series_key, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, {} AS value FROM orders {} GROUP BY 1, 2"
MONTHLY = {
    "spine": "SELECT series_key, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month FROM (SELECT o_orderstatus AS series_key, CAST(date_trunc('month', min(o_orderdate)) AS DATE) AS a, CAST(date_trunc('month', max(o_orderdate)) AS DATE) AS b FROM orders GROUP BY 1)",
    "light": _MONTH.format(R(C("avg(o_totalprice) / 500000"), 4), ""),
    "conflicts": _MONTH.format("CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS DOUBLE)", ""),
    "sentiment": _MONTH.format(R(C("avg(o_totalprice) / 300000"), 4), "WHERE o_totalprice > 100000"),
    "events": _MONTH.format("CAST(count(*) AS DOUBLE)", "WHERE o_orderpriority = '5-LOW'"),
}


def weights_sql() -> str:
    return "(VALUES " + ", ".join(f"('{k}', CAST({w} AS DOUBLE), {str(k in params.PLACEHOLDERS).lower()})" for k, w in params.WEIGHTS.items()) + ") w(indicator, weight, placeholder)"


def names_sql(column: str, names: dict[str, str] = params.INDICATOR_NAMES) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {column} END"


def bands_sql(x: str, bands: tuple) -> str:
    return "CASE WHEN " + x + " IS NULL THEN NULL " + " ".join(f"WHEN {x} >= {least} THEN '{label}'" if least != float("-inf") else f"ELSE '{label}'" for least, label in bands) + " END"


def long_sql(source: str) -> str:
    """HISTORY's indicators as rows."""
    return " UNION ALL ".join(f"SELECT series_key, date, '{k}' AS indicator, {k} AS value FROM ({source})" for k in params.WEIGHTS)
