"""Columns of coded event articles: tone, severity and categories, places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions import params
from riskloom.functions.num import clamp, rounded


def tone(text: Column) -> Column:
    """struct<tone_score,normalized_score,risk_score> from 'tone,positive,...'; a bad number is 0."""
    t = F.coalesce(F.split(F.coalesce(text, F.lit("")), ",")[0].try_cast("double"), F.lit(0.0))
    norm = clamp((t + 100) / 200)
    return F.struct(rounded(t, 2).alias("tone_score"), rounded(norm, 4).alias("normalized_score"), rounded(1 - norm, 4).alias("risk_score"))


def severity(themes: Column, rules: list[tuple] = params.EVENT_RULES) -> Column:
    """struct of three flags, max_severity and event_categories (first met first) of an array of themes.

    The rules are an array literal of bounded size, filtered per theme: no join, no shuffle.
    """
    table = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("pattern"), F.lit(c).alias("category"), F.lit(float(s)).alias("severity"), F.lit(f or "").alias("flag")) for k, p, c, s, f in rules])

    def hits(theme: Column) -> Column:
        t = F.coalesce(theme, F.lit(""))
        code = lambda r: (r["kind"] == "code") & t.startswith(r["pattern"]) & (F.length(t) <= F.length(r["pattern"]) + 2)
        name = lambda r: (r["kind"] == "name") & F.contains(F.upper(t), r["pattern"])
        return F.filter(table, lambda r: code(r) | name(r))

    found = F.flatten(F.transform(F.coalesce(themes, F.array().cast("array<string>")), hits))
    flag = lambda name: F.exists(found, lambda r: r["flag"] == name)
    most = F.aggregate(found, F.lit(0.0), lambda a, r: F.greatest(a, r["severity"]))
    return F.struct(
        flag("has_conflict").alias("has_conflict"),
        flag("has_unrest").alias("has_unrest"),
        flag("has_diplomacy").alias("has_diplomacy"),
        F.when(most == 0.0, F.lit(params.BASE_SEVERITY)).otherwise(most).alias("max_severity"),
        F.array_distinct(F.transform(found, lambda r: r["category"])).alias("event_categories"),
    )


def locations(text: Column) -> Column:
    """array<struct<name,lat,lon,type,country_code>> of 'type#country#name#adm#lat#lon#..;...'; bad entries drop out."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.split(x, "#"))
    number = lambda x: F.when(x == "", F.lit(0.0)).otherwise(x.try_cast("double"))
    made = F.transform(
        F.filter(parts, lambda p: F.size(p) >= 6),
        lambda p: F.struct(p[2].alias("name"), number(p[4]).alias("lat"), number(p[5]).alias("lon"), F.when(p[0] == "", "unknown").otherwise(p[0]).alias("type"), p[1].alias("country_code")),
    )
    return F.filter(made, lambda x: x["lat"].isNotNull() & x["lon"].isNotNull())
