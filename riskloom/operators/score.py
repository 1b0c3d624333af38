"""Risk scoring and attribution over long indicator tables: (series_key, date, indicator, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions import params
from riskloom.functions import text as T
from riskloom.functions.num import banded, clamp, rounded
from riskloom.operators.clean import tag_entities
from riskloom.session import small, stored


def weight_table(spark: SparkSession, weights: dict[str, float] = params.WEIGHTS, placeholders: tuple[str, ...] = params.PLACEHOLDERS) -> DataFrame:
    """(indicator, weight, placeholder). Weights that don't sum to 1 within 0.01 are refused."""
    if not weights or abs(sum(weights.values()) - 1) > 0.01:
        raise ValueError(f"weights sum to {sum(weights.values()) if weights else 0:.4f}, not 1")
    return spark.createDataFrame([(k, float(w), k in placeholders) for k, w in weights.items()], "indicator string, weight double, placeholder boolean")


def percentiles(history: DataFrame, by: tuple[str, ...] = ("series_key", "indicator"), value: str = "value", approximate: bool = False) -> DataFrame:
    """(by, p5, p95, n) of each group, interpolated; approximate for histories too long for one exact group."""
    shares = F.array(F.lit(0.05), F.lit(0.95))
    both = F.percentile_approx(value, shares, F.lit(10_000)) if approximate else F.percentile(value, shares)
    return history.groupBy(*by).agg(both.alias("__p"), F.count(value).alias("n")).select(*by, F.col("__p")[0].alias("p5"), F.col("__p")[1].alias("p95"), "n")


def percentile_sketches(history: DataFrame, by: tuple[str, ...] = ("series_key", "indicator"), day: str = "date", value: str = "value", k: int = 200) -> DataFrame:
    """(by, day, sketch): a KLL quantile sketch of each day's values, a few KB however many there are.

    Kept beside the history, they spare merged_percentiles() all rows of the days before. A rank is off by about
    2.3 / k ** 0.9 with 99 % confidence (1.65 % at 200, also after merges). Days without values have no row.
    """
    given = history.filter(F.col(value).isNotNull() & ~F.isnan(value))
    return given.groupBy(*by, day).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged_percentiles(sketches: DataFrame, by: tuple[str, ...] = ("series_key", "indicator"), k: int = 200) -> DataFrame:
    """(by, p5, p95, n) of all days' sketches: percentiles() from what is kept a day."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("__s"))
    at = lambda q: F.kll_sketch_get_quantile_double("__s", F.lit(q))
    return merged.select(*by, at(0.05).alias("p5"), at(0.95).alias("p95"), F.kll_sketch_get_n_double("__s").alias("n"))


def numeric_entries(details: Column) -> Column:
    """map<string,double> of the entries of a free-form map<string,string> that are numbers; others, nested ones too, drop out."""
    numbers = F.transform(F.map_entries(details), lambda x: F.struct(x["key"].alias("key"), x["value"].try_cast("double").alias("value")))
    return F.map_from_entries(F.filter(numbers, lambda x: x["value"].isNotNull() & ~F.isnan(x["value"])))


def normalize(values: DataFrame, bounds: DataFrame, by: tuple[str, ...] = ("series_key", "indicator"), value: str = "value", out: str = "value") -> DataFrame:
    """Min-max between the 5th and 95th percentile, 0.5 for an empty range; under five points the value itself, clamped."""
    span = F.col("p95") - F.col("p5")
    scaled = F.when(span < 1e-6, F.lit(0.5)).otherwise(clamp(F.try_divide(F.col(value) - F.col("p5"), span)))
    joined = values.join(bounds, list(by), "left")
    return joined.withColumn(out, rounded(F.when(F.coalesce("n", F.lit(0)) >= 5, scaled).otherwise(clamp(F.col(value))), 4)).drop("p5", "p95", "n")


def details(values: DataFrame, weights: DataFrame, by: tuple[str, ...] = ("series_key", "date")) -> DataFrame:
    """A row for each indicator: its used weight and contribution; placeholders at 0 or below, or null, give theirs to the others."""
    w = Window.partitionBy(*by)
    skipped = F.col("placeholder") & (F.coalesce("value", F.lit(0.0)) <= 0)
    valid = F.when(skipped, F.lit(0.0)).otherwise(F.col("weight"))
    df = values.join(weights, "indicator").withColumn("__valid", valid).withColumn("__total", F.sum("__valid").over(w)).withColumn("skipped", skipped)
    off = F.abs(F.col("__total") - 1) > 0.001
    used = F.when(F.col("__total") <= 0, F.col("weight")).when(off, F.try_divide("__valid", "__total")).otherwise(F.col("__valid"))
    v = clamp(F.coalesce("value", F.lit(0.0)))
    df = df.select(*by, "indicator", "skipped", v.alias("value"), used.alias("used_weight"), (v * used).alias("contribution"), ((F.col("__total") > 0) & off).alias("rebalanced"))
    return df


def risk_scores(values: DataFrame, weights: DataFrame, by: tuple[str, ...] = ("series_key", "date"), bands=params.RISK_BANDS) -> DataFrame:
    """(by, risk_score, risk_level, rebalanced): the weighted 0-100 score."""
    scored = details(values, weights, by).groupBy(*by).agg(rounded(F.sum("contribution") * 100, 2).alias("risk_score"), F.bool_or("rebalanced").alias("rebalanced"))
    return scored.select(*by, "risk_score", banded(F.col("risk_score"), bands).alias("risk_level"), "rebalanced")


def fuse(text: DataFrame, coded: DataFrame | None = None, external: DataFrame | None = None, by: tuple[str, ...] = ("series_key", "date")) -> DataFrame:
    """Raw indicators in long form from daily text metrics (conflict_frequency, sentiment_avg: positivity, n),
    coded-event metrics (conflict_frequency, avg_tone_risk, avg_severity) and external ones
    (nightlight_change, refugee_change). Days without news have none."""
    df = text.filter("n > 0").select(*by, F.col("conflict_frequency").alias("__c"), (1 - F.col("sentiment_avg")).alias("__s"))
    if coded is not None:
        df = df.join(coded.select(*by, F.col("conflict_frequency").alias("__ec"), F.col("avg_tone_risk").alias("__et"), F.col("avg_severity").alias("__ev")), list(by), "left")
    else:
        df = df.select("*", *[F.lit(None).cast("double").alias(c) for c in ("__ec", "__et", "__ev")])
    if external is not None:
        df = df.join(external.select(*by, "nightlight_change", "refugee_change"), list(by), "left")
    else:
        df = df.select("*", *[F.lit(None).cast("double").alias(c) for c in ("nightlight_change", "refugee_change")])
    coded_there = F.col("__ec").isNotNull()
    conflict = F.when(coded_there, 0.6 * F.col("__c") + 0.4 * F.col("__ec")).otherwise(F.col("__c"))
    negative = F.when(coded_there & F.col("__et").isNotNull(), 0.6 * F.col("__s") + 0.4 * F.col("__et")).otherwise(F.col("__s"))
    df = df.withColumn("__conflict", conflict).withColumn("__negative", negative)
    severity = F.when(coded_there & F.col("__ev").isNotNull(), F.col("__ev")).otherwise(F.col("__conflict") * 0.8 + F.col("__negative") * 0.2)
    pairs = [
        ("conflict_frequency", F.col("__conflict")),
        ("sentiment_avg", F.col("__negative")),
        ("nightlight_change", F.greatest(F.lit(0.0), -F.coalesce("nightlight_change", F.lit(0.0)))),
        ("refugee_change", F.coalesce("refugee_change", F.lit(0.0))),
        ("event_severity", severity),
    ]
    return df.select(*by, F.inline(F.array(*[F.struct(F.lit(k).alias("indicator"), c.alias("value")) for k, c in pairs])))


def single_text_indicators(has_conflict: Column, risk_sentiment: Column, event_frequency: Column | None = None, event_severity: Column | None = None) -> dict[str, Column]:
    """The indicators of one text: fixed values by its conflict flag, fused with event metrics where given."""
    conflict = F.when(has_conflict, 1.0).otherwise(0.2)
    severity = F.when(has_conflict, 0.8).otherwise(0.3)
    if event_frequency is not None:
        conflict = F.when(event_frequency.isNotNull(), 0.6 * conflict + 0.4 * event_frequency).otherwise(conflict)
    if event_severity is not None:
        severity = F.coalesce(event_severity, severity)
    return {"conflict_frequency": conflict, "sentiment_avg": risk_sentiment, "event_severity": severity}


def unpivot(df: DataFrame, by: tuple[str, ...], indicators: list[str]) -> DataFrame:
    """Indicator columns as rows; indicators without a column are 0."""
    pairs = [F.struct(F.lit(k).alias("indicator"), (F.col(k) if k in df.columns else F.lit(0.0)).cast("double").alias("value")) for k in indicators]
    return df.select(*by, F.inline(F.array(*pairs)))


def meta(column: str = "indicator", names: dict[str, str] = params.INDICATOR_NAMES) -> Column:
    """The display name of an indicator, itself if it has none."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.col(column)), F.col(column))


def drivers(detail: DataFrame, by: tuple[str, ...] = ("series_key", "date")) -> DataFrame:
    """(by, indicator, name, contribution, share, rank): shares of the total contribution, largest first; skipped ones are left out.

    Ties go by indicator name. The window holds one row an indicator, a handful.
    """
    total = F.sum("contribution").over(Window.partitionBy(*by))
    shared = detail.withColumn("__share", F.coalesce(F.try_divide("contribution", total), F.lit(0.0)) * 100).filter("NOT skipped")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(rounded(F.col("contribution"), 4)), "indicator"))
    return shared.select(*by, "indicator", meta().alias("name"), rounded(F.col("contribution"), 4).alias("contribution"), rounded(F.col("__share"), 2).alias("share"), rank.alias("rank"))


def attribution(detail: DataFrame, scores: DataFrame, by: tuple[str, ...] = ("series_key", "date")) -> DataFrame:
    """(by, risk_score, primary_driver, concentration, attribution_text): drivers, their Herfindahl index, and the sentence."""
    d = drivers(detail, by)
    picked = lambda n, c: F.max(F.when(F.col("rank") == n, F.col(c)))
    one = d.groupBy(*by).agg(picked(1, "name").alias("primary_driver"), picked(1, "indicator").alias("__top"), picked(1, "share").alias("__share1"), picked(2, "name").alias("__second"), picked(2, "share").alias("__share2"), rounded(F.sum(F.pow(F.col("share") / 100, 2)), 4).alias("concentration"))
    df = scores.join(one, list(by), "left")
    level = banded(F.col("risk_score"), ((70.0, "高"), (40.0, "中"), (float("-inf"), "低")))
    spread = F.when(F.col("concentration") > 0.5, "风险来源高度集中于单一因素，建议重点监测。").when(F.col("concentration") > 0.3, "风险由少数几个因素主导。").otherwise("风险来源较为分散，属多因素综合作用。")
    text = F.concat(
        F.lit("当前综合风险为"), level, F.lit("风险（"), _fixed("risk_score", 1), F.lit("分）。"),
        F.lit("最主要驱动因素是「"), F.col("primary_driver"), F.lit("」，贡献了 "), _fixed("__share1", 0), F.lit("% 的风险，"), meta("__top", params.INDICATOR_TEXTS), F.lit("。"),
        F.coalesce(F.concat(F.lit("其次为「"), F.col("__second"), F.lit("」（"), _fixed("__share2", 0), F.lit("%）。")), F.lit("")), spread,
    )
    return df.select(*by, "risk_score", "primary_driver", F.coalesce("concentration", F.lit(0.0)).alias("concentration"), F.coalesce(text, F.lit("无有效驱动指标。")).alias("attribution_text"))


def _fixed(column: str, places: int) -> Column:
    """A number with a fixed count of decimals, half up."""
    return F.round(F.col(column).cast("decimal(28,10)"), places).cast(f"decimal(28,{places})").cast("string")


def roll_up(results: DataFrame, key: str = "key", step: str = "step", result: str = "result") -> DataFrame:
    """(key, event_type, key_actors, risk_level, recommendations) of step results as JSON: a row for each key.

    Missing steps and fields are unknown or empty; the level goes by the event's severity once an impact is given.
    """
    of = lambda name: F.max(F.when(F.col(step) == name, F.nullif(F.trim(F.col(result)), F.lit("{}"))))
    one = results.groupBy(key).agg(of("event_identification").alias("__event"), of("impact_analysis").alias("__impact"), of("recommendation").alias("__advice"))
    words = lambda c, field: F.coalesce(F.from_json(F.get_json_object(c, f"$.{field}"), "array<string>"), F.array().cast("array<string>"))
    severity = F.coalesce(F.try_to_number(F.get_json_object("__event", "$.severity"), F.lit("9999")).cast("double"), F.lit(params.USUAL_SEVERITY))
    level = F.when(F.col("__impact").isNotNull(), banded(severity, params.ROLL_UP_BANDS)).otherwise(params.UNKNOWN)
    kind = F.coalesce(F.get_json_object("__event", "$.event_type"), F.lit(params.UNKNOWN))
    return one.select(key, kind.alias("event_type"), words("__event", "key_actors").alias("key_actors"), level.alias("risk_level"), words("__advice", "policy_recommendations").alias("recommendations"))


def analysis_records(docs: DataFrame, gazetteer: DataFrame, key: str = "doc_id", text: str = "text", weights: dict[str, float] = params.WEIGHTS, shown: int = 200) -> DataFrame:
    """A record of each text: its cleaned head, entities and event words, sentiment, score, alert level and attribution.

    (key, text, locations, organizations, persons, events, sentiment_score, risk_sentiment, sentiment_level, risk_score,
    risk_level, alert, primary_driver, concentration, attribution_text). The key must be unique. Texts are cleaned once and
    written; scores and attributions are worked out once for each flag and sentiment met, of which there are few.
    """
    clean = docs.select(key, T.clean_text(F.col(text)).alias("__t"))
    risk = T.risk_sentiment(T.lexicon_sentiment(F.col("__t")))
    flag = F.coalesce(T.contains_any(F.col("__t"), params.CONFLICT_WORDS_ZH + params.CONFLICT_WORDS_EN), F.lit(False))
    read = clean.select(key, "__t", F.concat(F.substring("__t", 1, shown), F.lit("...")).alias("text"), T.event_words(F.col("__t"), T.script_language(F.col("__t"))).alias("events"), flag.alias("__flag"), risk.alias("__s"))
    read = stored(read.withColumn("__case", F.concat_ws(" ", F.col("__flag").cast("string"), F.col("__s.risk_score").cast("string"))))
    ind = single_text_indicators(F.col("__flag"), F.col("__r"))
    cases = stored(read.groupBy("__case").agg(F.first("__flag").alias("__flag"), F.first("__s.risk_score").alias("__r")))
    values = unpivot(cases.select("__case", *[c.alias(k) for k, c in ind.items()]), ("__case",), list(weights))
    detail = details(values, weight_table(docs.sparkSession, weights), ("__case",))
    scores = risk_scores(values, weight_table(docs.sparkSession, weights), ("__case",))
    told = stored(scores.join(attribution(detail, scores, ("__case",)).drop("risk_score"), "__case"))
    tags = tag_entities(read.select(key, "__t"), gazetteer, key, "__t")
    out = read.drop("__t").join(tags, key).join(small(told), "__case")
    return out.select(key, "text", "locations", "organizations", "persons", "events", F.col("__s.sentiment_score").alias("sentiment_score"), F.col("__s.risk_score").alias("risk_sentiment"), F.col("__s.risk_level").alias("sentiment_level"), "risk_score", "risk_level", banded(F.col("risk_score"), params.ALERT_BANDS).alias("alert"), "primary_driver", "concentration", "attribution_text")


def change(current: DataFrame, previous: DataFrame, by: tuple[str, ...] = ("series_key",)) -> DataFrame:
    """(by, indicator, name, change, direction, rank) of contributions (by, indicator, contribution); unchanged ones drop out."""
    both = current.select(*by, "indicator", F.col("contribution").alias("__now")).join(previous.select(*by, "indicator", F.col("contribution").alias("__then")), [*by, "indicator"], "full")
    delta = F.coalesce("__now", F.lit(0.0)) - F.coalesce("__then", F.lit(0.0))
    out = both.withColumn("__d", delta).filter(F.abs("__d") >= 1e-6).withColumn("change", rounded(F.col("__d") * 100, 2))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.abs("change")), "indicator"))
    return out.select(*by, "indicator", meta().alias("name"), "change", F.when(F.col("__d") > 0, "上升").otherwise("下降").alias("direction"), rank.alias("rank"))


def change_text(delta: Column, name: Column, direction: Column, moved: Column) -> Column:
    """The sentence for a change of the score and its main driver (null: none)."""
    word = F.when(delta > 0, "上升").when(delta < 0, "下降").otherwise("持平")
    one = lambda c: F.round(c.cast("decimal(28,10)"), 1).cast("decimal(28,1)").cast("string")
    signed = F.concat(F.when(moved >= 0, "+").otherwise(""), one(moved))
    return F.coalesce(
        F.concat(F.lit("风险分较上期"), word, F.lit(" "), one(F.abs(delta)), F.lit(" 分，主要由「"), name, F.lit("」"), direction, F.lit("驱动（贡献变化 "), signed, F.lit(" 分）。")),
        F.concat(F.lit("风险分较上期基本"), word, F.lit("，无显著驱动因素变化。")),
    )


def half_means(history: DataFrame, indicators: list[str], n: int = 14, by: str = "series_key", order: tuple[str, ...] = ("date",)) -> DataFrame:
    """(by, half, rows, score, one mean an indicator, first, last): the older and recent half of each series' last n rows."""
    back = F.row_number().over(Window.partitionBy(by).orderBy(*[F.desc(c) for c in order]))
    tail = history.withColumn("__back", back).filter(F.col("__back") <= n)
    rows = F.count(F.lit(1)).over(Window.partitionBy(by))
    halves = tail.withColumn("__rows", rows).filter("__rows >= 4").withColumn("half", F.when(F.col("__back") > F.col("__rows") - F.floor(F.col("__rows") / 2), "older").otherwise("recent"))
    means = [(F.sum(F.coalesce(F.col(k), F.lit(0.0))) / F.count(F.lit(1))).alias(k) for k in indicators]
    return halves.groupBy(by, "half").agg(F.count(F.lit(1)).alias("rows"), F.avg("risk_score").alias("score"), *means, F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def history_change(history: DataFrame, weights: dict[str, float] = params.WEIGHTS, n: int = 14, by: str = "series_key") -> DataFrame:
    """(by, current_score, previous_score, delta, trend, main_change, change_text, older_period, recent_period)."""
    halves = half_means(history, list(weights), n, by)
    contribution = lambda half: halves.filter(F.col("half") == half).select(by, F.inline(F.array(*[F.struct(F.lit(k).alias("indicator"), (F.col(k) * w).alias("contribution")) for k, w in weights.items()])))
    main = change(contribution("recent"), contribution("older"), (by,)).filter("rank = 1")
    period = F.concat_ws(" ~ ", F.col("first").cast("string"), F.col("last").cast("string"))
    side = lambda half, out: F.max(F.when(F.col("half") == half, out))
    wide = halves.groupBy(by).agg(side("recent", F.col("score")).alias("__now"), side("older", F.col("score")).alias("__then"), side("older", period).alias("older_period"), side("recent", period).alias("recent_period"))
    df = wide.join(main.select(by, F.col("name").alias("main_change"), "direction", F.col("change").alias("__moved")), by, "left").withColumn("delta", rounded(F.col("__now") - F.col("__then"), 2))
    return df.select(by, rounded(F.col("__now"), 4).alias("current_score"), rounded(F.col("__then"), 4).alias("previous_score"), "delta", F.when(F.col("delta") > 0, "上升").when(F.col("delta") < 0, "下降").otherwise("持平").alias("trend"), "main_change", change_text(F.col("delta"), F.col("main_change"), F.col("direction"), F.col("__moved")).alias("change_text"), "older_period", "recent_period")


def activity_proxy(access: Column, loss: Column) -> Column:
    """Activity of 0..1 from an access and a loss percentage; 0.5 without access."""
    a = F.when(access.isNotNull(), clamp(0.1 + 0.8 * access / 100, 0.05, 0.95)).otherwise(0.5)
    return rounded(F.when(loss.isNotNull(), 0.7 * a + 0.3 * clamp((25 - loss) / 20)).otherwise(a), 4)


def macro_norms(growth: Column, per_capita: Column, inflation: Column, trade: Column) -> dict[str, Column]:
    """Macro indicators as 0..1."""
    return {
        "gdp_growth_norm": rounded(clamp((growth + 10) / 25), 4),
        "gdp_per_capita_norm": rounded(clamp(per_capita / 2000), 4),
        "inflation_norm": rounded(clamp((30 - inflation) / 35), 4),
        "trade_change_norm": rounded(clamp(trade / 100), 4),
    }


def displacement(growth: Column, inflation: Column) -> Column:
    """Displacement of 0..1 from growth (null: 0) and inflation (null: 10)."""
    g, i = F.coalesce(growth, F.lit(0.0)), F.coalesce(inflation, F.lit(10.0))
    distress = F.when(g < 0, 0.6 * F.least(F.lit(1.0), F.abs(g) / 10)).when(g < 3, 0.3).otherwise(0.0) + F.when(i > 15, 0.4 * F.least(F.lit(1.0), (i - 15) / 20)).when(i > 8, 0.2).otherwise(0.0)
    return rounded(clamp(0.6 + 0.4 * F.least(F.lit(1.0), distress)), 4)


def place_multiplier(score: Column, border: Column) -> Column:
    """A base score for a place: 1.3 times at a border, 100 at most, else 0.8 times."""
    return F.when(border, F.least(score * 1.3, F.lit(100.0))).otherwise(score * 0.8)
