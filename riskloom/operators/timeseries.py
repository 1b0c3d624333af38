"""Time series operators. A series is the rows of one `series_key`, ordered by `date`.

All windows of one frame partition by the series and order by its date, so Spark plans one shuffle for
them; nothing is partitioned by a constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.num import clamp, rounded

BY, DATE, SCORE = "series_key", "date", "score"


def _w() -> Window:
    return Window.partitionBy(BY).orderBy(DATE)


def indexed(df: DataFrame) -> DataFrame:
    """df, its row index within the series (idx, from 0) and the series' length (n)."""
    return df.withColumn("idx", F.row_number().over(_w()) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(BY)))


def last_rows(df: DataFrame, n: int) -> DataFrame:
    """The last n rows of each series."""
    back = F.row_number().over(Window.partitionBy(BY).orderBy(F.desc(DATE)))
    return df.withColumn("__back", back).filter(F.col("__back") <= n).drop("__back")


def moving_average(df: DataFrame, window: int = 7, out: str = "ma") -> DataFrame:
    """The mean of the last `window` rows, for rows with as many."""
    x = indexed(df)
    return x.withColumn(out, rounded(F.avg(SCORE).over(_w().rowsBetween(1 - window, 0)), 4)).filter(F.col("idx") >= window - 1).drop("idx", "n")


def weighted_moving_average(df: DataFrame, window: int = 7, out: str = "wma") -> DataFrame:
    """The mean of the last `window` rows with weights 1 to window, for rows with as many."""
    total = sum((F.lag(SCORE, k).over(_w()) * (window - k) for k in range(1, window)), F.col(SCORE) * window)
    return indexed(df).withColumn(out, rounded(total / (window * (window + 1) / 2), 4)).filter(F.col("idx") >= window - 1).drop("idx", "n")


def decompose(df: DataFrame, period: int = 7) -> DataFrame:
    """df with trend, seasonal and residual. Under two periods the trend is the score and the rest 0.

    The trend is the moving average, moved to its window's middle. Before it the first row's score stands,
    but the row right before the first average takes that; behind it the last average stands.
    """
    w, all_ = _w(), Window.partitionBy(BY)
    x = indexed(df).withColumn("__ma", rounded(F.avg(SCORE).over(w.rowsBetween(1 - period, 0)), 4))
    offset = (period - 1) // 2
    shift = period - 1 - offset  # the average of window i - period + 1..i stands at i - shift
    x = x.withColumn("__at", F.when(F.col("idx") + shift < F.col("n"), F.lead("__ma", shift).over(w)))
    x = x.withColumn("__at", F.when(F.col("idx") >= offset, F.col("__at")))
    last = F.last("__at", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    head = F.first(SCORE).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ordered_first = F.first("__at", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    trend = F.coalesce(F.col("__at"), F.when(F.col("idx") == offset - 1, ordered_first).when(F.col("idx") < offset, head).otherwise(last))
    x = x.withColumn("__trend", trend).withColumn("__d", F.col(SCORE) - F.col("__trend"))
    x = x.withColumn("__season", F.avg("__d").over(Window.partitionBy(BY, F.col("idx") % period)))
    x = x.withColumn("__season", F.col("__season") - F.avg("__season").over(all_))
    enough = F.col("n") >= 2 * period
    zero = F.lit(0.0)
    return x.select(
        *df.columns,
        rounded(F.when(enough, F.col("__trend")).otherwise(F.col(SCORE)), 4).alias("trend"),
        rounded(F.when(enough, F.col("__season")).otherwise(zero), 4).alias("seasonal"),
        rounded(F.when(enough, F.col(SCORE) - F.col("__trend") - F.col("__season")).otherwise(zero), 4).alias("residual"),
    )


def anomalies(df: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Rows whose |z| by the population deviation passes the threshold: idx, date, score, z, kind. Three rows at least."""
    all_ = Window.partitionBy(BY)
    x = indexed(df).withColumn("__s", F.stddev_pop(SCORE).over(all_)).withColumn("__z", F.try_divide(F.col(SCORE) - F.avg(SCORE).over(all_), F.col("__s")))
    x = x.filter((F.col("n") >= 3) & (F.col("__s") > 0) & (F.abs("__z") > threshold))
    return x.select(BY, DATE, F.col("idx").cast("long").alias("idx"), SCORE, rounded(F.col("__z"), 4).alias("z"), F.when(F.col("__z") > 0, "peak").otherwise("trough").alias("kind"))


def _line(x: DataFrame) -> DataFrame:
    """(series, n, slope, intercept, r2) of score over idx, by sums; constants have slope 0 and r2 0."""
    s = x.groupBy(BY).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("idx").cast("double")).alias("sx"), F.sum(SCORE).alias("sy"), F.sum(F.col("idx") * F.col(SCORE)).alias("sxy"),
        F.sum((F.col("idx") * F.col("idx")).cast("double")).alias("sxx"), F.regr_r2(F.col(SCORE), F.col("idx").cast("double")).alias("r2"), F.stddev_pop(SCORE).alias("sd"),
    )
    slope = F.coalesce(F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")), F.lit(0.0))
    s = s.withColumn("slope", slope)
    return s.select(BY, "n", "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"), F.when(F.col("sd") > 0, F.coalesce("r2", F.lit(0.0))).otherwise(0.0).alias("r2"))


def regression(df: DataFrame, least: int = 14, cut: float = 0.005) -> DataFrame:
    """(series, n, slope, intercept, r_squared, trend): 上升, 下降 or 平稳 by the slope; 数据不足 under `least` rows."""
    x = _line(indexed(df).drop("n"))
    enough = F.col("n") >= least
    trend = F.when(~enough, "数据不足").when(F.col("slope") > cut, "上升").when(F.col("slope") < -cut, "下降").otherwise("平稳")
    held = lambda c, places: rounded(F.when(enough, F.col(c)).otherwise(0.0), places)
    return x.select(BY, F.col("n").cast("long").alias("n"), held("slope", 6).alias("slope"), held("intercept", 4).alias("intercept"), held("r2", 4).alias("r_squared"), trend.alias("trend"))


def forecast(df: DataFrame, ahead: int = 7, window: int = 14) -> DataFrame:
    """(series, step, forecast, slope, r_squared, confidence): a line through the last rows carried on, in 0..100.

    Under three rows the last score stands.
    """
    tail = last_rows(df, window)
    line = _line(indexed(tail).drop("n"))
    last = tail.groupBy(BY).agg(F.max_by(SCORE, DATE).alias("last"))
    x = line.join(last, BY).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(ahead))))
    few = F.col("n") < 3
    pred = clamp(rounded(F.col("slope") * (F.col("n") - 1 + F.col("step")) + F.col("intercept"), 2), 0.0, 100.0)
    confidence = F.when(~few & (F.col("r2") > 0.7), "高").when(~few & (F.col("r2") > 0.4), "中").otherwise("低")
    return x.select(BY, "step", F.when(few, rounded(F.col("last"), 2)).otherwise(pred).alias("forecast"), F.when(few, 0.0).otherwise(rounded(F.col("slope"), 6)).alias("slope"), F.when(few, 0.0).otherwise(rounded(F.col("r2"), 4)).alias("r_squared"), confidence.alias("confidence"))


def fill_missing(df: DataFrame, out: str = "filled", linear: bool = False) -> DataFrame:
    """Null and 0 take the score before; before any there is 0, but a null first row takes what the second has.

    linear: instead the line between the known neighbours, the nearest beyond the ends.
    """
    w = _w()
    known = F.nullif(F.col(SCORE), F.lit(0.0))
    if linear:
        x = indexed(df).withColumn("__k", known).withColumn("__ki", F.when(F.col("__k").isNotNull(), F.col("idx")))
        back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
        a, ai, b, bi = F.last("__k", True).over(back), F.last("__ki", True).over(back), F.first("__k", True).over(ahead), F.first("__ki", True).over(ahead)
        return x.withColumn(out, rounded(F.coalesce(F.col("__k"), a + (b - a) * F.try_divide(F.col("idx") - ai, bi - ai), a, b), 2)).drop("__k", "__ki", "idx", "n")
    x = indexed(df).withColumn("__f", F.coalesce(F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    first = F.when((F.col("idx") == 0) & F.col(SCORE).isNull(), F.coalesce(F.lead("__f").over(w), F.lit(None)))
    x = x.withColumn("__g", F.coalesce(first, F.col("__f")))
    return x.withColumn(out, rounded(F.col("__g"), 2)).drop("__f", "__g", "idx", "n")


def month_spine(series: DataFrame, start: Column, end: Column) -> DataFrame:
    """(series_key, month) for every month from start to end."""
    return series.select(BY, F.explode(F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))).alias("month"))


def month_change(df: DataFrame, value: str, out: str) -> DataFrame:
    """The change of a monthly value to the month before, 0 without one."""
    before = F.lag(value).over(Window.partitionBy(BY).orderBy("month"))
    return df.withColumn(out, rounded(F.coalesce(F.col(value) - before, F.lit(0.0)), 4))


def annual_to_monthly(df: DataFrame, value: str = "value", year: str = "year") -> DataFrame:
    """(series, month, value): months between consecutive known years on the line between them, as clamp(0.1 + 0.8 v / 100)."""
    w = Window.partitionBy(BY).orderBy(year)
    x = df.withColumn("__next", F.lead(value).over(w)).filter(F.col("__next").isNotNull()).withColumn("__m", F.explode(F.sequence(F.lit(1), F.lit(12))))
    v = F.col(value) + (F.col("__m") - 1) / F.lit(12.0) * (F.col("__next") - F.col(value))
    return x.select(BY, F.make_date(F.col(year), F.col("__m"), F.lit(1)).alias("month"), rounded(clamp(0.1 + 0.8 * v / 100, 0.05, 0.95), 4).alias("value"))


def half_trend(df: DataFrame, k: int = 7, by: float = 5.0) -> DataFrame:
    """(series, first_avg, last_avg, trend): the first k rows against the last k."""
    x = indexed(df)
    head, tail = F.avg(F.when(F.col("idx") < k, F.col(SCORE))), F.avg(F.when(F.col("idx") >= F.col("n") - k, F.col(SCORE)))
    g = x.groupBy(BY).agg(F.max("n").alias("n"), head.alias("a"), tail.alias("b"))
    word = F.when(F.col("n") < k, "数据不足，无法判断趋势").when(F.col("b") > F.col("a") + by, "近期风险呈上升趋势").when(F.col("b") < F.col("a") - by, "近期风险呈下降趋势").otherwise("近期风险相对平稳")
    return g.select(BY, rounded(F.col("a"), 4).alias("first_avg"), rounded(F.col("b"), 4).alias("last_avg"), word.alias("trend"))


def summary(df: DataFrame) -> DataFrame:
    """(series, latest, mean, n)."""
    return df.groupBy(BY).agg(F.max_by(SCORE, DATE).alias("latest"), rounded(F.avg(SCORE), 4).alias("mean"), F.count(F.lit(1)).alias("n"))


def chart_frame(df: DataFrame, window: int = 7, ahead: int = 7) -> DataFrame:
    """(series, date, kind, score, ma): actual rows with their moving average, a bridge at the last, then the forecast."""
    ma = moving_average(df, window).select(BY, DATE, "ma")
    actual = df.select(BY, DATE, SCORE).join(ma, [BY, DATE], "left")
    last = df.groupBy(BY).agg(F.max(DATE).alias("__last"), F.max_by(SCORE, DATE).alias("__score"))
    bridge = last.select(BY, F.col("__last").alias(DATE), F.lit("bridge").alias("kind"), F.col("__score").alias(SCORE), F.lit(None).cast("double").alias("ma"))
    ahead_rows = forecast(df, ahead).join(last, BY).select(BY, F.date_add("__last", F.col("step")).alias(DATE), F.lit("forecast").alias("kind"), F.col("forecast").alias(SCORE), F.lit(None).cast("double").alias("ma"))
    return actual.select(BY, DATE, F.lit("actual").alias("kind"), SCORE, "ma").unionByName(bridge).unionByName(ahead_rows)
