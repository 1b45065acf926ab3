"""Forecasts of monthly series: candidates, rolling origins, errors and choice. Series are few and short;
sums over the cells come first, and what no expression can say runs per series in Arrow batches (`functions/timeseries.py`)."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..binding import Star, kept
from ..functions import timeseries as ts
from ..functions.timeseries import Z80
from . import statistics
from .common import op
from .statistics import dm_statistic, t_tail

_SERIES = """, cube AS (SELECT month, CASE WHEN grouping(product) = 0 THEN 'product:' || product WHEN grouping(state) = 0 THEN 'state:' || state ELSE 'all' END AS series, CAST(sum(amount) AS DOUBLE) AS a FROM fct GROUP BY GROUPING SETS ((month), (month, product), (month, state))),
  ser AS (SELECT s.series, m.month, coalesce(c.a, 0) AS amount FROM (SELECT DISTINCT series FROM cube) s CROSS JOIN months m LEFT JOIN cube c ON c.series = s.series AND c.month = m.month)"""


def series(s: Star) -> DataFrame:
    """(series, month, amount): the country, each product and each state, a missing month being 0."""
    cells = s.fct.groupBy("month", "product", "state").agg(F.sum("amount").alias("a"))
    names = F.array(F.lit("all"), F.concat(F.lit("product:"), "product"), F.concat(F.lit("state:"), "state"))
    cube = kept(cells.select("month", F.explode(names).alias("series"), "a").groupBy("series", "month").agg(F.sum("a").cast("double").alias("a")))
    grid = cube.select("series").distinct().crossJoin(F.broadcast(s.months))
    return grid.join(cube, ["series", "month"], "left").select("series", "month", F.coalesce("a", F.lit(0.0)).alias("amount"))


op("fc_series", f"{_SERIES} SELECT series, month, amount FROM ser")(series)

_STEP = f"{_SERIES}, d AS (SELECT series, month, amount, amount - lag(amount) OVER (PARTITION BY series ORDER BY month) AS s1, amount - lag(amount, 12) OVER (PARTITION BY series ORDER BY month) AS s12, row_number() OVER (PARTITION BY series ORDER BY month DESC) AS back FROM ser), st AS (SELECT series, avg(s1) AS drift, stddev_samp(s1) AS dev, sqrt(avg(s1 * s1)) AS rms, count(s1) AS n, sqrt(avg(s12 * s12)) AS srms FROM d GROUP BY 1)"


def _steps(s: Star) -> DataFrame:
    w = Window.partitionBy("series").orderBy("month")
    d = series(s).withColumns({"s1": F.col("amount") - F.lag("amount").over(w), "s12": F.col("amount") - F.lag("amount", 12).over(w), "back": F.row_number().over(Window.partitionBy("series").orderBy(F.desc("month")))})
    return d


def _horizons(df: DataFrame) -> DataFrame:
    return df.withColumn("h", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))


@op("fc_naive", f"{_STEP} SELECT d.series, h, amount AS forecast, round(amount - {Z80} * rms * sqrt(h), 4) AS low, round(amount + {Z80} * rms * sqrt(h), 4) AS high FROM d JOIN st USING (series), (VALUES (1), (2), (3)) AS v(h) WHERE back = 1")
def fc_naive(s):
    last = _steps(s).groupBy("series").agg(F.max(F.struct("month", "amount"))["amount"].alias("a"), F.sqrt(F.avg(F.col("s1") * F.col("s1"))).alias("rms"))
    half = Z80 * F.col("rms") * F.sqrt("h")
    return _horizons(last).select("series", "h", F.col("a").alias("forecast"), F.round(F.col("a") - half, 4).alias("low"), F.round(F.col("a") + half, 4).alias("high"))


@op("fc_drift", f"{_STEP} SELECT d.series, h, round(amount + h * drift, 4) AS forecast, round(amount + h * drift - {Z80} * dev * sqrt(h * (1 + CAST(h AS DOUBLE) / n)), 4) AS low FROM d JOIN st USING (series), (VALUES (1), (2), (3)) AS v(h) WHERE back = 1")
def fc_drift(s):
    last = _steps(s).groupBy("series").agg(F.max(F.struct("month", "amount"))["amount"].alias("a"), F.avg("s1").alias("drift"), F.stddev_samp("s1").alias("dev"), F.count("s1").alias("n"))
    mid = F.col("a") + F.col("h") * F.col("drift")
    half = Z80 * F.col("dev") * F.sqrt(F.col("h") * (1 + F.col("h") / F.col("n")))
    return _horizons(last).select("series", "h", F.round(mid, 4).alias("forecast"), F.round(mid - half, 4).alias("low"))


@op("fc_seasonal_naive", f"{_STEP} SELECT d.series, h, amount AS forecast, round(amount - {Z80} * srms, 4) AS low FROM d JOIN st USING (series), (VALUES (1), (2), (3)) AS v(h) WHERE back = 13 - h")
def fc_seasonal_naive(s):
    d = _steps(s)
    spread = d.groupBy("series").agg(F.sqrt(F.avg(F.col("s12") * F.col("s12"))).alias("srms"))
    then = d.where("back BETWEEN 10 AND 12").select("series", (13 - F.col("back")).alias("h"), "amount")
    return then.join(spread, "series").select("series", "h", F.col("amount").alias("forecast"), F.round(F.col("amount") - Z80 * F.col("srms"), 4).alias("low"))


def monthly(s: Star) -> DataFrame:
    """(series, month, t, amount, rate): the series with the number of the month from 1 on and the policy rate at its end."""
    last = s.rates.groupBy(F.last_day("day").alias("month")).agg(F.max_by("rate", "day").alias("rate"))
    calendar = s.months.select("month", F.row_number().over(Window.orderBy("month")).alias("t")).join(last, "month", "left")
    return series(s).join(F.broadcast(calendar), "month")


def _rates(pdf: pd.DataFrame) -> np.ndarray:
    """The rate by month of one series in order; a month without one keeps the rate before."""
    return pdf["rate"].astype(float).ffill().fillna(0.0).to_numpy()


def _boosted_at(at: int | None):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="series", columns="t", values="amount").sort_index()
        calendar = pdf[pdf["series"] == wide.index[0]].sort_values("t")
        month = pd.to_datetime(calendar["month"]).dt.month.to_numpy()
        got = ts.boosted(wide.to_numpy(float), month, _rates(calendar), at)
        return pd.DataFrame({"series": wide.index, "origin": int(pdf["origin"].iloc[0]), "ahead": list(got)})

    return one


def _calendar(s: Star) -> tuple[int, int | None]:
    """The number of months, and how many lie before the break, if it is one of them."""
    at = F.lit(s.p.break_month).cast("date")
    size, before, hit = s.months.agg(F.count("*"), F.count_if(F.col("month") < at), F.count_if(F.col("month") == at)).first()
    return size, before if hit else None


def boosted(s: Star, rows: DataFrame, size: int, at: int | None) -> DataFrame:
    """(series, origin, ahead): the boosted model of all series, trained at every rolling origin and at the last month.

    An origin's group holds its months of every series: products and states times the calendar, which the facts don't grow.
    """
    known = [*range(ts.LEAST, size - 2), size]
    past = rows.withColumn("origin", F.explode(F.filter(F.array(*map(F.lit, known)), lambda o: o >= F.col("t"))))
    # Little data but much work a row: a given number of partitions keeps Spark from merging them.
    return past.repartition(len(known), "origin").groupBy("origin").applyInPandas(_boosted_at(at), "series string, origin int, ahead array<double>")


_FORECASTS = "series string, model string, origin int, h int, forecast double, low double, high double, actual double, step double"


def _forecaster(models: tuple[str, ...], at: int | None, first: int | None):
    def one(pdf: pd.DataFrame, trees: pd.DataFrame | None = None) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        y, rate = pdf["amount"].to_numpy(float), _rates(pdf)
        size = len(y)
        if size < ts.LEAST:
            return pd.DataFrame([], columns=[c.split()[0] for c in _FORECASTS.split(", ")])
        n = np.array([size] if first is None else [*range(first, size - 2), size])
        rows = ts.adjusted(y, n, at)
        got = {m: ts.scaled(m, rows, n, rate) for m in models if m in ts.MODELS}
        if trees is not None:
            trees = trees.sort_values("origin")
            known = trees["origin"].to_numpy()
            got["boosted"] = ts.boosted_bands(y, np.stack(trees["ahead"]), known)[np.searchsorted(known, n)]
        if "combination" in models:
            got["combination"] = np.mean([got[m] for m in ts.MEMBERS], axis=0)
        steps = np.array([np.mean(np.abs(np.diff(row[:k]))) for row, k in zip(rows, n)])
        part = [
            pd.DataFrame({"series": pdf["series"].iloc[0], "model": m, "origin": n, "h": h + 1, "forecast": f[:, 0, h], "low": f[:, 1, h], "high": f[:, 2, h], "actual": [y[k + h] if k + h < size else np.nan for k in n], "step": steps})
            for m, f in got.items() for h in range(3)
        ]
        return pd.concat(part)

    return one


def _send(s: Star) -> None:
    """Functions that run per series travel whole, with those they call, so executors need no copy of this package."""
    for module in (sys.modules[__name__], statistics, ts):
        cloudpickle.register_pickle_by_value(module)


def forecasts(s: Star, *models: str, first: int | None = None) -> DataFrame:
    """(series, model, origin, h, forecast, low, high, actual, step) of the named models: at the last month, or at every origin from `first` on too.

    `step` is the mean change of the training, by which errors are scaled; `actual` is NaN where the month hasn't come. A series of
    fewer than 13 months gives no row. Every model of one series is trained without the step at the break.
    """
    _send(s)
    size, at = _calendar(s)
    one = _forecaster(models, at, first)
    if "boosted" not in models:
        return monthly(s).groupBy("series").applyInPandas(lambda pdf: one(pdf), _FORECASTS)
    rows = kept(monthly(s))
    return rows.groupBy("series").cogroup(boosted(s, rows, size, at).groupBy("series")).applyInPandas(lambda pdf, trees: one(pdf, trees), _FORECASTS)


def _last(s: Star, model: str, *needs: str) -> DataFrame:
    return forecasts(s, model, *needs).where(F.col("model") == model).select("series", "model", "h", "forecast", "low", "high")


for _name, _model in (("theta", "theta"), ("ets_damped", "damped"), ("arima", "arima"), ("sarimax", "arima_rate"), ("prophet", "additive"), ("global_gbm", "boosted")):
    op(f"fc_{_name}")(lambda s, m=_model: _last(s, m))
op("fc_combine")(lambda s: _last(s, "combination", *ts.MEMBERS))


@op("fc_break_adjust", f"""{_SERIES}, d AS (SELECT series, month, amount, lag(amount) OVER w AS before, amount / nullif(lag(amount) OVER w, 0) - 1 AS change, row_number() OVER w AS t, count(*) OVER (PARTITION BY series) AS n FROM ser WINDOW w AS (PARTITION BY series ORDER BY month)),
  o AS (SELECT series, median(CASE WHEN month <> DATE '2000-01-31' THEN change END) AS usual, max(CASE WHEN month = DATE '2000-01-31' THEN change END) AS own, max(CASE WHEN month = DATE '2000-01-31' THEN before END) AS before, max(CASE WHEN month = DATE '2000-01-31' THEN t END) AS t, min(CASE WHEN t < n THEN amount END) AS least FROM d GROUP BY 1)
  SELECT d.series, d.month, round(CASE WHEN d.month < DATE '2000-01-31' AND o.t > 2 AND o.least > 0 THEN d.amount + (own - usual) * o.before ELSE d.amount END, 4) AS amount FROM d JOIN o USING (series)""")
def fc_break_adjust(s):
    """The months before the break are lifted by its step: that month's rate of change over the median of the others, times the level before.

    A series with a month without an amount, the last aside, or with fewer than two months before the break stays as it is.
    """
    at = F.col("month") == F.lit(s.p.break_month).cast("date")
    w = Window.partitionBy("series").orderBy("month")
    d = series(s).withColumns({"before": F.lag("amount").over(w), "t": F.row_number().over(w), "next": F.lead("amount").over(w)})
    d = d.withColumn("change", F.col("amount") / F.nullif("before", F.lit(0.0)) - 1)
    own = d.groupBy("series").agg(F.median(F.when(~at, F.col("change"))).alias("usual"), F.max(F.when(at, F.struct("change", "before", "t"))).alias("x"), F.min(F.when(F.col("next").isNotNull(), F.col("amount"))).alias("least"))
    lifts = (F.col("month") < F.lit(s.p.break_month).cast("date")) & (F.col("x.t") > 2) & (F.col("least") > 0)
    lifted = F.col("amount") + (F.col("x.change") - F.col("usual")) * F.col("x.before")
    return d.join(own, "series").select("series", "month", F.round(F.when(lifts, lifted).otherwise(F.col("amount")), 4).alias("amount"))


_PANEL = f"{_SERIES}, f AS (SELECT series, month, CASE WHEN amount > 0 THEN ln(amount) END AS y, month(month) AS month_no FROM ser), p AS (SELECT series, month, month_no, y, y - lag(y) OVER w AS d1, lag(y, 1) OVER w - lag(y, 2) OVER w AS d2 FROM f WINDOW w AS (PARTITION BY series ORDER BY month))"


def panel(s: Star) -> DataFrame:
    y = F.when(F.col("amount") > 0, F.log("amount"))
    w = Window.partitionBy("series").orderBy("month")
    f = series(s).select("series", "month", F.month("month").cast("bigint").alias("month_no"), y.alias("y"))
    return f.withColumns({"d1": F.col("y") - F.lag("y").over(w), "d2": F.lag("y", 1).over(w) - F.lag("y", 2).over(w)})


@op("fc_features_panel", f"{_PANEL} SELECT series, month, month_no, round(d1, 9) AS d1, round(d2, 9) AS d2 FROM p")
def fc_features_panel(s):
    return panel(s).select("series", "month", "month_no", F.round("d1", 9).alias("d1"), F.round("d2", 9).alias("d2"))


_ORIGINS = f"{_SERIES}, k AS (SELECT series, month, amount, row_number() OVER (PARTITION BY series ORDER BY month) AS t, count(*) OVER (PARTITION BY series) AS n FROM ser)"


def origins(s: Star) -> DataFrame:
    """(series, origin, h, last, drift, actual): rolling origins from 13 on, three steps ahead."""
    k = series(s).withColumn("t", F.row_number().over(Window.partitionBy("series").orderBy("month")))
    first = k.where("t = 1").select("series", F.col("amount").alias("first"))
    o = k.where("t >= 13").select("series", F.col("t").alias("origin"), F.col("amount").alias("last")).join(first, "series")
    ahead = k.select("series", F.col("t"), F.col("amount").alias("actual"))
    steps = _horizons(o).withColumn("t", F.col("origin") + F.col("h"))
    return steps.join(ahead, ["series", "t"]).select("series", "origin", "h", "last", ((F.col("last") - F.col("first")) / (F.col("origin") - 1)).alias("drift"), "actual")


@op("fc_origins", f"{_ORIGINS} SELECT a.series, CAST(a.t AS BIGINT) AS origin, CAST(h AS BIGINT) AS h, b.amount AS actual FROM k a, (VALUES (1), (2), (3)) AS v(h), k b WHERE a.t >= 13 AND b.series = a.series AND b.t = a.t + h")
def fc_origins(s):
    return origins(s).select("series", F.col("origin").cast("bigint").alias("origin"), F.col("h").cast("bigint").alias("h"), "actual")


_ERRORS = f"{_ORIGINS}, o AS (SELECT a.series, a.t AS origin, h, a.amount AS last, (a.amount - f.amount) / (a.t - 1) AS drift, b.amount AS actual FROM k a JOIN k f ON f.series = a.series AND f.t = 1 CROSS JOIN (VALUES (1), (2), (3)) AS v(h) JOIN k b ON b.series = a.series AND b.t = a.t + h WHERE a.t >= 13)"


@op("fc_bands_global", f"{_ERRORS}, q AS (SELECT h, quantile_cont(abs(actual - last - h * drift), 0.8) AS q FROM o GROUP BY 1) SELECT h, round(max(q) OVER (ORDER BY h ROWS UNBOUNDED PRECEDING), 4) AS band FROM q")
def fc_bands_global(s):
    """Widths from past errors; no width is less than that of a shorter horizon."""
    miss = F.abs(F.col("actual") - F.col("last") - F.col("h") * F.col("drift"))
    q = origins(s).groupBy("h").agg(F.percentile(miss, 0.8).alias("q"))
    return q.select("h", F.round(F.max("q").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, 0)), 4).alias("band"))


@op("fc_backtest_metrics", f"{_ERRORS} SELECT series, round(avg(abs(actual - last - h * drift)) / nullif(avg(abs(actual - last)), 0), 8) AS relative_error, round(100 * avg(abs(actual - last - h * drift) / nullif(actual, 0)), 6) AS mape, count(*) AS n FROM o GROUP BY 1")
def fc_backtest_metrics(s):
    miss = F.abs(F.col("actual") - F.col("last") - F.col("h") * F.col("drift"))
    base = F.nullif(F.avg(F.abs(F.col("actual") - F.col("last"))), F.lit(0.0))
    return origins(s).groupBy("series").agg(F.round(F.avg(miss) / base, 8).alias("relative_error"), F.round(100 * F.avg(miss / F.nullif("actual", F.lit(0.0))), 6).alias("mape"), F.count("*").alias("n"))


def backtest(s: Star) -> DataFrame:
    """(series, model, origin, h, scaled, relative, inside, score) of every candidate over all rolling origins from 13 on.

    The error over the mean change of its training, the error over the actual value, whether the band holds it, and the interval score over it.
    """
    f = forecasts(s, *ts.CANDIDATES, first=ts.LEAST).where(~F.isnan("actual"))
    miss, real = F.abs(F.col("actual") - F.col("forecast")), F.nullif(F.abs("actual"), F.lit(0.0))
    outside = F.greatest(F.col("low") - F.col("actual"), F.lit(0.0)) + F.greatest(F.col("actual") - F.col("high"), F.lit(0.0))
    score = F.col("high") - F.col("low") + 10 * outside
    return f.select("series", "model", "origin", "h", (miss / F.nullif("step", F.lit(0.0))).alias("scaled"), (miss / real).alias("relative"), F.col("actual").between(F.col("low"), F.col("high")).alias("inside"), (score / real).alias("score"))


@op("fc_backtest_all")
def fc_backtest_all(s):
    """Scaled error, relative error, coverage and interval score by series, candidate and step, over all origins."""
    means = [F.avg("scaled").alias("mase"), F.avg("relative").alias("mape"), F.avg(F.col("inside").cast("int")).alias("coverage"), F.avg("score").alias("score")]
    return backtest(s).groupBy("series", "model", "h").agg(*means)


def challenger_p(d: np.ndarray) -> float:
    """One-sided p-value that the challenger errs less; d is its error less the champion's by origin."""
    d = d[~np.isnan(d)]
    t = dm_statistic(-d, 3) if len(d) >= 3 else None
    if t is None:
        return 0.0 if len(d) and d.mean() < 0 else 1.0
    return t_tail(t, len(d) - 1)


def choose(wide: pd.DataFrame, level: float = 0.10) -> str:
    """The drift stays unless challengers beat it after Holm's correction; of those that do the least mean error wins, a tie the simpler one."""
    p = {m: challenger_p((wide[m] - wide["drift"]).to_numpy()) for m in ts.CANDIDATES if m != "drift"}
    better = ["drift"]
    for i, m in enumerate(sorted(p, key=p.get)):
        if p[m] > level / (len(p) - i):
            break
        better.append(m)
    return min(better, key=lambda m: (wide[m].mean(), ts.CANDIDATES.index(m)))


def _choose(pdf: pd.DataFrame) -> pd.DataFrame:
    wide = pdf.pivot(index="origin", columns="model", values="scaled").sort_index()
    best = choose(wide)
    return pd.DataFrame([(pdf["series"].iloc[0], best, float(wide[best].mean()), float(wide["drift"].mean()))], columns=["series", "chosen", "mase", "champion_mase"])


def _by_origin(s: Star) -> DataFrame:
    return backtest(s).groupBy("series", "model", "origin").agg(F.avg("scaled").alias("scaled"), F.avg("relative").alias("relative"))


op("fc_choose")(lambda s: _by_origin(s).groupBy("series").applyInPandas(_choose, "series string, chosen string, mase double, champion_mase double"))


def _honest(pdf: pd.DataFrame) -> pd.DataFrame:
    """At each of the last four origins the choice sees only origins that had ended by then; without one the drift stands."""
    wide, out = pdf.pivot(index="origin", columns="model", values="scaled").sort_index(), []
    for origin in wide.index[-4:]:
        past = wide[wide.index <= origin - 3]
        best = choose(past) if len(past) else "drift"
        out.append((pdf["series"].iloc[0], int(origin), best, float(pdf[(pdf["origin"] == origin) & (pdf["model"] == best)]["relative"].iloc[0])))
    return pd.DataFrame(out, columns=["series", "origin", "chosen", "mape"])


op("fc_honest_error")(lambda s: _by_origin(s).groupBy("series").applyInPandas(_honest, "series string, origin int, chosen string, mape double"))


@op("fc_output_tables", f"{_STEP} SELECT 'projection' AS kind, d.series, 'drift' AS model, h, round(amount + h * drift, 4) AS value FROM d JOIN st USING (series), (VALUES (1), (2), (3)) AS v(h) WHERE back = 1 UNION ALL SELECT 'projection', d.series, 'naive', h, round(amount, 4) FROM d, (VALUES (1), (2), (3)) AS v(h) WHERE back = 1")
def fc_output_tables(s):
    one = lambda df, m: df.select(F.lit("projection").alias("kind"), "series", F.lit(m).alias("model"), "h", F.round("forecast", 4).alias("value"))
    return one(fc_drift(s), "drift").unionAll(one(fc_naive(s), "naive"))
