"""Statistics of paired experiments, in column arithmetic; tails without a closed form in Python on the driver's few numbers."""

from __future__ import annotations

from math import comb, erfc, exp, gamma, lgamma, pi, sqrt
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..binding import Star
from .common import op
from .relational import by_month, by_state

Z95 = 1.959963984540054


def paired(s: Star) -> DataFrame:
    """(e, f, g, h): both true, only the first, only the second, neither."""
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return s.raw("labels").agg(F.count_if(q & t).alias("e"), F.count_if(q & ~t).alias("f"), F.count_if(~q & t).alias("g"), F.count_if(~q & ~t).alias("h"))


_PAIRED = ", p AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS e, count(*) FILTER (quality = 1 AND toxic <> 1) AS f, count(*) FILTER (quality <> 1 AND toxic = 1) AS g, count(*) FILTER (quality <> 1 AND toxic <> 1) AS h FROM labels)"
op("stat_paired_table", f"{_PAIRED} SELECT * FROM p")(paired)


def binomial_tail(k: int, n: int) -> float:
    """P(X >= k) for n fair coins, exactly summed."""
    return sum(comb(n, i) for i in range(k, n + 1)) / 2**n if n else 1.0


@op("stat_mcnemar_exact", f"""{_PAIRED}, t AS (SELECT f + g AS n, least(f, g) AS k FROM p)
  SELECT n, k, round(sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n * ln(2.0))), 9) AS p_value FROM t, generate_series(CAST(0 AS BIGINT), k) AS x(i) GROUP BY n, k""")
def stat_mcnemar_exact(s):
    """The lower binomial tail of the discordant pairs."""
    r = paired(s).first()
    n, k = r["f"] + r["g"], min(r["f"], r["g"])
    return s.spark.createDataFrame([(n, k, round(binomial_tail(n - k, n), 9))], "n long, k long, p_value double")


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    p, z2 = k / n, z * z
    mid, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return (mid - half) / (1 + z2 / n), (mid + half) / (1 + z2 / n)


@op("stat_wilson", f""", r AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS k FROM labels JOIN documents USING (doc_id) GROUP BY 1)
  SELECT lang, n, k, round((CAST(k AS DOUBLE) / n + {Z95 * Z95} / (2 * n) - {Z95} * sqrt(CAST(k AS DOUBLE) / n * (1 - CAST(k AS DOUBLE) / n) / n + {Z95 * Z95} / (4.0 * n * n))) / (1 + {Z95 * Z95} / n), 9) AS low,
  round((CAST(k AS DOUBLE) / n + {Z95 * Z95} / (2 * n) + {Z95} * sqrt(CAST(k AS DOUBLE) / n * (1 - CAST(k AS DOUBLE) / n) / n + {Z95 * Z95} / (4.0 * n * n))) / (1 + {Z95 * Z95} / n), 9) AS high FROM r""")
def stat_wilson(s):
    r = s.raw("labels").join(s.raw("documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return r.select("lang", "n", "k", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def phi(e: Column, f: Column, g: Column, h: Column) -> Column:
    """The continuity-corrected correlation of two paired outcomes; 0 where a margin is empty."""
    n, det = e + f + g + h, e * h - f * g
    raw = F.when(det > 0, F.greatest(det - n / 2, F.lit(0.0))).otherwise(det)
    margins = (e + f).cast("double") * (g + h) * (e + g) * (f + h)
    return F.when(margins == 0, 0.0).otherwise(raw / F.sqrt(margins))


_PHI = "CASE WHEN CAST(e + f AS DOUBLE) * (g + h) * (e + g) * (f + h) = 0 THEN 0 ELSE (CASE WHEN e * h - f * g > 0 THEN greatest(e * h - f * g - (e + f + g + h) / 2.0, 0) ELSE e * h - f * g END) / sqrt(CAST(e + f AS DOUBLE) * (g + h) * (e + g) * (f + h)) END"


@op("stat_phi", f"{_PAIRED} SELECT round({_PHI}, 9) AS phi FROM p")
def stat_phi(s):
    return paired(s).select(F.round(phi(*[F.col(c) for c in "efgh"]), 9).alias("phi"))


def _wilson_sql(k: str, n: str, sign: str) -> str:
    p = f"(CAST({k} AS DOUBLE) / {n})"
    return f"(({p} + {Z95 * Z95} / (2.0 * {n}) {sign} {Z95} * sqrt({p} * (1 - {p}) / {n} + {Z95 * Z95} / (4.0 * {n} * {n}))) / (1 + {Z95 * Z95} / {n}))"


@op("stat_newcombe", f"""{_PAIRED}, a AS (SELECT *, e + f + g + h AS n, {_PHI} AS phi FROM p), w AS (SELECT *, CAST(e + f AS DOUBLE) / n AS p1, CAST(e + g AS DOUBLE) / n AS p2,
  {_wilson_sql('(e + f)', 'n', '-')} AS l1, {_wilson_sql('(e + f)', 'n', '+')} AS u1, {_wilson_sql('(e + g)', 'n', '-')} AS l2, {_wilson_sql('(e + g)', 'n', '+')} AS u2 FROM a)
  SELECT round(p1 - p2, 9) AS difference, round(p1 - p2 - sqrt(power(p1 - l1, 2) - 2 * phi * (p1 - l1) * (u2 - p2) + power(u2 - p2, 2)), 9) AS low,
    round(p1 - p2 + sqrt(power(u1 - p1, 2) - 2 * phi * (u1 - p1) * (p2 - l2) + power(p2 - l2, 2)), 9) AS high FROM w""")
def stat_newcombe(s):
    """The interval of a paired difference, from two score intervals and their correlation."""
    e, f, g, h = (F.col(c) for c in "efgh")
    n = e + f + g + h
    w = paired(s).select((e + f).alias("k1"), (e + g).alias("k2"), n.alias("n"), phi(e, f, g, h).alias("phi"))
    n, r = F.col("n"), F.col("phi")
    p1, p2 = F.col("k1") / n, F.col("k2") / n
    (l1, u1), (l2, u2) = wilson(F.col("k1"), n), wilson(F.col("k2"), n)
    below = F.sqrt(F.pow(p1 - l1, 2) - 2 * r * (p1 - l1) * (u2 - p2) + F.pow(u2 - p2, 2))
    over = F.sqrt(F.pow(u1 - p1, 2) - 2 * r * (u1 - p1) * (p2 - l2) + F.pow(p2 - l2, 2))
    return w.select(F.round(p1 - p2, 9).alias("difference"), F.round(p1 - p2 - below, 9).alias("low"), F.round(p1 - p2 + over, 9).alias("high"))


def newcombe_low(e: int, f: int, g: int, h: int, z: float) -> float:
    n = e + f + g + h

    def bounds(k):
        p, z2 = k / n, z * z
        mid, half = p + z2 / (2 * n), z * sqrt(p * (1 - p) / n + z2 / (4 * n * n))
        return p, (mid - half) / (1 + z2 / n), (mid + half) / (1 + z2 / n)

    (p1, l1, _), (p2, _, u2) = bounds(e + f), bounds(e + g)
    det, margins = e * h - f * g, (e + f) * (g + h) * (e + g) * (f + h)
    r = 0.0 if not margins else (max(det - n / 2, 0) if det > 0 else det) / sqrt(margins)
    return p1 - p2 - sqrt(max(0.0, (p1 - l1) ** 2 - 2 * r * (p1 - l1) * (u2 - p2) + (u2 - p2) ** 2))


# The largest z of the search, its step, and how closely the crossing is found.
Z_MOST, Z_STEP, Z_CLOSE = 40.0, 0.01, 1e-12


def noninferiority_p(e: int, f: int, g: int, h: int, margin: float) -> float:
    """The smallest level from which on the one-sided interval stays above the margin: the first z, going up, at which
    its lower end reaches the margin. A grid finds the first step below it, so that an interval that comes back above for a
    larger z doesn't count; 1 where the difference itself is at or below the margin."""
    above = lambda z: newcombe_low(e, f, g, h, z) > margin
    if (f - g) / (e + f + g + h) <= margin:
        return 1.0
    steps = (k * Z_STEP for k in range(1, round(Z_MOST / Z_STEP) + 1))
    crossed = next((z for z in steps if not above(z)), None)
    if crossed is None:
        return NormalDist().cdf(-Z_MOST)
    low, high = crossed - Z_STEP, crossed
    while high - low > Z_CLOSE:
        z = (low + high) / 2
        low, high = (z, high) if above(z) else (low, z)
    return 1 - NormalDist().cdf((low + high) / 2)


@op("stat_noninferiority_p")
def stat_noninferiority_p(s):
    """The level at which the interval's lower end meets the margin; one row reaches the driver."""
    r, margin = paired(s).first(), -0.05
    return s.spark.createDataFrame([(margin, noninferiority_p(r["e"], r["f"], r["g"], r["h"], margin))], "margin double, p_value double")


def holm(df: DataFrame, p: str, order: list[str]) -> DataFrame:
    """df with Holm's step-down adjusted p values."""
    w = Window.orderBy(p, *order)
    m, k = F.count("*").over(Window.partitionBy()), F.row_number().over(w)
    return df.withColumn("adjusted", F.least(F.lit(1.0), F.max((m - k + 1) * F.col(p)).over(w.rowsBetween(Window.unboundedPreceding, 0))))


_PS = "(VALUES ('a', 0.01), ('b', 0.04), ('c', 0.03), ('d', 0.005)) AS v(name, p)"


@op("stat_holm", f", t AS (SELECT name, CAST(p AS DOUBLE) AS p FROM {_PS}), k AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS m FROM t) SELECT name, p, round(least(1.0, max((m - k + 1) * p) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING)), 9) AS adjusted FROM k")
def stat_holm(s):
    t = s.spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "name string, p double")
    return holm(t, "p", ["name"]).withColumn("adjusted", F.round("adjusted", 9))


def chi2_tail(x: float, df: int) -> float:
    """P(X > x), by the finite sums that hold for whole degrees of freedom."""
    if x <= 0:
        return 1.0
    if df % 2 == 0:
        return exp(-x / 2) * sum((x / 2) ** k / gamma(k + 1) for k in range(df // 2))
    total = erfc(sqrt(x / 2))
    return total + exp(-x / 2) * sum((x / 2) ** (k - 0.5) / gamma(k + 0.5) for k in range(1, (df - 1) // 2 + 1))


_RUNS = ", r AS (SELECT conv_id, max(CASE WHEN turn = 0 AND role = 'user' THEN 1 ELSE 0 END) AS a, max(CASE WHEN turn = 1 AND role = 'user' THEN 1 ELSE 0 END) AS b, max(CASE WHEN turn = 2 AND role = 'user' THEN 1 ELSE 0 END) AS c FROM conversations GROUP BY 1)"


def cochran(s: Star) -> DataFrame:
    """Q over three paired outcomes; null where no row differs."""
    hit = lambda t: F.max(F.when((F.col("turn") == t) & (F.col("role") == "user"), 1).otherwise(0))
    r = s.raw("conversations").groupBy("conv_id").agg(hit(0).alias("a"), hit(1).alias("b"), hit(2).alias("c"))
    row = F.col("a") + F.col("b") + F.col("c")
    t = r.agg(*[F.sum(c).alias(c) for c in "abc"], F.sum(row).alias("t"), F.sum(row * row).alias("rr"))
    squares = F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c")
    q = 2.0 * (3 * squares - F.col("t") * F.col("t")) / F.nullif((3 * F.col("t") - F.col("rr")).cast("double"), F.lit(0.0))
    return t.select(F.round(q, 9).alias("q"))


op("stat_cochran_q", f"{_RUNS}, t AS (SELECT CAST(sum(a) AS DOUBLE) AS a, CAST(sum(b) AS DOUBLE) AS b, CAST(sum(c) AS DOUBLE) AS c, CAST(sum(a + b + c) AS DOUBLE) AS t, CAST(sum((a + b + c) * (a + b + c)) AS DOUBLE) AS rr FROM r) SELECT round(2.0 * (3 * (a * a + b * b + c * c) - t * t) / nullif(3 * t - rr, 0), 9) AS q FROM t")(cochran)


@op("stat_cochran_p")
def stat_cochran_p(s):
    q = cochran(s).first()["q"]
    return s.spark.createDataFrame([(q, None if q is None else chi2_tail(q, 2))], "q double, p_value double")


def _label_pairs(s: Star) -> np.ndarray:
    """The four counts stand for all rows: permuting and resampling need no more."""
    return np.array(paired(s).first(), np.int64)


@op("stat_permutation")
def stat_permutation(s, rounds: int = 5000, seed: int = 11):
    """Under exchange of labels each discordant pair is a fair coin: binomial draws of the counts."""
    _, f, g, _ = _label_pairs(s)
    draws = np.random.default_rng(seed).binomial(f + g, 0.5, rounds)
    p = (1 + int((np.abs(2 * draws - (f + g)) >= abs(int(f - g))).sum())) / (rounds + 1)
    return s.spark.createDataFrame([(int(f - g), p)], "difference long, p_value double")


@op("stat_bootstrap")
def stat_bootstrap(s, rounds: int = 5000, seed: int = 11):
    """Percentile interval of the difference of two paired shares: resampling rows is a multinomial on four counts."""
    counts = _label_pairs(s)
    n = int(counts.sum())
    draws = np.random.default_rng(seed).multinomial(n, counts / n, rounds)
    d = (draws[:, 1] - draws[:, 2]) / n
    return s.spark.createDataFrame([(float((counts[1] - counts[2]) / n), *map(float, np.quantile(d, [0.025, 0.975])))], "difference double, low double, high double")


@op("stat_effect_by_type", "SELECT lang, round(avg(quality - toxic), 9) AS effect, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1 UNION ALL SELECT 'all', round(avg(quality - toxic), 9), count(*) FROM labels")
def stat_effect_by_type(s):
    d = F.round(F.avg(F.col("quality") - F.col("toxic")), 9).alias("effect")
    by = s.raw("labels").join(s.raw("documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(d, F.count("*").alias("n"))
    return by.unionAll(s.raw("labels").agg(d, F.count("*").alias("n")).select(F.lit("all"), "effect", "n"))


def dm_statistic(d: np.ndarray, h: int) -> float | None:
    """Diebold-Mariano of loss differences with h - 1 autocovariances and the small-sample factor; null without variance."""
    n, c = len(d), d - d.mean()
    variance = (c @ c + 2 * sum(c[k:] @ c[:-k] for k in range(1, h))) / n
    return None if variance <= 0 else float(d.mean() / sqrt(variance / n) * sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n))


def t_tail(t: float, df: int) -> float:
    """P(T > t), by Simpson's rule on the density."""
    c = exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi)
    x = np.linspace(0, abs(t), 2001)
    y = c * (1 + x * x / df) ** (-(df + 1) / 2)
    inside = float((y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (x[1] - x[0]) / 3)
    return 0.5 - inside if t > 0 else 0.5 + inside


_DM = ", g AS (SELECT month, CAST(sum(amount) AS DOUBLE) AS a FROM fct GROUP BY 1), e AS (SELECT month, abs(a - lag(a) OVER (ORDER BY month)) / 1000 - abs(a - lag(a, 12) OVER (ORDER BY month)) / 1000 AS d FROM g), c AS (SELECT d - avg(d) OVER () AS c, avg(d) OVER () AS m, count(d) OVER () AS n FROM e WHERE d IS NOT NULL)"


@op("stat_dm_test", f"{_DM} SELECT any_value(n) AS n, round(any_value(m) / sqrt(sum(c * c) / any_value(n) / any_value(n)) * sqrt((any_value(n) - 1.0) / any_value(n)), 6) AS statistic FROM c")
def stat_dm_test(s):
    """One step ahead, the last value against the value a year ago; the statistic as window and aggregate."""
    w = Window.orderBy("month")
    a = F.col("amount")
    e = by_month(s).select((F.abs(a - F.lag("amount").over(w)) / 1000 - F.abs(a - F.lag("amount", 12).over(w)) / 1000).alias("d")).where("d IS NOT NULL")
    t = e.agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.var_pop("d").alias("v"))
    n = F.col("n")
    return t.select("n", F.round(F.col("m") / F.sqrt(F.col("v") / n) * F.sqrt((n - 1.0) / n), 6).alias("statistic"))


def group_series(s: Star) -> DataFrame:
    return by_state(s).select("month", "state", "amount")
