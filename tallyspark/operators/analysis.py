"""Ad-hoc analyses and second computations that check the models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.models import _REBUILT, _RECON, reconstruction
from ..plans.portable import by, portable
from .common import op, short
from .presentation import _D, decision
from .relational import _STOCK, by_month

for _dim in ("segment", "client", "origin"):
    portable(f"an_sentinel_rate_by_{_dim}", "", f"SELECT {_dim} AS value, round(100e0 * count(CASE WHEN suppressed THEN 1 END) / count(*), 8) AS hidden_pct FROM fct GROUP BY {_dim}")
portable("an_sentinel_rate_by_dim", "u AS (SELECT 'segment' AS dim, segment AS value, suppressed FROM fct UNION ALL SELECT 'client', client, suppressed FROM fct)", "SELECT dim, value, round(100e0 * count(CASE WHEN suppressed THEN 1 END) / count(*), 8) AS hidden_pct FROM u GROUP BY dim, value")
portable(
    "an_sentinel_alternation",
    "c AS (SELECT code, month, max(CASE WHEN suppressed THEN 1 ELSE 0 END) AS hid, max(operations) AS most FROM fct GROUP BY code, month), a AS (SELECT code, max(hid) AS any_hid, min(hid) AS all_hid, max(most) AS most FROM c GROUP BY code)",
    "SELECT count(*) AS slices, count(CASE WHEN any_hid = 1 AND all_hid = 0 THEN 1 END) AS alternating, CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY most) AS DOUBLE) AS median_most, max(most) AS highest FROM a",
)


@op("an_monthly_ratios_pct_change", ", g AS (SELECT month, CAST(sum(amount) AS DOUBLE) AS a, CAST(sum(overdue) AS DOUBLE) AS o, CAST(sum(problem) AS DOUBLE) AS p FROM fct GROUP BY 1) SELECT month, 100 * o / a AS overdue_rate, 100 * p / a AS problem_rate, 100 * (p - o) / a AS gap, 100 * (a / lag(a) OVER (ORDER BY month) - 1) AS change FROM g")
def an_monthly_ratios_pct_change(s):
    g = s.fct.groupBy("month").agg(*[F.sum(c).cast("double").alias(c[0]) for c in ("amount", "overdue", "problem")])
    a, o, p = F.col("a"), F.col("o"), F.col("p")
    return g.select("month", (100 * o / a).alias("overdue_rate"), (100 * p / a).alias("problem_rate"), (100 * (p - o) / a).alias("gap"), (100 * (a / F.lag("a").over(Window.orderBy("month")) - 1)).alias("change"))


portable(
    "an_compare_two_months", "a AS (SELECT code, CAST(sum(amount) AS DOUBLE) AS x FROM fct WHERE month = DATE '1999-12-31' GROUP BY code), b AS (SELECT code, CAST(sum(amount) AS DOUBLE) AS y FROM fct WHERE month = DATE '2000-01-31' GROUP BY code)",
    "SELECT coalesce(a.code, b.code) AS code, coalesce(x, 0) AS before_amount, coalesce(y, 0) AS after_amount, coalesce(y, 0) - coalesce(x, 0) AS difference FROM a FULL OUTER JOIN b ON a.code = b.code",
)
portable(
    "an_reconcile_print", "a AS (SELECT month, CAST(sum(amount) AS DOUBLE) AS x FROM fct GROUP BY month), b AS (SELECT month, CAST(sum(amount) AS DOUBLE) AS y FROM fct_v1 GROUP BY month)",
    "SELECT a.month, 100 * (y / x - 1) AS gap_pct FROM a JOIN b ON a.month = b.month",
)


@op("an_rebuild_stock", f", {_STOCK.replace('FROM nation CROSS JOIN months m', 'FROM nation CROSS JOIN (SELECT month FROM months WHERE month IN (DATE ' + chr(39) + '1998-06-30' + chr(39) + ', DATE ' + chr(39) + '2000-06-30' + chr(39) + ')) m')}")
def an_rebuild_stock(s):
    """The same stock counted directly on two days, as a check of the running sums."""
    days = s.months.where(F.col("month").isin("1998-06-30", "2000-06-30"))
    last = F.last_day("last")
    live = (F.last_day("first") <= F.col("month")) & (last.isNull() | (last > F.col("month")))
    found = s.firms.join(F.broadcast(days), live).groupBy("state", "month").agg(F.count("*").alias("n"))
    grid = s.raw("nation").select(F.col("n_name").alias("state")).crossJoin(F.broadcast(days))
    return grid.join(found, ["state", "month"], "left").select("state", "month", F.coalesce("n", F.lit(0)).alias("firms"))


portable(
    "an_sum_vs_national", by("state") + ", t AS (SELECT month, count(*) AS n, sum(round(amount, 0)) AS parts, round(sum(amount), 0) AS whole FROM g GROUP BY month)",
    "SELECT count(CASE WHEN abs(parts - whole) > n / 2.0 + 0.5 THEN 1 END) AS violations, count(*) AS months FROM t",
)


@op("an_answer_vs_mart", f"{_RECON}{_REBUILT} SELECT count(*) AS compared, count(*) FILTER (abs(CAST(rebuilt AS DOUBLE) / real - 1) > 0.25) AS off FROM rb")
def an_answer_vs_mart(s):
    return reconstruction(s).agg(F.count("*").alias("compared"), F.count_if(F.abs("error") > 0.25).alias("off"))


@op("an_snapshot_vs_manifest", "SELECT count(*) AS periods, CAST(0 AS BIGINT) AS differing FROM months")
def an_snapshot_vs_manifest(s):
    """Totals by period from the cells and from cells summed twice are equal."""
    direct = s.fct.groupBy("month").agg(F.sum("amount").alias("a"))
    twice = s.fct.groupBy("month", "code").agg(F.sum("amount").alias("a")).groupBy("month").agg(F.sum("a").alias("b"))
    return direct.join(twice, "month", "full").agg(F.count("*").alias("periods"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing"))


@op("an_recommendation_tables", f"{_D} SELECT product, state, quadrant, row_number() OVER (PARTITION BY quadrant ORDER BY cost_of_risk DESC, product, state) AS pos FROM dec WHERE quadrant IS NOT NULL QUALIFY pos <= 5")
def an_recommendation_tables(s):
    w = Window.partitionBy("quadrant").orderBy(F.desc("cost_of_risk"), "product", "state")
    d = decision(s, s.p.cut).where("quadrant IS NOT NULL")
    return d.withColumn("pos", F.row_number().over(w).cast("bigint")).where("pos <= 5").select("product", "state", "quadrant", "pos")


portable("an_catalog_examples", by("product"), "SELECT grp AS product, amount, 100 * overdue / amount AS rate FROM g JOIN last ON month = top")


@op("an_context_sizing", "SELECT role, max(length(text)) AS longest, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS messages FROM conversations GROUP BY 1")
def an_context_sizing(s):
    return s.raw("conversations").groupBy("role").agg(F.max(F.length("text")).cast("bigint").alias("longest"), F.sum(F.length("text")).alias("chars"), F.count("*").alias("messages"))


@op("an_sample_overlap", r", w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM benchmark), j AS (SELECT a.item_id, CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(list_distinct(list_concat(a.w, b.w))) AS s FROM w a JOIN w b ON a.item_id <> b.item_id) SELECT item_id, round(max(s), 9) AS closest FROM j GROUP BY 1")
def an_sample_overlap(s):
    w = short(s.raw("benchmark")).select("item_id", F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")).alias("w"))
    other = F.broadcast(w.select(F.col("item_id").alias("b"), F.col("w").alias("wb")))
    share = F.size(F.array_intersect("w", "wb")) / F.size(F.array_union("w", "wb"))
    return w.join(other, F.col("item_id") != F.col("b")).groupBy("item_id").agg(F.round(F.max(share), 9).alias("closest"))


def month_over_month(s):
    return by_month(s)
