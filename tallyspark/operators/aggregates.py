"""Aggregations and window functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as fn
from .common import op
from .relational import by_month, by_state

_MONTHS = "g AS (SELECT month, CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(overdue) AS DOUBLE) AS overdue FROM fct GROUP BY 1)"
_STATES = "g AS (SELECT month, state, CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(overdue) AS DOUBLE) AS overdue FROM fct GROUP BY 1, 2)"


@op("agg_group_sum", "SELECT month, state, client, product, origin, CAST(sum(amount) AS DOUBLE) AS amount FROM fct GROUP BY ALL")
def agg_group_sum(s):
    return s.fct.groupBy("month", "state", "client", "product", "origin").agg(F.sum("amount").cast("double").alias("amount"))


@op("agg_ratio_of_sums", "SELECT product, CAST(sum(overdue) AS DOUBLE) / CAST(sum(amount) AS DOUBLE) AS rate FROM fct GROUP BY 1")
def agg_ratio_of_sums(s):
    return s.fct.groupBy("product").agg(fn.ratio(F.sum("overdue"), F.sum("amount")).alias("rate"))


@op("agg_conditional_sum", "SELECT code, CAST(sum(CASE WHEN state = 'NATION_1' AND client = 'PJ' AND origin = 'R' THEN amount END) AS DOUBLE) AS kept_null, CAST(sum(CASE WHEN state = 'NATION_1' AND client = 'PJ' AND origin = 'R' THEN amount ELSE 0 END) AS DOUBLE) AS zero FROM fct GROUP BY 1")
def agg_conditional_sum(s):
    hit = (F.col("state") == "NATION_1") & (F.col("client") == "PJ") & (F.col("origin") == "R")
    return s.fct.groupBy("code").agg(F.sum(F.when(hit, F.col("amount"))).cast("double").alias("kept_null"), F.sum(F.when(hit, F.col("amount")).otherwise(0)).cast("double").alias("zero"))


@op("agg_count_if", "SELECT month, count(*) FILTER (suppressed) AS n FROM fct GROUP BY 1")
def agg_count_if(s):
    return s.fct.groupBy("month").agg(F.count_if("suppressed").alias("n"))


@op("agg_count_distinct", "SELECT segment, count(DISTINCT code) AS codes FROM fct GROUP BY 1")
def agg_count_distinct(s):
    return s.fct.groupBy("segment").agg(F.countDistinct("code").alias("codes"))


@op("agg_multi_distinct_profile", "SELECT month, count(DISTINCT state) AS states, count(DISTINCT segment) AS segments, count(DISTINCT code) AS codes FROM fct GROUP BY 1")
def agg_multi_distinct_profile(s):
    """Distinct values per month are gathered as small sets, so that rows aren't expanded once per column."""
    return s.fct.groupBy("month").agg(*[F.size(F.collect_set(c)).cast("bigint").alias(n) for c, n in (("state", "states"), ("segment", "segments"), ("code", "codes"))])


@op("agg_min_max_dates", "SELECT code, min(month) AS first_month, max(month) AS last_month FROM fct GROUP BY 1")
def agg_min_max_dates(s):
    return s.fct.groupBy("code").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"))


@op("agg_avg_of_rates", f", {_MONTHS} SELECT year(month) AS year, round(avg(100 * overdue / amount), 8) AS mean_rate FROM g GROUP BY 1")
def agg_avg_of_rates(s):
    rate = F.lit(100.0) * F.col("overdue") / F.col("amount")
    return by_month(s).groupBy(F.year("month").cast("bigint").alias("year")).agg(F.round(F.avg(rate), 8).alias("mean_rate"))


@op("agg_stddev_samp", f", {_MONTHS}, k AS (SELECT *, row_number() OVER (ORDER BY month DESC) AS pos FROM g) SELECT round(stddev_samp(amount / 1000), 6) AS dev, count(*) AS n FROM k WHERE pos BETWEEN 2 AND 13")
def agg_stddev_samp(s):
    recent = by_month(s).orderBy(F.desc("month")).limit(13)
    pos = F.row_number().over(Window.orderBy(F.desc("month")))
    return recent.withColumn("pos", pos).where("pos >= 2").agg(F.round(F.stddev_samp(F.col("amount") / 1000), 6).alias("dev"), F.count("*").alias("n"))


@op("agg_corr", f", {_STATES} SELECT state, round(corr(amount, overdue), 8) AS correlation, count(amount + overdue) AS pairs FROM g GROUP BY 1")
def agg_corr(s):
    return by_state(s).groupBy("state").agg(F.round(F.corr("amount", "overdue"), 8).alias("correlation"), F.count(F.col("amount") + F.col("overdue")).alias("pairs"))


@op("agg_median_exact", f", {_STATES} SELECT month, round(median(amount), 6) AS median_amount FROM g GROUP BY 1")
def agg_median_exact(s):
    return by_state(s).groupBy("month").agg(F.round(F.median("amount"), 6).alias("median_amount"))


@op("agg_percentile_approx")
def agg_percentile_approx(s):
    return s.fct.groupBy("product").agg(F.percentile_approx("amount", 0.5, 10000).cast("double").alias("median_amount"))


@op("agg_pivot_max_case", "SELECT state, year, max(CASE WHEN quarter = 1 THEN income END) AS q1, max(CASE WHEN quarter = 3 THEN income END) AS q3 FROM income GROUP BY 1, 2")
def agg_pivot_max_case(s):
    at = lambda q: F.max(F.when(F.col("quarter") == q, F.col("income"))).alias(f"q{q}")
    return s.income.groupBy("state", "year").agg(at(1), at(3))


@op("agg_hhi", ", g AS (SELECT month, segment, CAST(sum(amount) AS DOUBLE) AS a FROM fct GROUP BY 1, 2), s AS (SELECT month, 100 * a / sum(a) OVER (PARTITION BY month) AS p FROM g) SELECT month, round(sum(p * p), 6) AS hhi FROM s GROUP BY 1")
def agg_hhi(s):
    """Needs no window: the sum of squares over the squared sum."""
    a = s.fct.groupBy("month", "segment").agg(F.sum("amount").cast("double").alias("a"))
    return a.groupBy("month").agg(F.round(F.lit(10000.0) * F.sum(F.col("a") * F.col("a")) / (F.sum("a") * F.sum("a")), 6).alias("hhi"))


@op("agg_string_list", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def agg_string_list(s):
    return s.raw("nation").groupBy("n_regionkey").agg(F.concat_ws("; ", F.sort_array(F.collect_list("n_name"))).alias("names"))


@op("agg_collect_set_sorted", "SELECT product, array_to_string(list_sort(list(DISTINCT origin)), ' e ') AS origins FROM fct GROUP BY 1")
def agg_collect_set_sorted(s):
    return s.fct.groupBy("product").agg(F.concat_ws(" e ", F.sort_array(F.collect_set("origin"))).alias("origins"))


@op("agg_group_by_all", "SELECT segment, origin, count(*) AS n FROM fct GROUP BY ALL")
def agg_group_by_all(s):
    return s.spark.sql("SELECT segment, origin, count(*) AS n FROM {fct} GROUP BY ALL", fct=s.fct)


@op("agg_of_agg_window", ", g AS (SELECT client, size_class, CAST(sum(amount) AS DOUBLE) AS a FROM fct GROUP BY 1, 2) SELECT client, size_class, round(100 * a / sum(a) OVER (PARTITION BY client), 8) AS share FROM g")
def agg_of_agg_window(s):
    g = s.fct.groupBy("client", "size_class").agg(F.sum("amount").cast("double").alias("a"))
    return g.select("client", "size_class", F.round(100 * F.col("a") / F.sum("a").over(Window.partitionBy("client")), 8).alias("share"))


_BUCKET = "CASE WHEN operations IS NULL THEN 'hidden' WHEN operations <= 15 THEN '6-15' WHEN operations <= 30 THEN '16-30' ELSE '31+' END"


@op("agg_bucket_case", f"SELECT {_BUCKET} AS bucket, count(*) AS n, CAST(sum(amount) AS DOUBLE) / count(*) AS mean_amount FROM fct GROUP BY 1")
def agg_bucket_case(s):
    n = F.col("operations")
    bucket = F.when(n.isNull(), "hidden").when(n <= 15, "6-15").when(n <= 30, "16-30").otherwise("31+")
    return s.fct.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), (F.sum("amount").cast("double") / F.count("*")).alias("mean_amount"))


@op("agg_distinct_rows", "SELECT month FROM months")
def agg_distinct_rows(s):
    return s.months


@op("agg_rollup_series", "SELECT month, product, state, CAST(sum(amount) AS DOUBLE) AS amount FROM fct GROUP BY GROUPING SETS ((month), (month, product), (month, state))")
def agg_rollup_series(s):
    """Cells are summed to (month, product, state) before they are expanded to the three levels."""
    cells = s.fct.groupBy("month", "product", "state").agg(F.sum("amount").alias("amount"))
    return s.spark.sql(
        "SELECT month, product, state, CAST(sum(amount) AS DOUBLE) AS amount FROM {cells} GROUP BY GROUPING SETS ((month), (month, product), (month, state))", cells=cells
    )


@op("agg_majority_vote", "SELECT conv_id, CASE WHEN count(*) FILTER (role = 'user') >= 3 THEN 'right' WHEN count(*) FILTER (role <> 'user') >= 3 THEN 'wrong' ELSE 'pending' END AS status FROM conversations WHERE turn < 5 GROUP BY 1")
def agg_majority_vote(s):
    yes, no = F.count_if(F.col("role") == "user"), F.count_if(F.col("role") != "user")
    return s.raw("conversations").where("turn < 5").groupBy("conv_id").agg(F.when(yes >= 3, "right").when(no >= 3, "wrong").otherwise("pending").alias("status"))


@op("agg_error_reasons", "SELECT user_id % 7 AS grp, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'click') AS clicks, count(*) AS n FROM events GROUP BY 1")
def agg_error_reasons(s):
    of = lambda t: F.count_if(F.col("event_type") == t)
    return s.raw("events").groupBy((F.col("user_id") % 7).alias("grp")).agg(of("error").alias("errors"), of("click").alias("clicks"), F.count("*").alias("n"))


@op("agg_distribution_0_5", ", c AS (SELECT conv_id, count(*) FILTER (role = 'assistant' AND turn < 5) AS k FROM conversations GROUP BY 1) SELECT k AS rights, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS share FROM c GROUP BY 1")
def agg_distribution_0_5(s):
    c = s.raw("conversations").groupBy("conv_id").agg(F.count_if((F.col("role") == "assistant") & (F.col("turn") < 5)).alias("rights"))
    n = c.groupBy("rights").agg(F.count("*").alias("n"))
    return n.select("rights", "n", (F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def totals(df, period: str):
    """Rows and the sum of every numeric column by period, from the schema alone."""
    numeric = [f.name for f in df.schema if f.dataType.typeName() in ("decimal", "long", "integer", "double")]
    return df.groupBy(period).agg(F.count("*").alias("n"), *[F.sum(c).cast("double").alias(c) for c in numeric])


@op("snapshot_totals", "SELECT month, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(overdue) AS DOUBLE) AS overdue, CAST(sum(problem) AS DOUBLE) AS problem FROM fct_v1 GROUP BY 1")
def snapshot_totals(s):
    return totals(s.fct_v1, "month")


# Windows.
@op("win_row_number_dedup", """SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderdate DESC NULLS LAST, o_orderkey) AS k FROM ord) WHERE k = 1""")
def win_row_number_dedup(s):
    """The first row by priority is a minimum over a struct: partial aggregates instead of a sort per key."""
    order = F.struct(F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("p"), (-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("d"), "o_orderkey")
    return s.orders.groupBy("o_custkey").agg(F.min(order).alias("first")).select("o_custkey", F.col("first.o_orderkey").alias("o_orderkey"))


@op("win_rank_global", f", {_STATES}, l AS (SELECT max(month) AS t FROM g) SELECT state, row_number() OVER (ORDER BY amount DESC NULLS LAST, state) AS place FROM g, l WHERE month = t")
def win_rank_global(s):
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("amount"), "state"))
    return s.latest(by_state(s)).select("state", place.cast("bigint").alias("place"))


@op("win_recency", f", {_STATES}, k AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY month DESC) AS pos FROM g) SELECT state, month, pos FROM k WHERE pos BETWEEN 2 AND 13")
def win_recency(s):
    pos = F.row_number().over(Window.partitionBy("state").orderBy(F.desc("month")))
    return by_state(s).select("state", "month", pos.cast("bigint").alias("pos")).where("pos BETWEEN 2 AND 13")


@op("win_lag_diff", f", {_STATES} SELECT state, month, amount - lag(amount) OVER (PARTITION BY state ORDER BY month) AS d FROM g")
def win_lag_diff(s):
    return by_state(s).select("state", "month", (F.col("amount") - F.lag("amount").over(Window.partitionBy("state").orderBy("month"))).alias("d"))


@op("win_lag_gap_check", ", q AS (SELECT DISTINCT month FROM fct WHERE code = 'PROMO/Brand#1' AND state = 'NATION_1') SELECT month FROM (SELECT month, datediff('month', lag(month) OVER (ORDER BY month), month) AS step FROM q) WHERE step <> 1")
def win_lag_gap_check(s):
    q = s.fct.where("code = 'PROMO/Brand#1' AND state = 'NATION_1'").select("month").distinct()
    step = fn.months_between_starts(F.col("month"), F.lag("month").over(Window.orderBy("month")))
    return q.withColumn("step", step).where("step != 1").select("month")


@op("win_first_value_index", f", {_STATES}, w AS (SELECT * FROM g WHERE month >= DATE '1999-12-31') SELECT state, month, amount / first_value(amount) OVER (PARTITION BY state ORDER BY month) - 1 AS growth FROM w")
def win_first_value_index(s):
    w = by_state(s).where(F.col("month") >= F.lit("1999-12-31").cast("date"))
    return w.select("state", "month", (F.col("amount") / F.first_value("amount").over(Window.partitionBy("state").orderBy("month")) - 1).alias("growth"))


@op("win_cumulative_share", f", {_STATES}, l AS (SELECT max(month) AS t FROM g), p AS (SELECT state, 100 * amount / sum(amount) OVER () AS p, row_number() OVER (ORDER BY amount DESC, state) AS pos FROM g, l WHERE month = t) SELECT state, round(sum(p) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING), 8) AS cum FROM p")
def win_cumulative_share(s):
    p = s.latest(by_state(s)).withColumn("p", 100 * F.col("amount") / F.sum("amount").over(Window.partitionBy()))
    running = Window.orderBy(F.desc("amount"), "state").rowsBetween(Window.unboundedPreceding, 0)
    return p.select("state", F.round(F.sum("p").over(running), 8).alias("cum"))


@op("win_share_of_total", f", {_STATES} SELECT month, state, round(100 * amount / sum(amount) OVER (PARTITION BY month), 8) AS share FROM g")
def win_share_of_total(s):
    return by_state(s).select("month", "state", F.round(100 * F.col("amount") / F.sum("amount").over(Window.partitionBy("month")), 8).alias("share"))


@op("win_is_latest", "SELECT month, month = max(month) OVER () AS latest FROM months")
def win_is_latest(s):
    return s.months.select("month", (F.col("month") == F.max("month").over(Window.partitionBy())).alias("latest"))


@op("win_ffill", f", {_MONTHS}, k AS (SELECT month, CASE WHEN month(month) % 3 = 0 THEN amount END AS v FROM g) SELECT month, last_value(v IGNORE NULLS) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS filled FROM k")
def win_ffill(s):
    k = by_month(s).withColumn("v", F.when(F.month("month") % 3 == 0, F.col("amount")))
    return k.select("month", F.last("v", ignorenulls=True).over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)).alias("filled"))
