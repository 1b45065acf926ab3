"""Filters, joins, sorting, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..binding import Star, kept
from .common import op

_STATES = "g AS (SELECT month, state, CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(overdue) AS DOUBLE) AS overdue FROM fct GROUP BY 1, 2)"


def by_state(s: Star) -> DataFrame:
    return kept(s.fct.groupBy("month", "state").agg(F.sum("amount").cast("double").alias("amount"), F.sum("overdue").cast("double").alias("overdue")))


def by_month(s: Star) -> DataFrame:
    return kept(s.fct.groupBy("month").agg(F.sum("amount").cast("double").alias("amount"), F.sum("overdue").cast("double").alias("overdue")))


_MONTHS = "g AS (SELECT month, CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(overdue) AS DOUBLE) AS overdue FROM fct GROUP BY 1)"


# Filters.
@op("filter_latest", f", {_STATES} SELECT * FROM g WHERE month = (SELECT max(month) FROM g)")
def filter_latest(s):
    return s.latest(by_state(s))


@op("filter_trailing_window", f", {_MONTHS}, l AS (SELECT max(month) AS t FROM g) SELECT month, month > last_day(t - INTERVAL '24' MONTH) AS exclusive FROM g, l WHERE month >= last_day(t - INTERVAL '24' MONTH)")
def filter_trailing_window(s):
    g = by_month(s)
    top = F.broadcast(g.agg(F.max("month").alias("t")))
    low = fn.months_back(F.col("t"), 24)
    return g.join(top, F.col("month") >= low).select("month", (F.col("month") > low).alias("exclusive"))


@op("filter_code_in", "SELECT code, count(*) AS n FROM fct WHERE code IN ('PROMO/Brand#1', 'SMALL/Brand#2') GROUP BY 1")
def filter_code_in(s):
    return s.fct.where(F.col("code").isin("PROMO/Brand#1", "SMALL/Brand#2")).groupBy("code").agg(F.count("*").alias("n"))


@op("filter_by_code_not_label", "SELECT subproduct, count(*) AS n FROM fct WHERE code = 'LARGE/Brand#3' GROUP BY 1")
def filter_by_code_not_label(s):
    return s.fct.where(F.col("code") == "LARGE/Brand#3").groupBy("subproduct").agg(F.count("*").alias("n"))


@op("not_exists", "SELECT month FROM months m WHERE NOT EXISTS (SELECT 1 FROM income i WHERE i.quarter_end <= m.month)")
def not_exists(s):
    first = F.broadcast(s.income.agg(F.min("quarter_end").alias("q")))
    return s.months.join(first, F.col("q") <= F.col("month"), "left_anti")


@op("having", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def having(s):
    return s.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@op("null_or_range", "SELECT firm FROM firms WHERE (last IS NULL OR last > DATE '1998-01-01') AND (last IS NULL OR last > first)")
def null_or_range(s):
    last = F.col("last")
    return s.firms.where((last.isNull() | (last > F.lit("1998-01-01").cast("date"))) & (last.isNull() | (last > F.col("first")))).select("firm")


@op("threshold_zone", f", {_MONTHS} SELECT month, CASE WHEN abs(100 * overdue / amount - 5.0) <= 0.05 THEN 'optional' WHEN 100 * overdue / amount > 5.0 THEN 'inside' ELSE 'outside' END AS zone FROM g")
def threshold_zone(s):
    rate = fn.pct(F.col("overdue"), F.col("amount"))
    return by_month(s).select("month", F.when(F.abs(rate - 5.0) <= 0.05, "optional").when(rate > 5.0, "inside").otherwise("outside").alias("zone"))


# Joins.
@op("join_star_inner", "SELECT n_regionkey AS region, CAST(sum(amount) AS DOUBLE) AS amount FROM fct JOIN nation ON n_name = state GROUP BY 1")
def join_star_inner(s):
    """The fact is summed to the join key first, so that few rows meet the dimension."""
    small = s.fct.groupBy("state").agg(F.sum("amount").alias("a"))
    nation = s.raw("nation").select(F.col("n_name").alias("state"), F.col("n_regionkey").alias("region"))
    return small.join(nation, "state").groupBy("region").agg(F.sum("a").cast("double").alias("amount"))


_PAIRS = "pairs AS (SELECT * FROM (VALUES ('PROMO', 'Brand#1', 'A1'), ('SMALL', 'Brand#1', 'B1'), ('PROMO', 'Brand#2', 'A2')) AS v(product, subproduct, own))"


def pairs(s: Star) -> DataFrame:
    return s.spark.createDataFrame([("PROMO", "Brand#1", "A1"), ("SMALL", "Brand#1", "B1"), ("PROMO", "Brand#2", "A2")], "product string, subproduct string, own string")


@op("join_composite_label_left", f", {_PAIRS} SELECT own, count(*) AS n FROM fct LEFT JOIN pairs USING (product, subproduct) GROUP BY 1")
def join_composite_label_left(s):
    return s.fct.join(F.broadcast(pairs(s)), ["product", "subproduct"], "left").groupBy("own").agg(F.count("*").alias("n"))


@op("join_three_key_left", ", t AS (SELECT * FROM (VALUES ('PROMO', 'PF', 'A', 'x'), ('PROMO', 'PF', 'N', 'y'), ('LARGE', 'PJ', 'R', 'z')) AS v(product, client, origin, own)) SELECT own, count(*) AS n FROM fct LEFT JOIN t USING (product, client, origin) GROUP BY 1")
def join_three_key_left(s):
    t = s.spark.createDataFrame([("PROMO", "PF", "A", "x"), ("PROMO", "PF", "N", "y"), ("LARGE", "PJ", "R", "z")], "product string, client string, origin string, own string")
    return s.fct.join(F.broadcast(t), ["product", "client", "origin"], "left").groupBy("own").agg(F.count("*").alias("n"))


def with_period_before(g: DataFrame, n: int, keys: list[str], how: str = "left", suffix: str = "_before") -> DataFrame:
    """g with the measures of the same keys n months earlier; an equi-join on the derived month."""
    measures = [c for c in g.columns if c not in ("month", *keys)]
    then = g.select(F.last_day(F.add_months("month", n)).alias("month"), *keys, *[F.col(c).alias(c + suffix) for c in measures])
    return g.join(then, ["month", *keys], how)


@op("join_self_period", f", {_STATES} SELECT a.month, a.state, a.amount, b.amount AS amount_before FROM g a LEFT JOIN g b ON b.state = a.state AND b.month = last_day(a.month - INTERVAL '6' MONTH)")
def join_self_period(s):
    return with_period_before(by_state(s).drop("overdue"), 6, ["state"])


@op("join_two_windows", f""", {_STATES}, l AS (SELECT max(month) AS t, min(month) AS f FROM g) SELECT a.state, a.amount, b.amount AS year_ago, c.amount AS at_start FROM g a, l, g b, g c
  WHERE a.month = t AND b.state = a.state AND b.month = last_day(t - INTERVAL '12' MONTH) AND c.state = a.state AND c.month = f""")
def join_two_windows(s):
    """One pass: the three months become columns by conditional aggregation."""
    g = by_state(s)
    ends = F.broadcast(g.agg(F.max("month").alias("t"), F.min("month").alias("f")))
    at = lambda day: F.max(F.when(F.col("month") == day, F.col("amount")))
    wide = g.join(ends).groupBy("state").agg(at(F.col("t")).alias("amount"), at(fn.months_back(F.col("t"), 12)).alias("year_ago"), at(F.col("f")).alias("at_start"))
    return wide.dropna()


@op("join_cross_scalar", f", {_MONTHS}, l AS (SELECT max(month) AS t FROM g) SELECT month, datediff('month', month, t) AS age FROM g CROSS JOIN l")
def join_cross_scalar(s):
    g = s.months
    return g.crossJoin(F.broadcast(g.agg(F.max("month").alias("t")))).select("month", fn.months_between_starts(F.col("t"), F.col("month")).alias("age"))


@op("join_cross_guard", ", b AS (SELECT 1 AS x WHERE 1 = 0) SELECT month FROM months CROSS JOIN b")
def join_cross_guard(s):
    """The calendar is empty when a break that it relies on is missing."""
    wanted = s.spark.createDataFrame([("break", "2000-01-31")], "id string, day string").where("id = 'gone'").select("id")
    return s.months.crossJoin(F.broadcast(wanted)).drop("id")


_MOVES = """moves AS (SELECT state, last_day(first) AS month, 1 AS d FROM firms UNION ALL SELECT state, last_day(last), -1 FROM firms WHERE last IS NOT NULL),
  deltas AS (SELECT state, month, sum(d) AS d FROM moves GROUP BY 1, 2)"""


def stock(s: Star) -> DataFrame:
    """Active firms by state and month: a running sum of monthly movements on the dense grid."""
    one = lambda c, d: s.firms.where(F.col(c).isNotNull()).select("state", F.last_day(c).alias("month"), F.lit(d).alias("d"))
    deltas = one("first", 1).unionAll(one("last", -1)).groupBy("state", "month").agg(F.sum("d").alias("d"))  # both branches read one row a firm
    grid = s.raw("nation").select(F.col("n_name").alias("state")).crossJoin(F.broadcast(s.months))
    running = Window.partitionBy("state").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(deltas, ["state", "month"], "left").select("state", "month", F.sum(F.coalesce("d", F.lit(0))).over(running).alias("firms"))


_STOCK = f"{_MOVES} SELECT n_name AS state, m.month, CAST(coalesce(sum(d), 0) AS BIGINT) AS firms FROM nation CROSS JOIN months m LEFT JOIN deltas x ON x.state = n_name AND x.month <= m.month GROUP BY 1, 2"
op("join_range_le", f", {_STOCK}")(stock)
op("win_running_stock", f", {_STOCK}")(stock)


@op("join_interval_contains", ", d AS (SELECT * FROM (VALUES (DATE '1997-06-30'), (DATE '1999-06-30')) AS v(d)) SELECT d, state, count(*) AS n FROM firms JOIN d ON first <= d AND (last IS NULL OR last > d) GROUP BY 1, 2")
def join_interval_contains(s):
    days = s.spark.sql("SELECT * FROM VALUES (DATE '1997-06-30'), (DATE '1999-06-30') AS v(d)")
    inside = (F.col("first") <= F.col("d")) & (F.col("last").isNull() | (F.col("last") > F.col("d")))
    return s.firms.join(F.broadcast(days), inside).groupBy("d", "state").agg(F.count("*").alias("n"))


def as_of(left: DataFrame, left_on: str, right: DataFrame, right_on: str, value: str) -> DataFrame:
    """left with the latest value at or before left_on: both sides in one order, the last value carried on.

    Linear in both sides and without a range join; use only where the union fits one ordered window
    (calendars and series), or after adding a partition key.
    """
    both = left.select(F.col(left_on).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast("date").alias("_from")).unionAll(
        right.select(F.col(right_on), F.lit(0), F.col(value), F.col(right_on))
    )
    order = Window.orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.select("_at", "_side", F.last("_v", True).over(order).alias(value), F.last("_from", True).over(order).alias("day"))
    return filled.where("_side = 1").select(F.col("_at").alias(left_on), value, "day")


@op("join_asof_backward", "SELECT m.month, r.rate, r.day FROM months m ASOF LEFT JOIN rates r ON m.month >= r.day")
def join_asof_backward(s):
    return as_of(s.months, "month", s.rates, "day", "rate")


@op("join_asof_quarter", ", q AS (SELECT DISTINCT quarter_end FROM income) SELECT m.month, max(q.quarter_end) AS quarter_end FROM months m JOIN q ON q.quarter_end <= m.month GROUP BY 1")
def join_asof_quarter(s):
    """A month's last finished quarter follows from the calendar, so the join is on equality."""
    m = F.col("month")
    last = F.when(F.last_day(F.add_months(F.trunc(m, "quarter"), 2)) == m, m).otherwise(F.date_sub(F.trunc(m, "quarter"), 1))
    return s.months.select("month", last.alias("quarter_end")).join(s.income.select("quarter_end").distinct(), "quarter_end", "left_semi").select("month", "quarter_end")


@op("join_year_of_date", f", {_STATES} SELECT g.month, g.state, amount / population AS per_head FROM g JOIN population p ON p.year = year(g.month) AND p.state = g.state")
def join_year_of_date(s):
    g = by_state(s).withColumn("year", F.year("month").cast("bigint"))
    return g.join(s.population, ["year", "state"]).select("month", "state", (F.col("amount") / F.col("population")).alias("per_head"))


@op("join_full_outer_reconcile", """, a AS (SELECT month, client, product, CAST(sum(amount) AS DOUBLE) AS v2 FROM fct WHERE origin <> 'N' GROUP BY ALL), b AS (SELECT month, client, product, CAST(sum(amount) AS DOUBLE) AS v1 FROM fct_v1 WHERE origin <> 'R' GROUP BY ALL)
  SELECT coalesce(a.month, b.month) AS month, coalesce(a.client, b.client) AS client, coalesce(a.product, b.product) AS product, v2, v1 FROM a FULL JOIN b ON a.month = b.month AND a.client = b.client AND a.product = b.product""")
def join_full_outer_reconcile(s):
    keys = ["month", "client", "product"]
    a = s.fct.where("origin <> 'N'").groupBy(*keys).agg(F.sum("amount").cast("double").alias("v2"))
    b = s.fct_v1.where("origin <> 'R'").groupBy(*keys).agg(F.sum("amount").cast("double").alias("v1"))
    return a.join(b, keys, "full").select(*keys, "v2", "v1")


@op("join_lag_offset", f", {_MONTHS}, i AS (SELECT row_number() OVER (ORDER BY month) AS k, amount FROM g) SELECT n AS shift, count(*) AS pairs, round(corr(a.amount, b.amount), 8) AS correlation FROM i a, (VALUES (0), (1), (2)) AS v(n), i b WHERE a.k = b.k + n GROUP BY n")
def join_lag_offset(s):
    i = by_month(s).select(F.row_number().over(Window.orderBy("month")).alias("k"), "amount")
    shifted = i.crossJoin(F.broadcast(s.spark.range(3).select(F.col("id").cast("int").alias("shift")))).select((F.col("k") + F.col("shift")).alias("k"), "shift", F.col("amount").alias("b"))
    return i.join(shifted, "k").groupBy("shift").agg(F.count("*").alias("pairs"), F.round(F.corr("amount", "b"), 8).alias("correlation"))


@op("join_literal_windows", f", {_MONTHS}, l AS (SELECT max(month) AS t, min(month) AS f FROM g) SELECT n, count(*) AS months FROM g, l, (VALUES (12), (24), (999)) AS v(n) WHERE month > CASE WHEN n = 999 THEN f ELSE last_day(t - to_months(n)) END GROUP BY 1")
def join_literal_windows(s):
    g, v = s.months, s.spark.createDataFrame([(12,), (24,), (999,)], "n int")
    low = F.when(F.col("n") == 999, F.col("f")).otherwise(F.last_day(F.add_months(F.col("t"), -F.col("n"))))
    ends = F.broadcast(g.agg(F.max("month").alias("t"), F.min("month").alias("f")))
    return g.crossJoin(ends).crossJoin(F.broadcast(v)).where(F.col("month") > low).groupBy("n").agg(F.count("*").alias("months"))


@op("semi_dim_filter", "SELECT state, CAST(sum(quantity) AS BIGINT) AS quantity FROM flows WHERE state IN (SELECT n_name FROM nation WHERE n_regionkey <= 1) GROUP BY 1")
def semi_dim_filter(s):
    valid = s.raw("nation").where("n_regionkey <= 1").select(F.col("n_name").alias("state"))
    return s.flows.join(valid, "state", "left_semi").groupBy("state").agg(F.sum("quantity").alias("quantity"))


@op("anti_orphans", "SELECT count(*) AS orphans FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 3) ON l_partkey = p_partkey WHERE p_partkey IS NULL")
def anti_orphans(s):
    known = s.raw("part").where("p_size > 3").select("p_partkey")
    return s.raw("lineitem").join(known, F.col("l_partkey") == F.col("p_partkey"), "left_anti").agg(F.count("*").alias("orphans"))


@op("missing_periods", "SELECT last_day(CAST(d AS DATE)) AS month FROM generate_series(DATE '1994-06-01', DATE '1995-06-01', INTERVAL 1 MONTH) AS t(d) WHERE last_day(CAST(d AS DATE)) NOT IN (SELECT month FROM months)")
def missing_periods(s):
    days = F.sequence(F.lit("1994-06-01").cast("date"), F.lit("1995-06-01").cast("date"), F.expr("interval 1 month"))
    return s.spark.range(1).select(F.explode(days).alias("d")).select(F.last_day("d").alias("month")).join(s.months, "month", "left_anti")


@op("join_left_scalar_subqueries", "SELECT (SELECT count(*) FROM lineitem) AS rows, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS orders, (SELECT count(*) FROM orders) AS all_orders")
def join_left_scalar_subqueries(s):
    line = s.raw("lineitem").agg(F.count("*").alias("rows"), F.countDistinct("l_orderkey").alias("orders"))
    return line.crossJoin(s.raw("orders").agg(F.count("*").alias("all_orders")))


# Sorting and top-k.
@op("topk_limit", f", {_STATES}, l AS (SELECT max(month) AS t FROM g) SELECT state, amount FROM g, l WHERE month = t ORDER BY amount DESC, state LIMIT 3")
def topk_limit(s):
    return s.latest(by_state(s)).select("state", "amount").orderBy(F.desc("amount"), "state").limit(3)


@op("topk_where_pos", f", {_STATES}, p AS (SELECT month, state, amount, row_number() OVER (PARTITION BY month ORDER BY amount DESC, state) AS pos FROM g) SELECT * FROM p WHERE pos <= 5")
def topk_where_pos(s):
    pos = F.row_number().over(Window.partitionBy("month").orderBy(F.desc("amount"), "state"))
    return by_state(s).select("month", "state", "amount", pos.cast("bigint").alias("pos")).where("pos <= 5")


@op("top1_subquery", f", {_STATES}, l AS (SELECT max(month) AS t FROM g), x AS (SELECT state FROM g, l WHERE month = t ORDER BY amount DESC, state LIMIT 1) SELECT month, state, amount FROM g JOIN x USING (state)")
def top1_subquery(s):
    g = by_state(s)
    first = s.latest(g).orderBy(F.desc("amount"), "state").limit(1).select("state")
    return g.join(F.broadcast(first), "state").select("month", "state", "amount")


@op("sort_nulls_last", "SELECT state, CAST(sum(value) AS DOUBLE) AS value FROM flows GROUP BY 1 ORDER BY state DESC NULLS LAST")
def sort_nulls_last(s):
    return s.flows.groupBy("state").agg(F.sum("value").cast("double").alias("value")).orderBy(F.desc_nulls_last("state"))


@op("sort_abs_expr", f", {_MONTHS}, c AS (SELECT month, amount - lag(amount) OVER (ORDER BY month) AS d FROM g) SELECT month, round(d, 4) AS d FROM c WHERE d IS NOT NULL ORDER BY abs(d) DESC, month LIMIT 10")
def sort_abs_expr(s):
    d = F.col("amount") - F.lag("amount").over(Window.orderBy("month"))
    return by_month(s).select("month", F.round(d, 4).alias("d")).where("d IS NOT NULL").orderBy(F.desc(F.abs("d")), "month").limit(10)


@op("limit_with_total", "SELECT state, n_total FROM (SELECT n_name AS state, count(*) OVER () AS n_total FROM nation) ORDER BY state LIMIT 10")
def limit_with_total(s):
    """Ten rows and the whole count; one row more than wanted tells whether a count is needed."""
    rows = s.raw("nation").select(F.col("n_name").alias("state")).orderBy("state")
    if len(rows.limit(11).collect()) <= 10:
        return rows.withColumn("n_total", F.lit(rows.count()))
    return rows.limit(10).crossJoin(F.broadcast(s.raw("nation").agg(F.count("*").alias("n_total"))))


@op("topk_stable_similarity", """, q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id = 0),
  d AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, round(list_dot_product(d.e, q.e), 6) AS sim FROM d, q ORDER BY 2 DESC, 1 LIMIT 5""")
def topk_stable_similarity(s):
    e = s.raw("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    q = F.broadcast(e.where("vec_id = 0").select(F.col("e").alias("q")))
    dot = F.aggregate(F.zip_with("e", "q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return e.crossJoin(q).select("vec_id", F.round(dot, 6).alias("sim")).orderBy(F.desc("sim"), "vec_id").limit(5)


@op("sort_by_hash", "SELECT conv_id, turn FROM conversations ORDER BY sha256('seed|' || CAST(conv_id AS VARCHAR) || '|' || CAST(turn AS VARCHAR)) LIMIT 20")
def sort_by_hash(s):
    return s.raw("conversations").orderBy(F.sha2(F.concat_ws("|", F.lit("seed"), "conv_id", "turn"), 256)).select("conv_id", "turn").limit(20)


# Set operations and reshaping.
@op("set_union_all", "SELECT 'fct' AS source, CAST(sum(amount) AS DOUBLE) AS amount FROM fct UNION ALL SELECT 'fct_v1', CAST(sum(amount) AS DOUBLE) FROM fct_v1")
def set_union_all(s):
    one = lambda name, df: df.agg(F.sum("amount").cast("double").alias("amount")).select(F.lit(name).alias("source"), "amount")
    return one("fct", s.fct).unionByName(one("fct_v1", s.fct_v1))


@op("set_except_symmetric", """, a AS (SELECT month, product, CAST(sum(amount) AS DOUBLE) AS amount FROM fct GROUP BY 1, 2), b AS (SELECT month, product, CAST(sum(amount) AS DOUBLE) AS amount FROM fct_v1 GROUP BY 1, 2)
  SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def set_except_symmetric(s):
    a, b = (df.groupBy("month", "product").agg(F.sum("amount").cast("double").alias("amount")) for df in (s.fct, s.fct_v1))
    return a.subtract(b).select(F.lit("left").alias("side"), "*").unionAll(b.subtract(a).select(F.lit("right").alias("side"), "*"))


@op("unpivot_union", "SELECT month, state, side, client, CAST(value AS DOUBLE) AS value, quantity FROM flows")
def unpivot_union(s):
    return s.flows.select("month", "state", "side", "client", F.col("value").cast("double").alias("value"), "quantity")


@op("unpivot_metrics", f", {_MONTHS} SELECT month, 'amount' AS metric, 'R$' AS unit, amount AS value FROM g UNION ALL SELECT month, 'overdue', 'R$', overdue FROM g UNION ALL SELECT month, 'rate', '%', 100.0 * overdue / amount FROM g")
def unpivot_metrics(s):
    wide = by_month(s).withColumn("rate", fn.pct(F.col("overdue"), F.col("amount")))
    unit = F.when(F.col("metric") == "rate", "%").otherwise("R$")
    return wide.unpivot("month", ["amount", "overdue", "rate"], "metric", "value").select("month", "metric", unit.alias("unit"), "value")


@op("unpivot_stack", "SELECT 'state' AS name, state AS value, count(*) AS n FROM fct GROUP BY 2 UNION ALL SELECT 'segment', segment, count(*) FROM fct GROUP BY 2 UNION ALL SELECT 'client', client, count(*) FROM fct GROUP BY 2")
def unpivot_stack(s):
    """Cells are counted by all three columns before they are stacked, so the rows don't triple."""
    cells = s.fct.groupBy("state", "segment", "client").agg(F.count("*").alias("n"))
    long = cells.select(F.stack(F.lit(3), F.lit("state"), "state", F.lit("segment"), "segment", F.lit("client"), "client").alias("name", "value"), "n")
    return long.groupBy("name", "value").agg(F.sum("n").alias("n"))


@op("pivot_long_to_wide", "SELECT year, max(CASE WHEN quarter = 1 THEN income END) AS q1, max(CASE WHEN quarter = 2 THEN income END) AS q2, max(CASE WHEN quarter = 3 THEN income END) AS q3, max(CASE WHEN quarter = 4 THEN income END) AS q4 FROM income WHERE state = 'NATION_1' GROUP BY 1")
def pivot_long_to_wide(s):
    wide = s.income.where("state = 'NATION_1'").groupBy("year").pivot("quarter", [1, 2, 3, 4]).agg(F.first("income"))
    return wide.withColumnsRenamed({str(k): f"q{k}" for k in range(1, 5)})


@op("explode_sequence", "SELECT CAST(k AS BIGINT) AS k, last_day(DATE '1999-01-01' + to_months(CAST(k AS INTEGER))) AS month FROM range(0, 13) AS t(k)")
def explode_sequence(s):
    k = s.spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(12))).alias("k"))
    return k.select(F.col("k").cast("bigint").alias("k"), F.last_day(F.add_months(F.lit("1999-01-01").cast("date"), F.col("k"))).alias("month"))


@op("values_inline", "SELECT * FROM (VALUES (0, 'now'), (6, 'half'), (12, 'year')) AS v(n, name)")
def values_inline(s):
    return s.spark.sql("SELECT * FROM VALUES (0, 'now'), (6, 'half'), (12, 'year') AS v(n, name)")


@op("symmetric_key_diff", ", a AS (SELECT DISTINCT code FROM fct WHERE client = 'PF' AND month < DATE '1995-03-01'), b AS (SELECT DISTINCT code FROM fct WHERE client = 'PJ' AND month < DATE '1995-03-01') SELECT coalesce(a.code, b.code) AS code, a.code IS NULL AS only_right FROM a FULL JOIN b ON a.code = b.code WHERE a.code IS NULL OR b.code IS NULL")
def symmetric_key_diff(s):
    early = s.fct.where(F.col("month") < F.lit("1995-03-01").cast("date"))
    a = early.where("client = 'PF'").select("code").distinct().withColumn("l", F.lit(True))
    b = early.where("client = 'PJ'").select("code").distinct().withColumn("r", F.lit(True))
    return a.join(b, "code", "full").where("l IS NULL OR r IS NULL").select("code", F.col("l").isNull().alias("only_right"))
