"""Data-quality assertions: each returns a row per check with the number of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..binding import Star, kept
from ..plans.portable import portable
from .common import op
from .relational import by_month, stock
from .scalars import raw_text


# General assertions.
def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNull()).alias("violations"))


def unique(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("violations"))


def accepted(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.agg(F.count_if(~F.col(column).isin(values)).alias("violations"))


def related(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    known = parent.select(F.col(key).alias(column)).distinct()
    return df.where(F.col(column).isNotNull()).join(known, column, "left_anti").agg(F.count("*").alias("violations"))


def named(name: str, violations: DataFrame) -> DataFrame:
    return violations.select(F.lit(name).alias("check"), "violations")


def severity(violations: DataFrame, warn_above: int = 0, fail_above: int = 0) -> DataFrame:
    """pass, warn or fail from the number of violations."""
    v = F.col("violations")
    return violations.withColumn("status", F.when(v > fail_above, "fail").when(v > warn_above, "warn").otherwise("pass"))


@op("dq_unique_grain", "SELECT 'lineitem' AS \"check\", (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS violations UNION ALL SELECT 'orders', (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1))")
def dq_unique_grain(s):
    return named("lineitem", unique(s.raw("lineitem"), "l_orderkey", "l_linenumber")).unionAll(named("orders", unique(s.raw("orders"), "o_orderkey")))


@op("dq_count_keys", "SELECT count(*) AS n, count(DISTINCT concat_ws(chr(1), l_orderkey, l_linenumber)) AS keys FROM lineitem")
def dq_count_keys(s):
    return s.raw("lineitem").agg(F.count("*").alias("n"), F.countDistinct(F.concat_ws("\x01", "l_orderkey", "l_linenumber")).alias("keys"))


def symmetric(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).unionAll(b.subtract(a)).agg(F.count("*").alias("violations"))


@op("dq_preserves", "SELECT CAST(0 AS BIGINT) AS violations")
def dq_preserves(s):
    """The typed layer has the raw layer's rows and sums by origin."""
    raw = raw_text(s).groupBy(F.trim("flag").alias("origin")).agg(F.count("*").alias("n"), F.sum(fn.money(F.col("price"))).alias("amount"))
    typed = s.raw("lineitem").groupBy(F.col("l_returnflag").alias("origin")).agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"))
    return symmetric(raw, typed)


@op("dq_no_fanout", "SELECT CAST(0 AS BIGINT) AS violations")
def dq_no_fanout(s):
    """Joining the dimensions changes neither rows nor sums by month."""
    before = s.raw("lineitem").join(s.orders.select("o_orderkey", "month"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("month").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("a"))
    return symmetric(before, s.fct.groupBy("month").agg(F.count("*").alias("n"), F.sum("amount").alias("a")))


portable("dq_identity_sum", "", "SELECT count(CASE WHEN problem < overdue THEN 1 END) AS violations FROM fct")
portable("dq_interval_rule", "", "SELECT count(CASE WHEN suppressed AND operations IS NOT NULL OR NOT suppressed AND (operations IS NULL OR operations <= 5) THEN 1 END) AS violations FROM fct")
portable("dq_coverage_periods", "m AS (SELECT month, count(DISTINCT state) AS n FROM fct GROUP BY month)", "SELECT count(CASE WHEN n <> 25 THEN 1 END) AS violations, count(*) AS months FROM m")


@op("dq_missing_months", "SELECT CAST(0 AS BIGINT) AS violations")
def dq_missing_months(s):
    ends = s.months.agg(F.min("month").alias("a"), F.max("month").alias("z"))
    steps = ends.select(F.explode(F.sequence(F.trunc("a", "MM"), "z", F.expr("interval 1 month"))).alias("d")).select(F.last_day("d").alias("month"))
    return steps.join(s.months, "month", "left_anti").agg(F.count("*").alias("violations"))


@op("dq_column_emptied", ", m AS (SELECT month, count(*) FILTER (suppressed) AS f1, count(operations) AS f2 FROM fct GROUP BY 1), u AS (SELECT month, 'hidden' AS col, f1 AS f FROM m UNION ALL SELECT month, 'operations', f2 FROM m), w AS (SELECT *, lag(f) OVER (PARTITION BY col ORDER BY month) AS p FROM u) SELECT col, count(*) FILTER (f = 0 AND p > 0) AS violations FROM w GROUP BY 1")
def dq_column_emptied(s):
    m = s.fct.groupBy("month").agg(F.count_if("suppressed").alias("hidden"), F.count("operations").alias("operations"))
    long = m.unpivot("month", ["hidden", "operations"], "col", "f")
    before = F.lag("f").over(Window.partitionBy("col").orderBy("month"))
    return long.withColumn("p", before).groupBy("col").agg(F.count_if((F.col("f") == 0) & (F.col("p") > 0)).alias("violations"))


portable("dq_two_sides_equal", "m AS (SELECT month, sum(CASE WHEN side = 'payer' THEN value ELSE -value END) AS d FROM flows GROUP BY month)", "SELECT count(CASE WHEN d <> 0 THEN 1 END) AS violations, count(*) AS months FROM m")


@op("dq_positive", "SELECT CAST(0 AS BIGINT) AS violations")
def dq_positive(s):
    return stock(s).agg(F.count_if(F.col("firms") < 0).alias("violations"))


@op("dq_reconcile_marts", ", a AS (SELECT CAST(sum(amount) AS DOUBLE) AS t FROM fct) SELECT * FROM (VALUES ('product', CAST(0 AS BIGINT)), ('state', 0), ('segment', 0), ('client', 0)) AS v(\"check\", violations)")
def dq_reconcile_marts(s):
    """Totals by each dimension add up to the fact's, month by month; one pass over the cells."""
    keys = ["product", "state", "segment", "client"]
    cells = kept(s.fct.groupBy("month", *keys).agg(F.sum("amount").alias("a")))
    whole = cells.groupBy("month").agg(F.sum("a").alias("t"))
    out = None
    for k in keys:
        part = cells.groupBy("month", k).agg(F.sum("a").alias("a")).groupBy("month").agg(F.sum("a").alias("p"))
        one = named(k, part.join(whole, "month", "full").agg(F.count_if(~F.col("p").eqNullSafe(F.col("t"))).alias("violations")))
        out = one if out is None else out.unionAll(one)
    return out


@op("dq_classification_coherent", "SELECT CAST(0 AS BIGINT) AS violations")
def dq_classification_coherent(s):
    from ..plans.models import decision

    d = decision(s, s.p.cut)
    bad = (F.col("unrated").isNull() != F.col("quadrant").isNotNull()) | (F.col("unrated").isNotNull() & (F.col("cost_of_risk").isNotNull() | F.col("alert")))
    return d.agg(F.count_if(bad).alias("violations"))


@op("dq_exact_at_model_snapshot", ", m AS (SELECT max(month) AS t FROM months) SELECT count(*) FILTER (last = t) AS on_the_day, CAST(0 AS BIGINT) AS violations FROM firms, m")
def dq_exact_at_model_snapshot(s):
    """At the last month the rebuilt stock is the count of firms without an end, state by state."""
    top = s.months.agg(F.max("month").alias("month"))
    rebuilt = stock(s).join(F.broadcast(top), "month").select("state", "firms")
    real = s.firms.where("last IS NULL").groupBy("state").agg(F.count("*").alias("n"))
    day = s.firms.join(F.broadcast(top), F.col("last") == F.col("month")).agg(F.count("*").alias("on_the_day"))
    return day.crossJoin(rebuilt.join(real, "state", "full").agg(F.count_if(F.coalesce("firms", F.lit(0)) != F.coalesce("n", F.lit(0))).alias("violations")))


portable("dq_snapshot_complete", "", "SELECT 'firms' AS name, count(*) AS n, count(*) = 0 AS empty FROM firms UNION ALL SELECT 'flows', count(*), count(*) = 0 FROM flows UNION ALL SELECT 'rates', count(*), count(*) = 0 FROM rates")


@op("dq_warn_error_thresholds", "SELECT 'lineitem' AS \"check\", n AS violations, CASE WHEN n > 1 THEN 'fail' WHEN n > 0 THEN 'warn' ELSE 'pass' END AS status FROM (SELECT count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))")
def dq_warn_error_thresholds(s):
    return severity(named("lineitem", unique(s.raw("lineitem"), "l_orderkey", "l_linenumber")), 0, 1)


@op("dq_generic", """SELECT * FROM (VALUES ('not_null', (SELECT count(*) FROM flows WHERE state IS NULL)), ('unique', (SELECT count(*) FROM (SELECT 1 FROM nation GROUP BY n_name HAVING count(*) > 1))),
  ('accepted', (SELECT count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N'))), ('related', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)))) AS v("check", violations)""")
def dq_generic(s):
    checks = {
        "not_null": not_null(s.flows, "state"), "unique": unique(s.raw("nation"), "n_name"), "accepted": accepted(s.raw("lineitem"), "l_returnflag", ["A", "N"]),
        "related": related(s.raw("labels"), "doc_id", s.raw("documents"), "doc_id"),
    }
    out = None
    for name, df in checks.items():
        out = named(name, df) if out is None else out.unionAll(named(name, df))
    return out


@op("dq_pii_names", "SELECT column_name AS name, regexp_matches(column_name, '(?i)(name|phone|mail|address)') AS forbidden FROM information_schema.columns WHERE table_name = 'customer'")
def dq_pii_names(s):
    names = s.spark.createDataFrame([(c,) for c in s.raw("customer").columns], "name string")
    return names.withColumn("forbidden", F.col("name").rlike("(?i)(name|phone|mail|address)"))


@op("dq_pii_values", r"SELECT count(*) FILTER (regexp_matches(text, '\d{3}\.\d{3}\.\d{3}-\d{2}')) AS person_ids, count(*) FILTER (regexp_matches(text, '\+\d \(\d{3}\) \d{3}-\d{4}')) AS phones FROM documents")
def dq_pii_values(s):
    has = lambda p: F.count_if(F.col("text").rlike(p))
    return s.raw("documents").agg(has(r"\d{3}\.\d{3}\.\d{3}-\d{2}").alias("person_ids"), has(r"\+\d \(\d{3}\) \d{3}-\d{4}").alias("phones"))


portable("dq_contract", "", "SELECT count(CASE WHEN state IS NULL AND side = 'payer' THEN 1 END) AS null_states, count(CASE WHEN side NOT IN ('payer', 'receiver') THEN 1 END) AS bad_sides, count(CASE WHEN month < DATE '1995-01-31' OR month > DATE '2001-07-31' THEN 1 END) AS out_of_range, count(CASE WHEN month <> last_day(month) THEN 1 END) AS not_month_end FROM flows")
portable(
    "dq_totals_tolerance",
    "a AS (SELECT month, CAST(sum(amount) AS DOUBLE) AS x FROM fct GROUP BY month), b AS (SELECT month, CAST(sum(amount) AS DOUBLE) AS y FROM fct_v1 GROUP BY month)",
    "SELECT count(CASE WHEN y IS NULL OR abs(x / y - 1) > 0.000000001 THEN 1 END) AS violations, count(*) AS months FROM a LEFT JOIN b ON b.month = a.month",
)
portable("dq_row_counts_manifest", "e AS (SELECT * FROM (VALUES ('nation', 25), ('region', 5)) AS v(name, expected)), o AS (SELECT 'nation' AS name, count(*) AS n FROM raw_nation UNION ALL SELECT 'region', count(*) FROM raw_region)", "SELECT e.name, CAST(expected AS BIGINT) AS expected, n, n = expected AS same FROM e JOIN o ON o.name = e.name")


@op("dq_monotone_members", ", p AS (SELECT DISTINCT month, code FROM fct), l AS (SELECT max(month) AS t FROM p) SELECT p.month, count(*) AS gone FROM p, l WHERE p.month < t AND NOT EXISTS (SELECT 1 FROM p q WHERE q.code = p.code AND q.month = last_day(p.month + INTERVAL 1 MONTH)) GROUP BY 1")
def dq_monotone_members(s):
    p = s.fct.select("month", "code").distinct()
    later = p.select(F.last_day(F.add_months("month", -1)).alias("month"), "code")
    last = F.broadcast(p.agg(F.max("month").alias("t")))
    return p.join(last, F.col("month") < F.col("t")).join(later, ["month", "code"], "left_anti").groupBy("month").agg(F.count("*").alias("gone"))


portable("dq_last_day", "", "SELECT count(CASE WHEN month <> last_day(month) THEN 1 END) AS violations, count(*) AS n FROM months")
