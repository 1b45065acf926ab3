"""Table-against-table grading within tolerance bands, whatever the columns are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.portable import portable
from .common import op
from .relational import by_state

#: Factors by which an answer may be scaled.
SCALES = (1.0, 1e3, 1e6, 1e9, 1e12)


def tolerance_class(name: Column, kind: Column) -> Column:
    points = name.rlike("pp$|points")
    return F.when(kind.isin("bigint", "string", "date"), "exact").when(points, "points").when(name.rlike("rate|share|pct"), "dimensionless").otherwise("relative")


def band(cls: Column, ref: Column) -> Column:
    a = F.abs(ref)
    return F.when(cls == "exact", 0.0).when(cls == "points", F.least(F.lit(0.1), 0.1 * a)).when(cls == "dimensionless", F.greatest(F.lit(0.01), 0.01 * a)).otherwise(0.01 * a)


_COLS = "(VALUES ('amount', 'double'), ('rate', 'double'), ('gap_pp', 'double'), ('n', 'bigint'), ('state', 'string'))"
_CLASS = "CASE WHEN kind IN ('bigint', 'string', 'date') THEN 'exact' WHEN regexp_matches(name, 'pp$|points') THEN 'points' WHEN regexp_matches(name, 'rate|share|pct') THEN 'dimensionless' ELSE 'relative' END"


def _columns(s) -> DataFrame:
    return s.spark.createDataFrame([("amount", "double"), ("rate", "double"), ("gap_pp", "double"), ("n", "bigint"), ("state", "string")], "name string, kind string")


@op("tol_class", f"SELECT name, kind, {_CLASS} AS cls FROM {_COLS} AS v(name, kind)")
def tol_class(s):
    return _columns(s).withColumn("cls", tolerance_class(F.col("name"), F.col("kind")))


@op("tol_band", f"SELECT name, round(CASE {_CLASS} WHEN 'exact' THEN 0.0 WHEN 'points' THEN least(0.1, 0.1 * r) WHEN 'dimensionless' THEN greatest(0.01, 0.01 * r) ELSE 0.01 * r END, 9) AS band, r AS ref FROM {_COLS} AS v(name, kind), (SELECT CAST(x AS DOUBLE) AS r FROM range(1, 6) AS t(x))")
def tol_band(s):
    refs = s.spark.range(1, 6).select(F.col("id").cast("double").alias("ref"))
    return _columns(s).crossJoin(F.broadcast(refs)).select("name", F.round(band(tolerance_class(F.col("name"), F.col("kind")), F.col("ref")), 9).alias("band"), "ref")


_ANSWERS = """ref AS (SELECT product, amount FROM (SELECT product, CAST(sum(amount) AS DOUBLE) AS amount FROM fct GROUP BY product) AS r),
ans AS (SELECT product, amount / 1000 AS c1, amount * CASE WHEN product = 'PROMO' THEN 1.5 ELSE 1.005 END AS c2, 1.0 AS c3 FROM ref),
cells AS (SELECT product, 'c1' AS col, c1 AS v FROM ans UNION ALL SELECT product, 'c2', c2 FROM ans UNION ALL SELECT product, 'c3', c3 FROM ans),
sc AS (SELECT CAST(f AS DOUBLE) AS f FROM (VALUES (1), (1000), (1000000)) AS v(f)),
hits AS (SELECT c.product, c.col, sc.f, abs(c.v * sc.f - r.amount) <= 0.01 * r.amount AS hit, abs(c.v * sc.f - r.amount) <= 0.000000001 * r.amount AS exact FROM cells c JOIN ref r ON r.product = c.product CROSS JOIN sc)"""
portable("match_scale", _ANSWERS, "SELECT product, col, min(CASE WHEN hit THEN f END) AS factor FROM hits GROUP BY product, col")
portable("match_single", _ANSWERS, "SELECT product, max(CASE WHEN hit THEN 1 ELSE 0 END) = 1 AS found FROM hits GROUP BY product")
portable(
    "match_identify", _ANSWERS + ", n AS (SELECT col, count(DISTINCT CASE WHEN hit THEN product END) AS items, count(DISTINCT CASE WHEN exact THEN product END) AS exact_items FROM hits GROUP BY col)",
    "SELECT col, items, exact_items FROM n ORDER BY items DESC, exact_items DESC, col LIMIT 1",
)
portable("match_column_scale", _ANSWERS, "SELECT col, f AS factor FROM hits GROUP BY col, f HAVING min(CASE WHEN hit THEN 1 ELSE 0 END) = 1")
portable(
    "grade_ranking",
    _ANSWERS + ", rk AS (SELECT product, amount, row_number() OVER (ORDER BY amount DESC, product) AS pos FROM ref), n AS (SELECT amount AS nth FROM rk WHERE pos = 3), g AS (SELECT a.product, r.pos, a.c2, r.amount FROM ans a JOIN rk r ON r.product = a.product)",
    "SELECT count(CASE WHEN pos <= 3 AND abs(c2 - amount) <= 0.01 * amount THEN 1 END) AS right_items, count(CASE WHEN pos > 3 AND c2 > nth * 1.01 THEN 1 END) AS outsiders FROM g CROSS JOIN n",
)


@op("grade_set")
def grade_set(s):
    """Required, optional and extra items of an answered set, with those near the threshold optional."""
    g = s.latest(by_state(s)).withColumn("rate", 100 * F.col("overdue") / F.col("amount"))
    near = F.abs(F.col("rate") - 5.0) <= 0.05
    need = g.agg(F.sort_array(F.collect_list(F.when((F.col("rate") > 5.0) & ~near, F.col("state")))).alias("required"), F.sort_array(F.collect_list(F.when(near, F.col("state")))).alias("optional"))
    answer = g.where("rate > 4.9").agg(F.sort_array(F.collect_list("state")).alias("answer"))
    both = need.crossJoin(answer)
    extra = F.array_except("answer", F.concat("required", "optional"))
    missing = F.array_except("required", "answer")
    return both.select("required", "optional", extra.alias("extra"), missing.alias("missing"), ((F.size(extra) == 0) & (F.size(missing) == 0)).alias("passed"))


_CHECKS = "c AS (SELECT conv_id AS answer, CAST(floor(turn / 2) AS BIGINT) AS reading, turn, role <> 'system' AS passed FROM raw_conversations)"
portable("grade_readings", _CHECKS + ", r AS (SELECT answer, reading, min(CASE WHEN passed THEN 1 ELSE 0 END) AS ok FROM c GROUP BY answer, reading)", "SELECT answer, max(ok) = 1 AS right_answer FROM r GROUP BY answer")
portable("grade_status", _CHECKS, "SELECT answer, CASE WHEN count(CASE WHEN NOT passed THEN 1 END) = 0 THEN 'right' WHEN count(*) < 3 THEN 'pending' ELSE 'wrong' END AS status, CASE WHEN count(CASE WHEN NOT passed THEN 1 END) > 0 THEN 'a check failed' END AS reason FROM c GROUP BY answer")
portable(
    "judge_merge", "a AS (SELECT conv_id, count(CASE WHEN role = 'user' THEN 1 END) AS n FROM raw_conversations GROUP BY conv_id), j AS (SELECT DISTINCT conv_id, true AS verdict FROM raw_conversations WHERE turn = 6)",
    "SELECT a.conv_id, CASE WHEN n >= 3 THEN 'right' WHEN j.verdict THEN 'judged right' ELSE 'pending' END AS status FROM a LEFT JOIN j ON j.conv_id = a.conv_id",
)


def ranked(df: DataFrame, value: str, ties: str) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(Window.orderBy(F.desc(value), ties)))
