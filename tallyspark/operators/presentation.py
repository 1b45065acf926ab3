"""What a dashboard asks of exported tables: totals, ranks, quintiles, slices, geometry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.models import _DECISION, decision
from ..plans.portable import by, portable
from .common import op
from .relational import by_state

_D = _DECISION.replace("@CUT", "50000").replace("SELECT product, state, amount, unrated, CASE", ", dec AS (SELECT product, state, amount, unrated, CASE") + ")"


@op("ui_group_totals", f"{_D} SELECT product, round(sum(amount), 4) AS total, count(*) FILTER (unrated IS NULL) AS rated FROM dec GROUP BY 1")
def ui_group_totals(s):
    return decision(s, s.p.cut).groupBy("product").agg(F.round(F.sum("amount"), 4).alias("total"), F.count_if(F.col("unrated").isNull()).alias("rated")).orderBy(F.desc("total"))


@op("ui_fill_all_states", f"{_D} SELECT n_name AS state, coalesce(d.quadrant, d.unrated, 'no portfolio') AS status FROM nation LEFT JOIN (SELECT * FROM dec WHERE product = 'PROMO') d ON d.state = n_name")
def ui_fill_all_states(s):
    states = s.raw("nation").select(F.col("n_name").alias("state"))
    own = decision(s, s.p.cut).where("product = 'PROMO'").select("state", F.coalesce("quadrant", "unrated").alias("status"))
    return states.join(own, "state", "left").select("state", F.coalesce("status", F.lit("no portfolio")).alias("status"))


@op("ui_summary", f"{_D} SELECT count(*) FILTER (unrated IS NULL) AS rated, count(*) FILTER (cost_of_risk > 0) AS worsening, count(*) FILTER (alert) AS alerts, round(sum(cost_of_risk), 2) AS cost FROM dec")
def ui_summary(s):
    d = decision(s, s.p.cut)
    return d.agg(F.count_if(F.col("unrated").isNull()).alias("rated"), F.count_if(F.col("cost_of_risk") > 0).alias("worsening"), F.count_if("alert").alias("alerts"), F.round(F.sum("cost_of_risk"), 2).alias("cost"))


portable("ui_rank_position", by("state") + ", r AS (SELECT grp, row_number() OVER (ORDER BY amount DESC, grp) AS pos, count(*) OVER () AS n FROM g JOIN last ON month = top)", "SELECT grp AS state, CAST(pos AS BIGINT) AS pos, n FROM r WHERE grp = 'NATION_5'")


@op("ui_quadrant_summary", f"{_D} SELECT coalesce(quadrant, 'unrated: ' || unrated) AS quadrant, count(*) AS cells, round(sum(amount), 2) AS amount, round(sum(cost_of_staying_out), 2) AS cost_of_staying_out, round(sum(cost_of_risk), 2) AS cost_of_risk FROM dec GROUP BY 1")
def ui_quadrant_summary(s):
    d = decision(s, s.p.cut).withColumn("quadrant", F.coalesce("quadrant", F.concat(F.lit("unrated: "), "unrated")))
    return d.groupBy("quadrant").agg(F.count("*").alias("cells"), *[F.round(F.sum(c), 2).alias(c) for c in ("amount", "cost_of_staying_out", "cost_of_risk")])


_G = "g AS (SELECT month, state, CAST(sum(amount) AS DOUBLE) AS amount FROM fct GROUP BY 1, 2)"


@op("ui_quintiles", f", {_G}, v AS (SELECT state, amount FROM g WHERE month = (SELECT max(month) FROM g)), l AS (SELECT list_sort(list(amount)) AS x FROM v) SELECT state, CAST(1 + (CASE WHEN amount > x[CAST(ceil(len(x) * 0.2) AS BIGINT)] THEN 1 ELSE 0 END) + (CASE WHEN amount > x[CAST(ceil(len(x) * 0.4) AS BIGINT)] THEN 1 ELSE 0 END) + (CASE WHEN amount > x[CAST(ceil(len(x) * 0.6) AS BIGINT)] THEN 1 ELSE 0 END) + (CASE WHEN amount > x[CAST(ceil(len(x) * 0.8) AS BIGINT)] THEN 1 ELSE 0 END) AS BIGINT) AS quintile FROM v, l")
def ui_quintiles(s):
    """Nearest-rank limits over the states, a list as short as the map; then a value's class."""
    v = s.latest(by_state(s)).select("state", "amount")
    limits = v.agg(F.array_sort(F.collect_list("amount")).alias("x"))
    limit = lambda q: F.element_at("x", F.ceil(F.size("x") * q).cast("int"))
    cls = F.lit(1).cast("bigint")
    for q in (0.2, 0.4, 0.6, 0.8):
        cls = cls + F.when(F.col("amount") > limit(q), 1).otherwise(0)
    return v.crossJoin(F.broadcast(limits)).select("state", cls.alias("quintile"))


portable("ui_series_slice", by("product"), "SELECT month, grp AS product, amount, month > last_day(top - INTERVAL '12' MONTH) AS recent FROM g CROSS JOIN last")
portable(
    "ui_recent_error", "g AS (SELECT month, CAST(sum(amount) AS DOUBLE) AS a FROM fct GROUP BY month), e AS (SELECT month, a, lag(a, 1) OVER (ORDER BY month) AS p1, lag(a, 2) OVER (ORDER BY month) AS p2, row_number() OVER (ORDER BY month DESC) AS k FROM g)",
    "SELECT round(avg(abs(a - (2 * p1 - p2)) / a), 9) AS trend_error, round(avg(abs(a - p1) / a), 9) AS naive_error, count(CASE WHEN abs(a - p1) / a < 0.1 THEN 1 END) AS hits FROM e WHERE k <= 4",
)
portable("ui_break_crossing", "m AS (SELECT month, last_day(month - INTERVAL '6' MONTH) AS prev FROM months)", "SELECT month, prev < DATE '2000-01-31' AND DATE '2000-01-31' <= month AS crosses FROM m")


@op("ui_csv")
def ui_csv(s):
    """Cells as they go into a CSV file: quotes doubled, text with separators quoted, decimal comma."""
    text = s.raw("benchmark").select("item_id", F.replace("text", F.lit('"'), F.lit('""')).alias("t"))
    return text.select("item_id", F.when(F.col("t").rlike('[;"\n]'), F.concat(F.lit('"'), "t", F.lit('"'))).otherwise(F.col("t")).alias("cell"))


# Geometry over rings given as ordered corners; a square with a square hole, and a triangle.
_RINGS = [("square", 0, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]), ("square", 1, [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]), ("triangle", 0, [(20.0, 0.0), (30.0, 0.0), (20.0, 10.0), (20.0, 0.0)])]
_EDGES = ", e AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {r}, CAST({a[0]} AS DOUBLE), CAST({a[1]} AS DOUBLE), CAST({b[0]} AS DOUBLE), CAST({b[1]} AS DOUBLE))" for n, r, c in _RINGS for a, b in zip(c, c[1:])) + ") AS v(name, ring, x1, y1, x2, y2))"


def edges(s):
    rings = s.spark.createDataFrame(_RINGS, "name string, ring int, corners array<struct<x:double,y:double>>")
    pairs = F.zip_with(F.slice("corners", 1, F.size("corners") - 1), F.slice("corners", 2, F.size("corners") - 1), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return rings.select("name", "ring", F.explode(pairs).alias("e")).select("name", "ring", "e.*")


_POINTS = "(VALUES (0, 5.0, 5.0), (1, 2.0, 2.0), (2, 22.0, 3.0), (3, 29.0, 9.0), (4, 50.0, 50.0))"


@op("geo_point_in_polygon", f"{_EDGES}, p AS (SELECT id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM {_POINTS} AS v(id, x, y)) SELECT id, name, count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 AS inside FROM p, e GROUP BY 1, 2")
def geo_point_in_polygon(s):
    """An odd number of edges to the right, holes included."""
    points = s.spark.createDataFrame([(0, 5.0, 5.0), (1, 2.0, 2.0), (2, 22.0, 3.0), (3, 29.0, 9.0), (4, 50.0, 50.0)], "id int, x double, y double")
    x, y, x1, y1, x2, y2 = (F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2"))
    cut = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)
    return points.crossJoin(F.broadcast(edges(s))).groupBy("id", "name").agg((F.count_if(cut) % 2 == 1).alias("inside"))


@op("geo_sinusoidal_area", f"{_EDGES}, m AS (SELECT name, ring, radians(x1) * cos(radians(y1)) AS a1, radians(y1) AS b1, radians(x2) * cos(radians(y2)) AS a2, radians(y2) AS b2 FROM e), r AS (SELECT name, ring, abs(sum(a1 * b2 - a2 * b1)) / 2 * 6371.0 * 6371.0 AS area FROM m GROUP BY 1, 2) SELECT name, round(sum(CASE WHEN ring = 0 THEN area ELSE -area END), 3) AS km2 FROM r GROUP BY 1")
def geo_sinusoidal_area(s):
    """Equal-area projection, then the sum of edge cross products; holes are taken off."""
    e = edges(s)
    px = lambda x, y: F.radians(x) * F.cos(F.radians(y))
    cross = px("x1", "y1") * F.radians("y2") - px("x2", "y2") * F.radians("y1")
    rings = e.groupBy("name", "ring").agg((F.abs(F.sum(cross)) / 2 * 6371.0 * 6371.0).alias("area"))
    return rings.groupBy("name").agg(F.round(F.sum(F.when(F.col("ring") == 0, F.col("area")).otherwise(-F.col("area"))), 3).alias("km2"))


@op("geo_bbox", f"{_EDGES} SELECT name, min(x1) AS west, min(y1) AS south, max(x1) AS east, max(y1) AS north FROM e GROUP BY 1")
def geo_bbox(s):
    return edges(s).groupBy("name").agg(F.min("x1").alias("west"), F.min("y1").alias("south"), F.max("x1").alias("east"), F.max("y1").alias("north"))


def top_share(df, key: str, value: str):
    return df.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy(key)))
