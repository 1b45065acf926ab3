"""Staging, conformed, dimension, fact and presentation models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..binding import Star, kept
from ..operators.common import op
from ..operators.relational import stock, with_period_before
from ..operators.scalars import _LEGACY, _RAW, legacy, raw_text
from .portable import SUMS, ago, portable


# Staging: one row per raw row, typed, sentinels null beside a flag.
@op("stg_v2", _RAW + """ SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, trim(flag) AS origin, CAST(CAST(replace(trim(price), ',', '.') AS DECIMAL(18,2)) AS DOUBLE) AS amount, CAST(nullif(trim(n), '-1') AS BIGINT) AS operations, trim(n) = '-1' AS suppressed,
  CAST(trim(iso) AS DATE) AS day FROM raw""")
def stg_v2(s: Star) -> DataFrame:
    return raw_text(s).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fn.label(F.col("flag")).alias("origin"), fn.money(F.col("price")).cast("double").alias("amount"),
        fn.count_or_null(F.col("n"), "-1").alias("operations"), fn.is_suppressed(F.col("n"), "-1").alias("suppressed"), fn.clean_date(F.col("iso")).alias("day"),
    )


@op("stg_v1", _RAW + """ SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(trim(mark), '-') AS subclass, trim(mark) = '-' AND trim(flag) = 'N' AS two_meanings, coalesce(CAST(nullif(trim(n), '-1') AS BIGINT), 1) AS operations_least,
  coalesce(CAST(nullif(trim(n), '-1') AS BIGINT), 5) AS operations_most, CASE WHEN trim(day) NOT IN ('0', '00000000') THEN CAST(strptime(trim(day), '%Y%m%d') AS DATE) END AS day FROM raw""")
def stg_v1(s: Star) -> DataFrame:
    n = fn.count_or_null(F.col("n"), "-1")
    return raw_text(s).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fn.label_or_null(F.col("mark")).alias("subclass"), ((fn.label(F.col("mark")) == "-") & (fn.label(F.col("flag")) == "N")).alias("two_meanings"),
        fn.least_count(n).alias("operations_least"), fn.most_count(n, s.p.suppressed_most).alias("operations_most"), fn.date_or_null(F.col("day")).alias("day"),
    )


portable("stg_establishments", "", "SELECT firm, state, first AS opened, last AS closed, last IS NULL AS active FROM firms")
portable("stg_companies", "", "SELECT firm, grp AS legal_group FROM firms")
portable("stg_simples", "", "SELECT firm, inner_from IS NOT NULL AS opted, inner_from, inner_to FROM firms")
portable("stg_population", "", "SELECT year, state, population FROM population")
portable("stg_income", "", "SELECT year, quarter, state, income FROM income")
portable("stg_mass", "", "SELECT year, quarter, state, CAST(mass AS DOUBLE) AS mass FROM income")
portable("stg_flows", "", "SELECT month, state, side, client, CAST(value AS DOUBLE) AS value, quantity FROM flows")
portable("stg_series", "", "SELECT day, rate FROM rates")
op("stg_ext", "SELECT firm, state, first, last FROM firms")(lambda s: s.firms.select("firm", "state", "first", "last"))


# Conformed.
@op("int_conformed", _LEGACY + """ SELECT month, f.product, f.client, size_key, coalesce(official, inferred) AS legacy_name, CASE WHEN official IS NOT NULL THEN 'official' WHEN inferred IS NOT NULL THEN 'inferred' ELSE 'none' END AS source,
  count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM fct f LEFT JOIN legacy l ON l.product = f.product AND l.client = f.client GROUP BY ALL""")
def int_conformed(s: Star) -> DataFrame:
    cells = s.fct.groupBy("month", "product", "client", "size_key").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))
    source = F.when(F.col("official").isNotNull(), "official").when(F.col("inferred").isNotNull(), "inferred").otherwise("none")
    return cells.join(F.broadcast(legacy(s)), ["product", "client"], "left").select("month", "product", "client", "size_key", F.coalesce("official", "inferred").alias("legacy_name"), source.alias("source"), "n", "amount")


portable("int_dim_product", "", "SELECT DISTINCT code, product, subproduct, subproduct = 'Brand#1' AS lacks_definition FROM fct")
portable("int_dim_size", "", "SELECT DISTINCT size_key, client, size_class FROM fct")
portable("int_dim_activity", "", "SELECT DISTINCT client, segment, concat(client, ' - ', segment) AS activity_key FROM fct")
op("int_dims", "SELECT 'product' AS dim, count(DISTINCT code) AS members FROM fct UNION ALL SELECT 'size', count(DISTINCT size_key) FROM fct")(
    lambda s: s.fct.select(F.lit("product").alias("dim"), F.col("code").alias("m")).distinct().unionAll(s.fct.select(F.lit("size"), "size_key").distinct()).groupBy("dim").agg(F.count("*").alias("members"))
)

_SEGMENTS = """segs AS (SELECT firm, state, grp, false AS inside, first AS a, CASE WHEN inner_from IS NULL THEN last ELSE least(inner_from, last) END AS z FROM firms
  UNION ALL SELECT firm, state, grp, true, greatest(first, inner_from), least(inner_to, last) FROM firms WHERE inner_from IS NOT NULL
  UNION ALL SELECT firm, state, grp, false, greatest(first, inner_to), last FROM firms WHERE inner_to IS NOT NULL),
  valid AS (SELECT * FROM segs WHERE z IS NULL OR z > a)"""


def segments(s: Star) -> DataFrame:
    """Each firm's activity cut at its inner interval into up to three half-open stretches; a null end is open.

    greatest and least skip nulls, so an open end stays open. Empty stretches are dropped.
    """
    def part(inside: bool, a, z, when=None):
        rows = s.firms if when is None else s.firms.where(F.col(when).isNotNull())
        return rows.select("firm", "state", "grp", F.lit(inside).alias("inside"), a.alias("a"), z.alias("z"))

    first, last, lo, hi = (F.col(c) for c in ("first", "last", "inner_from", "inner_to"))
    before = part(False, first, F.when(lo.isNull(), last).otherwise(F.least(lo, last)))
    within = part(True, F.greatest(first, lo), F.least(hi, last), "inner_from")
    after = part(False, F.greatest(first, hi), last, "inner_to")
    return before.unionAll(within).unionAll(after).where("z IS NULL OR z > a")


op("int_intervals", f", {_SEGMENTS} SELECT firm, state, grp, inside, a, z FROM valid")(segments)

_STOCK3 = f"""{_SEGMENTS}, ev AS (SELECT state, grp, inside, last_day(a) AS month, 1 AS d FROM valid UNION ALL SELECT state, grp, inside, last_day(z), -1 FROM valid WHERE z IS NOT NULL),
  delta AS (SELECT state, grp, inside, month, sum(d) AS d FROM ev GROUP BY ALL), grps AS (SELECT DISTINCT state, grp, inside FROM delta),
  stk AS (SELECT k.state, k.grp, k.inside, m.month, CAST(sum(d) AS BIGINT) AS firms FROM grps k CROSS JOIN months m JOIN delta x ON x.state = k.state AND x.grp = k.grp AND x.inside = k.inside AND x.month <= m.month GROUP BY ALL HAVING sum(d) <> 0)"""


def monthly_stock(s: Star) -> DataFrame:
    """Firms by month: +1 and -1 events at month ends, summed over a dense grid by a running window; empty
    groups are left out. No interval is joined with months."""
    seg = segments(s)
    keys = ["state", "grp", "inside"]
    up = seg.select(*keys, F.last_day("a").alias("month"), F.lit(1).alias("d"))
    down = seg.where("z IS NOT NULL").select(*keys, F.last_day("z").alias("month"), F.lit(-1).alias("d"))
    delta = kept(up.unionAll(down).groupBy(*keys, "month").agg(F.sum("d").alias("d")))
    grid = delta.select(*keys).distinct().crossJoin(F.broadcast(s.months))
    run = Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(delta, [*keys, "month"], "left").select(*keys, "month", F.sum("d").over(run).cast("bigint").alias("firms")).where("firms != 0")


op("int_stock_events", f", {_STOCK3} SELECT state, grp, inside, month, firms FROM stk")(monthly_stock)
op("fct_active_firms", f", {_STOCK3} SELECT month, state, grp, inside, firms FROM stk")(lambda s: monthly_stock(s).select("month", "state", "grp", "inside", "firms"))

_RECON = ", real AS (SELECT m.month, f.state, count(*) AS real FROM firms f JOIN months m ON f.first <= m.month AND (f.last IS NULL OR f.last > m.month) WHERE m.month IN (DATE '1997-12-31', DATE '1999-12-31') GROUP BY ALL)"


def reconstruction(s: Star) -> DataFrame:
    """Firms counted in two snapshots beside the rebuilt stock, with the relative error."""
    days = s.months.where(F.col("month").isin("1997-12-31", "1999-12-31"))
    live = (F.col("first") <= F.col("month")) & (F.col("last").isNull() | (F.col("last") > F.col("month")))
    real = s.firms.join(F.broadcast(days), live).groupBy("month", "state").agg(F.count("*").alias("real"))
    return real.join(stock(s), ["month", "state"], "left").select("month", "state", "real", F.col("firms").alias("rebuilt"), (F.col("firms") / F.col("real") - 1).alias("error"))


_REBUILT = """, moves AS (SELECT state, last_day(first) AS month, 1 AS d FROM firms UNION ALL SELECT state, last_day(last), -1 FROM firms WHERE last IS NOT NULL),
  rb AS (SELECT r.month, r.state, r.real, (SELECT CAST(sum(d) AS BIGINT) FROM moves v WHERE v.state = r.state AND v.month <= r.month) AS rebuilt FROM real r)"""
for _name in ("int_recon_validation", "mart_recon_error"):
    op(_name, f"{_RECON}{_REBUILT} SELECT month, state, real, rebuilt, CAST(rebuilt AS DOUBLE) / real - 1 AS error FROM rb")(reconstruction)


# Dimensions.
portable(
    "dim_time", "b AS (SELECT DATE '2000-01-31' AS brk)",
    "SELECT month, CAST(year(month) AS BIGINT) AS year, CAST(month(month) AS BIGINT) AS month_no, CAST(quarter(month) AS BIGINT) AS quarter, month = max(month) OVER () AS latest, CASE WHEN month < brk THEN 'before' ELSE 'after' END AS regime, "
    "month <> brk AS comparable, CASE WHEN month = brk THEN 'break' END AS breaks FROM months CROSS JOIN b",
)
portable("dim_product", "", "SELECT DISTINCT code, product, subproduct FROM fct")
portable("dim_state", "", "SELECT n_name AS state, CAST(n_nationkey AS BIGINT) AS state_code, CAST(n_regionkey AS BIGINT) AS region FROM raw_nation")
portable("dim_segment", "", "SELECT DISTINCT c_mktsegment AS segment FROM raw_customer")
portable("dim_size", "", "SELECT DISTINCT size_key, client, size_class FROM fct")
portable("dim_activity", "", "SELECT DISTINCT concat(client, ' - ', segment) AS activity_key, client, segment FROM fct")
portable("dim_firm_size", "", "SELECT DISTINCT p_size AS size_code, CASE WHEN p_size <= 10 THEN 'small' ELSE 'other' END AS size_name, 'self declared' AS note FROM raw_part")
portable("dim_legal", "", "SELECT DISTINCT grp AS legal_group, lower(grp) AS legal_name FROM firms")
op("dims", "SELECT 'state' AS dim, count(*) AS members FROM nation UNION ALL SELECT 'month', count(*) FROM months")(
    lambda s: s.raw("nation").agg(F.count("*").alias("members")).select(F.lit("state").alias("dim"), "members").unionAll(s.months.agg(F.count("*").alias("members")).select(F.lit("month"), "members"))
)

# Facts.
portable("fct_credit", "", "SELECT month, state, segment, code, size_key, client, origin, count(*) AS n, CAST(sum(operations) AS BIGINT) AS operations, " + SUMS + " FROM fct GROUP BY month, state, segment, code, size_key, client, origin")
portable("fct_credit_v1", "", "SELECT month, state, client, product, origin, CAST(amount AS DOUBLE) AS amount, CAST(overdue AS DOUBLE) AS overdue, CAST(problem AS DOUBLE) AS problem FROM fct_v1")
portable("fct_flows", "", "SELECT month, state, side, client, CAST(value AS DOUBLE) AS value, quantity FROM flows")
portable("fct_population", "", "SELECT p.year, p.state, p.population FROM population p JOIN raw_nation n ON n.n_name = p.state")
portable("fct_income", "", "SELECT year, quarter, quarter_end, state, income, CAST(mass AS DOUBLE) AS mass FROM income")


@op("fct_policy_rate", "SELECT m.month, r.rate, r.day FROM months m ASOF LEFT JOIN rates r ON m.month >= r.day")
def fct_policy_rate(s: Star) -> DataFrame:
    """The last daily value of each month, carried over months without one: grouped first, then a small window."""
    last = s.rates.groupBy(F.last_day("day").alias("month")).agg(F.max(F.struct("day", "rate")).alias("v"))
    run = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    filled = s.months.join(last, "month", "left").select("month", F.last("v", True).over(run).alias("v"))
    return filled.select("month", "v.rate", "v.day")


op("facts", "SELECT count(*) AS cells, CAST(sum(amount) AS DOUBLE) AS amount FROM fct")(lambda s: s.fct.agg(F.count("*").alias("cells"), F.sum("amount").cast("double").alias("amount")))


# Marts.
_LEVELS = f"g AS (SELECT month, product, {SUMS} FROM fct GROUP BY month, product), b AS (SELECT DATE '2000-01-31' AS brk)"


@op("mart_monthly", f""", {_LEVELS} SELECT a.month, a.product, a.amount, 100 * a.overdue / a.amount AS rate, 100 * a.problem / a.amount AS problem_rate, round(100 * a.amount / sum(a.amount) OVER (PARTITION BY a.month), 8) AS share,
  100 * (a.amount / y.amount - 1) AS growth_12m, 100 * (a.overdue / a.amount - h.overdue / h.amount) AS rate_change_6m, {ago('a.month', 6)} < brk AND brk <= a.month AS crosses_break
  FROM g a CROSS JOIN b LEFT JOIN g y ON y.product = a.product AND y.month = {ago('a.month', 12)} LEFT JOIN g h ON h.product = a.product AND h.month = {ago('a.month', 6)}""")
def mart_monthly(s: Star) -> DataFrame:
    g = kept(s.fct.groupBy("month", "product").agg(*[F.sum(c).cast("double").alias(c) for c in ("amount", "overdue", "problem")]))
    year = with_period_before(g, 12, ["product"], suffix="_12").select("month", "product", "amount_12")
    half = with_period_before(g, 6, ["product"], suffix="_6").select("month", "product", "amount_6", "overdue_6")
    both = g.join(year, ["month", "product"]).join(half, ["month", "product"])
    at = F.lit(s.p.break_month).cast("date")
    share = 100 * F.col("amount") / F.sum("amount").over(Window.partitionBy("month"))
    return both.select(
        "month", "product", "amount", (100 * F.col("overdue") / F.col("amount")).alias("rate"), (100 * F.col("problem") / F.col("amount")).alias("problem_rate"), F.round(share, 8).alias("share"),
        (100 * (F.col("amount") / F.col("amount_12") - 1)).alias("growth_12m"), (100 * (F.col("overdue") / F.col("amount") - F.col("overdue_6") / F.col("amount_6"))).alias("rate_change_6m"),
        fn.crosses(fn.months_back(F.col("month"), 6), F.col("month"), at).alias("crosses_break"),
    )


_NOW = "c AS (SELECT month, state, CAST(sum(CASE WHEN client = 'PJ' THEN amount END) AS DOUBLE) AS pj, CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(overdue) AS DOUBLE) AS overdue FROM fct GROUP BY month, state), last AS (SELECT max(month) AS top FROM c)"
portable(
    "mart_by_state",
    _NOW + """, n AS (SELECT f.state, count(*) AS firms FROM firms f CROSS JOIN last t WHERE t.top >= f.first AND (f.last IS NULL OR f.last > t.top) GROUP BY f.state),
r AS (SELECT c.*, firms, pj / firms AS per_firm, population FROM c JOIN last ON month = top LEFT JOIN n ON n.state = c.state LEFT JOIN population p ON p.state = c.state AND p.year = year(c.month)),
md AS (SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY per_firm) AS med FROM r)""",
    "SELECT state, amount, 100 * overdue / amount AS rate, per_firm, round(per_firm / med, 8) AS index_to_median, CASE WHEN per_firm < med THEN round((med - per_firm) * firms, 4) ELSE 0 END AS missing_credit, amount / population AS per_head, round(100 * amount / sum(amount) OVER (), 8) AS share FROM r CROSS JOIN md",
)

_DECISION = f""", cell AS (SELECT month, product, state, CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(overdue) AS DOUBLE) AS overdue, CAST(sum(problem) AS DOUBLE) AS problem FROM fct WHERE client = 'PJ' GROUP BY 1, 2, 3),
  l AS (SELECT max(month) AS t FROM cell), n AS (SELECT state, count(*) AS firms FROM firms, l WHERE first <= t AND (last IS NULL OR last > t) GROUP BY 1),
  cur AS (SELECT cell.*, firms FROM cell JOIN l ON month = t LEFT JOIN n USING (state)), old AS (SELECT cell.* FROM cell, l WHERE month = {ago('t', 6)}),
  j AS (SELECT cur.product, cur.state, cur.amount, cur.firms, cur.amount / cur.firms AS x, cur.overdue / cur.amount - old.overdue / old.amount AS dr,
    (cur.problem - cur.overdue) / cur.amount - (old.problem - old.overdue) / old.amount AS dg FROM cur LEFT JOIN old ON old.product = cur.product AND old.state = cur.state),
  nat AS (SELECT a.product, a.o / a.a - b.o / b.a AS ndr, (a.p - a.o) / a.a - (b.p - b.o) / b.a AS ndg FROM
    (SELECT product, sum(amount) AS a, sum(overdue) AS o, sum(problem) AS p FROM cur GROUP BY 1) a LEFT JOIN (SELECT product, sum(amount) AS a, sum(overdue) AS o, sum(problem) AS p FROM old GROUP BY 1) b ON b.product = a.product),
  med AS (SELECT product, median(x) FILTER (amount >= @CUT) AS med, count(*) FILTER (amount >= @CUT) AS above FROM j GROUP BY 1),
  z AS (SELECT j.*, ndr, ndg, med, above, CASE WHEN amount < @CUT THEN 'small' WHEN above < 3 THEN 'few groups' WHEN dr IS NULL THEN 'no comparison' END AS unrated FROM j LEFT JOIN nat USING (product) LEFT JOIN med USING (product))
  SELECT product, state, amount, unrated, CASE WHEN unrated IS NOT NULL THEN NULL WHEN x < med AND dr <= ndr THEN 'enter' WHEN x < med THEN 'watch' WHEN dr <= ndr THEN 'keep' ELSE 'stay out' END AS quadrant,
    CASE WHEN unrated IS NULL AND x < med THEN round((med - x) * firms, 4) END AS cost_of_staying_out, CASE WHEN unrated IS NULL THEN round(amount * greatest(dr, 0), 4) END AS cost_of_risk,
    coalesce(unrated IS NULL AND dg > 0 AND dg > ndg, false) AS alert FROM z"""


def decision(s: Star, cut: float) -> DataFrame:
    """Room against risk for each product and state, from one pass over the cells.

    Unrated: amount below cut, then fewer than `least_groups` groups above it, then no comparison month.
    """
    keep = kept(s.fct.where("client = 'PJ'").groupBy("month", "product", "state").agg(*[F.sum(c).cast("double").alias(c) for c in ("amount", "overdue", "problem")]))
    ends = F.broadcast(keep.agg(F.max("month").alias("t")))
    old_month = fn.months_back(F.col("t"), s.p.rate_months)
    at = lambda c, day, name: F.max(F.when(F.col("month") == day, F.col(c))).alias(name)
    two = keep.join(ends, (F.col("month") == F.col("t")) | (F.col("month") == old_month))
    cells = two.groupBy("product", "state", "t").agg(
        *[at(c, F.col("t"), c) for c in ("amount", "overdue", "problem")], *[at(c, old_month, f"{c}_0") for c in ("amount", "overdue", "problem")]
    )
    live = s.firms.join(F.broadcast(keep.agg(F.max("month").alias("t"))), (F.col("first") <= F.col("t")) & (F.col("last").isNull() | (F.col("last") > F.col("t"))))
    cells = cells.join(live.groupBy("state").agg(F.count("*").alias("firms")), "state", "left")
    change = lambda a, b, a0, b0: a / b - a0 / b0
    c = {n: F.col(n) for n in ("amount", "overdue", "problem", "amount_0", "overdue_0", "problem_0")}
    own = Window.partitionBy("product")
    tot = {n: F.sum(v).over(own) for n, v in c.items()}
    now = F.col("amount").isNotNull()
    x = F.when(now, F.col("amount") / F.col("firms"))
    above = F.col("amount") >= cut
    rated = cells.withColumns({
        "x": x, "dr": change(c["overdue"], c["amount"], c["overdue_0"], c["amount_0"]), "dg": change(c["problem"] - c["overdue"], c["amount"], c["problem_0"] - c["overdue_0"], c["amount_0"]),
        "ndr": change(tot["overdue"], tot["amount"], tot["overdue_0"], tot["amount_0"]), "ndg": change(tot["problem"] - tot["overdue"], tot["amount"], tot["problem_0"] - tot["overdue_0"], tot["amount_0"]),
        "above": F.count(F.when(above, 1)).over(own), "med": F.median(F.when(above, x)).over(own),
    }).where(now)
    unrated = F.when(~above, "small").when(F.col("above") < s.p.least_groups, "few groups").when(F.col("dr").isNull(), "no comparison")
    rated = rated.withColumn("unrated", unrated)
    ok, room, calm = F.col("unrated").isNull(), F.col("x") < F.col("med"), F.col("dr") <= F.col("ndr")
    return rated.select(
        "product", "state", "amount", "unrated", F.when(ok, F.when(room & calm, "enter").when(room, "watch").when(calm, "keep").otherwise("stay out")).alias("quadrant"),
        F.when(ok & room, F.round((F.col("med") - F.col("x")) * F.col("firms"), 4)).alias("cost_of_staying_out"), F.when(ok, F.round(F.col("amount") * F.greatest(F.col("dr"), F.lit(0.0)), 4)).alias("cost_of_risk"),
        F.coalesce(ok & (F.col("dg") > 0) & (F.col("dg") > F.col("ndg")), F.lit(False)).alias("alert"),
    )


op("mart_decision", _DECISION.replace("@CUT", "50000"))(lambda s: decision(s, s.p.cut))
portable(
    "mart_limits", "",
    "SELECT month, count(*) AS n, count(CASE WHEN suppressed THEN 1 END) AS hidden_rows, 100 * CAST(sum(CASE WHEN suppressed THEN amount ELSE 0 END) AS DOUBLE) / CAST(sum(amount) AS DOUBLE) AS hidden_share, "
    "count(CASE WHEN size_class = 'Unavailable' THEN 1 END) AS unavailable FROM fct GROUP BY month",
)
portable(
    "mart_versions",
    "a AS (SELECT month, client, product, CAST(sum(amount) AS DOUBLE) AS v2 FROM fct GROUP BY month, client, product), b AS (SELECT month, client, product, CAST(sum(amount) AS DOUBLE) AS v1 FROM fct_v1 GROUP BY month, client, product)",
    "SELECT coalesce(a.month, b.month) AS month, coalesce(a.client, b.client) AS client, coalesce(a.product, b.product) AS product, coalesce(v2, 0) AS v2, coalesce(v1, 0) AS v1, 100 * (v1 / nullif(v2, 0) - 1) AS gap_pct "
    "FROM a FULL OUTER JOIN b ON a.month = b.month AND a.client = b.client AND a.product = b.product",
)
