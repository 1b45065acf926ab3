"""Business questions over the credit cells; one statement per accepted reading."""

from __future__ import annotations

from .portable import SUMS, TOTAL, ago, by, portable

GROWTH = "100e0 * (a.amount / b.amount - 1)"


def _yoy(select: str, ctes: str, n: int = 12, on: str = "AND b.grp = a.grp", join: str = "JOIN") -> tuple[str, str]:
    return ctes, f"SELECT {select} FROM g a JOIN last ON a.month = top {join} g b ON b.month = {ago('a.month', n)} {on}"


portable("q01_yoy_total", *_yoy(f"a.month, a.amount, b.amount AS amount_before, a.amount - b.amount AS change, {GROWTH} AS change_pct", TOTAL, on=""))
for _name, _value in (("pct", GROWTH), ("abs", "a.amount - b.amount")):
    portable(f"q02_growth_{_name}", *_yoy(f"a.grp AS segment, {_value} AS growth, CAST(row_number() OVER (ORDER BY {_value} DESC NULLS LAST, a.grp) AS BIGINT) AS place", by("segment")))
portable(
    "q03_share_24m",
    "g AS (SELECT month, CAST(sum(CASE WHEN client = 'PF' THEN amount ELSE 0 END) AS DOUBLE) AS pf, CAST(sum(CASE WHEN client = 'PJ' THEN amount ELSE 0 END) AS DOUBLE) AS pj, CAST(sum(amount) AS DOUBLE) AS amount "
    "FROM fct GROUP BY month), last AS (SELECT max(month) AS top FROM g)",
    f"SELECT month, 100 * pf / amount AS share_pf, 100 * pj / amount AS share_pj FROM g CROSS JOIN last WHERE month >= {ago('top', 24)}",
)
portable(
    "q04_growth_two_windows",
    by("segment") + ", first AS (SELECT min(month) AS low FROM g)",
    f"SELECT a.grp AS segment, a.amount, 100 * (a.amount / b.amount - 1) AS growth_12m, 100 * (a.amount / c.amount - 1) AS growth_all FROM g a JOIN last ON a.month = top CROSS JOIN first "
    f"LEFT JOIN g b ON b.grp = a.grp AND b.month = {ago('a.month', 12)} LEFT JOIN g c ON c.grp = a.grp AND c.month = low",
)
portable(
    "q05_top5_cum_share",
    by("state") + ", s AS (SELECT grp, amount, 100 * amount / sum(amount) OVER () AS share, row_number() OVER (ORDER BY amount DESC, grp) AS pos FROM g JOIN last ON month = top), "
    "c AS (SELECT *, sum(share) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM s)",
    "SELECT CAST(pos AS BIGINT) AS place, grp AS state, amount, round(share, 8) AS share, round(cum, 8) AS cumulative_share FROM c WHERE pos <= 5",
)
portable("q06_rate_by_group", by("product"), "SELECT grp AS product, amount, overdue, 100 * overdue / nullif(amount, 0) AS rate FROM g JOIN last ON month = top")
for _name, _value in (("pp", "100 * (a.overdue / a.amount - b.overdue / b.amount)"), ("rel", "100 * ((a.overdue / a.amount) / nullif(b.overdue / b.amount, 0) - 1)")):
    portable(f"q07_rate_delta_{_name}", *_yoy(f"a.grp AS product, 100 * a.overdue / a.amount AS rate, 100 * b.overdue / b.amount AS rate_before, {_value} AS delta", by("product"), 6))
portable(
    "q08_vs_hist_mean",
    TOTAL + f", r AS (SELECT month, 100 * overdue / amount AS rate, top FROM g CROSS JOIN last), h AS (SELECT round(avg(rate), 8) AS mean_rate, count(*) AS points FROM r WHERE month > {ago('top', 24)})",
    "SELECT month, rate, mean_rate, points, rate > mean_rate AS above FROM r CROSS JOIN h WHERE month = top",
)
portable(
    "q09_metric_gap",
    by("product"),
    "SELECT grp AS product, problem - overdue AS gap, 100 * (problem / amount - overdue / amount) AS gap_pp, CASE WHEN month >= DATE '2000-01-31' THEN 'after' ELSE 'before' END AS regime FROM g JOIN last ON month = top",
)
portable(
    "q10_grow_and_fall",
    by("state") + ", first AS (SELECT min(month) AS low FROM g)",
    f"""SELECT a.grp AS state, a.amount > b.amount AND a.overdue / a.amount < b.overdue / b.amount AS both_12m, a.amount > c.amount AND a.overdue / a.amount < c.overdue / c.amount AS both_all
FROM g a JOIN last ON a.month = top CROSS JOIN first JOIN g b ON b.grp = a.grp AND b.month = {ago('a.month', 12)} JOIN g c ON c.grp = a.grp AND c.month = low""",
)
_PER_HEAD = by("state") + ", h AS (SELECT g.month, g.grp, amount / population AS per_head FROM g JOIN population p ON p.state = g.grp AND p.year = year(g.month))"
portable("q11_per_capita", _PER_HEAD, "SELECT grp AS state, per_head, CAST(row_number() OVER (ORDER BY per_head DESC, grp) AS BIGINT) AS place FROM h JOIN last ON month = top")
for _name, _value in (("pct", "100 * (a.per_head / b.per_head - 1)"), ("abs", "a.per_head - b.per_head")):
    portable(
        f"q12_per_capita_growth_{_name}", _PER_HEAD,
        f"SELECT a.grp AS state, a.per_head, {_value} AS growth, CAST(row_number() OVER (ORDER BY {_value} DESC, a.grp) AS BIGINT) AS place FROM h a JOIN last ON a.month = top JOIN h b ON b.grp = a.grp AND b.month = {ago('a.month', 12)}",
    )
for _name, _where in (("pf", "WHERE client = 'PF'"), ("total", "")):
    portable(
        f"q13_corr_income_{_name}",
        by("state", where=_where) + f""", q AS (SELECT DISTINCT quarter_end FROM income), m AS (SELECT DISTINCT month FROM g),
aligned AS (SELECT m.month, max(q.quarter_end) AS quarter_end FROM m JOIN q ON q.quarter_end <= m.month GROUP BY m.month),
j AS (SELECT g.month, g.grp, g.amount, i.income, top FROM g JOIN aligned ON aligned.month = g.month JOIN income i ON i.quarter_end = aligned.quarter_end AND i.state = g.grp CROSS JOIN last),
w AS (SELECT * FROM (VALUES (12), (24)) AS v(n))""",
        f"SELECT CAST(n AS BIGINT) AS months, count(*) AS points, round(corr(amount, income), 8) AS correlation FROM j JOIN w ON month > CASE WHEN n = 12 THEN {ago('top', 12)} ELSE {ago('top', 24)} END GROUP BY n",
    )
_ACTIVE = "t.top >= f.first AND (f.last IS NULL OR f.last > t.top)"
for _name, _where in (("business", "AND NOT coalesce(f.inner_from <= t.top AND (f.inner_to IS NULL OR f.inner_to > t.top), false)"), ("all", "")):
    portable(
        f"q14_underserved_{_name}",
        by("state", where="WHERE client = 'PJ'") + f""", n AS (SELECT f.state, count(*) AS firms FROM firms f CROSS JOIN last t WHERE {_ACTIVE} {_where} GROUP BY f.state),
r AS (SELECT g.grp, amount / firms AS per_firm FROM g JOIN last ON month = top JOIN n ON n.state = g.grp), md AS (SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY per_firm) AS med FROM r)""",
        "SELECT grp AS state, per_firm, round(med, 8) AS median_per_firm, per_firm < med AS underserved, CAST(row_number() OVER (ORDER BY per_firm, grp) AS BIGINT) AS place FROM r CROSS JOIN md",
    )
portable(
    "q15_months_of_income",
    by("state", where="WHERE client = 'PF'") + """, lastq AS (SELECT max(quarter_end) AS q FROM income CROSS JOIN last WHERE quarter_end <= top),
i AS (SELECT state, CAST(mass AS DOUBLE) / 3 AS mass FROM income JOIN lastq ON quarter_end = q), j AS (SELECT grp, amount, mass FROM g JOIN last ON month = top JOIN i ON i.state = grp),
b AS (SELECT sum(CAST(amount AS DECIMAL(30,4))) AS a, sum(CAST(mass AS DECIMAL(30,4))) AS m FROM j)""",
    "SELECT grp AS state, amount / mass AS months, round(CAST(a AS DOUBLE) / CAST(m AS DOUBLE), 6) AS national, amount / mass > CAST(a AS DOUBLE) / CAST(m AS DOUBLE) AS above FROM j CROSS JOIN b",
)
portable(
    "q16_two_codes_index",
    by("product") + f", s AS (SELECT month, grp, amount, 100 * amount / sum(amount) OVER (PARTITION BY month) AS share FROM g), w AS (SELECT s.* FROM s CROSS JOIN last WHERE grp IN ('PROMO', 'SMALL') AND month >= {ago('top', 24)})",
    "SELECT month, grp AS product, round(share, 8) AS share, 100 * (amount / first_value(amount) OVER (PARTITION BY grp ORDER BY month) - 1) AS growth FROM w",
)
portable("q17_absence_proof", "", "SELECT p_type AS product, count(*) AS names FROM raw_part WHERE lower(p_name) LIKE '%guarantee%' OR lower(p_type) LIKE '%m%' GROUP BY p_type")
portable(
    "q17_only_comparison",
    "g AS (SELECT month, CAST(sum(CASE WHEN product = 'PROMO' THEN overdue END) AS DOUBLE) / CAST(sum(CASE WHEN product = 'PROMO' THEN amount END) AS DOUBLE) AS own, "
    "CAST(sum(CASE WHEN product <> 'PROMO' THEN overdue END) AS DOUBLE) / CAST(sum(CASE WHEN product <> 'PROMO' THEN amount END) AS DOUBLE) AS rest FROM fct GROUP BY month)",
    "SELECT count(*) AS months, count(CASE WHEN own < rest THEN 1 END) AS months_below, round(100 * min(own - rest), 8) AS least_gap FROM g",
)
portable(
    "q18_avg_ticket",
    "g AS (SELECT month, product, CAST(sum(CASE WHEN NOT suppressed THEN amount END) AS DOUBLE) AS known, CAST(sum(operations) AS BIGINT) AS n, CAST(sum(CASE WHEN suppressed THEN amount ELSE 0 END) AS DOUBLE) AS hidden, "
    "CAST(sum(amount) AS DOUBLE) AS amount FROM fct GROUP BY month, product), last AS (SELECT max(month) AS top FROM g)",
    "SELECT product, known / n AS ticket, 100 * hidden / amount AS left_out_pct FROM g JOIN last ON month = top",
)
portable(
    "q19_group_vs_rest",
    by("CASE WHEN segment = 'BUILDING' THEN 'BUILDING' ELSE 'rest' END") + ", first AS (SELECT min(month) AS low FROM g)",
    f"SELECT a.grp, 100 * (a.amount / b.amount - 1) AS growth_12m, 100 * (a.amount / c.amount - 1) AS growth_all, 100 * a.overdue / a.amount AS rate, 100 * (a.overdue / a.amount - b.overdue / b.amount) AS rate_change "
    f"FROM g a JOIN last ON a.month = top CROSS JOIN first JOIN g b ON b.grp = a.grp AND b.month = {ago('a.month', 12)} JOIN g c ON c.grp = a.grp AND c.month = low",
)
portable(
    "q20_hhi",
    by("segment") + ", s AS (SELECT month, 100 * amount / sum(amount) OVER (PARTITION BY month) AS share FROM g)",
    "SELECT month, round(sum(power(share, 2)), 6) AS hhi, count(*) AS members FROM s GROUP BY month",
)
portable(
    "q20_top_share",
    by("segment") + ", s AS (SELECT month, grp, 100 * amount / sum(amount) OVER (PARTITION BY month) AS share FROM g), t AS (SELECT grp FROM s JOIN last ON month = top ORDER BY share DESC, grp LIMIT 1)",
    "SELECT s.month, s.grp AS segment, round(s.share, 8) AS share FROM s JOIN t ON t.grp = s.grp",
)
portable(
    "q21_share_gain",
    "g AS (SELECT month, product AS grp, CAST(sum(CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN amount ELSE 0 END) AS DOUBLE) / CAST(sum(amount) AS DOUBLE) AS share FROM fct GROUP BY month, product), last AS (SELECT max(month) AS top FROM g)",
    f"SELECT a.grp AS product, 100 * a.share AS share, 100 * b.share AS share_before, 100 * (a.share - b.share) AS gain FROM g a JOIN last ON a.month = top JOIN g b ON b.grp = a.grp AND b.month = {ago('a.month', 12)}",
)
_FLOW = "g AS (SELECT month, CAST(sum(value) AS DOUBLE) AS value, CAST(sum(quantity) AS BIGINT) AS quantity FROM flows WHERE side = 'payer' GROUP BY month), last AS (SELECT max(month) AS top FROM g)"
portable("q22_flow_growth", _FLOW + f", w AS (SELECT g.* FROM g CROSS JOIN last WHERE month >= {ago('top', 24)})", "SELECT month, value, quantity, 100 * (value / first_value(value) OVER (ORDER BY month) - 1) AS growth FROM w")
for _name, _key in (("group", "product"), ("subgroup", "code")):
    portable(
        f"q23_coincidence_{_name}",
        by(_key) + ", p AS (SELECT month, CAST(sum(value) AS DOUBLE) AS value FROM flows WHERE side = 'payer' AND client = 'PF' GROUP BY month)",
        f"SELECT a.grp, 100 * (a.amount / b.amount - 1) AS stock_growth, 100 * (c.value / d.value - 1) AS flow_growth, a.amount < b.amount AND c.value > d.value AS coincide "
        f"FROM g a JOIN last ON a.month = top JOIN g b ON b.grp = a.grp AND b.month = {ago('a.month', 12)} JOIN p c ON c.month = a.month JOIN p d ON d.month = b.month",
    )
for _side in ("payer", "receiver"):
    portable(
        f"q24_flow_over_stock_{_side}",
        by("state") + f", p AS (SELECT month, state, CAST(sum(value) AS DOUBLE) AS value FROM flows WHERE side = '{_side}' AND state IS NOT NULL GROUP BY month, state)",
        "SELECT grp AS state, value / amount AS ratio, CAST(row_number() OVER (ORDER BY value / amount DESC, grp) AS BIGINT) AS place FROM g JOIN last ON g.month = top JOIN p ON p.month = g.month AND p.state = grp",
    )
_RATE = "aligned AS (SELECT m.month, r.rate, row_number() OVER (PARTITION BY m.month ORDER BY r.day DESC) AS k FROM months m JOIN rates r ON r.day <= m.month AND r.day > last_day(m.month - INTERVAL '2' MONTH)), sel AS (SELECT month, rate FROM aligned WHERE k = 1)"
portable("q25_two_series", TOTAL + ", " + _RATE, f"SELECT g.month, sel.rate AS policy_rate, 100 * overdue / amount AS overdue_rate FROM g JOIN sel ON sel.month = g.month CROSS JOIN last WHERE g.month >= {ago('top', 24)}")
portable(
    "q26_lag_corr",
    TOTAL + ", " + _RATE + ", i AS (SELECT row_number() OVER (ORDER BY g.month) AS k, overdue / amount - lag(overdue / amount) OVER (ORDER BY g.month) AS dr, sel.rate - lag(sel.rate) OVER (ORDER BY g.month) AS ds "
    "FROM g JOIN sel ON sel.month = g.month), l AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12)) AS v(n))",
    "SELECT CAST(n AS BIGINT) AS months_later, count(a.dr + b.ds) AS pairs, round(corr(a.dr, b.ds), 8) AS correlation FROM i a CROSS JOIN l JOIN i b ON a.k = b.k + l.n GROUP BY n",
)
portable(
    "q27_drift_forecast",
    TOTAL + ", d AS (SELECT month, amount, amount - lag(amount) OVER (ORDER BY month) AS step FROM g), s AS (SELECT avg(step) AS drift, stddev_samp(step) AS dev, count(step) AS n FROM d), h AS (SELECT * FROM (VALUES (1), (2), (3)) AS v(h))",
    "SELECT CAST(h AS BIGINT) AS horizon, round(amount + h * drift, 4) AS forecast, round(amount + h * drift - 1.2815515655446004 * dev * sqrt(h * (1 + CAST(h AS DOUBLE) / n)), 4) AS low, "
    "round(amount + h * drift + 1.2815515655446004 * dev * sqrt(h * (1 + CAST(h AS DOUBLE) / n)), 4) AS high FROM d JOIN last ON month = top CROSS JOIN s CROSS JOIN h",
)
portable("q28_totals", *_yoy("a.month, a.amount, 100 * a.overdue / a.amount AS rate, 100 * a.problem / a.amount AS problem_rate, 100 * (a.amount / b.amount - 1) AS month_growth", TOTAL, 1, on=""))
for _name, _n in (("month", 1), ("12m", 12)):
    for _what, _value in (("growth", "a.amount - b.amount"), ("worse", "a.overdue / a.amount - b.overdue / b.amount")):
        _ctes, _select = _yoy(f"a.grp AS product, {_value} AS change", by("product"), _n)
        portable(f"q28_top3_{_what}_{_name}", _ctes, f"SELECT product, change FROM ({_select}) AS x ORDER BY change DESC, product LIMIT 3")
for _n in (12, 24):
    portable(
        f"q29_anomaly_{_n}",
        TOTAL + f""", u AS (SELECT month, 'amount' AS metric, amount AS v FROM g UNION ALL SELECT month, 'overdue', overdue FROM g UNION ALL SELECT month, 'problem', problem FROM g
 UNION ALL SELECT month, 'overdue_rate', 100 * overdue / amount FROM g UNION ALL SELECT month, 'problem_rate', 100 * problem / amount FROM g),
c AS (SELECT month, metric, v - lag(v) OVER (PARTITION BY metric ORDER BY month) AS d FROM u), k AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY month DESC) AS pos FROM c),
s AS (SELECT metric, avg(d) AS mean, stddev_samp(d) AS dev FROM k WHERE pos BETWEEN 2 AND {_n + 1} GROUP BY metric)""",
        "SELECT k.metric, round(d, 6) AS change, round((d - mean) / nullif(dev, 0), 6) AS z, abs((d - mean) / nullif(dev, 0)) > 2 AS odd FROM k JOIN s ON s.metric = k.metric WHERE pos = 1",
    )
portable(
    "q30_presence",
    "n AS (SELECT count(DISTINCT month) AS all_months FROM months), p AS (SELECT code, count(DISTINCT month) AS seen, min(month) AS first_month, max(month) AS last_month FROM fct GROUP BY code)",
    "SELECT code, seen, first_month, last_month, all_months - seen AS missing FROM p CROSS JOIN n WHERE seen < all_months",
)
_VERSIONS = "a AS (SELECT month, CAST(sum(amount) AS DOUBLE) AS v2 FROM fct GROUP BY month), b AS (SELECT month, CAST(sum(amount) AS DOUBLE) AS v1 FROM fct_v1 GROUP BY month)"
portable(
    "q30_comparability",
    "a AS (SELECT month, product, CAST(sum(amount) AS DOUBLE) AS v2 FROM fct GROUP BY month, product), b AS (SELECT month, product, CAST(sum(amount) AS DOUBLE) AS v1 FROM fct_v1 GROUP BY month, product)",
    "SELECT coalesce(a.month, b.month) AS month, coalesce(a.product, b.product) AS product, v2, v1, 100 * (v1 / v2 - 1) AS gap_pct FROM a FULL OUTER JOIN b ON a.month = b.month AND a.product = b.product",
)
portable(
    "q31_multi_code_total",
    by("code", where="WHERE code IN ('PROMO/Brand#1', 'PROMO/Brand#2', 'SMALL/Brand#3', 'SMALL/Brand#4', 'LARGE/Brand#5')"),
    "SELECT grp AS code, amount, round(100 * amount / sum(amount) OVER (), 8) AS share, round(sum(amount) OVER (), 4) AS total FROM g JOIN last ON month = top",
)
portable(
    "q32_composition",
    by("code") + ", p AS (SELECT grp, amount, sum(amount) OVER () AS everything FROM g JOIN last ON month = top)",
    "SELECT grp AS code, amount, round(100 * amount / sum(amount) OVER (), 8) AS share, round(100 * amount / everything, 8) AS weight FROM p WHERE grp LIKE 'PROMO/%'",
)
portable(
    "q33_polymorphic_distribution",
    f"g AS (SELECT month, client, size_key, {SUMS} FROM fct GROUP BY month, client, size_key), last AS (SELECT max(month) AS top FROM g)",
    "SELECT client, size_key, amount, round(100 * amount / sum(amount) OVER (PARTITION BY client), 8) AS share FROM g JOIN last ON month = top",
)
portable("q34_single_code", by("code", where="WHERE code = 'STANDARD/Brand#7'"), "SELECT month, grp AS code, amount, overdue FROM g JOIN last ON month = top")
portable(
    "q35_odd_combination",
    "g AS (SELECT month, CAST(sum(CASE WHEN client = 'PJ' AND size_class = 'Unavailable' THEN amount ELSE 0 END) AS DOUBLE) AS odd, count(CASE WHEN client = 'PJ' AND size_class = 'Unavailable' THEN 1 END) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM fct GROUP BY month)",
    "SELECT count(CASE WHEN n > 0 THEN 1 END) AS months, CAST(sum(n) AS BIGINT) AS cells, 100 * max(odd / amount) AS max_share FROM g",
)
_HIDDEN = "CAST(sum(CASE WHEN suppressed THEN amount ELSE 0 END) AS DOUBLE) / CAST(sum(amount) AS DOUBLE) * 100 AS amount_share, 100e0 * count(CASE WHEN suppressed THEN 1 END) / count(*) AS row_share"
portable("q36_suppressed_share", "m AS (SELECT month, amount, suppressed FROM fct), last AS (SELECT max(month) AS top FROM months)", f"SELECT 'latest' AS span, {_HIDDEN} FROM m JOIN last ON month = top UNION ALL SELECT 'all', {_HIDDEN} FROM m")
portable(
    "q37_lower_bound_count",
    "g AS (SELECT month, CAST(sum(operations) AS BIGINT) AS at_least, count(CASE WHEN suppressed THEN 1 END) AS hidden_rows, CAST(sum(CASE WHEN suppressed THEN amount ELSE 0 END) AS DOUBLE) AS hidden_amount FROM fct GROUP BY month), last AS (SELECT max(month) AS top FROM g)",
    "SELECT month, at_least, hidden_rows, hidden_amount FROM g JOIN last ON month = top",
)
for _name, _table in (("v2", "fct"), ("v1", "fct_v1")):
    portable(
        f"q38_break_effect_{_name}",
        f"""g AS (SELECT month, {SUMS} FROM {_table} GROUP BY month), u AS (SELECT month, 'amount' AS metric, amount AS v FROM g UNION ALL SELECT month, 'overdue_rate', 100 * overdue / amount FROM g UNION ALL SELECT month, 'problem_rate', 100 * problem / amount FROM g),
c AS (SELECT month, metric, v - lag(v) OVER (PARTITION BY metric ORDER BY month) AS d FROM u)""",
        "SELECT metric, round(max(CASE WHEN month = DATE '2000-01-31' THEN d END), 6) AS at_break, round(min(CASE WHEN month <> DATE '2000-01-31' THEN d END), 6) AS least_elsewhere, round(max(CASE WHEN month <> DATE '2000-01-31' THEN d END), 6) AS most_elsewhere FROM c GROUP BY metric",
    )
portable("q39_version_gap", _VERSIONS + ", x AS (SELECT a.month, v2, v1, v1 - v2 AS gap FROM a JOIN b ON a.month = b.month)", "SELECT month, v2, v1, gap, gap - lag(gap) OVER (ORDER BY month) AS gap_change FROM x")
portable(
    "q40_ambiguous_share",
    "map AS (SELECT * FROM (VALUES ('PROMO', 'PF', 'official'), ('PROMO', 'PJ', 'ambiguous'), ('SMALL', 'PF', 'inferred'), ('SMALL', 'PJ', 'inferred'), ('LARGE', 'PF', 'official'), ('LARGE', 'PJ', 'official')) AS v(product, client, rule)), "
    "j AS (SELECT f.month, f.amount, coalesce(m.rule, 'official') AS rule FROM fct f LEFT JOIN map m ON m.product = f.product AND m.client = f.client)",
    "SELECT month, 100 * CAST(sum(CASE WHEN rule = 'ambiguous' THEN amount ELSE 0 END) AS DOUBLE) / CAST(sum(amount) AS DOUBLE) AS ambiguous_pct, 100 * CAST(sum(CASE WHEN rule = 'inferred' THEN amount ELSE 0 END) AS DOUBLE) / CAST(sum(amount) AS DOUBLE) AS inferred_pct FROM j GROUP BY month",
)

# The simpler set.
_D = "CAST(sum({}) AS DOUBLE)".format
portable("d01", "last AS (SELECT max(day) AS d FROM rates)", "SELECT day, rate FROM rates JOIN last ON day = d")
portable("d02", by("state", where="WHERE client = 'PJ' AND state = 'NATION_3'"), "SELECT month, grp AS state, amount FROM g JOIN last ON month = top")
portable("d03", "", "SELECT population FROM population WHERE state = 'NATION_5' AND year = 1999")
portable("d04", by("state", where="WHERE state = 'NATION_7'"), "SELECT month, amount - overdue AS not_due FROM g JOIN last ON month = top")
portable("d05", "", "SELECT income FROM income WHERE state = 'NATION_2' AND year = 1998 AND quarter = 3")
portable("d06", TOTAL, "SELECT month, overdue FROM g JOIN last ON month = top")
portable("d07", "", "SELECT count(DISTINCT month) AS n FROM months")
portable("d08", "", "SELECT max(rate) AS highest FROM rates")
portable("d15", "", "SELECT 100 * CAST(sum(CASE WHEN origin = 'R' THEN amount ELSE 0 END) AS DOUBLE) / CAST(sum(amount) AS DOUBLE) AS share FROM fct WHERE client = 'PF' AND month = DATE '1998-06-30'")
portable("d16", by("segment", where="WHERE product = 'LARGE'"), "SELECT grp AS segment, amount, CAST(row_number() OVER (ORDER BY amount DESC, grp) AS BIGINT) AS place FROM g JOIN last ON month = top")
portable("d17", "g AS (SELECT month, CAST(sum(value) AS DOUBLE) AS value FROM flows WHERE side = 'receiver' AND client = 'PJ' AND year(month) = 2000 GROUP BY month)", "SELECT month, value FROM g ORDER BY value DESC, month LIMIT 1")
portable(
    "d18", "t AS (SELECT max(month) AS top FROM months), n AS (SELECT f.state, count(*) AS firms FROM firms f CROSS JOIN t WHERE " + _ACTIVE + " GROUP BY f.state)",
    "SELECT n.state, 1000e0 * firms / population AS per_thousand, CAST(row_number() OVER (ORDER BY 1000e0 * firms / population DESC, n.state) AS BIGINT) AS place FROM n CROSS JOIN t JOIN population p ON p.state = n.state AND p.year = year(t.top)",
)
portable(
    "d19", by("segment"),
    "SELECT grp AS segment, max(CASE WHEN month = DATE '1996-12-31' THEN amount END) AS then_amount, max(CASE WHEN month = DATE '2000-12-31' THEN amount END) AS now_amount, "
    "100 * (max(CASE WHEN month = DATE '2000-12-31' THEN amount END) / max(CASE WHEN month = DATE '1996-12-31' THEN amount END) - 1) AS growth FROM g GROUP BY grp",
)
portable(
    "d20", "g AS (SELECT month, CAST(sum(CASE WHEN client = 'PF' THEN amount ELSE 0 END) AS DOUBLE) AS pf, CAST(sum(amount) AS DOUBLE) AS amount FROM fct GROUP BY month), c AS (SELECT month, year(month) AS y, month(month) AS m FROM months)",
    "SELECT g.month, 100 * pf / amount AS share FROM g JOIN c ON c.month = g.month WHERE y = 1999 AND m <= 6",
)
portable(
    "d21", TOTAL + ", r AS (SELECT max(CASE WHEN month = DATE '1997-12-31' THEN 100 * overdue / amount END) AS then_rate, max(CASE WHEN month = DATE '2000-12-31' THEN 100 * overdue / amount END) AS now_rate FROM g)",
    "SELECT then_rate, now_rate, now_rate - then_rate AS change FROM r",
)
portable("d22", by("product"), "SELECT grp AS product, problem FROM g JOIN last ON month = top")
portable("d23", *_yoy(f"a.grp AS state, {GROWTH} AS growth, CAST(row_number() OVER (ORDER BY {GROWTH} DESC, a.grp) AS BIGINT) AS place", by("state", where="WHERE state IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4')")))
portable(
    "d24", "g AS (SELECT year, CAST(sum(mass) AS DOUBLE) AS mass FROM income GROUP BY year)",
    "SELECT a.mass AS mass_1996, b.mass AS mass_2000, 100 * (b.mass / a.mass - 1) AS growth FROM g a JOIN g b ON a.year = 1996 AND b.year = 2000",
)
portable(
    "d25", "g AS (SELECT month, CAST(sum(value) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE) AS mean_value FROM flows WHERE side = 'payer' GROUP BY month)",
    "SELECT max(CASE WHEN month = DATE '1997-06-30' THEN mean_value END) AS then_value, max(CASE WHEN month = DATE '2000-06-30' THEN mean_value END) AS now_value FROM g",
)
portable("d26", "", "SELECT state, income, CAST(mass AS DOUBLE) AS mass, income / CAST(mass AS DOUBLE) AS share FROM income WHERE state = 'NATION_9' AND year = 2000 AND quarter = 2")
portable("d27", "last AS (SELECT max(month) AS top FROM months)", f"SELECT 100 * {_D('CASE WHEN size_class = ' + chr(39) + 'Unavailable' + chr(39) + ' THEN amount ELSE 0 END')} / {_D('amount')} AS share FROM fct JOIN last ON month = top WHERE client = 'PF'")
portable("d28", TOTAL, "SELECT month, amount FROM g WHERE month IN (DATE '1999-03-31', DATE '1999-06-30', DATE '1999-09-30', DATE '1999-12-31')")
portable("d29", "", "SELECT month, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM fct_v1 WHERE month IN (DATE '1999-12-31', DATE '2000-01-31') GROUP BY month")
