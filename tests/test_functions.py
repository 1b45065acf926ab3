"""Edge cases by hand: sentinels, intervals, bands, grades, guards, forecasts."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark import functions as fn
from tallyspark.operators import checks, grading, guard, statistics


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first()["x"]


def test_money_is_strict(spark):
    assert str(one(spark, " 1234,56 ", fn.money)) == "1234.56"
    with pytest.raises(Exception):
        one(spark, "12.345,00", fn.money)


@pytest.mark.parametrize("text, month", [("2024-3", 202403), ("2024-03-31", 202403), ("marco de 2024", 202403), ("Março/2024", 202403), ("em 7/2023", 202307), ("dez. 2020", 202012), ("dez 2020", 202012), ("foo 2020", None), ("", None)])
def test_months(spark, text, month):
    assert one(spark, text, fn.parse_month) == month


def test_runs_against_brute_force(spark):
    from tallyspark.operators import retrieval

    items = {1: "a definition that is looked for", 2: "short", 3: "ação é ñ números €", 4: "aaaaaaaaaaaa"}
    docs = {1: "here is a definition that is looked for, all of it", 2: "a definition that isn't", 3: "ação é ñ números €", 4: "", 5: None, 6: "aaaaaaaa", 7: "a definition that is lo" * 300}
    got = retrieval.ngram_coverage(spark.createDataFrame(list(items.items()), "item_id int, text string"), spark.createDataFrame(list(docs.items()), "doc_id int, text string"))
    expected = []
    for i, t in items.items():
        own = {t[k : k + 8] for k in range(len(t) - 7)}
        for d, u in docs.items():
            share = sum(g in (u or "") for g in own) / len(own) if own else 0
            if share >= 0.5:
                expected.append((i, d, round(share, 9)))
    assert sorted(tuple(r) for r in got.collect()) == expected and len(expected) > 3


def test_dates(spark):
    assert one(spark, "00000000", fn.date_or_null) is None
    assert one(spark, "20240229", fn.date_or_null) == dt.date(2024, 2, 29)
    with pytest.raises(Exception):
        one(spark, "20260231", fn.date_or_null)


def test_counts(spark):
    assert one(spark, "-1", lambda c: fn.count_or_null(c, "-1")) is None
    with pytest.raises(Exception):
        one(spark, "<= 15", lambda c: fn.count_or_null(c, "-1"))


@pytest.mark.parametrize("month, quarter", [("2024-01-31", "2023-12-31"), ("2024-02-29", "2023-12-31"), ("2024-03-31", "2024-03-31")])
def test_last_finished_quarter(spark, month, quarter):
    m = F.lit(month).cast("date")
    got = F.when(F.last_day(F.add_months(F.trunc(m, "quarter"), 2)) == m, m).otherwise(F.date_sub(F.trunc(m, "quarter"), 1))
    assert str(spark.range(1).select(got.alias("q")).first()["q"]) == quarter


def test_ratio_of_nothing(spark):
    assert one(spark, 0.0, lambda c: fn.ratio(F.lit(1.0), c), "double") is None


def test_bands_at_their_edge(spark):
    got = spark.createDataFrame([("relative", 100.0), ("points", 0.5), ("dimensionless", 0.2), ("exact", 5.0)], "c string, r double").select(grading.band(F.col("c"), F.col("r")).alias("b"))
    assert [round(r["b"], 12) for r in got.collect()] == [1.0, 0.05, 0.01, 0.0]


def test_violations_are_found(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "z")], "k int, v string")
    assert checks.unique(df, "k").first()["violations"] == 1
    assert checks.not_null(df, "v").first()["violations"] == 1
    assert checks.accepted(df, "v", ["a"]).first()["violations"] == 1
    assert checks.related(df, "v", df.where("v = 'a'"), "v").first()["violations"] == 1
    assert checks.severity(checks.unique(df, "k"), 0, 1).first()["status"] == "warn"


@pytest.mark.parametrize("sql, ok", [
    ("SELECT * FROM fct", True), ("SELECT 1; SELECT 2", False), ("SELECT * FROM a.fct", False), ("SELECT * FROM other", False), ("SELECT (SELECT max(x) FROM other) FROM fct", False),
    ("WITH other AS (SELECT 1) SELECT * FROM other", True), ("CREATE TABLE t AS SELECT 1", False), ("SELECT * FROM range(3)", False), ("nonsense", False),
])
def test_guard(spark, sql, ok):
    assert guard.judge(spark, sql, frozenset({"fct"})).allowed is ok


def test_row_limit(spark):
    assert [len(x) if isinstance(x, list) else x for x in guard.run_limited(spark, spark.range(7), 5)] == [5, 7]
    assert guard.run_limited(spark, spark.range(5), 5)[1] is None


def test_tails():
    assert statistics.binomial_tail(0, 0) == 1.0
    assert abs(statistics.chi2_tail(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(statistics.chi2_tail(5.991464547107979, 2) - 0.05) < 1e-9
    assert abs(statistics.t_tail(2.228138852, 10) - 0.025) < 1e-7


def test_noninferiority_level():
    """At the level found, the interval's lower end is the margin, and above it for every smaller z of a fine scan."""
    for e, f, g, h in ((40, 8, 5, 10), (80, 3, 4, 13), (10, 0, 0, 90), (50, 10, 20, 20), (5, 30, 1, 4)):
        p = statistics.noninferiority_p(e, f, g, h, -0.05)
        if (f - g) / (e + f + g + h) <= -0.05:
            assert p == 1.0
            continue
        z = statistics.NormalDist().inv_cdf(1 - p)
        assert abs(statistics.newcombe_low(e, f, g, h, z) + 0.05) < 1e-6
        assert all(statistics.newcombe_low(e, f, g, h, x) > -0.05 for x in np.arange(0.001, z - 1e-6, 0.001))


def test_no_variance_gives_no_statistic():
    assert statistics.dm_statistic(np.zeros(10), 3) is None
