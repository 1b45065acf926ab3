"""Sources, sinks and the comparison of stored runs."""

import pytest
from compare import connect, same
from pyspark.sql import functions as F

from tallyspark import binding, registry
from tallyspark.operators.guard import compare_runs
from tallyspark.sources import scans

SAMPLE = "sink_parquet_sorted fetch_all_chunks scan_duckdb_views replay_compare q24_flow_over_stock_payer".split()


@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_sql(spark, sf_dir, name):
    same(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], connect(sf_dir))


def test_positions_follow_the_files(spark, tmp_path):
    spark.range(1000).select((999 - F.col("id")).alias("id")).repartition(5).write.parquet(str(tmp_path / "t"))
    rows = scans.positions(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert sorted(r["position"] for r in rows) == list(range(1000))
    empty = scans.write_sorted(spark.createDataFrame([], "a int, b string"), str(tmp_path / "none"))
    assert scans.positions(empty).count() == 0


def test_sorted_writes_keep_one_order(spark, tmp_path):
    df = spark.createDataFrame([(i % 7 if i % 5 else None, str(i % 3), i) for i in range(300)], "a int, b string, c int").repartition(4)
    got = scans.positions(scans.write_sorted(df, str(tmp_path / "s"))).orderBy("position").collect()
    want = sorted(df.collect(), key=lambda r: (r["a"] is None, r["a"] or 0, r["b"], r["c"]))
    assert [tuple(r)[:3] for r in got] == [tuple(r) for r in want]


@pytest.mark.parametrize("rows, size, sizes", [(0, 3, []), (6, 3, [3, 3]), (7, 3, [3, 3, 1]), (2, 5, [2])])
def test_fetch_gives_every_chunk_in_order(spark, rows, size, sizes):
    got = list(scans.fetch(spark.range(rows).orderBy("id"), size))
    assert [len(c) for c in got] == sizes
    assert [r["id"] for c in got for r in c] == list(range(rows))


def test_views_of_a_pinned_set(spark, sf_dir):
    base, _, revision = sf_dir.rpartition("/")
    assert scans.register_views(spark, base, ("region", "nation"), revision, "pinned_", materialize=True) == ["pinned_region", "pinned_nation"]
    assert spark.table("pinned_nation").count() == 25 and spark.catalog.isCached("pinned_region")
    for name in ("pinned_region", "pinned_nation"):
        spark.catalog.uncacheTable(name)


def test_runs_are_compared_key_by_key(spark):
    schema = "k string, v double, w string"
    first = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "x"), ("c", None, None), (None, 4.0, "x"), ("e", 5.0, "x"), ("g", 0.0, "x")], schema)
    again = spark.createDataFrame([("a", 1.0 + 1e-12, "x"), ("b", 2.1, "x"), ("c", None, None), (None, 4.0, "y"), ("f", 6.0, "x"), ("g", None, "x")], schema)
    got = {r["k"]: r["status"] for r in compare_runs(first, again, ["k"]).collect()}
    assert got == {"a": "same", "b": "changed", "c": "same", None: "changed", "e": "missing", "f": "new", "g": "changed"}
    assert compare_runs(first.limit(0), again.limit(0), ["k"]).count() == 0


def test_every_status_occurs_in_the_query(spark, sf_dir):
    found = {r["status"] for r in registry.queries()["replay_compare"](spark, sf_dir).collect()}
    assert found == {"same", "changed", "missing", "new"}


def test_kept_tables_are_freed(spark):
    df = binding.kept(spark.range(3).selectExpr("id * 2 AS twice"))
    assert df.count() == 3 and df.is_cached
    binding.release()
    assert not df.is_cached and df.count() == 3
