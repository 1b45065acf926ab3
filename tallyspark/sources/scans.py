"""Sources and sinks: typed or all-text reads, sorted and columnar writes, manifests.

Sources that need sample files write them below the shared folder first; readers take any path Spark reads.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import functions as fn
from ..operators.common import op
from ..operators.relational import by_month, by_state


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share; in a local one where that is unset and the session is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="tallyspark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def all_text(columns: list[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def read_text_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ";", **options: str) -> DataFrame:
    """Every column as text under the declared names: no inference, so a byte-order mark in the header is harmless."""
    return spark.read.options(sep=sep, quote='"', header="true", enforceSchema="true", **options).schema(all_text(columns)).csv(path)


@op("scan_parquet_glob", "SELECT count(*) AS n, count(DISTINCT n_regionkey) AS regions FROM nation")
def scan_parquet_glob(s):
    found = s.spark.read.parquet(f"{s.dir}/nation.par*").withColumn("ingested_at", F.current_timestamp())
    return found.where("ingested_at IS NOT NULL").agg(F.count("*").alias("n"), F.countDistinct("n_regionkey").alias("regions"))


@op("scan_csv_text", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name || '; \"x\"' AS name FROM nation")
def scan_csv_text(s):
    path = scratch(s.spark, "csv")
    dirty = s.raw("nation").select(F.col("n_nationkey").alias("﻿key"), F.concat("n_name", F.lit('; "x"')).alias("name"))
    dirty.coalesce(1).write.options(sep=";", header="true", quoteAll="true", escape='"').csv(path)
    return read_text_csv(s.spark, path, ["key", "name"], escape='"')


@op("scan_csv_multiline", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name || chr(10) || 'ção' AS name FROM nation")
def scan_csv_multiline(s):
    path = scratch(s.spark, "multiline")
    rows = s.raw("nation").select(F.col("n_nationkey").cast("string").alias("key"), F.concat("n_name", F.lit("\nção")).alias("name"))
    rows.write.options(sep=";", quoteAll="true", encoding="ISO-8859-1", maxRecordsPerFile="3000000").csv(path)
    return s.spark.read.options(sep=";", quote='"', multiLine="true", encoding="ISO-8859-1").schema(all_text(["key", "name"])).csv(path)


@op("scan_json_api", "SELECT CAST(year AS VARCHAR) AS year, state, CAST(population AS VARCHAR) AS population FROM population")
def scan_json_api(s):
    path = scratch(s.spark, "json")
    s.population.write.json(path)
    return s.spark.read.option("primitivesAsString", "true").schema(all_text(["year", "state", "population"])).json(path)


@op("scan_excel", "SELECT n_nationkey, last_value(v IGNORE NULLS) OVER (ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING) AS label FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN n_name END AS v FROM nation)")
def scan_excel(s):
    """Merged cells of a sheet: a label stands once and holds for the rows below it."""
    merged = s.raw("nation").select("n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, F.col("n_name")).alias("v"))
    return merged.select("n_nationkey", F.last("v", True).over(Window.orderBy("n_nationkey").rowsBetween(Window.unboundedPreceding, 0)).alias("label"))


@op("scan_docs")
def scan_docs(s):
    """Markup to ordered blocks: paragraphs and headings in document order, entities and tags removed."""
    body = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<(s|strike|del)>.*?</\2>", "")
    blocks = F.filter(F.split(body, r"(?i)</?(?:p|h[1-6]|li|div|br|article|nav|ul|body|head|title)\b[^>]*>"), lambda b: F.length(F.trim(F.regexp_replace(b, "<[^>]*>", ""))) > 0)
    rows = s.raw("pages").select("page_id", F.posexplode(blocks).alias("pos", "block"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("block", "<[^>]*>", ""), r"\s+", " "))
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        clean = F.replace(clean, F.lit(name), F.lit(char))
    return rows.select("page_id", F.col("pos").cast("bigint").alias("pos"), clean.alias("block"))


def register_views(spark: SparkSession, base: str, names: tuple[str, ...], revision: str = "", prefix: str = "", materialize: bool = False) -> list[str]:
    """One view a table of a set that lies under one base, at a pinned revision if one is named: base/revision/name.parquet.

    `materialize` keeps the tables' rows near the executors, in memory or on disk, until the view is uncached. Returns the view names.
    """
    root = "/".join(p.rstrip("/") for p in (base, revision) if p)
    for name in names:
        spark.read.parquet(f"{root}/{name}.parquet").createOrReplaceTempView(prefix + name)
        if materialize:
            spark.catalog.cacheTable(prefix + name)
    return [prefix + name for name in names]


@op("scan_duckdb_views", "SELECT r_name, n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def scan_duckdb_views(s):
    base, _, revision = s.dir.rstrip("/").rpartition("/")
    register_views(s.spark, base, ("customer", "nation", "region"), revision, "tally_")
    return s.spark.sql("SELECT r_name, n_name, count(*) AS customers FROM tally_customer JOIN tally_nation ON c_nationkey = n_nationkey JOIN tally_region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")


@op("scan_seed", "SELECT * FROM (VALUES (1, 'a', NULL), (2, NULL, 'x')) AS v(id, before, after)")
def scan_seed(s):
    path = scratch(s.spark, "seed")
    s.spark.createDataFrame([(1, "a", ""), (2, "", "x")], "id int, before string, after string").coalesce(1).write.options(header="true", quoteAll="true").csv(path)
    seed = s.spark.read.options(header="true", emptyValue="").schema("id int, before string, after string").csv(path)
    return seed.select("id", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("before", "after")])


def write_sorted(df: DataFrame, path: str) -> DataFrame:
    """One canonical order over all columns, nulls last, zstd; returns the table as it was read back."""
    df.orderBy(*[F.asc_nulls_last(c) for c in df.columns]).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def positions(df: DataFrame) -> DataFrame:
    """The rows of Parquet files with `position`, their place in the files taken by name; only counts by file are ranked."""
    rows = df.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select("_file", before.alias("_before")), "_file").withColumn("position", F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def row_digest(df: DataFrame) -> DataFrame:
    """Rows and a digest that doesn't depend on their order: the sum of 48-bit row hashes."""
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("digest"))


@op("sink_parquet_sorted", "SELECT state, month, product, amount, row_number() OVER (ORDER BY state NULLS LAST, month, product, amount) - 1 AS position FROM (SELECT state, month, product, CAST(sum(amount) AS DOUBLE) AS amount FROM fct GROUP BY 1, 2, 3)")
def sink_parquet_sorted(s):
    """Each row with its place in the written files, which shows their order."""
    cells = s.fct.groupBy("state", "month", "product").agg(F.sum("amount").cast("double").alias("amount"))
    return positions(write_sorted(cells, scratch(s.spark, "sorted")))


@op("sink_columnar_json", "SELECT state, list(month ORDER BY month) AS months, list(CAST(round(a, 0) AS DOUBLE) ORDER BY month) AS amounts FROM (SELECT state, CAST(month AS VARCHAR) AS month, CAST(sum(amount) AS DECIMAL(28,2)) AS a FROM fct GROUP BY 1, 2) GROUP BY 1")
def sink_columnar_json(s):
    cells = s.fct.groupBy("state", F.col("month").cast("string").alias("month")).agg(F.sum("amount").cast("decimal(28,2)").alias("a"))
    ordered = cells.groupBy("state").agg(F.sort_array(F.collect_list(F.struct("month", fn.half_up(F.col("a"), 0).cast("double").alias("a")))).alias("x"))
    return ordered.select("state", F.col("x.month").alias("months"), F.col("x.a").alias("amounts"))


@op("sink_manifest", "SELECT 'fct' AS name, month, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM fct GROUP BY month UNION ALL SELECT 'flows', month, count(*), CAST(sum(value) AS DOUBLE) FROM flows GROUP BY month")
def sink_manifest(s):
    one = lambda name, df, c: df.groupBy("month").agg(F.count("*").alias("n"), F.sum(c).cast("double").alias("amount")).select(F.lit(name).alias("name"), "month", "n", "amount")
    return one("fct", s.fct, "amount").unionAll(one("flows", s.flows, "value"))


def fetch(df: DataFrame, rows: int = 1000):
    """The result in lists of at most so many rows, in its order: one partition and one list are held at a time, whatever the result's size."""
    held = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == rows:
            yield held
            held = []
    if held:
        yield held


@op("fetch_all_chunks", ", g AS (SELECT state, month, CAST(sum(amount) AS DOUBLE) AS amount, row_number() OVER (ORDER BY state NULLS LAST, month) - 1 AS k FROM fct GROUP BY 1, 2) SELECT k // 500 AS chunk, count(*) AS n, CAST(min(month) AS VARCHAR) AS first_month, round(sum(amount), 2) AS amount FROM g GROUP BY 1")
def fetch_all_chunks(s):
    """Every chunk of a result of states times months, the later ones included."""
    result = by_state(s).select("state", "month", "amount").orderBy(F.asc_nulls_last("state"), "month")
    found = [(i, len(rows), str(min(r["month"] for r in rows)), sum(r["amount"] for r in rows)) for i, rows in enumerate(fetch(result, 500))]
    return s.spark.createDataFrame(found, "chunk long, n long, first_month string, amount double").withColumn("amount", F.round("amount", 2))


@op("last_n_periods_filter", ", g AS (SELECT month, CAST(sum(amount) AS DOUBLE) AS amount FROM fct GROUP BY 1) SELECT month, amount FROM g WHERE month IN (SELECT month FROM g WHERE month <= DATE '2001-05-31' ORDER BY month DESC LIMIT 6)")
def last_n_periods_filter(s):
    g = by_month(s).select("month", "amount").where(F.col("month") <= F.lit("2001-05-31").cast("date"))
    return g.orderBy(F.desc("month")).limit(6)


@op("volume_sync", "SELECT count(*) AS sent FROM nation WHERE n_nationkey % 2 = 1")
def volume_sync(s):
    """What to send: files whose size differs from, or that are missing at, the other side."""
    here = s.raw("nation").select(F.col("n_name").alias("file"), F.length("n_name").alias("size"))
    there = s.raw("nation").select(F.col("n_name").alias("file"), (F.length("n_name") + F.col("n_nationkey") % 2).alias("size"))
    return here.join(there, ["file", "size"], "left_anti").agg(F.count("*").alias("sent"))
