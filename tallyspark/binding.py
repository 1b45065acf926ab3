"""Canonical credit tables over the given star schema, as DataFrames and as the matching SQL prefix.

The row source is lineitem with its order, customer, nation and part; a row is a credit cell with month,
state, segment, product, client type and amounts. Every model and question reads these tables only.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import month_end
from .params import DEFAULT, Params

STATE_HIDDEN = "NATION_24"
_KEPT: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    """An aggregate that several branches of a query read: computed once, in memory or on disk.

    For results of the size of a calendar times a key only; without it each branch would scan the facts
    again, since pruned branches don't share an exchange. A lost executor's part is computed again.
    `release` frees them, once the results that read them are stored.
    """
    _KEPT.append(df.cache())
    return df


def release() -> None:
    """Frees what `kept` holds; a result that is read later computes it again."""
    while _KEPT:
        _KEPT.pop().unpersist()


class Star:
    """Lazily built tables; nothing is read until an action runs, and each scan reads the used columns only."""

    def __init__(self, spark: SparkSession, sf_dir: str, params: Params = DEFAULT):
        self.spark, self.dir, self.p = spark, sf_dir, params

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        return self.raw("orders").where(F.col("o_orderdate") < F.lit(self.p.end).cast("timestamp_ntz")).withColumn("month", month_end(F.col("o_orderdate")))

    @cached_property
    def fct(self) -> DataFrame:
        """Credit cells. Dimensions are joined as they come; Spark broadcasts those it measures as small."""
        nation = self.raw("nation").select("n_nationkey", F.col("n_name").alias("state"))
        customer = self.raw("customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("segment"))
        part = self.raw("part").select("p_partkey", F.col("p_type").alias("product"), F.col("p_brand").alias("subproduct"), "p_size")
        rows = (
            self.raw("lineitem").join(self.orders.select("o_orderkey", "o_custkey", "month", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
        )
        client = F.when(F.col("l_linestatus") == "F", "PF").otherwise("PJ")
        bucket = (F.col("p_size") / 10).cast("int").cast("string")
        size = F.when(client == "PF", F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Unavailable").otherwise(F.col("o_orderpriority"))).otherwise(
            F.when(bucket == "0", "Unavailable").otherwise(bucket)
        )
        amount, discount, tax = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)")
        hidden = F.col("l_quantity") <= self.p.suppressed_most
        return rows.select(
            "month", "state", "segment", "product", "subproduct", F.concat("product", F.lit("/"), "subproduct").alias("code"), client.alias("client"),
            F.col("l_returnflag").alias("origin"), size.alias("size_class"), F.concat(client, F.lit(" - "), size).alias("size_key"),
            F.when(~hidden, F.col("l_quantity").cast("bigint")).alias("operations"), hidden.alias("suppressed"), amount.alias("amount"),
            (amount * discount).cast("decimal(20,4)").alias("overdue"), (amount * (discount + tax)).cast("decimal(20,4)").alias("problem"),
        )

    @cached_property
    def fct_v1(self) -> DataFrame:
        """The older version: the same cells without origin A from the break on."""
        kept = self.fct.where((F.col("origin") != "A") | (F.col("month") < F.lit(self.p.break_month).cast("date")))
        return kept.groupBy("month", "state", "client", "product", "origin").agg(*[F.sum(c).cast("decimal(38,4)").alias(c) for c in ("amount", "overdue", "problem")])

    @cached_property
    def flows(self) -> DataFrame:
        """Payments by month, state (null where unknown), side and client, from both ends of each payment."""
        supplier = self.raw("supplier").select("s_suppkey", "s_nationkey")
        nation = self.raw("nation").select("n_nationkey", F.nullif(F.col("n_name"), F.lit(STATE_HIDDEN)).alias("n_name"))
        payer = nation.withColumnsRenamed({"n_nationkey": "pk", "n_name": "payer"})
        receiver = nation.withColumnsRenamed({"n_nationkey": "rk", "n_name": "receiver"})
        rows = (
            self.raw("lineitem").join(self.orders.select("o_orderkey", "o_custkey", "month"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.raw("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(payer, F.col("c_nationkey") == F.col("pk")).join(receiver, F.col("s_nationkey") == F.col("rk"))
        )
        client = F.when(F.col("l_linestatus") == "F", "PF").otherwise("PJ")
        # Both sides of a sum are laid out, not those of every row.
        pairs = rows.groupBy("month", client.alias("client"), "payer", "receiver").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("value"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))
        sides = F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("state")) for c in ("payer", "receiver"))))
        return pairs.select("month", "client", "value", "quantity", sides.alias("s")).groupBy("month", F.col("s.state").alias("state"), F.col("s.side").alias("side"), "client").agg(
            F.sum("value").cast("decimal(38,2)").alias("value"), F.sum("quantity").alias("quantity")
        )

    @cached_property
    def population(self) -> DataFrame:
        years = self.spark.range(1995, 2002).select(F.col("id").alias("year"))
        nation = self.raw("nation").select(F.col("n_name").alias("state"), F.col("n_nationkey").cast("bigint").alias("k"))
        return nation.crossJoin(F.broadcast(years)).select("year", "state", (100000 + 1000 * F.col("k") + 10 * (F.col("year") - 1995)).alias("population"))

    @cached_property
    def income(self) -> DataFrame:
        """Quarterly income and its mass by state."""
        rows = self.orders.join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        price = F.col("o_totalprice").cast("decimal(18,2)")
        return rows.groupBy(F.year("o_orderdate").cast("bigint").alias("year"), F.quarter("o_orderdate").cast("bigint").alias("quarter"), F.col("n_name").alias("state")).agg(
            F.last_day(F.make_date(F.first(F.year("o_orderdate")), F.first(F.quarter("o_orderdate")) * 3, F.lit(1))).alias("quarter_end"),
            F.sum(price).cast("decimal(38,2)").alias("mass"), (F.sum(price).cast("double") / F.count(F.lit(1))).alias("income"),
        )

    @cached_property
    def rates(self) -> DataFrame:
        """A daily series: (day, rate); days without orders have no value."""
        return self.orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(
            (F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)) / 10000.0).alias("rate")
        )

    @cached_property
    def firms(self) -> DataFrame:
        """One activity interval [first, last) and one inner interval [inner_from, inner_to) per customer."""
        day = F.col("o_orderdate").cast("date")
        seen = self.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set(day)).alias("days"))
        bounds = seen.select(
            F.col("o_custkey").alias("firm"), F.get("days", F.lit(0)).alias("first"),
            F.when(F.element_at("days", -1) < F.lit("2001-01-01").cast("date"), F.element_at("days", -1)).alias("last"),
            F.get("days", F.lit(1)).alias("inner_from"), F.get("days", F.lit(2)).alias("inner_to"),
        )
        customer = self.raw("customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("grp"))
        nation = self.raw("nation").select("n_nationkey", F.col("n_name").alias("state"))
        return bounds.join(customer, F.col("firm") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("firm", "state", "grp", "first", "last", "inner_from", "inner_to")

    @cached_property
    def months(self) -> DataFrame:
        """The calendar of months with data."""
        return self.orders.select("month").distinct()

    def latest(self, df: DataFrame, column: str = "month") -> DataFrame:
        """The rows of an aggregate's last period: a one-row maximum joined on equality."""
        df = kept(df)
        top = df.agg(F.max(column).alias("_top"))
        return df.join(F.broadcast(top), F.col(column) == F.col("_top")).drop("_top")


ORACLE_PREFIX = f"""WITH ord AS (SELECT *, last_day(CAST(o_orderdate AS DATE)) AS month FROM orders WHERE o_orderdate < TIMESTAMP '{DEFAULT.end} 00:00:00'),
src AS (SELECT *, CASE WHEN l_linestatus = 'F' THEN 'PF' ELSE 'PJ' END AS client FROM lineitem JOIN ord ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey),
siz AS (SELECT *, CASE WHEN client = 'PF' THEN CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Unavailable' ELSE o_orderpriority END
  ELSE CASE WHEN p_size // 10 = 0 THEN 'Unavailable' ELSE CAST(p_size // 10 AS VARCHAR) END END AS size_class FROM src),
fct AS (SELECT month, n_name AS state, c_mktsegment AS segment, p_type AS product, p_brand AS subproduct, p_type || '/' || p_brand AS code, client, l_returnflag AS origin,
  size_class, client || ' - ' || size_class AS size_key, CASE WHEN l_quantity > {DEFAULT.suppressed_most} THEN CAST(l_quantity AS BIGINT) END AS operations, l_quantity <= {DEFAULT.suppressed_most} AS suppressed,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(20,4)) AS overdue,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(l_discount AS DECIMAL(4,2)) + CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(20,4)) AS problem FROM siz),
fct_v1 AS (SELECT month, state, client, product, origin, sum(amount) AS amount, sum(overdue) AS overdue, sum(problem) AS problem FROM fct
  WHERE origin <> 'A' OR month < DATE '{DEFAULT.break_month}' GROUP BY ALL),
pay AS (SELECT month, client, CAST(l_extendedprice AS DECIMAL(18,2)) AS value, CAST(l_quantity AS BIGINT) AS quantity, nullif(src.n_name, '{STATE_HIDDEN}') AS payer, nullif(r.n_name, '{STATE_HIDDEN}') AS receiver
  FROM src JOIN supplier ON l_suppkey = s_suppkey JOIN nation r ON s_nationkey = r.n_nationkey),
flows AS (SELECT month, state, side, client, sum(value) AS value, CAST(sum(quantity) AS BIGINT) AS quantity FROM
  (SELECT month, client, value, quantity, payer AS state, 'payer' AS side FROM pay UNION ALL SELECT month, client, value, quantity, receiver, 'receiver' FROM pay) GROUP BY ALL),
population AS (SELECT y AS year, n_name AS state, 100000 + 1000 * CAST(n_nationkey AS BIGINT) + 10 * (y - 1995) AS population FROM nation, range(1995, 2002) AS t(y)),
income AS (SELECT year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, n_name AS state, last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) AS quarter_end,
  sum(CAST(o_totalprice AS DECIMAL(18,2))) AS mass, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS income
  FROM ord JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3, 4),
rates AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 10000.0 AS rate FROM ord GROUP BY 1),
dys AS (SELECT o_custkey AS firm, list_sort(list(DISTINCT CAST(o_orderdate AS DATE))) AS d FROM ord GROUP BY 1),
firms AS (SELECT firm, n_name AS state, c_mktsegment AS grp, d[1] AS first, CASE WHEN d[-1] < DATE '2001-01-01' THEN d[-1] END AS last, d[2] AS inner_from, d[3] AS inner_to
  FROM dys JOIN customer ON firm = c_custkey JOIN nation ON c_nationkey = n_nationkey),
months AS (SELECT DISTINCT month FROM ord),
top AS (SELECT max(month) AS top FROM fct)
"""


def oracle(sql: str) -> str:
    """A statement over the canonical tables; further WITH entries begin with a comma."""
    return ORACLE_PREFIX + sql.strip()


def back(column: Column | str, n: int) -> Column:
    from .functions import months_back

    return months_back(F.col(column) if isinstance(column, str) else column, n)
