"""A guarded way to run one read-only statement: parse, allow-list, lineage, row and time limits.

The engine's own parser builds the tree; nothing is analysed or run before the checks pass.
"""

from __future__ import annotations

import re
import threading
from dataclasses import dataclass, field

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..binding import Star
from ..plans.portable import TABLES
from .common import op


@dataclass
class Verdict:
    allowed: bool
    reason: str = ""
    tables: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    literals: list[str] = field(default_factory=list)


def statements(sql: str) -> list[str]:
    """The statements of a text: split on semicolons outside quotes and comments."""
    clean = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    parts = re.findall(r"(?:'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|[^;'\"`])+", clean)
    return [p.strip() for p in parts if p.strip()]


_CATALYST = "org.apache.spark.sql.catalyst"


def _nodes(spark: SparkSession, plan) -> list:
    """The plan, its CTEs, its expressions and the plans inside those."""
    gateway = spark.sparkContext._gateway
    out, todo = [], [plan]
    while todo:
        node = todo.pop()
        out.append(node)
        below = [node.children()]
        if is_instance_of(gateway, node, f"{_CATALYST}.plans.QueryPlan"):
            below += [node.expressions(), node.innerChildren()]
        elif is_instance_of(gateway, node, f"{_CATALYST}.expressions.PlanExpression"):
            todo.append(node.plan())
        for seq in below:
            todo += [seq.apply(i) for i in range(seq.size())]
    return out


def judge(spark: SparkSession, sql: str, allowed: frozenset[str]) -> Verdict:
    """One SELECT over allowed tables only: no commands, table functions or qualified names."""
    found = statements(sql)
    if len(found) != 1:
        return Verdict(False, f"{len(found)} statements")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(found[0])
    except Exception as e:  # the parser's own error, whichever class it has
        return Verdict(False, "not parsed: " + str(e).split("\n")[0][:80])
    nodes = _nodes(spark, plan)
    kinds = [n.getClass().getSimpleName() for n in nodes]
    if not re.match(r"(?i)\s*(select|with|\()", found[0]) or any(re.search(r"Command|Insert|Create|Drop|Show|Set[A-Z]|Describe|Explain", k) for k in kinds):
        return Verdict(False, "not a query")
    if any("TableValuedFunction" in k or "TableFunction" in k for k in kinds):
        return Verdict(False, "table function")
    ctes = {m.lower() for m in re.findall(r"(?i)(?:\bwith\b|,)\s*(\w+)\s+as\s*\(", found[0])}
    tables, columns, literals = set(), set(), set()
    for node, kind in zip(nodes, kinds):
        if kind == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            if parts.size() != 1:
                return Verdict(False, "qualified table name")
            tables.add(parts.apply(0).lower())
        elif kind == "UnresolvedAttribute":
            columns.add(node.name().lower())
        elif kind == "Literal" and node.dataType().typeName() == "string":
            literals.add(str(node.value()))
    outside = tables - ctes - allowed
    if outside:
        return Verdict(False, "table not allowed: " + ", ".join(sorted(outside)))
    return Verdict(True, "", sorted(tables - ctes), sorted(columns), sorted(literals))


_CASES = (
    "SELECT state, sum(amount) FROM fct WHERE client = 'PF' GROUP BY state", "WITH x AS (SELECT month FROM months) SELECT count(*) FROM x", "SELECT 1; SELECT 2", "DROP TABLE fct", "SELECT * FROM secrets",
    "SELECT * FROM default.fct", "SELECT * FROM range(5)", "SELECT * FROM fct -- trailing; comment", "SHOW TABLES", "SELECT ';' AS c FROM fct",
)


def _verdicts(s: Star) -> list[tuple[str, Verdict]]:
    return [(c, judge(s.spark, c, frozenset(TABLES))) for c in _CASES]


@op("guard_single_select", "SELECT * FROM (VALUES (0, true), (1, true), (2, false), (3, false), (8, false)) AS v(id, allowed)")
def guard_single_select(s):
    found = _verdicts(s)
    return s.spark.createDataFrame([(i, found[i][1].allowed) for i in (0, 1, 2, 3, 8)], "id int, allowed boolean")


@op("guard_allowlist", "SELECT * FROM (VALUES (0, true), (1, true), (4, false), (5, false), (6, false), (7, true), (9, true)) AS v(id, allowed)")
def guard_allowlist(s):
    found = _verdicts(s)
    return s.spark.createDataFrame([(i, found[i][1].allowed) for i in (0, 1, 4, 5, 6, 7, 9)], "id int, allowed boolean")


@op("guard_lineage", "SELECT 'fct' AS tables, 'amount, client, state' AS columns, 'PF' AS literals")
def guard_lineage(s):
    v = _verdicts(s)[0][1]
    return s.spark.createDataFrame([(", ".join(v.tables), ", ".join(v.columns), ", ".join(v.literals))], "tables string, columns string, literals string")


_FORBIDDEN = r"(?i)\b(insert|update|delete|drop|create|alter|truncate|merge|grant|copy|attach|install)\b"


def static_check(sql: str, allowed: frozenset[str]) -> bool:
    """The same question by patterns alone, where no engine is at hand."""
    body = re.sub(r"'(?:[^']|'')*'", "''", re.sub(r"--[^\n]*", " ", sql))
    if re.search(_FORBIDDEN, body) or ";" in body.strip().rstrip(";") or not re.match(r"(?i)\s*(select|with)\b", body):
        return False
    ctes = {m.lower() for m in re.findall(r"(?i)(?:\bwith\b|,)\s*(\w+)\s+as\s*\(", body)}
    used = {m.lower() for m in re.findall(r"(?i)\b(?:from|join)\s+([\w.]+)", body)}
    return used <= ctes | allowed


@op("guard_regex_static", "SELECT * FROM (VALUES (0, true), (1, true), (2, false), (3, false), (4, false), (5, false), (6, false), (7, true), (8, false), (9, true)) AS v(id, allowed)")
def guard_regex_static(s):
    return s.spark.createDataFrame([(i, static_check(c, frozenset(TABLES))) for i, c in enumerate(_CASES)], "id int, allowed boolean")


def run_limited(spark: SparkSession, df: DataFrame, rows: int = 100, seconds: float = 30.0) -> tuple[list, int | None]:
    """At most `rows` rows; the whole count only if there are more; a job past the limit is cancelled."""
    sc, group = spark.sparkContext, f"limited-{id(df)}"
    timer = threading.Timer(seconds, lambda: sc.cancelJobGroup(group))
    sc.setJobGroup(group, "limited query", interruptOnCancel=True)
    timer.start()
    try:
        found = df.limit(rows + 1).collect()
        return found[:rows], df.count() if len(found) > rows else None
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


@op("run_limited", "SELECT 100 AS rows, (SELECT count(*) FROM orders) AS total")
def run_limited_query(s):
    rows, total = run_limited(s.spark, s.raw("orders").select("o_orderkey"))
    return s.spark.createDataFrame([(len(rows), total)], "rows int, total long")


@op("provenance_concepts", "SELECT * FROM (VALUES ('amount', 'Outstanding balance'), ('client', 'Client type'), ('PF', 'Natural person')) AS v(token, concept)")
def provenance_concepts(s):
    """Tokens of a statement's lineage joined with an index of concepts."""
    v = _verdicts(s)[0][1]
    used = s.spark.createDataFrame([(t,) for t in (*v.columns, *v.literals)], "token string")
    index = s.spark.createDataFrame([("Outstanding balance", ["amount"]), ("Client type", ["client"]), ("Natural person", ["PF"]), ("Legal person", ["PJ"])], "concept string, tokens array<string>")
    return index.select("concept", F.explode("tokens").alias("token")).join(used, "token").select("token", "concept")


@op("schema_describe", "SELECT * FROM (VALUES ('flows', 'client'), ('flows', 'month'), ('flows', 'quantity'), ('flows', 'side'), ('flows', 'state'), ('flows', 'value'), ('population', 'population'), ('population', 'state'), ('population', 'year')) AS v(name, col)")
def schema_describe(s):
    return s.spark.createDataFrame([(t, c) for t in ("flows", "population") for c in getattr(s, t).columns], "name string, col string")


@op("join_hints", "SELECT * FROM (VALUES ('flows', 'state'), ('population', 'state'), ('income', 'state')) AS v(name, key)")
def join_hints(s):
    """Tables that hold the first column of the state dimension."""
    key = "state"
    return s.spark.createDataFrame([(t, key) for t in ("flows", "population", "income", "rates") if key in getattr(s, t).columns], "name string, key string")


@op("two_call_flow", "SELECT conv_id, count(*) AS calls, max(turn) AS last_turn FROM conversations GROUP BY 1")
def two_call_flow(s):
    """The record of a run: its calls and where it ended; generation itself is out of scope."""
    return s.raw("conversations").groupBy("conv_id").agg(F.count("*").alias("calls"), F.max("turn").alias("last_turn"))


def compare_runs(recorded: DataFrame, replayed: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(keys, status): same, changed, missing from the replay or new in it, over every value column of the record, nulls equal to nulls.

    Numbers may differ by `tolerance` relative to the larger one; other values must be equal. Keys are unique and may be null.
    """
    values = [c for c in recorded.columns if c not in keys]
    kind = dict(recorded.dtypes)

    def equal(c):
        a, b = F.col(f"r.{c}"), F.col(f"p.{c}")
        if kind[c] in ("double", "float") or kind[c].startswith("decimal"):
            near = F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))
            return a.eqNullSafe(b) | F.coalesce(near, F.lit(False))
        return a.eqNullSafe(b)

    met = F.lit(True)
    for k in keys:
        met = met & F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}"))
    same = F.lit(True)
    for c in values:
        same = same & equal(c)
    both = recorded.withColumn("_r", F.lit(1)).alias("r").join(replayed.withColumn("_p", F.lit(1)).alias("p"), met, "full")
    status = F.when(F.col("_p").isNull(), "missing").when(F.col("_r").isNull(), "new").when(same, "same").otherwise("changed")
    own = [F.when(F.col("_r").isNull(), F.col(f"p.{k}")).otherwise(F.col(f"r.{k}")).alias(k) for k in keys]
    return both.select(*own, status.alias("status"))


@op("replay_compare", """, a AS (SELECT month, state, sum(amount) AS amount FROM fct WHERE month <= DATE '2001-06-30' AND NOT (month = DATE '2001-05-31' AND product LIKE 'PROMO%') GROUP BY 1, 2), b AS (SELECT month, state, sum(amount) AS amount FROM fct WHERE month >= DATE '1995-03-31' GROUP BY 1, 2)
  SELECT coalesce(a.month, b.month) AS month, coalesce(a.state, b.state) AS state, CASE WHEN b.month IS NULL THEN 'missing' WHEN a.month IS NULL THEN 'new' WHEN a.amount = b.amount THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.month = b.month AND a.state IS NOT DISTINCT FROM b.state""")
def replay_compare(s):
    """A stored run against its replay, key by key. Of the stored one the last months hadn't come, and May 2001 lacked some products; the replay begins in March 1995."""
    from ..sources.scans import scratch

    cells = s.fct.groupBy("month", "state", F.col("product").startswith("PROMO").alias("late")).agg(F.sum("amount").alias("amount"))
    path = scratch(s.spark, "recorded")
    known = (F.col("month") <= F.lit("2001-06-30").cast("date")) & ~((F.col("month") == F.lit("2001-05-31").cast("date")) & F.col("late"))
    cells.where(known).groupBy("month", "state").agg(F.sum("amount").alias("amount")).write.parquet(path)
    replayed = cells.where(F.col("month") >= F.lit("1995-03-31").cast("date")).groupBy("month", "state").agg(F.sum("amount").alias("amount"))
    return compare_runs(s.spark.read.parquet(path), replayed, ["month", "state"])
