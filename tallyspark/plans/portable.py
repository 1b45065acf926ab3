"""Registers statements that Spark and the oracle both run, over the canonical tables.

Statements aggregate the cells to months first and take periods, shares and ranks from that small result,
so the star join and one partial aggregate are all that grows with the data.
"""

from __future__ import annotations

import re

from ..binding import ORACLE_PREFIX, Star, kept
from ..registry import register

TABLES = ("fct", "fct_v1", "flows", "population", "income", "rates", "firms", "months")
#: Tables whose sums are kept where several parts of a statement read them.
LARGE = {"fct", "fct_v1", "flows", "income", "rates"}
#: Raw tables, named raw_<table> in statements.
RAW = ("nation", "documents", "benchmark", "embeddings", "labels", "conversations", "events", "customer", "part", "orders", "lineitem", "supplier", "region", "pages")
#: Cells summed by month and one key; sums are exact and become doubles last.
SUMS = "CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(overdue) AS DOUBLE) AS overdue, CAST(sum(problem) AS DOUBLE) AS problem"


def by(key: str, name: str = "g", where: str = "") -> str:
    """CTEs: `name` with the sums by month and key (as grp), and `last` with its last month (as top)."""
    return f"{name} AS (SELECT month, {key} AS grp, {SUMS} FROM fct {where} GROUP BY month, {key}), last AS (SELECT max(month) AS top FROM {name})"


TOTAL = f"g AS (SELECT month, {SUMS} FROM fct GROUP BY month), last AS (SELECT max(month) AS top FROM g)"


def ago(month: str, n: int) -> str:
    return f"last_day({month} - INTERVAL '{n}' MONTH)"


def entries(ctes: str) -> list[tuple[str, str]]:
    """The (name, statement) pairs of a WITH clause: each statement ends where its parenthesis closes."""
    out, at = [], 0
    while at < len(ctes):
        head = re.compile(r"[\s,]*(\w+)\s+AS\s*\(").match(ctes, at)
        if not head:
            raise ValueError(ctes[at : at + 40])
        depth, quoted, end = 1, False, head.end()
        while depth:
            c = ctes[end]
            quoted ^= c == "'"
            depth += 0 if quoted else (c == "(") - (c == ")")
            end += 1
        out.append((head[1], ctes[head.end() : end - 1]))
        at = end
    return out


def portable(name: str, ctes: str, select: str) -> None:
    """ctes are the statement's own WITH entries; tables that the text doesn't name are not bound.

    An entry that sums a large table and that later text reads more than once is kept, so that the table is
    scanned once.
    """
    parts = entries(ctes)

    def query(spark, sf_dir):
        star = Star(spark, sf_dir)
        words = set(re.findall(r"\w+", f"{ctes} {select}"))
        views = [(t, getattr(star, t)) for t in TABLES if t in words] + [(f"raw_{t}", star.raw(t)) for t in RAW if f"raw_{t}" in words]
        names, reused = [v for v, _ in views] + [n for n, _ in parts], []
        try:
            for view, df in views:
                df.createOrReplaceTempView(view)
            for k, (view, body) in enumerate(parts):
                df = spark.sql(body)
                later = " ".join([*(b for _, b in parts[k + 1 :]), select])
                if LARGE & set(re.findall(r"\w+", body)) and "GROUP BY" in body and len(re.findall(rf"(?:FROM|JOIN|,) {view}\b", later)) > 1:
                    reused.append(df)
                df.createOrReplaceTempView(view)
            found = spark.sql(select)
        finally:
            for view in names:
                spark.catalog.dropTempView(view)
        for df in reused:  # after the views are gone: dropping a view lets go of what is kept under it
            kept(df)
        return found

    oracle = f"{ORACLE_PREFIX}, {ctes} {select}" if ctes else f"{ORACLE_PREFIX} {select}"
    register(name, re.sub(r"\braw_(\w+)", r"\1", oracle))(query)
