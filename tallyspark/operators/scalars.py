"""Projection, cleaning and scalar functions, over cells written as raw text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..binding import Star
from .common import op

#: Raw text of line items and its SQL form: padding, decimal comma, sentinels, markers, date codes.
_RAW = """, raw AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ' ' || l_returnflag || ' ' AS flag, ' ' || replace(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',') || ' ' AS price,
  CASE WHEN l_quantity <= 5 THEN '-1 ' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS n, CASE WHEN l_linenumber = 1 THEN ' - ' ELSE ' ' || l_linestatus END AS mark,
  CASE WHEN l_linenumber = 2 THEN '0' WHEN l_linenumber = 3 THEN '00000000' ELSE strftime(l_shipdate, '%Y%m%d') END AS day, strftime(l_shipdate, '%Y-%m-%d') || ' ' AS iso FROM lineitem)"""


def raw_text(s: Star) -> DataFrame:
    flag, q, k = F.concat(F.lit(" "), F.col("l_returnflag"), F.lit(" ")), F.col("l_quantity"), F.col("l_linenumber")
    price = F.concat(F.lit(" "), F.replace(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")), F.lit(" "))
    return s.raw("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", flag.alias("flag"), price.alias("price"), F.when(q <= 5, "-1 ").otherwise(q.cast("bigint").cast("string")).alias("n"),
        F.when(k == 1, " - ").otherwise(F.concat(F.lit(" "), F.col("l_linestatus"))).alias("mark"),
        F.when(k == 2, "0").when(k == 3, "00000000").otherwise(F.date_format("l_shipdate", "yyyyMMdd")).alias("day"), F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(" ")).alias("iso"),
    )


def _raw(name: str, sql: str):
    return op(name, f"{_RAW} {sql}")


@_raw("clean_label", "SELECT trim(flag) AS label, count(*) AS n FROM raw GROUP BY 1")
def clean_label(s):
    return raw_text(s).groupBy(fn.label(F.col("flag")).alias("label")).agg(F.count("*").alias("n"))


@_raw("clean_label_marker", "SELECT nullif(trim(mark), '-') AS label, count(*) AS n FROM raw GROUP BY 1")
def clean_label_marker(s):
    return raw_text(s).groupBy(fn.label_or_null(F.col("mark")).alias("label")).agg(F.count("*").alias("n"))


@_raw("clean_money", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(replace(trim(price), ',', '.') AS DECIMAL(18,2)) AS DOUBLE) AS money FROM raw")
def clean_money(s):
    return raw_text(s).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fn.money(F.col("price")).cast("double").alias("money"))


@_raw("clean_date", "SELECT CAST(trim(iso) AS DATE) AS day, count(*) AS n FROM raw GROUP BY 1")
def clean_date(s):
    return raw_text(s).groupBy(fn.clean_date(F.col("iso")).alias("day")).agg(F.count("*").alias("n"))


@_raw("clean_count_sentinel", "SELECT CAST(nullif(trim(n), '-1') AS BIGINT) AS operations, count(*) AS n FROM raw GROUP BY 1")
def clean_count_sentinel(s):
    return raw_text(s).groupBy(fn.count_or_null(F.col("n"), "-1").alias("operations")).agg(F.count("*").alias("n"))


@_raw("clean_date_markers", "SELECT CASE WHEN trim(day) NOT IN ('0', '00000000') THEN CAST(strptime(trim(day), '%Y%m%d') AS DATE) END AS day, count(*) AS n FROM raw GROUP BY 1")
def clean_date_markers(s):
    return raw_text(s).groupBy(fn.date_or_null(F.col("day")).alias("day")).agg(F.count("*").alias("n"))


@_raw("suppression_flag", "SELECT trim(n) = '-1' AS suppressed, count(nullif(trim(n), '-1')) AS disclosed, count(*) AS n FROM raw GROUP BY 1")
def suppression_flag(s):
    return raw_text(s).groupBy(fn.is_suppressed(F.col("n"), "-1").alias("suppressed")).agg(F.count(fn.count_or_null(F.col("n"), "-1")).alias("disclosed"), F.count("*").alias("n"))


@_raw("suppression_interval", "SELECT coalesce(CAST(nullif(trim(n), '-1') AS BIGINT), 1) AS least, coalesce(CAST(nullif(trim(n), '-1') AS BIGINT), 5) AS most, count(*) AS n FROM raw GROUP BY 1, 2")
def suppression_interval(s):
    count = fn.count_or_null(F.col("n"), "-1")
    return raw_text(s).groupBy(fn.least_count(count).alias("least"), fn.most_count(count, 5).alias("most")).agg(F.count("*").alias("n"))


@_raw("two_meaning_marker", "SELECT trim(mark) = '-' AND trim(flag) = 'N' AS two_meanings, nullif(trim(mark), '-') AS mark, count(*) AS n FROM raw GROUP BY 1, 2")
def two_meaning_marker(s):
    both = (fn.label(F.col("mark")) == "-") & (fn.label(F.col("flag")) == "N")
    return raw_text(s).groupBy(both.alias("two_meanings"), fn.label_or_null(F.col("mark")).alias("mark")).agg(F.count("*").alias("n"))


@op("period_parse", """SELECT last_day(CAST(strptime(strftime(o_orderdate, '%Y%m') || '01', '%Y%m%d') AS DATE)) AS month, last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) AS quarter_end,
  CAST(strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS DATE) AS day, count(*) AS n FROM ord GROUP BY ALL""")
def period_parse(s):
    d = F.col("o_orderdate")
    quarter = F.concat(F.year(d).cast("string"), F.lpad(F.quarter(d).cast("string"), 2, "0"))
    text = s.orders.select(F.date_format(d, "yyyyMM").alias("m"), quarter.alias("q"), F.date_format(d, "dd/MM/yyyy").alias("d"))
    return text.groupBy(fn.month_of(F.col("m")).alias("month"), fn.quarter_of_code(F.col("q")).alias("quarter_end"), F.to_date("d", "dd/MM/yyyy").alias("day")).agg(F.count("*").alias("n"))


@op("disambiguate", "SELECT size_key, count(*) AS n FROM fct GROUP BY 1")
def disambiguate(s):
    return s.fct.groupBy("size_key").agg(F.count("*").alias("n"))


@op("code_prefix", "SELECT substring(product, 1, 2) AS prefix, left(state, 1) AS first, count(*) AS n FROM fct GROUP BY ALL")
def code_prefix(s):
    return s.fct.groupBy(F.substring("product", 1, 2).alias("prefix"), F.left("state", F.lit(1)).alias("first")).agg(F.count("*").alias("n"))


#: Legacy names of products by client: (product, client, official name, inferred name).
LEGACY = (("PROMO", "PF", "Credit card", None), ("PROMO", "PJ", None, "Working capital"), ("SMALL", "PF", "Vehicles", "Vehicles"), ("LARGE", "PJ", None, None), ("ECONOMY", "PF", None, "Payroll"))
_LEGACY = ", legacy AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in LEGACY) + ") AS v(product, client, official, inferred))"


def legacy(s: Star) -> DataFrame:
    return s.spark.createDataFrame(LEGACY, "product string, client string, official string, inferred string")


@op("coalesce_with_provenance", _LEGACY + """ SELECT f.product, f.client, coalesce(official, inferred) AS name, CASE WHEN official IS NOT NULL THEN 'official' WHEN inferred IS NOT NULL THEN 'inferred' ELSE 'none' END AS source, count(*) AS n
  FROM fct f LEFT JOIN legacy l ON l.product = f.product AND l.client = f.client GROUP BY ALL""")
def coalesce_with_provenance(s):
    source = F.when(F.col("official").isNotNull(), "official").when(F.col("inferred").isNotNull(), "inferred").otherwise("none")
    joined = s.fct.groupBy("product", "client").agg(F.count("*").alias("n")).join(F.broadcast(legacy(s)), ["product", "client"], "left")
    return joined.select("product", "client", F.coalesce("official", "inferred").alias("name"), source.alias("source"), "n")


@op("projection_exclude", "SELECT * EXCLUDE (r_regionkey) FROM region")
def projection_exclude(s):
    return s.raw("region").drop("r_regionkey")


@op("calendar_parts", "SELECT month, year(month) AS year, month(month) AS month_no, quarter(month) AS quarter, strftime(month, '%Y-%m') AS code FROM months")
def calendar_parts(s):
    m = F.col("month")
    return s.months.select("month", F.year(m).cast("bigint").alias("year"), F.month(m).cast("bigint").alias("month_no"), F.quarter(m).cast("bigint").alias("quarter"), F.date_format(m, "yyyy-MM").alias("code"))


@op("quarter_end", "SELECT DISTINCT year, quarter, quarter_end FROM income")
def quarter_end(s):
    keys = s.income.select("year", "quarter").distinct()
    return keys.withColumn("quarter_end", fn.quarter_end(F.col("year"), F.col("quarter")))


@op("months_distance", "SELECT month, datediff('month', month, (SELECT max(month) FROM months)) AS distance FROM months")
def months_distance(s):
    top = s.months.agg(F.max("month").alias("top"))
    return s.months.crossJoin(F.broadcast(top)).select("month", fn.months_between_starts(F.col("top"), F.col("month")).alias("distance"))


@op("null_skipping_minmax", "SELECT firm, greatest(first, inner_from) AS later, least(last, inner_to) AS earlier FROM firms")
def null_skipping_minmax(s):
    return s.firms.select("firm", F.greatest("first", "inner_from").alias("later"), F.least("last", "inner_to").alias("earlier"))


@op("safe_div", "SELECT l_linenumber, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / nullif(CAST(l_linenumber - 1 AS DOUBLE), 0) AS ratio FROM lineitem GROUP BY 1")
def safe_div(s):
    total = s.raw("lineitem").groupBy("l_linenumber").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("t"))
    return total.select("l_linenumber", fn.ratio(F.col("t"), F.col("l_linenumber") - 1).alias("ratio"))


@op("pct_growth", """, g AS (SELECT year(month) AS y, CAST(sum(amount) AS DOUBLE) AS a FROM fct GROUP BY 1)
  SELECT n.y AS year, 100.0 * (n.a / p.a - 1.0) AS growth FROM g n JOIN g p ON p.y = n.y - 1""")
def pct_growth(s):
    g = s.fct.groupBy(F.year("month").cast("bigint").alias("year")).agg(F.sum("amount").cast("double").alias("a"))
    return g.join(g.select((F.col("year") + 1).alias("year"), F.col("a").alias("b")), "year").select("year", fn.growth(F.col("a"), F.col("b")).alias("growth"))


@op("abs_sqrt_power", "SELECT n_nationkey, abs(n_nationkey - 12) AS a, round(sqrt(n_nationkey), 9) AS b, power(n_nationkey, 2) AS c FROM nation")
def abs_sqrt_power(s):
    k = F.col("n_nationkey")
    return s.raw("nation").select("n_nationkey", F.abs(k - 12).alias("a"), F.round(F.sqrt(k), 9).alias("b"), F.pow(k, 2).alias("c"))


@_raw("regex_extract", "SELECT regexp_extract(iso, '^([0-9]{4})-([0-9]{2})', 2) AS month_no, regexp_matches(trim(price), '^-?[0-9]+,[0-9][0-9]$') AS shaped, count(*) AS n FROM raw GROUP BY ALL")
def regex_extract(s):
    month = F.regexp_extract("iso", "^([0-9]{4})-([0-9]{2})", 2)
    return raw_text(s).groupBy(month.alias("month_no"), F.trim("price").rlike("^-?[0-9]+,[0-9][0-9]$").alias("shaped")).agg(F.count("*").alias("n"))


@_raw("roundtrip_check", "SELECT replace(CAST(CAST(replace(trim(price), ',', '.') AS DECIMAL(18,2)) AS VARCHAR), '.', ',') = trim(price) AS same, count(*) AS n FROM raw GROUP BY 1")
def roundtrip_check(s):
    back = F.replace(fn.money(F.col("price")).cast("string"), F.lit("."), F.lit(","))
    return raw_text(s).groupBy((back == F.trim("price")).alias("same")).agg(F.count("*").alias("n"))


@_raw("try_cast_profile", "SELECT count(*) AS n, count(TRY_CAST(trim(n) AS BIGINT)) AS numbers, count(TRY_CAST(trim(mark) AS BIGINT)) AS marks, min(TRY_CAST(trim(n) AS BIGINT)) AS low, max(TRY_CAST(trim(n) AS BIGINT)) AS high FROM raw")
def try_cast_profile(s):
    n, mark = F.trim("n").try_cast("bigint"), F.trim("mark").try_cast("bigint")
    return raw_text(s).agg(F.count("*").alias("n"), F.count(n).alias("numbers"), F.count(mark).alias("marks"), F.min(n).alias("low"), F.max(n).alias("high"))


@op("like_search", "SELECT item_id FROM benchmark WHERE lower(text) LIKE '%tion%the%'")
def like_search(s):
    return s.raw("benchmark").where(F.lower("text").like("%tion%the%")).select("item_id")


@op("concat_ws_key", "SELECT concat_ws('|', CAST(month AS VARCHAR), coalesce(state, '∅'), side, client) AS k, count(*) AS n FROM flows GROUP BY 1")
def concat_ws_key(s):
    return s.flows.groupBy(F.concat_ws("|", F.col("month").cast("string"), F.coalesce("state", F.lit("∅")), "side", "client").alias("k")).agg(F.count("*").alias("n"))


@op("text_normalize", "SELECT doc_id, trim(regexp_replace(translate(lower(text), 'áàâãäéèêëíìîïóòôõöúùûüçñ', 'aaaaaeeeeiiiiooooouuuucn'), '[_\\s-]+', ' ', 'g')) AS plain FROM documents")
def text_normalize(s):
    return s.raw("documents").select("doc_id", fn.plain(F.col("text")).alias("plain"))


_NUMBERS = {
    "1.234,56": 1234.56, "R$ 2,5 mi": 2500000.0, "1,234.5": 1234.5, "12%": 12.0, "3 bilhões": 3000000000.0, "1e3": 1000.0, "abc": None, "-7,5": -7.5, "10 mil": 10000.0, "1.234": 1.234, "2.5": 2.5,
    "1,234": 1.234, "12.345": 12.345, "5,0 p.p.": 5.0, "3 pp": 3.0, "1.234.567": 1234567.0, "1,234,567": 1234567.0, "−4": -4.0, "mil": None, "1 2": 12.0, "2,5 trilhões.": 2500000000000.0, "": None,
}


@op("parse_localized_number", "SELECT text, CAST(value AS DOUBLE) AS value FROM (VALUES " + ", ".join(f"('{k}', {'NULL' if v is None else v})" for k, v in _NUMBERS.items()) + ") AS v(text, value)")
def parse_localized_number(s):
    return s.spark.createDataFrame([(x,) for x in _NUMBERS], "text string").withColumn("value", fn.parse_number(F.col("text")))


@op("parse_month", "SELECT month, " + ", ".join(f"CAST(year(month) * 100 + month(month) AS BIGINT) AS {k}" for k in "abcdef") + " FROM months")
def parse_month(s):
    m = F.col("month")
    name = F.element_at(F.array(*[F.lit(x) for x in fn.text._MONTHS]), F.month(m))
    year = F.year(m).cast("string")
    text = [F.date_format(m, "yyyy-MM"), F.date_format(m, "MM/yyyy"), F.concat(name, F.lit("/"), year), F.date_format(m, "yyyy-MM-dd"), F.date_format(m, "yyyy-M"), F.concat(F.initcap(name), F.lit("o. de "), year)]
    return s.months.select("month", *[fn.parse_month(t).alias(k) for t, k in zip(text, "abcdef")])


#: A cell alone, in a column of flags, and in a column named acima_da_media.
_WORDS = {"Sim": (True, True, True), "NÃO": (False, False, False), "acima": (None, None, True), "Abaixo de todos": (None, None, False), "1": (None, True, None), "0": (None, False, None), "s": (None, True, None), "f": (None, False, None), "x": (None, None, None), "5,0": (None, None, None)}


@op("parse_bool_words", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', " + ", ".join({None: "NULL", True: "true", False: "false"}[x] for x in v) + ")" for k, v in _WORDS.items()) + ") AS v(word, cell, flag, named)")
def parse_bool_words(s):
    words, w = s.spark.createDataFrame([(x,) for x in _WORDS], "word string"), F.col("word")
    return words.select("word", fn.parse_bool(w).alias("cell"), fn.parse_bool(w, flags=True).alias("flag"), fn.parse_bool(w, "acima_da_media").alias("named"))


@op("half_up_round_units", "SELECT month, CAST(round(CAST(sum(amount) AS DECIMAL(28,2)), 0) AS DOUBLE) AS units, CAST(round(CAST(sum(amount) AS DECIMAL(28,2)) / 1, 1) AS DOUBLE) AS tenths FROM fct GROUP BY 1")
def half_up_round_units(s):
    total = F.sum("amount").cast("decimal(28,2)")
    return s.fct.groupBy("month").agg(fn.half_up(total, 0).cast("double").alias("units"), fn.half_up(total, 1).cast("double").alias("tenths"))


@op("sig_digits")
def sig_digits(s):
    """Ten significant digits: exponent from log10, then a rounded decimal scaling."""
    x = F.col("rate")
    scale = F.pow(F.lit(10.0), F.lit(9.0) - F.floor(F.log10(F.abs(x))))
    return s.rates.select("day", F.when(x == 0, 0.0).otherwise(F.round(x * scale) / scale).alias("rate"))


@op("hash_order_key", "SELECT conv_id, turn, sha256('seed|' || CAST(conv_id AS VARCHAR) || '|' || CAST(turn AS VARCHAR)) AS k FROM conversations")
def hash_order_key(s):
    return s.raw("conversations").select("conv_id", "turn", F.sha2(F.concat_ws("|", F.lit("seed"), "conv_id", "turn"), 256).alias("k"))


@op("locale_format", "SELECT month, 'R$ ' || translate(format('{:,.2f}', CAST(sum(amount) AS DOUBLE)), ',.', '.,') AS text FROM fct GROUP BY month")
def locale_format(s):
    return s.fct.groupBy("month").agg(fn.brl(F.sum("amount").cast("double")).alias("text"))
