import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import urls

URLS = [
    "https://A.B.example.NET/en/1?x#y", "http://net/", "http://net", "https://x.net?a=/", "no scheme", None, "", "http://example.com/de/x", "http://sub.example.com/de/", "http://example.com/De/x",
    "http://x.org/fr/", "http://org/fr", "http://borg/fr/", "ftp://notnet/", "http://É.net/a", "http://h/://net/", "http://example.net/en/", "http://user@x.net:80/a", "a\nb://x.net/c\nd",
]


def brute(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for r in urls.RULES:
        own, _, tail = r.text.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + tail) and (best is None or len(r.text) > len(best.text)):
            best = r
    return host, path, best and best.text, best and best.verdict


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "old", 1.0) for i, u in enumerate(URLS)], "page_id long, url string, host string, _x double")
    got = {r["page_id"]: r for r in urls.judged(pages).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert verdict is None or got[i]["verdict"] == verdict
        assert got[i]["verdict"] in ("allow", "block") and 0 <= got[i]["score"] <= 1


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = urls.judged(pages).collect()
    assert len(out) == pages.count()
    for r in out:
        host, path, rule, verdict = brute(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))


def test_names_that_the_method_uses(spark):
    """Columns of pages named like working columns stay as they are, and change no verdict."""
    extra = {"_rows": 5, "_blocked": 6, "_suffix": 7, "_RULED": 8, "_features": 9, "_pages": 1, "suffix": 10, "y": 11, "blocked": 12}
    plain = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 3)], "page_id long, url string")
    named = plain.withColumns({k: F.lit(v) for k, v in extra.items()})
    for most in (100_000, 2):
        got = urls.judged(named, broadcast_suffixes=most)
        assert got.columns[:-5] == named.columns
        rows = sorted(got.collect())
        assert all(r[k] == v for r in rows for k, v in extra.items())
        assert [(r["verdict"], round(r["score"], 9)) for r in rows] == [(r["verdict"], round(r["score"], 9)) for r in sorted(urls.judged(plain).collect())]


def test_learns_from_labelled_urls(spark):
    rows = [(f"https://h{i}.example.{'org' if i % 3 else 'com'}/{'a/b/c/d' if i % 2 else 'x'}/{i}", i % 2) for i in range(600)]
    known, rest = spark.createDataFrame(rows[:400], "url string, blocked int"), spark.createDataFrame([(u, b) for u, b in rows[400:]], "url string, blocked int")
    got = urls.judged(rest, rules=(), labelled=known).collect()
    assert np.mean([(r["verdict"] == "block") == (r["blocked"] == 1) for r in got]) > 0.97


def test_trees_and_column_agree(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, 4)).round(3)
    model = urls.fit(x, (x[:, 0] + x[:, 2] > 1).astype(int), trees=8)
    got = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "i int, f array<double>").select("i", model.margin(F.col("f")).alias("m")).orderBy("i").collect()
    assert np.allclose([r["m"] for r in got], model.margins(x))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "http://a.b/"), (1, "http://a.b/")]])
def test_nothing_labelled(spark, rows):
    got = urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert [(r["verdict"], r["score"]) for r in got] == [("allow", 0.5)] * len(rows)


def test_entropy_of_a_long_url_is_that_of_all_of_it(spark):
    host = "h" * 2100 + "abcdefgh" * 300
    url = f"http://{host}/" + "a" * 2100 + "0123456789" * 300
    shares = lambda t: [t.count(c) / len(t) for c in set(t)]
    bits = [-sum(p * np.log2(p) for p in shares(t)) for t in (url, host)]
    row = spark.createDataFrame([(url, host)], "url string, host string").select(urls.lexical(F.col("url"), F.col("host"), F.lit("/")).alias("x")).first()
    assert row["x"][8:10] == pytest.approx(bits)
