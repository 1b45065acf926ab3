import numpy as np
import pytest

from tallyspark.llm import language
from tallyspark.llm.queries import op8_language


def test_whole_tables(spark):
    base = "/root/testdata/sf0.01"
    docs, pages = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/pages.parquet")
    got = op8_language(spark, base).collect()
    of_docs = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    of_pages = {r["page_id"]: r for r in got if r["page_id"] is not None}
    assert len(got) == docs.count() + pages.count() == len(of_docs) + len(of_pages)
    labels = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert np.mean([of_docs[i]["lang"] == x for i, x in labels.items()]) > 0.97
    marked = {r["page_id"]: r["lang"] for r in pages.select("page_id", language.declared(pages["html"]).alias("lang")).collect()}
    assert np.mean([of_pages[i]["lang"] == x for i, x in marked.items()]) > 0.9
    assert all(0 < r["confidence"] <= 1 for r in got)


def test_learns_on_some_and_tells_the_others(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen, rest = docs.where("doc_id % 3 != 1"), docs.where("doc_id % 3 = 1")
    rows = rest.selectExpr("doc_id", "lang AS truth", "text", "CAST(NULL AS STRING) AS markup", "CAST(NULL AS STRING) AS suffix", "CAST(NULL AS STRING) AS host")
    got = language.identified(rows, seen).collect()
    assert np.mean([r["lang"] == r["truth"] for r in got]) > 0.97


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([("en", "the cat and the dog went home " * 20), ("fr", "le chat et les chiens vont bien " * 20), (None, "???"), ("en", None)], "lang string, text string")


def test_edge_rows(spark, small):
    rows = [
        (1, "the dog and the cat", None, None, None), (2, "les chiens et le chat", "fr", "fr", "h"), (3, None, "fr", None, None), (4, "", None, "fr", None), (5, "", None, None, "h"), (5, "", None, None, "h"),
        (None, "le chat", "xx", "yy", "h"), (6, "les chats " * 50_000, "fr", "fr", "h"), *((10 + k, "les chiens vont", "fr", "fr", "h") for k in range(30)), *((50 + k, "the dog went home", "en", "com", "g") for k in range(30)),
    ]
    df = spark.createDataFrame([(*r, "old") for r in rows], "id long, text string, markup string, suffix string, host string, p string")
    got = language.identified(df.drop("p"), small).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r["lang"])
    assert len(got) == len(rows)
    assert by[1] == ["en"] and by[2] == ["fr"] and by[3] == ["fr"] and by[4] == ["fr"] and by[5] == ["fr", "fr"] and by[6] == ["fr"] and by[None] == ["fr"]


def test_no_labels_and_no_rows(spark, small):
    rows = spark.createDataFrame([(1, "x", None, None, None)], "id long, text string, markup string, suffix string, host string")
    assert language.identified(rows, small.limit(0)).first()["lang"] is None
    assert language.identified(rows.limit(0), small).count() == 0


def test_markup(spark):
    html = spark.createDataFrame([('<HTML lang="FR-ca"><script>var the="x"</script><p>a&amp;b</p>',), ("<p>x",), (None,)], "h string")
    got = html.select(language.declared(html["h"]).alias("d"), language.visible(html["h"]).alias("v")).collect()
    assert [r["d"] for r in got] == ["fr", None, None]
    assert "var" not in got[0]["v"] and "amp" not in got[0]["v"]


def test_more_than_64_languages_and_suffixes(spark):
    """The rarest of 70 languages is told; the rarest of 70 suffixes gives its hosts their prior."""
    own = lambda k: f"{chr(97 + k % 26) * 3}{chr(97 + k // 26) * 3}"
    docs = spark.createDataFrame([(f"l{k:02d}", f"{own(k)} " * 30) for k in range(70) for _ in range(1 if k == 69 else 2)], "lang string, text string")
    languages, _ = language.train(docs)
    assert len(languages) == 70
    schema = "id long, text string, markup string, suffix string, host string"
    told = language.identified(spark.createDataFrame([(1, f"{own(69)} " * 30, None, None, None)], schema), docs).first()
    assert told["lang"] == "l69"
    two = spark.createDataFrame([("a", "the cat and the dog " * 20), ("b", "le chat et les chiens " * 20)], "lang string, text string")
    rows = [(100 + k, "the cat and the dog", f"m{k // 2}", f"s{k // 2}", None) for k in range(140)] + [(1, "le chat et les chiens", "rare", "rare", None), (2, "", "rare", "rare", None)]
    got = {r["id"]: r["lang"] for r in language.identified(spark.createDataFrame(rows, schema), two).collect()}
    assert got[2] == "b"


@pytest.mark.parametrize("most", [None, 2])
def test_against_a_plain_account(spark, small, most):
    """Every posterior computed row by row in plain Python, with tables broadcast whole and in part."""
    languages, table = language.train(small)
    rng = np.random.default_rng(3)
    texts = ["the cat and the dog", "le chat et les chiens", "the chat", "", None, "les dog went home", "?"]
    pick = lambda options: options[rng.integers(len(options))]
    rows = [(i, pick(texts), pick(["en", "fr", "xx", None, f"m{i}"]), pick(["com", "fr", None]), pick(["h", "h", "g", None, f"own{i}"])) for i in range(120)]

    def softened(text):
        counts = language._trigrams(text)
        ll = counts @ table.T * min(1.0, language.MOST_TRIGRAMS / max(1.0, counts.sum())) / 3
        return ll - ll.max()

    lls = [softened(r[1]) for r in rows]
    ps = [np.exp(x) / np.exp(x).sum() for x in lls]
    base = sum(ps) + 1
    base = base / base.sum()
    expected = {}
    for i, r in enumerate(rows):
        other = lambda c: sum((ps[j] for j, q in enumerate(rows) if j != i and r[c] is not None and q[c] == r[c]), np.zeros(2))  # noqa: E731, B023
        m, x, h = other(2), other(3), other(4)
        told = lambda s: np.log((s + 2 * base) / ((s.sum() + 2) * base))  # noqa: E731, B023
        of_suffix = (x + 5 * base) / (x.sum() + 5)
        post = lls[i] + told(m) + (told(x) if r[4] is None else 0) + np.log((h + 5 * of_suffix) / (h.sum() + 5))
        share = np.exp(post - post.max())
        expected[i] = (languages[int(post.argmax())], 1 / share.sum())
    df = spark.createDataFrame(rows, "id long, text string, markup string, suffix string, host string")
    got = language.identified(df, small, most_broadcast=most).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, confidence = expected[r["id"]]
        assert abs(r["confidence"] - confidence) < 1e-6 and (r["lang"] == lang or confidence < 0.500001), r
