import re

import pytest
import regex
from pyspark.sql import functions as F

from tallyspark.llm import pii, queries

TEXT = (
    'Call +1 (487) 555-7209, pay 4929348385146306 or 4929-3483-8514-6306, id 1219538112535716, mail An.55@mail4.example.com or an.55@MAIL4.example.com, from 161.17.88.162 and 10.2.3.4. '
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" Mrs. Jane Smith met Mr Smith and г-жа Анна Петрова; 123-45-6789'
)


def luhn(n):
    d = [int(c) for c in n if c.isdigit()][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


@pytest.fixture(scope="module")
def out(spark):
    docs = spark.createDataFrame([(1, TEXT, "x"), (1, TEXT, "x"), (2, None, None), (3, "", "y"), (None, "nothing here", "z"), (4, "Again +1 487 555 7209 " + "word " * 20_000, "z")], "doc_id long, text string, _hits string")
    got = pii.pseudonymised(docs, "key", count_col="n")
    assert got.columns == [*docs.columns, "n"]
    return sorted(got.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"]))


def test_nothing_is_left(out):
    first = out[0]["text"]
    for secret in ("487", "7209", "4929348385146306", "4929-3483", "an.55", "161.17", "10.2.3.4", "04dbebab", "Jane", "Smith", "Петрова", "6789"):
        assert secret not in first, secret
    assert out[0]["n"] == 12 and out[0]["text"] == out[1]["text"]


def test_formats_stay(out):
    t = out[0]["text"]
    assert re.search(r"Call \+1 \([1-9]\d\d\) [1-9]\d\d-[1-9]\d{3},", t)
    cards = re.findall(r"\b4\d{15}\b|4\d{3}(?:-\d{4}){3}", t)
    assert len(cards) == 2 and luhn(cards[0]) and cards[0] == cards[1].replace("-", "")
    assert "1219538112535716" in t
    mails = re.findall(r"[\w.]+@[a-z]+\.example\.com", t)
    assert len(mails) == 2 and mails[0].lower() == mails[1].lower()
    assert re.search(r'token = "[0-9a-f]{40}"', t)
    assert re.search(r" 10\.\d+\.\d+\.\d+\.", t)


def test_names_keep_title_gender_script_and_link(out):
    m = re.search(r"Mrs\. (\w+) (\w+) met Mr (\w+) and г-жа (\w+) (\w+);", out[0]["text"])
    assert re.fullmatch("[A-Z][a-z]+a", m[1]) and m[2] == m[3]
    assert re.fullmatch("[А-Я][а-я]+а", m[4]) and re.fullmatch("[А-Я][а-я]+", m[5])


def test_one_number_one_surrogate_in_every_spelling(spark, out):
    spelled = ["+1 487 555 0209", "+14875550209", "+1-487-5550209", "(487) 555-0209", "487-555-0209", "+1 (487) 555-0209", "+44 20 7946 0958", "+442079460958", "+44.2079.460958"]
    docs = spark.createDataFrame([(i, f"call {x}, please") for i, x in enumerate(spelled)], "doc_id long, text string")
    got = [r["text"].removeprefix("call ").removesuffix(", please") for r in sorted(pii.pseudonymised(docs, "key").collect())]
    digits = [re.sub(r"\D", "", x) for x in got]
    assert [re.sub(r"\d", "0", x) for x in got] == [re.sub(r"\d", "0", x) for x in spelled]
    assert len({d if x.startswith("+") else "1" + d for d, x in zip(digits[:6], spelled)}) == 1 and len(set(digits[6:])) == 1
    assert digits[0].startswith("1") and digits[0] != "14875550209" and digits[6].startswith("44") and digits[6] != "442079460958"
    both = swapped(spark, ["+1 (843) 555-7672 170.106.47.9 +44 20 7946 0958 170.106.47.9"])[0].split(" ")
    assert len(both) == 9 and both[3] == both[8] != "170.106.47.9" and both[2] != "555-7672"
    later = next(r["text"] for r in out if r["doc_id"] == 4)
    assert re.match(r"Again \+1 [2-9]\d\d \d{3} \d{4} word", later) and len(later) == len("Again +1 487 555 7209 " + "word " * 20_000)


def swapped(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in sorted(pii.pseudonymised(docs, "key", **options).select("doc_id", "text").collect())]


@pytest.mark.parametrize("few", [0, 1000])
def test_surnames_stay_one_beside_many_first_names(spark, few):
    """More namesakes than any list of first names holds: the surname's surrogate is one, first names stay distinct."""
    given = [a + b for a in ("Ba", "Do", "Ke", "Li", "Mu") for b in ("ran", "vid", "los", "mek")]
    texts = [f"Mr {g} Smith came" for g in given] + ["Mr Smith came"] + [f"Mr {a}{b} left" for a in "BCDFGHJKLMNPQRSTVWXZ" for b in "aeiou"]
    got = swapped(spark, texts, few=few)
    surname = got[20].split()[1]
    words = [t.split() for t in got[:20]]
    assert {w[2] for w in words} == {surname} and surname != "Smith"
    assert len({w[1] for w in words}) == 20 and all(w[1].endswith("o") for w in words)


def test_a_full_format_of_names_grows(spark):
    """All hundred two-letter names of their format: no form of that length is free, so surrogates are longer."""
    names = [a + b for a in "BCDFGHJKLMNPQRSTVWXZ" for b in "aeiou"]
    out = [re.fullmatch(r"Mr (\w+) came", t)[1] for t in swapped(spark, [f"Mr {n} came" for n in names])]
    assert len(set(out)) == 100 and not set(out) & set(names)


def test_a_full_network_is_permuted(spark):
    """All 65,536 addresses of a private network: the surrogates are the same addresses, each once, all in it."""
    texts = [" ".join(f"192.168.{a}.{b}," for b in range(256)) for a in range(256)]
    out = [x for t in swapped(spark, texts) for x in t.replace(",", "").split()]
    own = [x for t in texts for x in t.replace(",", "").split()]
    assert len(set(out)) == 65_536 and set(out) <= {f"192.168.{a}.{b}" for a in range(256) for b in range(256)}
    assert sum(a == b for a, b in zip(own, out)) < 20


def test_permutation_is_one(spark):
    for pattern in ("{:02d}", "a{:03d}", "{:01d}"):
        n = 10 ** int(pattern[-3])
        rows = spark.createDataFrame([(pattern.format(i),) for i in range(n)], "t string")
        got = [r["p"] for r in rows.select(F.array_join(pii.permuted("k", F.lit("x"), F.lit(0), pii._chars(F.col("t"))), "").alias("p")).collect()]
        assert len(set(got)) == n


def test_edge_rows(out):
    by = {r["doc_id"]: r for r in out}
    assert by[2]["text"] is None and by[2]["n"] == 0
    assert by[3]["text"] == "" and by[3]["n"] == 0
    assert by[None]["text"] == "nothing here"


def test_collisions_are_drawn_again(spark):
    """Thirty two-letter names have a hundred forms to go to, thirty of them taken: first draws must hit some."""
    names = [a + b for a in "BCDFGH" for b in "aeiou"]
    docs = spark.createDataFrame([(i, f"Mr {n} and Mr {names[i - 1]} came") for i, n in enumerate(names)], "doc_id long, text string")
    known = pii.entities(docs)
    assert known.count() == 30
    assert pii.exceptions(known, "key").count() > 0
    out = {}
    for r in pii.pseudonymised(docs, "key").collect():
        first, second = re.fullmatch(r"Mr (\w+) and Mr (\w+) came", r["text"]).groups()
        assert out.setdefault(names[r["doc_id"]], first) == first
        assert out.setdefault(names[r["doc_id"] - 1], second) == second
    assert len(set(out.values())) == 30 and not set(out.values()) & set(names)


def test_empty_table(spark):
    assert pii.pseudonymised(spark.createDataFrame([], "doc_id long, text string"), "k").count() == 0


def entity_of(match):
    """(type, what its spellings share) by the docstring's rules, or None for a number that is no card and no phone."""
    digits = re.sub(r"\D", "", match)
    kind = next(k for k, p in pii.PATTERNS.items() if regex.fullmatch(p.replace(r"\d", "[0-9]"), match))
    if kind == "card" and not luhn(digits) or kind == "phone" and not 8 <= len(digits) <= 15:
        return None
    shared = {"email": match.lower(), "card": digits, "ssn": digits, "phone": digits if match.startswith("+") else "1" + digits}
    return kind, shared.get(kind, match)


def test_whole_table_by_a_plain_account(spark):
    """The query over all documents: what lies between entities stays, each entity has one surrogate everywhere, no two share one, none is left."""
    sf_dir = "/root/testdata/sf0.1"
    before = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op2_pii(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(before)
    any_kind = regex.compile(pii.ANY.replace(r"\d", "[0-9]"))
    given, hits = {}, 0
    for row in rows:
        text, found, at, shape = before[row["doc_id"]], [], 0, ""
        for m in any_kind.finditer(text):
            entity = entity_of(m[0])
            if entity:
                pattern = pii.PATTERNS[entity[0]].replace(r"\d", "[0-9]")
                shape += regex.escape(text[at : m.start()], literal_spaces=True) + f"({pattern})"
                found.append(entity)
                at = m.end()
        assert row["n_entities"] == len(found), row["doc_id"]
        if not found:
            assert (row["text"] or "") == text
            continue
        shape += regex.escape(text[at:], literal_spaces=True)
        whole = regex.fullmatch(shape, row["text"] or "")
        assert whole, row["doc_id"]
        for (kind, shared), new in zip(found, whole.groups()):
            again = entity_of(new)
            assert again and again[0] == kind, (kind, shared, new)
            assert given.setdefault((kind, shared), again[1]) == again[1]
            hits += 1
    assert hits > 100
    assert len(set(given.values())) == len(given)
    assert not {v for _, v in given} & set(given.values())
