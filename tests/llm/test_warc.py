import base64
import hashlib

import pytest

from tallyspark.llm import warc

ROWS = [
    (1, "http://a/", "<p>x</p>"), (5, "http://b/ \r\nX: y", "<p>x</p>"), (3, None, None), (4, "http://c/", ""), (-7, "http://d/", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"),
    (9, "http://e/", "z" * 300_000), (9, "http://e/", "z" * 300_000), (2**40, "http://f/", "\x00\r\n\r\n\r\n"), (8, "http://g/", "Content-Length: 9"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "header", "digest") for r in ROWS], "page_id long, url string, html string, header string, digest string")


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(spark, pages):
    got = sorted(tuple(r) for r in warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    holder = {}
    for p, _, h in ROWS:
        holder[h or ""] = max(p, holder.get(h or "", p))
    seen, expected = set(), []
    for p, _, h in ROWS:
        first = holder[h or ""] == p and (p, h) not in seen
        seen.add((p, h))
        expected.append((p, len((h or "").encode()), digest(h), "response" if first else "revisit", None if first else holder[h or ""]))
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_clashing_and_null_ids(spark):
    """One id over several payloads, null ids, repeated rows: as a plain Python account of the rules has it."""
    rows = [(5, "AAA"), (5, "BBB"), (3, "AAA"), (None, "AAA"), (None, "CCC"), (None, "CCC"), (None, "DDD"), (5, "BBB"), (-1, "CC"), (None, None), (-1, "DD"), (-1, "CC")]
    df = spark.createDataFrame([(p, "http://x/", h) for p, h in rows], "page_id long, url string, html string")
    expected, seen = [], set()
    for p, h in rows:
        ids = [q for q, g in rows if (g or "") == (h or "")]
        holder = max((q for q in ids if q is not None), default=None)
        first = p == holder and (p, h) not in seen
        seen.add((p, h))
        expected.append((p, len(h or ""), digest(h), "response" if first else "revisit", None if first else holder))
    got = [tuple(r) for r in warc.round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    heads = [r["header"] for r in warc.archive(df).headers.collect()]
    ids = [h.split("WARC-Record-ID: ")[1].split("\r")[0] for h in heads]
    assert len(set(ids)) == len(rows) and all(len(i) == len("<urn:uuid:>") + 36 for i in ids)


def test_payloads_are_stored_once_and_records_rebuilt(pages):
    kept = warc.archive(pages)
    assert kept.payloads.count() == len({r[2] or "" for r in ROWS})
    rebuilt = sorted((r["page_id"], r["payload"]) for r in warc.records(kept).collect())
    assert rebuilt == sorted((p, h or "") for p, _, h in ROWS)
    heads = [r["header"] for r in kept.headers.collect()]
    assert all(h.startswith("WARC/1.1\r\n") and h.endswith("\r\n\r\n") and h.count("\r\n\r\n") == 1 for h in heads)
    assert sum("WARC-Type: response" in h for h in heads) == kept.payloads.count()


def test_least_bytes(pages):
    kept = warc.archive(pages, least_bytes=10)
    types = {r["page_id"]: "response" in r["header"] for r in kept.headers.collect()}
    assert types[1] and types[5] and types[3] and types[4]


def test_damage_is_noticed():
    good = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [p for _, p in warc.parsed(iter([good[:5], good[5:20], good[20:] + good]))] == [b"abc", b"abc"]
    for bad in (good[:-1], good.replace(b"abc", b"abcd"), b"WARC/1.1\r\nContent-L"):
        with pytest.raises(ValueError):
            list(warc.parsed(iter([bad])))


def test_empty_table(spark, pages):
    assert warc.round_trip(pages.limit(0)).count() == 0
