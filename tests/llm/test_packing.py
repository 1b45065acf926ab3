import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import packing


@pytest.fixture(scope="module")
def encoder():
    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        return packing.Encoder(f.read())


def defining(encoder, text):
    return encoder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_fast_ids_are_the_library_s(encoder, text):
    assert encoder.fast is not None
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == defining(encoder, text)


@pytest.mark.parametrize("text", ["", " ", "a <|endoftext|> b", "\n\n x  y\t z ", "don't", "x" * 3000, "日本語 текст ééé"])
def test_odd_texts(encoder, text):
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == defining(encoder, text)


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" + "\t" * 2_000_000 + "b", "x\u2003" * 3 + "\u2003" * 1_000_000, "z" * 2_000_000, "1" * 500_000, "?" * 500_000, "a " * 500_000], ids=list("bntuzdqa"))
def test_very_long_runs(encoder, text):
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == defining(encoder, text)


@pytest.mark.parametrize("n, expected", [(1, [(0, 1)]), (4, [(0, 4)]), (5, [(0, 1), (1, 4)]), (8, [(0, 4), (4, 4)]), (11, [(0, 3), (3, 4), (7, 4)])])
def test_cuts(n, expected):
    assert packing.cuts(n, 4) == expected


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("docs, cost", [(None, None), (3, None), (None, 3000), (2, 2500)])
def test_every_capacity_holds(rule, docs, cost):
    rng = random.Random(docs or 5)
    histogram = {}
    for _ in range(3000):
        n = rng.randint(1, 50)
        histogram[n] = histogram.get(n, 0) + 1
    plan = packing.best_fit(histogram, 100, docs, cost, rule)
    bins = {}
    for n, count in histogram.items():
        sequence, offset = plan.place(np.full(count, n), np.arange(count))
        for b, o in zip(sequence.tolist(), offset.tolist()):
            bins.setdefault(b, []).append((o, n))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 100 and len(own) <= (docs or 100) and sum(n * n for _, n in own) <= (cost or 10_000)
    if docs is None and cost is None and rule == "norm":
        assert len(bins) == -(-sum(n * c for n, c in histogram.items()) // 100)


def test_best_fit_as_done_piece_by_piece():
    """Without other capacities the runs give as many bins as classic best-fit decreasing."""
    rng = random.Random(8)
    for _ in range(20):
        sizes = [rng.randint(1, 60) for _ in range(200)]
        room = []
        for n in sorted(sizes, reverse=True):
            fit = [r for r in room if r >= n]
            if fit:
                room.remove(min(fit))
                room.append(min(fit) - n)
            else:
                room.append(100 - n)
        histogram = {n: sizes.count(n) for n in set(sizes)}
        plan = packing.best_fit(histogram, 100, weights=(1.0, 0.0, 0.0))
        used = {b for n, c in histogram.items() for b in plan.place(np.full(c, n), np.arange(c))[0].tolist()}
        assert len(used) == len(room)


def test_pieces_that_fit_nowhere():
    with pytest.raises(ValueError):
        packing.best_fit({101: 1}, 100)


@pytest.mark.parametrize("salt_rows", [packing.SALT_ROWS, 7])
def test_round_trip(spark, sf_dir, encoder, salt_rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.unionAll(spark.createDataFrame([(None, None, "x"), (-1, "", "x"), (-2, "long " * 9000, "x"), (-3, "same", "x"), (-3, "same", "x")], docs.schema))
    parts = packing.pieces(docs, packing.default_tokenizer(), with_ids=True).cache()
    rows = packing.pack(parts, salt_rows=salt_rows).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(defining(encoder, r["text"] or "") + [0])
    own, bins = {}, {}
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        own.setdefault(r["doc_id"], []).append((r["start"], r["piece"], ids))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, expected in texts.items():
        if len(expected) == 1:
            got = [x for _, _, ids in sorted(own[doc]) for x in ids]
            assert got == expected[0]
            assert [p for _, p, _ in sorted(own[doc])] == list(range(len(own[doc])))
    for pieces in bins.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(n for p in bins.values() for _, n in p)
    assert len(bins) <= -(-total // 2048) + 1


def test_repeated_ids_over_different_texts(spark):
    """Null and repeated ids, each over several texts: every piece has one place and sequences have no gap."""
    texts = ["", "a b", "long " * 3000, "\n" * 30_000, None]
    docs = spark.createDataFrame([(i, t) for i in (None, 7) for t in texts for _ in range(3)], "doc_id long, text string")
    parts = packing.pieces(docs, packing.default_tokenizer()).cache()
    rows = packing.pack(parts, salt_rows=5).collect()
    assert len(rows) == parts.count()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), packing.default_tokenizer()).count() == 0
