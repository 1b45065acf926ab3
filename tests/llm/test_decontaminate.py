import random
import re

import pytest

from tallyspark.llm import decontaminate as dc


def brute(docs, items, threshold=0.8):
    def words(t):
        return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())

    out = []
    for d, t in docs:
        w = words(t)
        for i, u in items:
            v = words(u)
            k = min(5, len(v))
            if k:
                own = {tuple(v[a : a + k]) for a in range(len(v) - k + 1)}
                there = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}
                if len(own & there) / len(own) >= threshold - 1e-12:
                    out.append((d, i, len(own), len(own & there)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [dc.BLOCK_SHINGLES, 40])
def test_against_brute_force(spark, block):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "naïve", "x"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 8, 20, 40])))) for i in range(30)] + [(99, ""), (98, None), (97, "... !"), (0, "a repeated id with seven words here")]
    docs = []
    for d in range(60):
        w = rng.choices(vocabulary, k=rng.randint(0, 400))
        for _, t in rng.sample(items, 3):
            own = (t or "").split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if own:
                    own[rng.randrange(len(own))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = own
        docs.append((d, rng.choice([" ", "\n", ", "]).join(w).upper() if d % 2 else " ".join(w)))
    docs += [(None, items[4][1]), (70, None), (71, ""), (72, items[5][1]), (72, items[5][1])]
    left = spark.createDataFrame([(d, t, 1, 2.0) for d, t in docs], "doc_id long, text string, item_id int, containment double")
    right = spark.createDataFrame([(i, t, "k") for i, t in items], "item_id long, text string, doc_id string")
    got = dc.contamination(left, right, block=block)
    assert sorted(((r["doc_id"], r["item_id"], r["item_shingles"], r["matched"]) for r in got.collect()), key=repr) == brute(docs, items)
    hit = {d for d, *_ in brute(docs, items)}
    clean = dc.decontaminated(left, right, block=block)
    assert clean.columns == left.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, _ in docs if d not in hit and d is not None)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert dc.contamination(docs, items).count() == 0
    assert dc.decontaminated(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 1
