import numpy as np
import pytest

from tallyspark.llm import embeddings


def brute(rows, threshold=0.98):
    def ok(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links = {i: 0 for i, _, _ in rows}
    root = {i: i for i in links}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, (i, v, a) in enumerate(rows):
        for j, w, b in rows[k + 1 :]:
            if a is not None and a == b and ok(v) and ok(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
    return sorted((i, links[i], find(i), find(i) == i) for i in links)


@pytest.mark.parametrize("block_rows, cells", [(2048, 512), (7, 512), (5, 1)])
def test_against_brute_force(spark, block_rows, cells):
    rng = np.random.default_rng(6)
    rows, i = [], 0
    for _ in range(60):
        centre = rng.normal(size=8)
        for _ in range(rng.integers(1, 12)):
            noise = rng.normal(size=8) * rng.choice([0, 0.02, 0.1, 0.3])
            rows.append((int(i), [float(np.float32(x)) for x in centre + noise], int(rng.integers(0, 3))))
            i += 1
    rows += [(9001, None, 1), (9002, [0.0] * 8, 1), (9003, [1.0, None] * 4, 1), (9004, [float("nan")] * 8, 1), (9005, [float("inf")] + [1.0] * 7, 1), (9006, rows[0][1], None), (9007, [1.0, 2.0], 1), (9008, [2.0, 4.0], 1), (9009, [], 1)]
    rows += [(10_000 + k, rows[5][1], rows[5][2]) for k in range(40)] + [(9010, [1e-30 * x for x in rows[5][1]], rows[5][2])]
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([(*rows[k], "x", 0) for k in order], "vec_id long, embedding array<float>, label int, cell string, rep int")
    got = embeddings.near_duplicates(df, block_rows=block_rows, max_cells=cells)
    single = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v], a) for i, v, a in rows]
    assert sorted(tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()) == brute(single)


def test_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame([(3, None, 1)], schema)).collect()] == [(3, 0, 3, True)]
