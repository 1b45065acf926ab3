"""Embedding near-duplicates: spherical k-means cells and blocked cosine products.

Vectors are compared within one label. Equal vectors collapse to one class first. Every class lives in
the cell of its nearest centre and visits each cell of a lower number that could hold a partner: if
cos(x, y) >= t then |x - y| <= s = sqrt(2 - 2t), and y can live in cell b while x lives in cell a only if
<x, c_a> - <x, c_b> <= s |c_a - c_b|. So no pair is missed, whatever the centres, and each is compared
once. Cells are cut into blocks of `block_rows` vectors; a task multiplies two blocks in double
precision and returns link counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, stored
from .components import connected_components

THRESHOLD = 0.98
#: Vectors that the centres are fitted on, those of the smallest xxhash64(id); centres at most; rows of a block.
SAMPLE_ROWS = 20_000
MAX_CELLS = 4096
BLOCK_ROWS = 2048
#: Slack that covers rounding in the bound on visits.
_SLACK = 1e-6


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Unit centres (at most `cells`) for rows of unit vectors."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(cells, len(x)), replace=False))]
    for _ in range(rounds):
        home = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 1e-9, sums / np.maximum(norms, 1e-9)[:, None], centres)
    return centres


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest over the true entries of near; left and right name rows and columns."""
    root: dict[int, int] = {}

    def find(a: int) -> int:
        while root.setdefault(a, a) != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    out = []
    for i in np.flatnonzero(near.any(1)).tolist():
        for j in np.flatnonzero(near[i]).tolist():
            a, b = find(int(left[i])), find(int(right[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(left[i]), int(right[j])))
    return out


def _matrix(column) -> np.ndarray:
    flat = np.asarray(column.flatten().cast(pa.float64()), np.float64)
    return flat.reshape(len(column), -1)


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS, max_cells: int = MAX_CELLS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of vectors; kept marks a group's smallest id.

    Links join rows of one label (not null) with cosine >= threshold in double precision, equal vectors
    included. Vectors that are null, empty or zero, or that hold null or non-finite components, link with
    nothing, nor do vectors of different lengths. Ids should be unique and not null; repeated ids count as
    one node for components and a row each. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    bound_batches(spark, 10_000)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    rows = rows.withColumn("v", F.when(F.col("label").isNotNull() & (F.size("v") > 0) & finite & (top > 0), F.transform("v", lambda x: x / top)))
    # Equal vectors meet by 128 bits of hash, not by their components; the first hash is free of the second's seed.
    rows = stored(rows.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit("second"), "v")}), "vector-rows")
    classes = rows.where("v IS NOT NULL").groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many"), F.any_value("v").alias("v"))
    classes = stored(classes.withColumn("u", F.transform("v", lambda x: x / norm)).withColumn("d", F.size("v")), "vector-classes")
    total = classes.count()
    zero = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not total:
        return zero.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

    # Centres: fitted for the commonest length only; vectors of any other length share one cell.
    length = classes.groupBy("d").count().orderBy(F.desc("count"), "d").first()["d"]
    sample = classes.where(F.col("d") == length).orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).select("u").toArrow()
    cells = int(min(max_cells, max(1, (total // 64) ** 0.5)))
    centres = spherical_kmeans(_matrix(sample.column("u").combine_chunks()), cells)
    shared = spark.sparkContext.broadcast(centres)  # at most max_cells vectors
    reach = (2 - 2 * threshold) ** 0.5

    def place(batches):
        c = shared.value
        for batch in batches:
            same = np.asarray(batch.column(3)) == c.shape[1]
            out = [([int(i)], [0]) for i in np.flatnonzero(~same)]
            for at in np.array_split(np.flatnonzero(same), max(1, same.sum() // 2000)):
                if len(at):
                    dots = _matrix(batch.column(2).take(pa.array(at))) @ c.T
                    home = dots.argmax(1)
                    apart = np.sqrt(np.maximum(0, 2 - 2 * c[home] @ c.T)) * reach + _SLACK
                    visit = (dots[np.arange(len(at)), home][:, None] - dots <= apart) & (np.arange(len(c))[None, :] <= home[:, None])
                    visit[np.arange(len(at)), home] = True
                    r, cell = np.nonzero(visit)
                    out.append((at[r].tolist(), np.where(cell == home[r], cell, -cell - 1).tolist()))
            picked = [i for own, _ in out for i in own]
            marks = np.array([m for _, own in out for m in own], np.int64)
            home_row = marks >= 0
            cell_of = np.where(home_row, marks, -marks - 1).astype(np.int32)
            base = batch.take(pa.array(picked, pa.int64()))
            yield pa.RecordBatch.from_arrays([*base.columns, pa.array(cell_of), pa.array(home_row)], [*batch.schema.names, "cell", "home"])

    placed = classes.select("label", "rep", "u", "d", "many").mapInArrow(place, "label string, rep long, u array<double>, d int, many long, cell int, home boolean")
    placed = stored(placed, "vector-cells")
    key = ["label", "d", "cell"]
    sizes = placed.groupBy(*key).agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("visits"))
    sizes = sizes.where("homes > 0 AND homes + visits > 1").select(
        *key, F.ceil(F.col("homes") / block_rows).cast("int").alias("hb"), F.ceil(F.col("visits") / block_rows).cast("int").alias("vb")
    )
    # A task is (cell, b, a): home block b against home block a <= b, or (a >= hb) against visitor block a - hb.
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("home"), F.col("hb")).otherwise(F.greatest("vb", F.lit(1)))).cast("int")
    cut = placed.join(sizes, key).withColumn("b", mine)
    last = F.col("hb") + F.col("vb") - 1
    as_right = F.transform(F.sequence(F.lit(0), last), lambda a: F.struct(F.greatest(F.col("b"), F.when(a < F.col("hb"), a).otherwise(F.lit(0))).alias("b"), F.when(a < F.col("hb"), F.least(a, F.col("b"))).otherwise(a).alias("a")))
    as_left = F.transform(F.sequence(F.lit(0), F.col("hb") - 1), lambda b: F.struct(b.alias("b"), (F.col("hb") + F.col("b")).alias("a")))
    tasks = cut.select("label", "d", "cell", "rep", "u", "many", "home", F.col("b").alias("own"), F.explode(F.when(F.col("home"), as_right).otherwise(as_left)).alias("t"))
    tasks = tasks.select("label", "d", "cell", F.col("t.b").alias("b"), F.col("t.a").alias("a"), "own", "home", "rep", "many", "u")

    def compare(table: pa.Table) -> pa.Table:
        b, a = table.column("b")[0].as_py(), table.column("a")[0].as_py()
        own, home = np.asarray(table.column("own")), np.asarray(table.column("home"))
        rep, many, u = np.asarray(table.column("rep")), np.asarray(table.column("many")), _matrix(table.column("u").combine_chunks())
        right = np.flatnonzero(home & (own == b))
        left = right if (same := bool(home.all()) and a == b) else np.flatnonzero(~home) if not home.all() else np.flatnonzero(home & (own == a))
        links: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        for at in range(0, len(left), 512):
            part = left[at : at + 512]
            near = u[part] @ u[right].T >= threshold
            if same:
                near &= rep[part][:, None] < rep[right][None, :]
            if near.any():
                for names, counts in ((rep[part], near @ many[right]), (rep[right], many[part] @ near)):
                    for r, n in zip(names.tolist(), counts.tolist()):
                        if n:
                            links[r] = links.get(r, 0) + n
                edges += _forest(near, rep[part], rep[right])
        cols = ([*links, *(u for u, _ in edges)], [*links.values(), *([0] * len(edges))], [*([None] * len(links)), *(v for _, v in edges)])
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["rep", "n", "other"])

    found = stored(tasks.groupBy("label", "d", "cell", "b", "a").applyInArrow(compare, "rep long, n long, other long"), "vector-links")
    counts = found.where("other IS NULL").groupBy("rep").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("other IS NOT NULL").select(F.col("rep").alias("u"), F.col("other").alias("v")))
    classed = classes.join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    classed = classed.select("label", "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).cast("long").alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    linked = rows.where("v IS NOT NULL").join(classed, ["label", "k1", "k2"]).select("vec_id", "n_links", "component_id")
    single = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(single).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
