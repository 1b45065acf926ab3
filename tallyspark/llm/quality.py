"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics come from one pass over each whole text. Boosted shallow trees over the statistics of a
bounded labelled sample give paths; each path is a conjunctive rule; a lasso-penalised logistic
regression keeps few of them; the fitted model is a Spark column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import bound_batches

#: Labelled rows that the model is fitted on, those of the smallest xxhash64(id); the one bound here.
SAMPLE_ROWS = 20_000
STATS = (
    "words", "bytes_per_word", "distinct_words", "repeated_next", "most_common", "digits", "upper", "symbols", "bars",
    "punctuation", "blanks", "not_ascii", "lines", "repeated_lines", "short_words", "long_words", "bare_marks", "ends_sentence", "line_words", "capital_words",
)
_SETS = {
    "digits": b"0123456789", "upper": bytes(range(65, 91)), "symbols": b"#$%&*@^~<>{}[]\\/=+_`", "bars": b"|",
    "punctuation": b".,;:!?'\"()-", "blanks": b" \t\n\r\x0b\x0c",
}
_WEIGHTS = np.array([[c in own for own in _SETS.values()] + [c >= 128] for c in range(256)], np.float64)


def statistics(text: bytes) -> list[float]:
    """The values of STATS for a whole UTF-8 text; all are 0 for an empty one."""
    if not text:
        return [0.0] * len(STATS)
    words = text.split()
    n = max(1, len(words))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    digits, upper, symbols, bars, punctuation, blanks, high = (counts @ _WEIGHTS / len(text)).tolist()
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        float(len(words)), len(text) / n, len(seen) / n, sum(map(eq, words, words[1:])) / n, max(seen.values(), default=0) / n, digits, upper, symbols, bars,
        punctuation, blanks, high, len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)), float((lengths <= 3).sum()) / n, float((lengths >= 14).sum()) / n,
        sum(not w.isalnum() and len(w) == 1 and w < b"\x80" for w in words) / n, float(text.rstrip()[-1:] in b".!?"), len(words) / max(1, len(lines)), sum(w[:1].isupper() for w in words) / n,
    ]


def with_statistics(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """docs and a column `name` of type array<double> with STATS; null texts count as empty."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            got = [statistics(t.as_py() or b"") for t in batch.column(at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.float64()))], [*batch.schema.names, name])

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, ArrayType(DoubleType()))]))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, limit), all of which must hold


@dataclass
class RuleModel:
    bias: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self, stats: Column) -> Column:
        """The score as a column expression over the array of statistics."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for k, above, limit in rule:
                holds = holds & (stats[k] > F.lit(limit) if above else stats[k] <= F.lit(limit))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.bias + _held(x, self.rules) @ np.array(self.weights, float).reshape(-1))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _held(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for k, above, limit in rule:
            out[:, j] *= (x[:, k] > limit) if above else (x[:, k] <= limit)
    return out


def _paths(x: np.ndarray, binned: np.ndarray, limits: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path: Rule, out: dict, step: np.ndarray) -> None:
    """Grows one tree on second-order gains; notes each node's path and puts the leaves' values into step."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-3, -1, -1)
    if depth and len(rows) >= 20:
        for k, cuts in enumerate(limits):
            if len(cuts):
                gs = np.cumsum(np.bincount(binned[rows, k], grad[rows], len(cuts) + 1))[:-1]
                hs = np.cumsum(np.bincount(binned[rows, k], hess[rows], len(cuts) + 1))[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(hs < 1) | (h - hs < 1)] = -1
                if gain[i := int(gain.argmax())] > best[0]:
                    best = (gain[i], k, i)
    if path:
        out[path] = True
    if best[1] < 0:
        step[rows] = -g / (h + 1)
        return
    _, k, i = best
    low = binned[rows, k] <= i
    for side, above in ((rows[low], False), (rows[~low], True)):
        _paths(x, binned, limits, grad, hess, side, depth - 1, tuple(sorted({*path, (k, above, float(limits[k][i]))})), out, step)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 0.002, seed: int = 7) -> RuleModel:
    """x: rows of STATS; y: 0 or 1. Without rows the score is 0.5; with one class only, its smoothed share."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1 - share)))
    if len(y) < 40 or not 0 < y.sum() < len(y):
        return RuleModel(base if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    limits = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 33)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(limits)], 1)
    at, found = np.full(len(y), base), {}
    for _ in range(trees):
        p, step = _sigmoid(at), np.zeros(len(y))
        rows = np.flatnonzero(rng.random(len(y)) < 0.6)
        _paths(x, binned, limits, p - y, p * (1 - p), rows, depth, (), found, step)
        at[rows] += rate * step[rows]
    rules = list(found)
    held = _held(x, rules)
    keep = (held.mean(0) > 0.001) & (held.mean(0) < 0.999)
    rules, held = [r for r, ok in zip(rules, keep) if ok], held[:, keep]
    weights, bias = _lasso(held, y.astype(float), penalty)
    used = np.flatnonzero(np.abs(weights) > 1e-6)
    return RuleModel(float(bias), [rules[i] for i in used], [float(weights[i]) for i in used])


def _lasso(held: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty on the weights of scaled rules, by accelerated proximal steps."""
    mean, dev = held.mean(0), held.std(0) + 1e-9
    z = ((held - mean) / dev).astype(np.float32)
    w = v = np.zeros(z.shape[1], np.float32)
    b, t = float(np.log(y.mean() / (1 - y.mean()))), 1.0
    top = np.ones(z.shape[1], np.float32)
    for _ in range(12):
        top = z.T @ (z @ top)
        top /= np.linalg.norm(top) + 1e-12
    size = 4 * len(y) / (float(np.linalg.norm(z @ top)) ** 2 + len(y) + 1e-9)
    for _ in range(rounds):
        miss = (_sigmoid(z @ v + b) - y).astype(np.float32)
        new = v - size * (z.T @ miss) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - size * penalty, 0)
        b -= float(miss.mean()) * min(4.0, 4 * size * 10)
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / nt * (new - w), new, nt
    weights = w / dev
    return weights, b - float(weights @ mean)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the labelled training documents of the smallest hashes, at most sample_rows."""
    picked = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
        .where(~held_out(F.col("id"))).groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = with_statistics(texts.join(F.broadcast(picked), "id"), "stats").orderBy("id").select("stats", "y").collect()
    return np.array([r[0] for r in rows], float).reshape(-1, len(STATS)), np.array([r[1] for r in rows], int)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    return fit(*training_rows(docs, labels, id_col, text_col, label_col, sample_rows))


def _free(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def scored(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """docs with one more column, score (double, 0 to 1): null and empty texts are scored as empty, rows repeat
    as they come, an empty table stays empty. A column of docs called score is replaced."""
    name = _free(docs, "_stats")
    out = with_statistics(docs, name, text_col)
    return out.withColumn("score", model.score(F.col(name))).drop(name)


def accepted(docs: DataFrame, model: RuleModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score at least threshold, with their own columns."""
    name = _free(docs, "_stats")
    return with_statistics(docs, name, text_col).where(model.score(F.col(name)) >= threshold).drop(name)
