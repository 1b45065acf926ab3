"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

An item is contaminating where a document holds at least `threshold` of its distinct word shingles.
Items are partitioned by their number of shingles, [2^j, 2^(j+1)). In a partition whose largest item
has u shingles, an item's sketch is its k = u - ceil(threshold * u) + 1 smallest shingle hashes
(bottom-k MinHash): at most k - 1 of an item's shingles may be missing, so a document that contains
the item holds at least one hash of its sketch. Documents probe the sketches once, whatever their
length, with all their shingle hashes and not a signature: a document's own MinHash signature would lose short items in
long texts (the README has the recall). Each candidate is verified on the shingles themselves, not on hashes.

The items go out in blocks of a fixed size (`BLOCK_SHINGLES`), one broadcast and one scan a block, so
a worker's memory doesn't grow with the benchmark. Documents are never shuffled for one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, free_name, stored

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Shingles of the items in one broadcast block, at about 100 bytes each.
BLOCK_SHINGLES = 500_000
_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def normal_words(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and of all that is not ASCII."""
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACED).split()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 1 << 14)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingled:
    """A text's word sequence with the hashes of its shingles of any width."""

    def __init__(self, words: list[bytes]):
        self.buffer = b" ".join(words)
        self.ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        self.starts = np.concatenate((np.zeros(1, np.int64), self.ends[:-1] + 1)) if len(words) else self.ends
        codes = np.frombuffer(self.buffer, np.uint8).astype(np.uint64) + np.uint64(1)
        up, self.down = _powers(len(codes) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * up[:-1], dtype=np.uint64)))

    def hashes(self, width: int) -> np.ndarray:
        if len(self.ends) < width:
            return np.zeros(0, np.uint64)
        a, b = self.starts[: len(self.starts) - width + 1], self.ends[width - 1 :]
        return _mixed((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))

    def texts(self, width: int) -> set[bytes]:
        if len(self.ends) < width:
            return set()
        a, b = self.starts[: len(self.starts) - width + 1].tolist(), self.ends[width - 1 :].tolist()
        return {self.buffer[i:j] for i, j in zip(a, b)}


@dataclass
class Item:
    item_id: int | None
    width: int
    shingles: frozenset[bytes]
    least: int


class Sketches:
    """The sketches of one block of items: by shingle width, sorted hashes and the items of each."""

    def __init__(self, items: list[Item], threshold: float):
        self.items, found = items, {}
        largest: dict[int, int] = {}
        for item in items:
            part = len(item.shingles).bit_length()
            largest[part] = max(largest.get(part, 0), len(item.shingles))
        for at, item in enumerate(items):
            u = largest[len(item.shingles).bit_length()]
            size = u - ceil(threshold * u - 1e-9) + 1
            own = sorted(int(Shingled(s.split(b" ")).hashes(item.width)[0]) for s in item.shingles)
            for h in own[:size]:
                found.setdefault(item.width, {}).setdefault(h, []).append(at)
        self.by_width = {w: (np.array(sorted(by), np.uint64), [by[h] for h in sorted(by)]) for w, by in found.items()}

    def hits(self, words: list[bytes]) -> list[tuple[Item, int]]:
        """The items contained in the text, with the number of their shingles found, in item order."""
        out, text = [], Shingled(words)
        for width, (known, owners) in self.by_width.items():
            hashes = text.hashes(width)
            at = np.searchsorted(known, hashes)
            at[at == len(known)] = 0
            if not (same := known[at] == hashes).any():
                continue
            there = text.texts(width)
            for i in sorted({o for k in np.unique(at[same]).tolist() for o in owners[k]}):
                n = sum(s in there for s in self.items[i].shingles)
                if n >= self.items[i].least:
                    out.append((self.items[i], n))
        return out


def _item(item_id: int | None, text: str | None, threshold: float, shingle_words: int) -> Item | None:
    words = normal_words(text)
    if not words:
        return None
    width = min(shingle_words, len(words))
    shingles = frozenset(Shingled(words).texts(width))
    return Item(item_id, width, shingles, ceil(threshold * len(shingles) - 1e-9))


def item_blocks(items: DataFrame, id_col: str, text_col: str, threshold: float, shingle_words: int, block: int) -> Iterator[Sketches]:
    """Reads the items block by block; at most one block and one partition of items is in memory."""
    own: list[Item] = []
    held = 0
    for row in items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        if item := _item(row[0], row[1], threshold, shingle_words):
            own.append(item)
            held += len(item.shingles)
            if held >= block:
                yield Sketches(own, threshold)
                own, held = [], 0
    if own:
        yield Sketches(own, threshold)


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD, shingle_words: int = SHINGLE_WORDS, block: int = BLOCK_SHINGLES,
) -> DataFrame:
    """(doc_id, item_id, item_shingles, matched, containment): a row for each row of docs and each item it contains.

    Items of fewer words than a shingle are one shingle of all their words; items and texts that are
    null or without words match nothing. Repeated rows of either side give a row each, a null id stays
    null, empty tables give no rows, other columns are ignored. Texts are read whole.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    schema = "doc_id long, item_id long, item_shingles int, matched int, containment double"
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for sketches in item_blocks(items, item_id, item_text, threshold, shingle_words, block):
        shared = spark.sparkContext.broadcast(sketches)

        def run(batches, shared=shared):
            for batch in batches:
                rows = [
                    (d, item.item_id, len(item.shingles), n, n / len(item.shingles))
                    for d, t in zip(batch.column(0).to_pylist(), batch.column(1))
                    for item, n in shared.value.hits(normal_words(t.as_py()))
                ]
                cols = list(zip(*rows)) or [()] * 5
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], ["doc_id", "item_id", "item_shingles", "matched", "containment"])

        out = out.unionAll(picked.mapInArrow(run, schema))
    return out


def decontaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD, shingle_words: int = SHINGLE_WORDS, block: int = BLOCK_SHINGLES,
) -> DataFrame:
    """docs without the rows that contain an item; all columns stay.

    With one block of items no row moves between tasks. With more, each block is a pass of its own over the texts,
    which returns the digests of those that contain an item, and these texts are left out in the end: a worker holds
    one block at a time.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    at, texts, found = docs.columns.index(text_col), docs.select(F.col(text_col).cast("string").alias("text")), []
    blocks = item_blocks(items, item_id, item_text, threshold, shingle_words, block)
    last = next(blocks, None)
    if last is None:
        return docs
    shared = spark.sparkContext.broadcast(last)

    def clean(batches, shared=shared):
        for batch in batches:
            yield batch.filter(pa.array([not shared.value.hits(normal_words(t.as_py())) for t in batch.column(at)], pa.bool_()))

    def hit(own):
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(t.as_py().encode()).hexdigest() for t in batch.column(0) if own.value.hits(normal_words(t.as_py()))], pa.string())], ["digest"])

        return run

    for sketches in blocks:
        if not found:
            found.append(stored(texts.mapInArrow(hit(shared), "digest string").distinct(), "leaks"))
        found.append(stored(texts.mapInArrow(hit(spark.sparkContext.broadcast(sketches)), "digest string").distinct(), "leaks"))
    if not found:
        return docs.mapInArrow(clean, docs.schema)
    bad, own = reduce(DataFrame.unionAll, found).distinct(), free_name(docs, "_digest")
    marked = docs.withColumn(own, F.sha2(F.col(text_col).cast("string"), 256))
    return marked.join(bad, marked[own] == bad["digest"], "left_anti").drop(own)
