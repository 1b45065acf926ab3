"""Best-fit packing of tokenised documents into sequences under several capacities.

Each document becomes its token ids and one end id; longer ones are cut so that only their first piece
is shorter than a sequence. A piece demands tokens, one document slot and attention cost (its length
squared); a bin holds `tokens`, `max_docs` and `max_cost`. Pieces go in by falling length; each takes
the open bin that the rule prefers among those where every residual suffices: `norm` the smallest
weighted norm of what would remain, `dot` the largest weighted dot-product of demand and residual.

All pieces of one length are alike, so bins are chosen for the histogram of lengths, at most `tokens`
rows whatever the corpus, and for runs of equal bins at once. The plan maps (length, rank) to
(sequence, offset); ranks come from salted counts, so no length meets in one task.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, stored

TOKENS = 2048
END_ID = 0
#: Pieces that one salt ranks.
SALT_ROWS = 50_000
# Fixed value: how byte-level vocabularies of this kind split text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A run of blanks on which the faster encoder would run out of stack.
_LONG_BLANK = re.compile(r"\s{20000}")
_ENCODERS: dict[int, Encoder] = {}


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the
    others, in order, for 256 and on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def ranks_of(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary of a tokenizer file by its bytes, where plain byte-pair ranks give the same ids: byte-level
    words, no normalizer, and ids in the order of the merges. None otherwise."""
    model, words = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    level = words.get("type") == "ByteLevel" and not words.get("add_prefix_space") and words.get("use_regex", True)
    if not plain or not level or spec.get("normalizer") or spec.get("post_processor"):
        return None
    letters, vocabulary = byte_letters(), model["vocab"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    if any(vocabulary.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
        return None
    added = {x["content"] for x in spec.get("added_tokens", ())}
    return {bytes(letters[c] for c in word): i for word, i in vocabulary.items() if word not in added}


class Encoder:
    """Ids as little-endian bytes. The tokenizer's own library defines them; where its file is a plain byte-level
    vocabulary, a faster encoder with the same ranks gives the same ids (tests compare the two). Texts that hold an added
    token or a very long run of blanks, which its pattern can't take, go the defining way, as do those that it fails on."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer, spec, self.fast = Tokenizer.from_str(tokenizer_json), json.loads(tokenizer_json), None
        if ranks := ranks_of(spec):
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
            self.added = [x["content"] for x in spec.get("added_tokens", ())]

    def ids(self, text: str) -> bytes:
        if self.fast is not None and not any(x in text for x in self.added) and not _LONG_BLANK.search(text):
            try:
                return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
            except BaseException as e:
                if type(e).__name__ != "PanicException":
                    raise
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _encoder(tokenizer_json: str) -> Encoder:
    key = hash(tokenizer_json)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokenizer_json)
    return _ENCODERS[key]


def cuts(n: int, tokens: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % tokens or tokens
    return [(0, min(n, first)), *((s, tokens) for s in range(first, n, tokens))]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): ids is the little-endian unsigned 32-bit form."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

    def run(batches):
        encoder = _encoder(vocabulary.value)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.ids(text.as_py() or "") + end
                for k, (start, n) in enumerate(cuts(len(ids) // 4, tokens)):
                    own = ids[4 * start : 4 * (start + n)]
                    rows.append((doc, k, start, n, zlib.crc32(own)) + (own,) * with_ids)
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    bound_batches(spark)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


@dataclass
class Plan:
    """Runs of pieces: from rank `first` of `length` on, `each` to a bin, from bin `sequence` on, at `offset`."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted((self.length << 44) + self.first, (length << 44) + rank, side="right") - 1
        past = rank - self.first[at]
        return self.sequence[at] + past // self.each[at], self.offset[at] + past % self.each[at] * length


def best_fit(histogram: dict[int, int], tokens: int = TOKENS, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.01, 0.01)) -> Plan:
    """Packs histogram (pieces by length) by falling length; see the module text for the rules."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"no such rule: {rule}")
    room = np.array([tokens, max_docs or tokens, max_cost or tokens * tokens], np.int64)
    scale = np.sqrt(np.array(weights)) / room
    bins = np.zeros((64, 5), np.int64)  # first bin, how many, residual tokens, slots, cost
    used, opened, runs = 0, 0, []

    def add(first: int, many: int, left: np.ndarray) -> None:
        nonlocal bins, used
        if many:
            if used == len(bins):
                bins = np.concatenate((bins, np.zeros_like(bins)))
            bins[used] = (first, many, *left)
            used += 1

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        need = np.array([length, 1, length * length], np.int64)
        if length > tokens or length < 1 or (need > room).any():
            raise ValueError(f"a piece of {length} tokens fits no bin")
        while todo:
            open_to = np.flatnonzero((bins[:used, 2:] >= need).all(1) & (bins[:used, 1] > 0))
            if len(open_to):
                left = bins[open_to, 2:]
                cost = (((left - need) * scale) ** 2).sum(1) if rule == "norm" else -((left * scale) * (need * scale)).sum(1)
                at = int(open_to[cost.argmin()])
                first, many, left = int(bins[at, 0]), int(bins[at, 1]), bins[at, 2:].copy()
                each = 1 if rule == "dot" else int((left // need).min())
                bins[at, 1] = 0
            else:
                left, at = room, -1
                each = int((room // need).min())
                first, many = opened, -(-todo // each)
                opened += many
            full = min(many, todo // each)
            rest = 0 if full == many else todo - full * each
            placed = full * each + rest
            runs.append((length, rank, each, first, int(room[0] - left[0])))
            if at >= 0 and full:
                bins[at] = (first, full, *(left - each * need))
            else:
                add(first, full, left - each * need)
            add(first + full, 1 if rest else 0, left - rest * need)
            add(first + full + (rest > 0), many - full - (rest > 0), left)
            todo, rank = todo - placed, rank + placed
    ordered = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return Plan(*(np.ascontiguousarray(ordered[:, k]) for k in range(5)))


def pack(parts: DataFrame, tokens: int = TOKENS, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm", salt_rows: int = SALT_ROWS) -> DataFrame:
    """parts(doc_id, piece, start, length, ...), read twice -> parts with sequence_id and offset.

    Null ids, repeated rows and ties are packed like any other row; an empty table packs to nothing. A column _row,
    a number of each row, deals rows to salts and is left out; without it rows alike share a salt.
    """
    spark = parts.sparkSession
    histogram = {int(r[0]): int(r[1]) for r in parts.groupBy("length").count().collect()}  # at most `tokens` rows
    plan = spark.sparkContext.broadcast(best_fit(histogram, tokens, max_docs, max_cost, rule))
    salts = max(1, -(-sum(histogram.values()) // salt_rows))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64(*(["_row"] if "_row" in parts.columns else ["doc_id", "piece", "ids_crc32"])), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")).select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(own) - 1).join(bases, ["length", "_salt"])
    given = parts.drop("_row")
    ranked = ranked.select(*given.columns, (F.col("_base") + F.col("_rank")).alias("_rank"))
    length_at, names = given.columns.index("length"), [*given.columns, "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(k)).astype(np.int64) for k in (length_at, batch.num_columns - 1))
            sequence, offset = plan.value.place(length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names)

    bound_batches(spark)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    return ranked.mapInArrow(run, f"{columns}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = TOKENS, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm", end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of docs: (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset).

    A null or empty text is its end id alone. Texts are encoded whole and once; the pieces are kept in
    the shared folder. Other columns of docs are ignored.
    """
    parts = pieces(docs, tokenizer_path, id_col, text_col, tokens, end_id, with_ids).withColumn("_row", F.monotonically_increasing_id())
    parts = stored(parts, "pieces")
    return pack(parts, tokens, max_docs, max_cost, rule)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
