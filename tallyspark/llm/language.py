"""Language identification by fusing evidence in log space.

Sources of evidence, each a likelihood of what was seen given the language:
text (hashed byte trigrams, naive Bayes with a tempered length), the declared markup language, the
address suffix, and a host prior smoothed towards its suffix and the whole corpus. Tables of the last
three are grouped sums of the texts' posteriors over all rows; a row's own share is taken out of
each before it is used. A markup value or suffix counts by how its languages differ from the corpus's. Training texts are the labelled documents; labels serve for nothing else.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, joined_by_hot_key, stored

CELLS = 1 << 13
#: The text's evidence counts as this many trigrams at most.
MOST_TRIGRAMS = 200.0
#: Pseudo-rows of a host's suffix and of the corpus in the host's prior, and of the corpus in a markup value or suffix.
SUFFIX_ROWS, CORPUS_ROWS, VALUE_ROWS = 5.0, 5.0, 2.0
#: Bytes of a table of sums that is broadcast; of larger ones its rows of the most texts are.
BROADCAST_BYTES = 8 << 20


def _trigrams(text: str | None) -> np.ndarray:
    """Counts of hashed byte trigrams of letters; runs of anything else are one space."""
    data = np.frombuffer(f" {(text or '').lower()} ".encode("utf-8", "replace"), np.uint8)
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    flat = np.where(letter, data, 32)
    flat = flat[np.concatenate(([True], (flat[1:] != 32) | (flat[:-1] != 32)))].astype(np.uint32)
    if len(flat) < 3:
        return np.zeros(CELLS)
    codes = (flat[:-2] * np.uint32(0x9E3779B1) ^ flat[1:-1] * np.uint32(0x85EBCA77) ^ flat[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    return np.bincount(codes >> np.uint32(32 - 13), minlength=CELLS)


def train(docs: DataFrame, label_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [languages x CELLS]) from every labelled text; counts are summed by
    language and cell, so tasks return at most CELLS rows a language."""
    languages = sorted(r[0] for r in docs.where(F.col(label_col).isNotNull()).select(F.col(label_col).cast("string")).distinct().collect())
    at = {x: i for i, x in enumerate(languages)}

    def run(batches):
        sums = np.zeros((len(languages), CELLS))
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if label in at:
                    counts = _trigrams(text.as_py())
                    sums[at[label]] += counts / max(1.0, counts.sum() / 1000)
        lang, cell = np.nonzero(sums)
        for a in range(0, len(lang), 10_000):
            k, c = lang[a : a + 10_000], cell[a : a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(c, pa.int32()), pa.array(sums[k, c])], ["lang", "cell", "n"])

    bound_batches(docs.sparkSession)
    table = np.ones((len(languages), CELLS)) * 0.5
    summed = docs.select(F.col(label_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, "lang int, cell int, n double").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    for r in summed.collect():  # at most languages x CELLS
        table[r["lang"], r["cell"]] += r["n"]
    return languages, np.log(table / table.sum(1, keepdims=True))


def visible(html: Column) -> Column:
    """The text of markup: without comments, scripts, styles, tags and entities."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>|&#?\w{1,10};", " ")


def declared(html: Column) -> Column:
    """The primary subtag of the first lang attribute of the html element, lower-cased; null without one."""
    tag = F.regexp_extract(F.regexp_extract(html, r"(?is)<html\b[^>]*>", 0), r"(?i)\slang\s*=\s*[\"']?([a-z]{2,8})", 1)
    return F.nullif(F.lower(tag), F.lit(""))


def likelihoods(rows: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """rows(key..., text) with `text` replaced by `ll`: log-likelihoods by language, tempered, largest 0."""
    at = rows.columns.index("text")
    shared = rows.sparkSession.sparkContext.broadcast(table.T.copy())  # 64 KB a language

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(at):
                counts = _trigrams(text.as_py())
                ll = counts @ shared.value * min(1.0, MOST_TRIGRAMS / max(1.0, counts.sum())) / 3
                out.append((ll - ll.max()).tolist())
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.float64()))], [*[n for n in batch.schema.names if n != "text"], "ll"])

    bound_batches(rows.sparkSession)
    kept = rows.drop("text")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return rows.mapInArrow(run, f"{columns}, ll array<double>")


def _soft(ll: Column, n: int) -> list[Column]:
    total = reduce(lambda a, b: a + b, [F.exp(ll[i]) for i in range(n)])
    return [F.exp(ll[i]) / total for i in range(n)]


def identified(rows: DataFrame, labelled: DataFrame, label_col: str = "lang", text_col: str = "text", most_broadcast: int | None = None) -> DataFrame:
    """rows(key columns, text, markup, suffix, host) -> key columns, lang, confidence, text_lang.

    lang is the language of the largest posterior, ties to the first in alphabetical order; text_lang the
    text's alone. Null evidence says nothing: a null or empty text has even likelihoods, a null markup,
    suffix or host leaves its factor out (a null host's prior is the corpus's). Rows repeat as they come,
    an empty table gives no rows, texts are read whole. Without labelled texts lang is null, confidence 0.
    """
    keys = [c for c in rows.columns if c not in ("text", "markup", "suffix", "host")]
    languages, table = train(labelled, label_col, text_col)
    n = len(languages)
    if not n:
        return rows.select(*keys, F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"))
    seen = stored(likelihoods(rows, languages, table).withColumn("p", F.array(*_soft(F.col("ll"), n))), "language-text")

    def sums(by: str) -> DataFrame:
        own = seen.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias(f"{by}_rows"), *[F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)])
        return stored(own.select(by, f"{by}_rows", F.array(*[f"s{i}" for i in range(n)]).alias(f"{by}_sum")), f"language-{by}")

    corpus = seen.agg(*[F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)) for i in range(n)]).first()
    base = np.array(corpus, float) + 1.0
    base /= base.sum()
    joined = seen
    for by in ("host", "markup", "suffix"):
        joined = joined_by_hot_key(joined, sums(by), by, f"{by}_rows", max(most_broadcast or BROADCAST_BYTES // (8 * n + 64), 1))
    even = F.array(*[F.lit(0.0)] * n)

    def others(by: str) -> Column:
        """The sums of a value without the row's own share; zeros for a null."""
        return F.when(F.col(f"{by}_sum").isNotNull(), F.zip_with(f"{by}_sum", "p", lambda s, p: F.greatest(s - p, F.lit(0.0)))).otherwise(even)

    joined = joined.withColumns({"_hs": others("host"), "_ms": others("markup"), "_xs": others("suffix")})
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    joined = joined.withColumns({"_ht": total("_hs"), "_mt": total("_ms"), "_xt": total("_xs")})

    def evidence(i: int, sums: str, of: str) -> Column:
        """log P(value | language), but for what all languages share: P(language | value) over P(language)."""
        return F.log((F.col(sums)[i] + VALUE_ROWS * float(base[i])) / ((F.col(of) + VALUE_ROWS) * float(base[i])))

    def log_prior(i: int) -> Column:
        of_suffix = (F.col("_xs")[i] + CORPUS_ROWS * float(base[i])) / (F.col("_xt") + CORPUS_ROWS)
        of_host = (F.col("_hs")[i] + SUFFIX_ROWS * of_suffix) / (F.col("_ht") + SUFFIX_ROWS)
        return F.log(F.greatest(of_host, F.lit(1e-9)))

    # The host's prior already leans on its suffix, so the suffix adds its own factor only where there's no host.
    post = [F.col("ll")[i] + evidence(i, "_ms", "_mt") + F.when(F.col("host").isNull(), evidence(i, "_xs", "_xt")).otherwise(0.0) + log_prior(i) for i in range(n)]
    joined = joined.withColumn("_post", F.array(*post)).withColumn("_top", F.array_max("_post"))
    names = F.array(*[F.lit(x) for x in languages])
    share = 1 / F.aggregate(F.col("_post"), F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    lang = F.element_at(names, F.array_position("_post", F.col("_top")).cast("int"))
    return joined.select(*keys, lang.alias("lang"), share.alias("confidence"), F.element_at(names, F.array_position("ll", F.array_max("ll")).cast("int")).alias("text_lang"))
