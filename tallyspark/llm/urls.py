"""URL verdicts: host and path rules first, boosted trees on lexical features for the rest.

Everything on the main path is a DataFrame expression. The trees are fitted on the driver from a bounded
sample of labelled URLs and compiled to nested conditions; suffix statistics are grouped counts of the
labelled URLs, smoothed towards the overall rate, and joined by suffix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, joined_by_hot_key, stored

#: Labelled URLs that the trees are fitted on, those of the smallest xxhash64(url).
SAMPLE_ROWS = 20_000
#: Parts of the labelled URLs; a URL's suffix statistics for training come from the parts that it isn't in.
FOLDS = 5
#: Suffixes whose statistics are broadcast (some 60 bytes each), those of the most pages; pages of others are dealt by suffix.
BROADCAST_SUFFIXES = 100_000
#: Weight of the overall rate in a suffix's rate.
PRIOR_ROWS = 20.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "host_hyphens", "entropy", "host_entropy",
    "parameters", "query_length", "has_fragment", "escapes", "secure", "vowels", "longest_label", "extension", "port", "suffix_rate", "suffix_rows",
)


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """text is host/path, as `example.net/en/`; it fits the host, its subdomains and paths that it begins."""

    text: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        own, _, rest = self.text.partition("/")
        return ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)


RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))


def ruled(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        rule, verdict = F.when(r.fits(host, path), F.lit(r.text)).otherwise(rule), F.when(r.fits(host, path), F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    """The last two labels of a host without its port."""
    return F.substring_index(F.regexp_replace(host, r":\d*$", ""), ".", -2)


def _share(text: Column, kept: str) -> Column:
    return F.char_length(F.regexp_replace(text, kept, "")) / F.greatest(F.char_length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    """Bits a character, from the counts of distinct characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1)).cast("double")
    share = lambda c: (F.char_length(text) - F.char_length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def lexical(url: Column, host: Column, path: Column) -> Column:
    """The features that need nothing but the URL, as an array of doubles in the order of FEATURES."""
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    values = [
        F.char_length(url), F.char_length(host), F.char_length(path), F.size(F.filter(F.split(path, "/"), lambda p: p != "")), F.size(F.split(host, r"\.")),
        _share(url, "[^0-9]"), _share(host, "[^0-9]"), F.char_length(host) - F.char_length(F.replace(host, F.lit("-"), F.lit(""))), _entropy(url), _entropy(host),
        F.size(F.filter(F.split(query, "&"), lambda p: p != "")), F.char_length(query), F.instr(url, "#") > 0, F.regexp_count(url, F.lit("%[0-9A-Fa-f]{2}")),
        F.lower(F.substring(url, 1, 8)) == "https://", _share(host, "[^aeiou]"), F.array_max(F.transform(F.split(host, r"\."), lambda p: F.char_length(p))),
        path.rlike(r"\.[A-Za-z0-9]{1,5}$"), host.rlike(r":\d+$"),
    ]
    return F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])


# A tree: a leaf's value, or (feature, limit, tree where value <= limit, tree where it's above).
Tree = float | tuple


def _grow(x: np.ndarray, bins: np.ndarray, limits: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> Tree:
    total_g, total_h = g[rows].sum(), h[rows].sum()
    leaf = float(-total_g / (total_h + 1))
    best = (1e-6, 0, 0)
    for k, cuts in enumerate(limits if depth and len(rows) >= 20 else ()):
        if len(cuts):
            low_g = np.cumsum(np.bincount(bins[rows, k], g[rows], len(cuts) + 1))[:-1]
            low_h = np.cumsum(np.bincount(bins[rows, k], h[rows], len(cuts) + 1))[:-1]
            gain = low_g**2 / (low_h + 1) + (total_g - low_g) ** 2 / (total_h - low_h + 1) - total_g**2 / (total_h + 1)
            at = int(gain.argmax())
            best = max(best, (float(gain[at]), k, at))
    if best[0] <= 1e-6:
        return leaf
    _, k, at = best
    low = bins[rows, k] <= at
    if low.all() or not low.any():
        return leaf
    return (k, float(limits[k][at]), _grow(x, bins, limits, g, h, rows[low], depth - 1), _grow(x, bins, limits, g, h, rows[~low], depth - 1))


def _values(tree: Tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    k, limit, low, high = tree
    return np.where(x[:, k] <= limit, _values(low, x), _values(high, x))


@dataclass
class Trees:
    base: float
    trees: list[Tree]
    rate: float = 0.3

    def margin(self, features: Column) -> Column:
        def column(tree: Tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree * self.rate)
            k, limit, low, high = tree
            return F.when(features[k] <= limit, column(low)).otherwise(column(high))

        out = F.lit(self.base)
        for tree in self.trees:
            out = out + column(tree)
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((_values(t, x) for t in self.trees), np.zeros(len(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3) -> Trees:
    """Logistic boosting with second-order steps; without both classes only the smoothed share remains."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return Trees(base, [], rate)
    limits = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 33)[1:-1], method="lower")) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(limits)], 1)
    at, found = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-np.clip(at, -30, 30)))
        tree = _grow(x, bins, limits, p - y, p * (1 - p), np.arange(len(y)), depth)
        found.append(tree)
        at = at + rate * _values(tree, x)
    return Trees(base, found, rate)


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, labelled: DataFrame | None = None, url_col: str = "url", sample_rows: int = SAMPLE_ROWS, broadcast_suffixes: int = BROADCAST_SUFFIXES) -> DataFrame:
    """pages and the columns host, path, rule, verdict, score (the trees' share of `block`).

    labelled(url, blocked 0/1) are the URLs to learn from; without it the URLs of pages that a rule fits
    are, labelled by their rule. Suffix statistics of a training URL come from the other folds, so that they
    don't give its own label away. A null url or one without ://
    has an empty host and path. Repeated rows give a row each and an empty table no row; columns of pages
    with the names of new ones are replaced, all others stay. Where nothing is labelled the score is 0.5 and the verdict allow.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    given = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "score")]
    by_rule, end, blocked, many, own_x = (free_name(pages, n) for n in ("_ruled", "_suffix", "_blocked", "_rows", "_features"))
    base = pages.select(*[F.col(f"`{c}`") for c in given], host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = ruled(rules, F.col("host"), F.col("path"))
    base = base.withColumns({"rule": rule, by_rule: verdict})
    if labelled is None:
        known = base.where("rule IS NOT NULL").select(url.alias("url"), "host", "path", (F.col(by_rule) == "block").cast("int").alias("y"))
    else:
        known = labelled.where("url IS NOT NULL AND blocked IN (0, 1)").select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("blocked").cast("int").alias("y"))
    known = known.withColumns({"suffix": suffix_of(F.col("host")), "fold": F.pmod(F.xxhash64("url"), F.lit(FOLDS))})
    by_fold = known.groupBy("suffix", "fold").agg(F.sum("y").alias("blocked_in"), F.count(F.lit(1)).alias("rows_in"))
    counts = by_fold.groupBy("suffix").agg(F.sum("blocked_in").alias("blocked"), F.sum("rows_in").alias("rows"))
    counts = stored(counts, "url-suffixes")
    total = counts.agg(F.coalesce(F.sum("blocked"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
    kept = [F.col(f"`{c}`") for c in given]
    if not total[1]:
        return base.select(*kept, "host", "path", "rule", F.coalesce(by_rule, F.lit("allow")).alias("verdict"), F.lit(0.5).alias("score"))
    overall = total[0] / total[1]

    def rate(blocked: Column, rows: Column) -> list[Column]:
        return [(blocked + PRIOR_ROWS * overall) / (rows + PRIOR_ROWS), F.log1p(rows.cast("double"))]

    sample = known.orderBy(F.xxhash64("url"), "url").limit(sample_rows).join(counts, "suffix", "left").join(by_fold, ["suffix", "fold"], "left")
    own = rate(F.col("blocked") - F.col("blocked_in"), F.col("rows") - F.col("rows_in"))
    rows = sample.select(F.concat(lexical(F.col("url"), F.col("host"), F.col("path")), F.array(*own)).alias("x"), "y").collect()  # at most sample_rows
    rows.sort(key=lambda r: (r[0], r[1]))
    model = fit(np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float))
    base = base.withColumn(end, suffix_of(F.col("host")))
    if total[2] <= broadcast_suffixes:
        joined = base.join(F.broadcast(counts.select(F.col("suffix").alias(end), F.col("blocked").alias(blocked), F.col("rows").alias(many))), end, "left")
    else:
        pages_of = base.groupBy(end).agg(F.count(F.lit(1)).alias("pages")).join(counts, F.col(end) == F.col("suffix"), "left")
        pages_of = stored(pages_of.select(end, F.col("blocked").alias(blocked), F.col("rows").alias(many), "pages"), "url-pages")
        joined = joined_by_hot_key(base, pages_of.withColumnRenamed("pages", free_name(pages, "_pages")), end, free_name(pages, "_pages"), broadcast_suffixes)
    none = [F.coalesce(F.col(c), F.lit(0)) for c in (blocked, many)]
    scored = joined.withColumn(own_x, F.concat(lexical(url, F.col("host"), F.col("path")), F.array(*rate(*none))))
    scored = scored.withColumn("score", 1 / (1 + F.exp(-model.margin(F.col(own_x)))))
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(*kept, "host", "path", "rule", F.coalesce(F.col(by_rule), method).alias("verdict"), "score")
