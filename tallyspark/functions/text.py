"""Text normalisation and tolerant parsing of numbers, months and yes/no."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["plain", "parse_number", "parse_month", "parse_bool", "brl"]

# Accented letters and their plain forms, scale words, month names, words for yes and no.
_ACCENTED, _PLAIN = "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn"
_SCALES = {"mil": 10**3, "milhao": 10**6, "milhoes": 10**6, "mi": 10**6, "mm": 10**6, "bilhao": 10**9, "bilhoes": 10**9, "bi": 10**9, "trilhao": 10**12, "trilhoes": 10**12, "tri": 10**12}
_MONTHS = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")
_YES, _NO = ("true", "sim", "verdadeiro", "yes"), ("false", "nao", "falso", "no")
_YES_FLAGS, _NO_FLAGS = ("s", "v", "1"), ("n", "f", "0")
_OPPOSITES = {"acima": "abaixo", "abaixo": "acima"}


def unaccented(c: Column) -> Column:
    return F.translate(F.lower(c), _ACCENTED, _PLAIN)


def plain(c: Column) -> Column:
    """Lower case without accents; _ and - are blanks; runs of blanks are one."""
    spaced = F.regexp_replace(unaccented(c), "[_\\s-]+", " ")
    return F.trim(spaced)


def parse_number(c: Column) -> Column:
    """Numbers as people write them in either convention, with currency, percent, points and scale words; null if it's no number.

    Of points and commas the last kind is the decimal mark; a single comma or point is one too, a kind that
    repeats alone separates thousands.
    """
    t = F.trim(F.regexp_replace(F.translate(unaccented(c), "−–", "--"), r"r\$|p\.p\.|%", ""))
    last = F.regexp_extract(t, r"\s(\S+)$", 1)
    scale, word = F.lit(1), F.regexp_replace(last, r"\.+$", "")
    for name, value in _SCALES.items():
        scale = F.when(word == name, F.lit(value)).otherwise(scale)
    t = F.when(word.isin(*_SCALES), F.regexp_replace(t, r"\s\S+$", "")).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, r"\spp$", ""), r"\s+", "")
    points, commas = F.regexp_count(t, F.lit(r"\.")), F.regexp_count(t, F.lit(","))
    comma_last = F.length(F.substring_index(t, ",", -1)) < F.length(F.substring_index(t, ".", -1))
    only_points, only_commas = F.replace(t, F.lit(","), F.lit("")), F.translate(F.replace(t, F.lit("."), F.lit("")), ",", ".")
    digits = (
        F.when((points > 0) & (commas > 0), F.when(comma_last, only_commas).otherwise(only_points))
        .when(commas == 1, only_commas).when(commas > 1, only_points).when(points > 1, F.replace(t, F.lit("."), F.lit(""))).otherwise(t)
    )
    known = t.rlike(r"^[+-]?\d+(\.\d+)?e[+-]?\d+$") | t.rlike(r"^[+-]?[\d.,]*\d[\d.,]*$")
    return F.when(known, digits.try_cast("double") * scale.cast("double"))


def parse_month(c: Column) -> Column:
    """The first yyyy-MM, MM/yyyy or month name and year in a text, as the number yyyyMM; null without one."""
    t = unaccented(c)
    found = []
    for pattern, year, month in ((r"(\d{4})-(\d{1,2})", 1, 2), (r"(\d{1,2})/(\d{4})", 2, 1)):
        found.append(F.when(t.rlike(pattern), F.regexp_extract(t, pattern, year).cast("bigint") * 100 + F.regexp_extract(t, pattern, month).cast("bigint")))
    pattern = r"([a-z]{3})[a-z]*\.?(?:/| de | )(\d{4})"
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.regexp_extract(t, pattern, 1))
    return F.coalesce(*found, F.when(month > 0, F.regexp_extract(t, pattern, 2).try_cast("bigint") * 100 + month))


def parse_bool(c: Column, column: str = "", flags: bool = False) -> Column:
    """Words for yes and no. The first word of the column's name says yes too, and its opposite no; one-letter marks
    and 0 or 1 count in a column of flags only."""
    t = plain(c)
    out = F.when(parse_number(c).isNotNull(), None).when(t.isin(*_YES), True).when(t.isin(*_NO), False)
    if word := column.lower().replace("-", "_").split("_")[0].strip():
        first = F.substring_index(t, " ", 1)
        out = out.when(first == word, True)
        if word in _OPPOSITES:
            out = out.when(first == _OPPOSITES[word], False)
    return F.when(t.isin(*_YES_FLAGS), True).when(t.isin(*_NO_FLAGS), False).otherwise(out) if flags else out


def brl(c: Column) -> Column:
    """R$ with thousands points and a decimal comma."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(c, 2), ",.", ".,"))
