r"""Surrogates for personal data, in DataFrame functions only.

Each detected entity is replaced by a value of the same type and format: digits for digits, vowels for
vowels, consonants for consonants, letters of the same case and script; separators stay. The replacement is
a keyed permutation of the format's space (alternating halves are shifted by SHA-512 of key, type, attempt and the
other half), so two entities of one format never share a surrogate. Card numbers keep a valid check digit (and only
numbers with one are cards), phone numbers their country code, addresses stay in their kind of network, e-mail
hosts move under example.*. A name keeps its title; its words are entities of their own, a first name
(of a title's gender) or a surname, so that a surname is the same with and without a first name; surrogates of first
names end as their gender does in their script. The canonical form (the digits of a number with its country code, a
lower-cased e-mail, a word of a name) ties spellings of one entity together wherever they occur.

Collision checks run over the distinct entities of the whole corpus: a surrogate that two entities share (across
formats), or that is itself an entity of the corpus, is drawn again with the next attempt for all but the
first of them, until none is left; names grow by a syllable an attempt and hosts by a letter, so there is always room.
Formats of numbers and secrets can't grow: where the corpus fills so much of one that DRAWS attempts don't do, all its
entities go back to attempt 0, which is a permutation and so keeps them distinct, but may give a value that
occurs elsewhere in the corpus. Attempts other than 0 go along as one small map where there are at most FEW of them; beyond, they
are joined to the texts that need them by the digest of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored

# Titles by gender, alphabets by script and class.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "г-жа", "госпожа"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "господин"),
}
# How first names end, by script and gender, and the syllables that names grow by.
ENDINGS = {("latin", "f"): "a", ("latin", "m"): "o", ("cyrillic", "f"): "а", ("cyrillic", "m"): "ий"}
SYLLABLES = {"latin": ("bcdfghjklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрстфх", "аеиоу")}
# Fixed value: the country calling codes of one and two digits; all others have three.
CALLING = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ALPHABETS = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxz", "AEIOU", "BCDFGHJKLMNPQRSTVWXZ", "áàâäéèêëíìîïóòôöúùûü", "ÁÀÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜ", "çñß", "ÇÑ",
    "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
)

_LETTERS = "".join(ALPHABETS)
#: For each of _LETTERS, where its alphabet begins and how long it is.
_STARTS = [1 + sum(map(len, ALPHABETS[:k])) for k, a in enumerate(ALPHABETS) for _ in a]
_SIZES = [len(a) for a in ALPHABETS for _ in a]

#: Attempts before a format counts as full, and attempts other than 0 that go along with every task as one map.
DRAWS, FEW = 8, 1000
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLES = "|".join(t for own in TITLES.values() for t in own)
#: Type and pattern, in order of precedence; no capturing groups.
PATTERNS = {
    "email": r"[\p{L}\p{N}_][\p{L}\p{N}._%+-]*+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![A-Za-z0-9])",
    "secret": r"(?:(?i:token|secret|password|passwd|api_?key)\s{0,3}[=:]\s{0,3}[\"'][A-Za-z0-9+/_=-]{8,}[\"']|AKIA[0-9A-Z]{16}(?![0-9A-Za-z]))",
    "name": rf"(?:{_TITLES})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+){{0,2}}",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+[2-9]\d{0,2}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,8}){1,5}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?![\p{L}\d]|\.\d)",
    "ip": rf"{_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\d]|\.\d)",
    "card": r"(?:\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5}|\d{13,19})(?![\p{L}\d])",
}
_FIRST = r"(?<![\p{L}\p{N}])"
ANY = f"{_FIRST}(?:{'|'.join(PATTERNS.values())})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _at(numbers: list[int], i: Column) -> Column:
    """The i-th of constant numbers, from 1 on; the split is folded into a constant."""
    return F.element_at(F.split(F.lit(" ".join(map(str, numbers))), " "), i).cast("int")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _positions(text: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1)))


def check_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    n = F.char_length(digits)

    def term(i):
        d = F.substring(digits, i, 1).cast("int")
        return F.when((n - i) % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(_positions(digits), term), F.lit(0), lambda a, x: a + x) % 10


def kind_of(match: Column) -> Column:
    """The type of a match of ANY; null for a number that is neither card nor phone."""
    out = None
    for kind, pattern in PATTERNS.items():
        hit = match.rlike(f"^(?:{pattern})$")
        good = {"card": check_sum(_digits(match)) == 0, "phone": F.char_length(_digits(match)).between(8, 15)}.get(kind, F.lit(True))
        value = F.when(good, F.lit(kind))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def canonical(kind: Column, match: Column) -> Column:
    """What spellings of one entity share; kind is the type of match. A phone number without a country code has 1."""
    phone = F.concat(F.when(match.startswith("+"), "").otherwise("1"), _digits(match))
    return F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), _digits(match)).when(kind == "email", F.lower(match)).otherwise(match)


def _noise(key: str, *parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 512)


def _drawn(noise: Column, i: Column) -> Column:
    """The i-th number below 65536 of the noise, from 0 on; it repeats after 32."""
    return F.conv(F.substring(noise, 4 * F.pmod(i, F.lit(32)) + 1, F.lit(4)), 16, 10).cast("int")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _shifted(c: Column, by: Column) -> Column:
    """A letter or digit moved on within its alphabet; a letter of no alphabet becomes some Latin one, all else stays."""
    other = F.when(c.rlike(r"\p{L}"), F.substring(F.lit("aeiouklmnprst"), by % 13 + 1, F.lit(1))).otherwise(c)

    def own(at):
        start, size = _at(_STARTS, at), _at(_SIZES, at)
        return F.when(at > 0, F.substring(F.lit(_LETTERS), start + (at - start + by) % size, F.lit(1))).otherwise(other)

    return let(F.instr(F.lit(_LETTERS), c), own)


def _hex_shifted(c: Column, by: Column) -> Column:
    """A digit of lower-case hexadecimal moved on."""
    return let(F.instr(F.lit("0123456789abcdef"), c), lambda at: F.substring(F.lit("0123456789abcdef"), (at - 1 + by) % 16 + 1, F.lit(1)))


def _octet_shifted(c: Column, by: Column) -> Column:
    """A number below 256 moved on; null for what is no number."""
    return ((c.try_cast("int") + by) % 256).cast("string")


def permuted(key: str, kind: Column, attempt: Column, units: Column, shifted: Callable[[Column, Column], Column] = _shifted) -> Column:
    """The units (an array) under a keyed permutation: four rounds, each of which shifts every other unit by noise
    from the units that stay."""

    def again(value: Column, r: int) -> Column:
        if r == 4:
            return value
        still = F.array_join(F.filter(value, lambda c, i: i % 2 != r % 2), ".")
        moved = lambda noise: F.transform(value, lambda c, i: F.when(i % 2 == r % 2, shifted(c, _drawn(noise, (i / 2).cast("int")))).otherwise(c))
        return let(let(_noise(key, kind, attempt, str(r), still), moved), lambda v: again(v, r + 1))

    return let(units, lambda v: again(v, 0))


#: First octets of public networks, and the parts of an address that stay.
_PUBLIC = [n for n in range(1, 224) if n not in (10, 127, 172, 192)]
_KEPT = r"^(10\.|127\.|(?:192|172)\.\d+\.|0\.|2(?:2[4-9]|[34]\d|5[0-5])\.)"
_WORDS = ("surname", "given-f", "given-m")


def pieces(kind: Column, match: Column) -> Column:
    """What of an entity stays or is drawn apart (`kept`), and the units that are permuted.

    A phone number keeps its country code, a card its first digit, a secret what names it; of an address that stays which
    tells a network that isn't public, else its first octet is drawn apart, as the first digit of a phone number is.
    """
    digits, phone, rest = _digits(match), canonical(F.lit("phone"), match), F.lit(1000)
    code = F.regexp_extract(phone, rf"^({CALLING}|\d{{3}})", 1)
    address = F.coalesce(F.nullif(F.regexp_extract(match, _KEPT, 1), F.lit("")), F.concat(F.substring_index(match, ".", 1), F.lit(".")))
    kept = (
        F.when(kind == "email", F.lower(F.substring_index(match, "@", -1))).when(kind == "phone", code).when(kind == "card", F.substring(digits, 1, 1))
        .when(kind == "secret", F.regexp_extract(match, "^([^\"']*[\"']|AKIA)", 1)).when(kind == "ip", address).otherwise("")
    )

    def with_units(k: Column) -> Column:
        text = (
            F.when(kind == "email", F.lower(F.substring_index(match, "@", 1))).when(kind == "phone", F.substring(phone, F.char_length(k) + 2, rest)).when(kind == "card", F.substring(digits, F.lit(2), F.char_length(digits) - 2))
            .when(kind == "secret", F.regexp_extract(F.substring(match, F.char_length(k) + 1, F.char_length(match)), "^([^\"']*)", 1)).when(kind == "ssn", digits).otherwise(match)
        )
        units = F.when(kind == "ip", F.split(F.substring(match, F.char_length(k) + 1, rest), r"\.")).otherwise(_chars(text))
        return F.struct(k.alias("kept"), units.alias("units"))

    return let(kept, with_units)


def _laid(spelling: Column, drawn: Column) -> Column:
    """The digits of spelling replaced by those of drawn, from left to right."""
    nth = lambda i: F.char_length(_digits(F.substring(spelling, F.lit(1), i)))
    return F.array_join(F.transform(_chars(spelling), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(drawn, nth(i + 1), F.lit(1))).otherwise(c)), "")


def _email(key: str, match: Column, host: Column, drawn: Column, attempt: Column) -> Column:
    """The local part keeps the case of its letters; a host goes to one of its own, a letter longer an attempt."""
    top = F.substring_index(host, ".", -1)
    letters = lambda n: F.array_join(F.transform(F.sequence(F.lit(1), 10 + attempt), lambda i: F.substring(F.lit("bcdfghjklmnpqrstvwxz"), _drawn(n, i) % 20 + 1, F.lit(1))), "")
    cased = F.array_join(F.transform(_chars(F.substring_index(match, "@", 1)), lambda c, i: let(F.substring(drawn, i + 1, F.lit(1)), lambda d: F.when(c != F.lower(c), F.upper(d)).otherwise(d))), "")
    return F.concat(cased, F.lit("@"), let(_noise(key, "host", attempt, host), letters), F.lit(".example."), F.when(top.isin("com", "net", "org"), top).otherwise(F.lit("org")))


def _number(kind: Column, match: Column, kept: Column, drawn: Column, by: Column) -> Column:
    """The digits that a number gets: a phone's first digit after the code stays 0 or 1, or something else; a card's last
    digit makes the check sum right."""
    first = F.substring(canonical(F.lit("phone"), match), F.char_length(kept) + 1, F.lit(1)).cast("int")
    lead = F.when(first < 2, (first + by) % 2).otherwise((first - 2 + by) % 8 + 2).cast("string")
    last = lambda b: F.concat(b, F.pmod(10 - check_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))
    phone = F.concat(F.when(match.startswith("+"), kept).otherwise(""), lead, drawn)
    return F.when(kind == "phone", phone).when(kind == "card", let(F.concat(kept, drawn), last)).otherwise(drawn)


def _address(match: Column, kept: Column, drawn: Column, by: Column) -> Column:
    """What tells a network that isn't public stays; a public address stays public."""
    at = F.array_position(F.split(F.lit(" ".join(map(str, _PUBLIC))), " "), F.substring_index(match, ".", 1)).cast("int")
    first = F.concat(_at(_PUBLIC, (at - 1 + by) % len(_PUBLIC) + 1).cast("string"), F.lit("."))
    return F.concat(F.when(match.rlike(_KEPT), kept).otherwise(first), drawn)


def _word(key: str, kind: Column, word: Column, drawn: Column, attempt: Column) -> Column:
    """The surrogate of a word of a name: longer by a syllable an attempt, and with its gender's end."""
    cyrillic, latin = word.rlike(r"^\p{IsCyrillic}"), word.rlike(r"^\p{IsLatin}")
    script = lambda of: F.when(cyrillic, F.lit(of("cyrillic"))).otherwise(F.lit(of("latin")))
    letter = lambda kind, number: F.substring(script(lambda s: SYLLABLES[s][kind]), number % F.char_length(script(lambda s: SYLLABLES[s][kind])) + 1, F.lit(1))
    syllable = lambda noise, i: F.concat(letter(0, _drawn(noise, 2 * i)), letter(1, _drawn(noise, 2 * i + 1)))
    more = lambda noise: F.array_join(F.transform(F.sequence(F.lit(1), attempt), lambda i: syllable(noise, i)), "")
    grown = F.when(attempt > 0, let(_noise(key, kind, attempt, "more", word), more)).otherwise("")
    end = F.when(kind == "given-f", script(lambda s: ENDINGS[s, "f"])).when(kind == "given-m", script(lambda s: ENDINGS[s, "m"])).otherwise("")
    return F.concat(drawn, F.when(cyrillic | latin, F.concat(grown, end)).otherwise(""))


def title_of(match: Column) -> Column:
    return F.regexp_extract(match, rf"^((?:{_TITLES})\.? )", 1)


def name_words(match: Column) -> Column:
    """The words of a name after its title, each with its type: of two or more the first is a first name."""
    title = title_of(match)
    given = F.when(title.rlike(rf"^(?:{'|'.join(TITLES['f'])})\.? $"), "given-f").otherwise("given-m")
    words = F.split(F.substring(match, F.char_length(title) + 1, F.char_length(match)), " ")
    return let(words, lambda w: F.transform(w, lambda x, i: F.struct(F.when((F.size(w) > 1) & (i == 0), given).otherwise("surname").alias("kind"), x.alias("match"), x.alias("value"))))


def surrogate(key: str, kind: Column, match: Column, attempt: Column) -> Column:
    """The replacement of one entity: of a match, or of a word of a name; the match itself where kind is null."""

    def made(p):
        tweak = F.when(kind == "phone", F.concat(kind, p["kept"])).otherwise(kind)
        hexadecimal = (kind == "secret") & F.forall(p["units"], lambda c: c.rlike("[0-9a-f]"))
        shifted = lambda c, by: F.when(kind == "ip", _octet_shifted(c, by)).when(hexadecimal, _hex_shifted(c, by)).otherwise(_shifted(c, by))
        joined = lambda u: F.when(kind == "ip", F.array_join(u, ".")).otherwise(F.array_join(u, ""))
        return let(let(permuted(key, tweak, attempt, p["units"], shifted), joined), lambda drawn: by_kind(p["kept"], drawn))

    def by_kind(kept, drawn):
        by = lambda then: let(_drawn(_noise(key, kind, attempt, "first", drawn), F.lit(0)), then)
        rest = F.char_length(kept) + F.char_length(drawn)
        return (
            F.when(kind.isin(*_WORDS), _word(key, kind, match, drawn, attempt)).when(kind == "email", _email(key, match, kept, drawn, attempt))
            .when(kind == "secret", F.concat(kept, drawn, F.substring(match, rest + 1, F.char_length(match)))).when(kind == "ip", by(lambda n: _address(match, kept, drawn, n)))
            .when(kind.isin("ssn", "phone", "card"), let(by(lambda n: _number(kind, match, kept, drawn, n)), lambda d: _laid(match, d))).otherwise(match)
        )

    return F.when(kind.isNull(), match).otherwise(let(pieces(kind, match), made))


def space(kind: Column, value: Column) -> Column:
    """Names the format that surrogates of an entity can't leave: its type, the digits that stay, its length; null where they can grow."""
    kept = {
        "ssn": F.lit(""), "card": F.concat(F.substring(value, 1, 1), F.lit("/"), F.char_length(value).cast("string")), "ip": F.regexp_extract(value, _KEPT, 1),
        "phone": F.concat(F.regexp_extract(value, rf"^({CALLING}|\d{{3}})", 1), F.lit("/"), F.char_length(value).cast("string")),
        "secret": F.regexp_replace(F.regexp_replace(value, "[A-Z]", "A"), "[0-9a-z]", "0"),
    }
    out = F.lit(None).cast("string")
    for name, part in kept.items():
        out = F.when(kind == name, F.concat_ws("\x1f", F.lit(name), part)).otherwise(out)
    return out


def found(text: Column) -> Column:
    """The matches in a text, in order; some may be numbers without a type."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def parts_of(match: Column) -> Column:
    """The entities (kind, match, value) in a match: the words of a name, or the match itself; none where it has no type."""
    own = lambda k: F.when(k == "name", name_words(match)).when(k.isNotNull(), F.array(F.struct(k.alias("kind"), match.alias("match"), canonical(k, match).alias("value"))))
    return let(kind_of(match), own)


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, value, match): the distinct entities of the corpus, one spelling each."""
    each = docs.select(F.explode(F.array_distinct(found(F.col(text_col)))).alias("found")).groupBy("found").agg(F.count(F.lit(1)).alias("n"))
    typed = each.select(F.explode(parts_of(F.col("found"))).alias("e")).select("e.*")
    return typed.groupBy("kind", "value").agg(F.min("match").alias("match"))


def exceptions(known: DataFrame, key: str, draws: int = DRAWS) -> DataFrame:
    """(kind, value, attempt) of the entities whose attempt isn't 0, so that surrogates are all distinct and,
    but for spaces that `draws` attempts don't do for, none is an entity of the corpus."""
    known = stored(known, "pii-entities")
    taken = known.select("kind", F.col("value").alias("made"))
    state = known.withColumns({"attempt": F.lit(0), "full": F.lit(False)})
    for n in range(8 * draws):
        made = canonical(F.col("kind"), surrogate(key, F.col("kind"), F.col("match"), F.col("attempt")))
        made = stored(state.withColumn("made", made), "pii-made")
        first = made.groupBy("kind", "made").agg(F.max_by("value", F.struct("full", -F.col("attempt"), "value")).alias("first"), F.count(F.lit(1)).alias("n"))
        clash = made.join(first.where("n > 1"), ["kind", "made"]).where("value != first")
        clash = clash.select("kind", "value", "full").unionAll(made.join(taken, ["kind", "made"], "left_semi").select("kind", "value", "full")).where("NOT full").select("kind", "value").distinct()
        clash = stored(clash, "pii-clash")
        if clash.isEmpty():
            return state.where("attempt > 0").select("kind", "value", "attempt")
        if n and n % draws == 0:
            # The formats that still clash are full: all their entities go back to the permutation.
            full = clash.withColumn("space", space(F.col("kind"), F.col("value"))).where("space IS NOT NULL").select("space").distinct().withColumn("now", F.lit(True))
            state = made.withColumn("space", space(F.col("kind"), F.col("value"))).join(full, "space", "left")
            state = state.select("kind", "value", "match", F.when(F.col("now"), 0).otherwise(F.col("attempt")).alias("attempt"), F.coalesce("now", "full").alias("full"))
            made = stored(state, "pii-state")
        state = made.join(clash.withColumn("more", F.lit(1)), ["kind", "value"], "left")
        state = state.select("kind", "value", "match", F.when(F.col("full"), 0).otherwise(F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt"), "full")
    raise RuntimeError(f"surrogates still collide after {8 * draws} draws")


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None, few: int = FEW) -> DataFrame:
    """docs with surrogates in text_col; count_col, if named, gets the number of replaced matches.

    Every row and column stays. A null text stays null, an empty one empty, both with count 0; repeated
    rows get the same text; an empty table stays empty; texts are read whole.
    """
    text, hits, tries = F.col(text_col), free_name(docs, "_hits"), free_name(docs, "_tries")
    retry = stored(exceptions(entities(docs, text_col), key), "pii-exceptions")
    out = docs.withColumn(hits, F.transform(found(text), lambda m: F.struct(m.alias("match"), parts_of(m).alias("parts"))))
    named = F.struct(F.concat_ws("\x1f", "kind", "value"), "attempt")
    if many := retry.count():
        if many <= few:
            out = out.crossJoin(F.broadcast(retry.agg(F.map_from_entries(F.collect_list(named)).alias(tries))))  # one row of at most `few` entries
        else:
            digest = free_name(docs, "_digest")
            each = docs.select(F.sha2(text, 256).alias(digest), F.explode(F.array_distinct(F.flatten(F.filter(F.transform(found(text), parts_of), lambda p: p.isNotNull())))).alias("e"))
            needed = each.select(digest, "e.kind", "e.value").join(retry, ["kind", "value"]).distinct().groupBy(digest).agg(F.map_from_entries(F.collect_list(named)).alias(tries))
            out = out.withColumn(digest, F.sha2(text, 256)).join(needed, digest, "left").drop(digest)
        attempt = lambda kind, value: F.coalesce(F.try_element_at(F.col(tries), F.concat_ws("\x1f", kind, value)), F.lit(0))
    else:
        attempt = lambda kind, value: F.lit(0)

    def replaced(hit):
        own = lambda e: let(attempt(e["kind"], e["value"]), lambda a: surrogate(key, e["kind"], e["match"], a))
        return F.when(hit["parts"].isNull(), hit["match"]).otherwise(F.concat(title_of(hit["match"]), F.array_join(F.transform(hit["parts"], own), " ")))

    parts = F.split(text, ANY, -1)
    joined = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(let(F.get(F.col(hits), i), replaced), F.lit("")))), "")
    if count_col:
        out = out.withColumn(count_col, F.coalesce(F.size(F.filter(F.col(hits), lambda h: h["parts"].isNotNull())), F.lit(0)))
    return out.withColumn(text_col, F.when(F.size(hits) > 0, joined).otherwise(text)).drop(hits, tries)
