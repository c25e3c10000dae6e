r"""Text functions as column expressions: volumes, strengths, ages, prices, keywords, brands, identity keys.

Patterns are Java's: (?iu) folds Cyrillic too, and blanks beyond ASCII are listed, as \s has none of them.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

BLANK = r"[\s   -     　﻿]"
_CYRILLIC = "а-яіїєґ"
_NO_LETTER = f"(?![a-z{_CYRILLIC}])"
_ML = f"(?iu)([0-9]{{2,4}}){BLANK}*(?:мл|ml){_NO_LETTER}"
_LITRES = f"(?iu)([0-9]+(?:[.,][0-9]+)?){BLANK}*(?:літр|л|l){_NO_LETTER}"
_ABV = r"(?<![-−–])([0-9]{1,2}(?:[.,][0-9])?)" + BLANK + "*%"
_AGE = f"(?iu)(?<![0-9])([0-9]{{1,3}}){BLANK}*(?:y\\.?o\\.?|yo|years?|років|роки|рік|year|лет|года|год){_NO_LETTER}"
_MATURED = f"(?iu)витримк[{_CYRILLIC}]*{BLANK}*(?<![0-9])([0-9]{{1,3}})"
_BARE = f"^{BLANK}*([0-9]+(?:[.,][0-9]+)?){BLANK}*$"
_PRICE = r"[0-9][0-9\s   ]*(?:[.,][0-9]{1,2})?"


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def _first(text: Column, pattern: str) -> Column:
    """The first group of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _round(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def parse_price(text: Column) -> Column:
    """The first price in a text: blanks between digits go, a comma is the decimal sign unless there is a dot."""
    found = F.regexp_replace(F.nullif(F.regexp_extract(text, _PRICE, 0), F.lit("")), r"[\s   ]", "")
    comma = F.contains(found, F.lit(",")) & ~F.contains(found, F.lit("."))
    return F.when(comma, F.replace(found, F.lit(","), F.lit("."))).otherwise(F.replace(found, F.lit(","), F.lit(""))).try_cast("double")


def single_volume_ml(text: Column) -> Column:
    """The first volume: millilitres if any are named, else litres."""
    return F.coalesce(_first(text, _ML).cast("int"), _round(_number(_first(text, _LITRES)) * 1000))


def volume_ml(text: Column) -> Column:
    """The volume of a text; of a set joined by + the sum, where two parts or more name one."""
    parts = F.transform(F.split(text, r"\+"), single_volume_ml)
    known = F.filter(parts, lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0), lambda a, v: a + v)
    return F.when(F.size(known) > 1, total).otherwise(single_volume_ml(text))


def _in_range(values: Column, low: float, high: float) -> Column:
    return F.get(F.filter(F.transform(values, _number), lambda v: v.between(low, high)), F.lit(0))


def abv(text: Column) -> Column:
    """The first percentage from 30 to 70 that no dash stands before (those are discounts)."""
    return _in_range(F.regexp_extract_all(text, F.lit(_ABV), F.lit(1)), 30, 70)


def age_years(text: Column) -> Column:
    """A stated age of 1 to 60 years: a number with a unit, else one after the word for maturation."""
    ok = lambda v: F.when(v.between(1, 60), v)
    return F.coalesce(ok(_first(text, _AGE).cast("int")), ok(_first(text, _MATURED).cast("int")))


def abv_value(text: Column) -> Column:
    """A strength field, with or without the sign: the first number from 30 to 70."""
    return _in_range(F.regexp_extract_all(text, F.lit(r"([0-9]{1,2}(?:[.,][0-9])?)"), F.lit(1)), 30, 70)


def volume_value(text: Column) -> Column:
    """A volume field; a bare number under 20 is in litres, another in millilitres."""
    bare = _number(_first(text, _BARE))
    return F.coalesce(F.nullif(volume_ml(text), F.lit(0)), _round(F.when(bare < 20, bare * 1000).otherwise(bare)))


def age_value(text: Column) -> Column:
    """An age field; a bare number is in years, and then nothing else is looked for."""
    bare = F.floor(_number(_first(text, _BARE))).cast("int")
    return F.when(bare.isNotNull(), F.when(bare.between(1, 60), bare)).otherwise(age_years(text))


def _has_any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def _keyword(text: Column, table: dict[str, list[str]]) -> Column:
    return F.coalesce(*[F.when(_has_any(text, words), name) for name, words in table.items()])


def product_type(text: Column) -> Column:
    """The first type of the ordered list that a text names."""
    return _keyword(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), vocab.TYPE_KEYWORDS)


def country(text: Column) -> Column:
    return _keyword(F.lower(text), vocab.COUNTRY_KEYWORDS)


def canonical_country(value: Column) -> Column:
    """A stated country, trimmed; null for umbrella names and for nothing."""
    trimmed = F.regexp_replace(value, f"^{BLANK}+|{BLANK}+$", "")
    return F.when(~F.lower(trimmed).isin(vocab.UMBRELLA_COUNTRIES), F.nullif(trimmed, F.lit("")))


def flavor_tags(text: Column) -> Column:
    """All flavors a text names, sorted; never null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_sort(F.array_compact(F.array(*[F.when(_has_any(low, words), tag) for tag, words in vocab.FLAVOR_KEYWORDS.items()])))


def needs_model(abv_column: Column, volume_column: Column) -> Column:
    return abv_column.isNull() | volume_column.isNull()


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def brand(raw: Column) -> Column:
    """A brand's one spelling: wraps and junk go, Cyrillic names map to their Latin ones or to null."""
    wrap = "[\"“”«»'’‘`´\\s]+"
    text = F.trim(F.regexp_replace(F.regexp_replace(raw, f"^{wrap}|{wrap}$", ""), f"{BLANK}+", " "))
    key = F.trim(F.regexp_replace(F.lower(text), "[\\s'’‘`´_-]+", " "))
    upper_first = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))
    words = F.transform(F.split(key, " "), lambda w, i: F.when((i > 0) & w.isin("of", "and"), w).when((i > 0) & (w == "s"), "'s").otherwise(upper_first(w)))
    titled = F.regexp_replace(F.array_join(words, " "), " '", "'")
    named = F.when(F.rlike(text, F.lit(f"(?iu)[{_CYRILLIC}]")), _lookup(key, vocab.BRAND_ALIASES)).otherwise(F.coalesce(_lookup(key, vocab.BRAND_SPELLINGS), titled))
    return F.when((key != "") & ~key.isin(vocab.BRAND_JUNK), named)


def _latin_marks() -> tuple[str, str]:
    """Accented Latin letters and what is left of them without their marks: a rule, not a table."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii() and base[0].isalpha():
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _latin_marks()


def fold(text: Column) -> Column:
    """Lower case, Latin letters without marks, apostrophes gone, all but letters and digits as one blank."""
    plain = F.regexp_replace(F.translate(text, _MARKED, _PLAIN), "(?<=[A-Za-z])[\\u0300-\\u036F]+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(plain), "['’‘ʼ`´]", ""), f"[^0-9a-z{_CYRILLIC}]+", " "))


def _significant(words: Column) -> Column:
    stem = f"^(?:{'|'.join(vocab.KEY_STOP_STEMS)})"
    return F.filter(words, lambda w: (w != "") & ~w.isin(vocab.KEY_STOP_WORDS) & ~F.rlike(w, F.lit(stem)))


def match_key(name: Column, brand_name: Column, volume: Column, age: Column) -> Column:
    """The identity of a product across stores: its sorted significant words, volume and age; null without a word."""
    words = F.filter(_significant(F.split(fold(F.coalesce(name, F.lit(""))), " ")), lambda w: (F.length(w) >= 2) & ~F.rlike(w, F.lit("^[0-9]+(?:[.,][0-9]+)?(?:мл|л|l|ml)$")))
    own = F.array_join(_significant(F.split(fold(F.coalesce(brand_name, F.lit(""))), " ")), "")
    tokens = F.array_sort(F.filter(F.array_union(words, F.array(own)), lambda w: w != ""))
    key = F.concat(F.array_join(tokens, ""), F.lit("|v"), F.coalesce(volume, F.lit(0)).cast("string"), F.lit("|a"), F.coalesce(age, F.lit(0)).cast("string"))
    return F.when(F.size(tokens) > 0, key)


def spelling_key(name: Column) -> Column:
    """What two spellings of one name share: folded, without the article and without blanks."""
    return F.array_join(F.filter(F.split(fold(name), " "), lambda w: w != "the"), "")


def duration(seconds: Column) -> Column:
    """Minutes and seconds, as 3m 05s."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%dm %02ds", F.floor(whole / 60).cast("long"), (whole % 60).cast("long"))
