"""Normalization of names, addresses, cities and postal codes as Column expressions.

Everything stays inside the JVM.  Missing values are empty strings on the way out.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms with their spellings, in the order in which they are looked for.
LEGAL_FORMS = (
    ("inc", "incorporated|inc"),
    ("corp", "corporation|corp"),
    ("co", "company|co"),
    ("llc", "llc"),
    ("ltd", "limited|ltd"),
    ("plc", "plc"),
    ("bv", "bv"),
    ("nv", "nv"),
    ("gmbh", "gmbh"),
    ("holdings", "holdings?"),
    ("group", "group"),
)
# Abbreviations in company names.
NAME_WORDS = dict(ind="industrial", mfg="manufacturing", tech="technologies", svcs="services", intl="international", natl="national", assoc="associates")
# Abbreviations in addresses.
ADDRESS_WORDS = dict(
    st="street", str="street", ave="avenue", av="avenue", rd="road", blvd="boulevard", dr="drive", ln="lane", ct="court", pl="place", sq="square",
    hwy="highway", pkwy="parkway", apt="apartment", ste="suite", fl="floor", n="north", s="south", e="east", w="west", mt="mount",
)
CITY_WORDS = ADDRESS_WORDS | {"st": "saint"}
# Fixed value: Dutch-style and numeric postal codes.
POSTAL = r"(?U)\b(\d{4}\s?[a-zA-Z]{2}\b|\d{4,5}(?:[- ]?\d{2,4})?\b)"


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters that fold to one character, those that vanish (at the end), and letters that fold to several."""
    source, target, gone, several = [], [], [], []
    for point in range(128, min(sys.maxunicode, 0x1FFFF)):
        c = chr(point)
        if 0xD800 <= point <= 0xDFFF or 0xAC00 <= point <= 0xD7A3:
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain == c:
            continue
        if not plain:
            gone.append(c)
        elif len(plain) == 1:
            source.append(c)
            target.append(plain)
        elif plain.isascii() and plain.isalpha():
            several.append((c, plain))
    return "".join(source + gone), "".join(target), tuple(several)


def strip_accents(text: Column) -> Column:
    """Compatibility decomposition without combining marks, where a character folds to one or to plain letters."""
    source, target, several = _folding()
    out = F.translate(text, source, target)
    for c, plain in several:
        if ord(c) < 0x200 or 0xFB00 <= ord(c) <= 0xFB06:
            out = F.replace(out, F.lit(c), F.lit(plain))
    return F.when(text.rlike(r"[^\x00-\x7F]"), out).otherwise(text)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def basic_clean(text: Column) -> Column:
    """Lower case without accents or punctuation; dots vanish, ampersands are words."""
    low = F.lower(strip_accents(F.coalesce(text.cast("string"), F.lit(""))))
    low = F.replace(F.replace(low, F.lit("&"), F.lit(" and ")), F.lit("."), F.lit(""))
    return squeeze(F.regexp_replace(low, r"(?U)[^\w\s]", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def expand(tokens: Column, mapping: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.transform(tokens, lambda w: F.coalesce(F.try_element_at(table, w), w))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def name_parts(raw_name: Column) -> Column:
    """Struct of ``normalized_name``, ``legal_suffix`` and ``name_core_tokens``.

    The suffix is the first legal form of the list that the name holds; all forms are
    taken out.  As every form is one word, none hides or uncovers another.
    """
    forms = [form for form, _ in LEGAL_FORMS]
    every = rf"(?U)\b(?:{'|'.join(spellings for _, spellings in LEGAL_FORMS)})\b"

    def parts(text: Column) -> Column:
        suffix = F.coalesce(*[F.when(text.rlike(rf"(?U)\b(?:{spellings})\b"), F.lit(form)) for form, spellings in LEGAL_FORMS], F.lit(""))
        core = expand(F.filter(words(squeeze(F.regexp_replace(text, every, " "))), lambda w: ~w.isin(forms)), NAME_WORDS)
        return F.struct(suffix.alias("suffix"), core.alias("core"))

    return let(
        let(basic_clean(raw_name), parts),
        lambda p: F.struct(
            F.array_join(F.filter(F.concat(p["core"], F.array(p["suffix"])), lambda w: w != ""), " ").alias("normalized_name"),
            p["suffix"].alias("legal_suffix"),
            F.array_sort(F.array_distinct(p["core"])).alias("name_core_tokens"),
        ),
    )


def address_text(raw_address: Column) -> Column:
    return F.array_join(expand(words(basic_clean(raw_address)), ADDRESS_WORDS), " ")


def city_name(city: Column) -> Column:
    return F.array_join(expand(words(basic_clean(city)), CITY_WORDS), " ")


def postal_code(code: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(code, F.lit("")), r"(?U)[\s-]", ""))


def postal_from_address(raw_address: Column) -> Column:
    """The last postal code in a free-text address, or an empty string."""
    found = F.regexp_extract_all(F.coalesce(raw_address, F.lit("")), F.lit(POSTAL), F.lit(1))
    return F.coalesce(postal_code(F.try_element_at(found, F.lit(-1))), F.lit(""))


def city_from_address(raw_address: Column) -> Column:
    """The city of a comma-separated address, by the number of its segments."""
    parts = F.filter(F.transform(F.split(F.coalesce(raw_address, F.lit("")), ","), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")

    def without_code(last: Column) -> Column:
        at = F.regexp_instr(last, F.lit(POSTAL))
        rest = F.concat(F.substr(last, F.lit(1), at - 1), F.substr(last, at + F.length(F.regexp_substr(last, F.lit(POSTAL)))))
        return F.when(at > 0, rest).otherwise(last)

    def city(p: Column) -> Column:
        return F.when(F.size(p) >= 3, F.try_element_at(p, F.lit(-2))).when(F.size(p) == 2, let(F.try_element_at(p, F.lit(-1)), without_code)).otherwise(F.lit(""))

    return city_name(let(parts, city))


def first_filled(value: Column, otherwise: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(otherwise)


def soundex(token: Column) -> Column:
    """Soundex of a token; one that begins with no letter keeps that character and codes the rest."""
    return F.when(token.rlike("^[A-Za-z]"), F.soundex(token)).otherwise(F.concat(F.upper(F.left(token, F.lit(1))), F.substring(F.soundex(F.concat(F.lit("a"), F.substring(token, 2, 1 << 20))), 2, 3)))
