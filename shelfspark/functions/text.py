"""Text hygiene and tokenising as column expressions.

Everything here runs inside Catalyst, except :func:`compat_markup` and
:func:`nfkc`: Spark has no Unicode normalisation and no HTML unescaping, so the
values that they could change (and only those) visit Python in Arrow batches.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions import fixed

# Character classes removed or folded while cleaning (Java syntax).
TAG_PATTERN = r"<[^>]+>"
CONTROL_PATTERN = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
SPACE_PATTERN = (
    r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
)
SPACE_BEFORE_PUNCTUATION = r" +([.,;:!?])"
#: What an HTML entity can begin with; any other ampersand stays as it is.
ENTITY_PATTERN = r"&[^\t\n\f <&;]"


@F.pandas_udf(T.StringType())
def _compat_markup(values: pd.Series) -> pd.Series:
    tag = re.compile(TAG_PATTERN)

    def one(text):
        return html.unescape(tag.sub(" ", unicodedata.normalize("NFKC", text)))

    return values.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda text: unicodedata.normalize("NFKC", text), na_action="ignore")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use ``value`` several times in ``body`` but evaluate and write it out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


@lru_cache(maxsize=1)
def settled_ranges() -> list[tuple[int, int]]:
    """Ranges of characters beyond ASCII that NFKC leaves alone whatever stands beside them.

    These are no marks, normalise to themselves, and aren't the second part of a composed
    character. Only ranges of a useful length are kept, as any other character is just looked
    at in Python.
    """
    restless = {code for code in range(0x1161, 0x1176)} | {code for code in range(0x11A8, 0x11C3)}
    for code in range(0x80, 0x10000):
        char = chr(code)
        parts = unicodedata.decomposition(char)
        if parts and "<" not in parts:
            restless.update(int(part, 16) for part in parts.split()[1:])
        if unicodedata.combining(char) or 0xD800 <= code < 0xE000 or unicodedata.normalize("NFKC", char) != char:
            restless.add(code)
    ranges, start = [], 0x80
    for code in [*sorted(restless), 0x10000]:
        if code - start >= (4 if start < 0x2200 else 32):
            ranges.append((start, code - 1))
        start = code + 1
    return ranges


def unsettled(value: Column) -> Column:
    """Whether NFKC could change a value; never false where it does.

    Only the characters beyond ASCII of a value are held against the ranges.
    """
    beyond = F.regexp_replace(value, r"[\x00-\x7f]+", "")
    ranges = "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in settled_ranges())
    return F.when(value.rlike(r"[^\x00-\x7f]"), beyond.rlike(f"[^{ranges}]")).otherwise(F.lit(False))


def nfkc(value: Column) -> Column:
    """Compatibility-normalise; text that this can't change never leaves the JVM."""
    odd = unsettled(value)
    return F.when(odd, _nfkc(F.when(odd, value))).otherwise(value)


def needs_python(value: Column) -> Column:
    """Whether NFKC or unescaping of entities could change a value."""
    return value.rlike(ENTITY_PATTERN) | unsettled(value)


def compat_markup(value: Column) -> Column:
    """NFKC, then drop tags, then unescape entities, in that order."""
    odd = needs_python(value)
    return F.when(odd, _compat_markup(F.when(odd, value))).otherwise(
        F.regexp_replace(value, TAG_PATTERN, " ")
    )


def tidy(value: Column) -> Column:
    """Control characters out, whitespace runs to one space, no space before a stop."""
    text = F.regexp_replace(value, CONTROL_PATTERN, " ")
    text = F.regexp_replace(text, SPACE_PATTERN, " ")
    return F.trim(F.regexp_replace(text, SPACE_BEFORE_PUNCTUATION, "$1"))


def clean_text(value: Column) -> Column:
    """One free-text field, safe on nulls and markup; never null."""
    return tidy(compat_markup(_text(value)))


def casefold(value: Column) -> Column:
    """Lower case that also folds the sharp s and the final sigma."""
    return F.translate(F.replace(F.lower(value), F.lit("ß"), F.lit("ss")), "ςſ", "σs")


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Every single character whose decomposition keeps exactly one ASCII character."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        char = chr(code)
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
    return "".join(source), "".join(target)


def fold_accents(value: Column) -> Column:
    """ASCII letters for accented ones; what has no ASCII form is dropped.

    Expects NFKC text, in which multi-character compatibility forms are gone.
    """
    source, target = _accent_table()

    def fold(text: Column) -> Column:
        plain = F.regexp_replace(F.translate(text, source, target), r"[^\x00-\x7f]", "")
        return F.when(text.rlike(r"[^\x00-\x7f]"), plain).otherwise(text)

    return let(value, fold)


def _rfind(backwards: Column, size: Column, mark: str) -> Column:
    """0-based index of the last ``mark``, -1 when absent, from the reversed text."""
    found = F.instr(backwards, mark[::-1])
    return F.when(found > 0, size - found - len(mark) + 1).otherwise(-1)


def truncate(text: Column, limit: int) -> Column:
    """struct(text, cut): shorten at a sentence end, else a word end, else hard."""

    def at_word(window: Column, space: Column) -> Column:
        kept = F.when(space > 0, F.substring(window, F.lit(1), space)).otherwise(window)
        return F.concat(F.rtrim(kept, F.lit(" ,;:-")), F.lit("…"))

    def shorten(window: Column) -> Column:
        backwards, size = F.reverse(window), F.length(window)
        sentence = F.greatest(*[_rfind(backwards, size, mark) for mark in (". ", "! ", "? ")])
        return let(
            sentence,
            lambda end: F.when(
                end >= limit // 3, F.trim(F.substring(window, F.lit(1), end + 1))
            ).otherwise(let(_rfind(backwards, size, " "), lambda space: at_word(window, space))),
        )

    cut = F.length(text) > limit
    short = let(F.substring(text, 1, limit), shorten)
    return F.struct(F.when(cut, short).otherwise(text).alias("text"), cut.alias("cut"))


def slugify(text: Column) -> Column:
    slug = F.regexp_replace(F.lower(fold_accents(text)), "[^a-z0-9]+", "-")
    slug = F.trim(slug, F.lit("-"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("uncategorised"))


def product_id(cleaned: Column) -> Column:
    """Identifier of an already cleaned value: no whitespace, upper case."""
    return F.upper(F.replace(cleaned, F.lit(" "), F.lit("")))


def category_key(cleaned: Column) -> Column:
    """Fold the spellings of one category onto one key."""
    text = F.regexp_replace(casefold(cleaned), r"\s+and\s+", " & ")
    text = F.regexp_replace(text, r"\s*&\s*", " & ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def title_case_score(text: Column) -> Column:
    """How many words start with a capital."""
    words = F.split(F.trim(text), r"\s+")
    return F.size(F.filter(words, lambda word: word.rlike(r"^\p{Lu}")))


def spelling_order(text: Column) -> Column:
    """Sort key that is greater for the alphabetically earlier spelling.

    Code points are negated, so of two spellings where one continues the other,
    the longer one is greater.
    """
    return F.transform(F.split(text, ""), lambda char: -F.ascii(char))


def tokens(text: Column) -> Column:
    """Distinct search terms of NFKC text: folded, lower case, no function words."""
    words = F.regexp_extract_all(
        fold_accents(F.lower(_text(text))), F.lit("([a-z0-9]{2,})"), F.lit(1)
    )
    stopwords = fixed.STOPWORDS_ENGLISH + fixed.STOPWORDS_SPANISH
    return F.array_distinct(F.filter(words, lambda word: ~word.isin(stopwords)))


def stem(token: Column) -> Column:
    """Fold everyday English variants of one token onto one key.

    At most one suffix goes, the longest that leaves three characters (a final
    ``ss`` is no plural); then a doubled consonant and a silent ``e``.
    """
    base = F
    for word, singular in fixed.IRREGULAR_PLURALS.items():
        base = base.when(token == word, F.lit(singular))
    base = base.otherwise(F.regexp_replace(token, fixed.SUFFIX_PATTERN, "$1"))
    single = F.regexp_replace(base, fixed.DOUBLED_PATTERN, "$1$2")
    return F.regexp_replace(single, fixed.SILENT_E_PATTERN, "$1")


def stems(token_array: Column) -> Column:
    return F.array_distinct(F.transform(token_array, stem))
