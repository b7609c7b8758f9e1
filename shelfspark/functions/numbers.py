"""Defensive number parsing as column expressions.

All parsers take text that went through ``clean_text``. Spark's own casts accept
spellings the input rules do not (``1f``) and reject some they allow
(``1_000``), so a pattern decides first and ``try_cast`` only converts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions import fixed
from shelfspark.functions.text import let

# Accepted number spellings and currency marks.
_DIGITS = r"\d+(_\d+)*"
NUMBER_PATTERN = rf"^[+-]?({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})([eE][+-]?{_DIGITS})?$"
CURRENCY_PATTERN = r"(?i)(eur|euros?|€|\$|£)"


def _number(text: Column) -> Column:
    """A finite double where the whole text is one number."""

    def convert(candidate: Column) -> Column:
        plain = F.replace(candidate, F.lit("_"), F.lit(""))
        return F.when(candidate.rlike(NUMBER_PATTERN), plain).try_cast("double")

    # An overlong exponent gives infinity, which is not a number anyone can use.
    return let(let(text, convert), lambda v: F.when(F.abs(v) < F.lit(float("inf")), v))


def round_exact(value: Column, digits: int) -> Column:
    """Round a non-negative double on its exact binary value, ties to even.

    Spark's ``round`` and ``bround`` go through the shortest decimal spelling and
    turn 2.675 into 2.68, although the stored number lies below the tie. Here the
    product with ten to the ``digits`` is split into its rounded part and its
    exact error (Dekker), which shows the side of the tie.
    """
    scale = float(10**digits)

    def error(v: Column) -> Column:
        wide = v * 134217729.0
        return let(
            wide - (wide - v),
            lambda high: (high * scale - v * scale) + (v - high) * scale,
        )

    def nearest(v: Column, whole: Column) -> Column:
        return let(
            (v * scale - whole - 0.5) + error(v),
            lambda beyond: whole
            + F.when((beyond > 0) | ((beyond == 0) & (whole % 2 == 1)), 1.0).otherwise(0.0),
        )

    return let(
        value,
        lambda v: let(F.floor(v * scale).cast("double"), lambda whole: nearest(v, whole)) / scale,
    )


def _one_decimal_point(text: Column) -> Column:
    """Drop thousands separators; the last separator kind is the decimal one."""
    last_comma = F.contains(text, F.lit(",")) & ~text.rlike(r",[^,]*\.[^,]*$")
    has_dot = F.contains(text, F.lit("."))
    decimal_comma = has_dot | text.rlike(r",[^,]{1,2}$")
    return (
        F.when(last_comma & decimal_comma, F.translate(text, ",.", "."))
        .when(F.contains(text, F.lit(",")), F.replace(text, F.lit(","), F.lit("")))
        .when(text.rlike(r"\..*\."), F.replace(text, F.lit("."), F.lit("")))
        .otherwise(text)
    )


def parse_money(cleaned: Column) -> Column:
    """A non-negative price with two decimals, or null."""
    text = F.replace(F.regexp_replace(cleaned, CURRENCY_PATTERN, ""), F.lit(" "), F.lit(""))
    amount = _number(let(F.regexp_replace(text, r"^\+", ""), _one_decimal_point))
    in_range = let(
        amount, lambda v: F.when((v >= 0) & (v <= fixed.MAX_PRICE_EUR), F.abs(v))
    )
    return round_exact(in_range, 2)


def parse_int(cleaned: Column) -> Column:
    """A whole number, truncated toward zero, or null."""
    return _number(F.regexp_replace(cleaned, "[ ,_]", "")).try_cast("bigint")


def parse_float(cleaned: Column) -> Column:
    def decimal_point(text: Column) -> Column:
        return F.when(F.contains(text, F.lit(".")), text).otherwise(
            F.replace(text, F.lit(","), F.lit("."))
        )

    return _number(let(F.replace(cleaned, F.lit(" "), F.lit("")), decimal_point))


def parse_bool(cleaned: Column) -> Column:
    """Three-valued: yes, no, or null for anything else."""
    word = F.lower(cleaned)
    return F.when(word.isin(fixed.YES_WORDS), True).when(word.isin(fixed.NO_WORDS), False)


def popularity(rating: Column, reviews: Column) -> Column:
    return F.coalesce(rating * F.log10(F.coalesce(reviews, F.lit(0)) + 10), F.lit(0.0))


def stock_level(stock: Column) -> Column:
    """Unknown stock is not the same as none."""
    return (
        F.when(stock.isNull(), "unknown")
        .when(stock == 0, "out_of_stock")
        .when(stock <= 5, "low")
        .otherwise("in_stock")
    )
