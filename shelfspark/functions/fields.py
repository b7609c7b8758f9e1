"""Multi-value fields, content hashes and JSON sizes."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions import fixed
from shelfspark.functions.text import TAG_PATTERN, needs_python, tidy


@F.pandas_udf(T.ArrayType(T.StringType()))
def _compat_markup_items(values: pd.Series) -> pd.Series:
    tag = re.compile(TAG_PATTERN)

    def one(items):
        return [html.unescape(tag.sub(" ", unicodedata.normalize("NFKC", i))) for i in items]

    return values.map(one, na_action="ignore")


def split_multi(cleaned: Column) -> Column:
    """Ordered distinct lower-case items, split on the first separator in use.

    Each item is cleaned once more after the split, so entities are unescaped a
    second time; only values that can hold one leave the JVM.
    """
    separator = (
        F.when(F.contains(cleaned, F.lit("|")), r"\|")
        .when(F.contains(cleaned, F.lit(";")), ";")
        .when(F.contains(cleaned, F.lit(",")), ",")
        .when(F.contains(cleaned, F.lit("/")), "/")
    )
    parts = F.when(separator.isNull(), F.array(cleaned)).otherwise(F.split(cleaned, separator))
    odd = needs_python(cleaned)
    plain = F.transform(parts, lambda part: F.regexp_replace(part, TAG_PATTERN, " "))
    parts = F.when(odd, _compat_markup_items(F.when(odd, parts))).otherwise(plain)
    items = F.transform(
        parts,
        lambda part: F.trim(F.substring(F.lower(tidy(part)), 1, fixed.MAX_LIST_ITEM_CHARS)),
    )
    items = F.array_distinct(F.filter(items, lambda item: item != ""))
    return F.slice(items, 1, fixed.MAX_LIST_ITEMS)


def short_hash(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by newlines."""
    joined = F.concat_ws("\n", *[F.coalesce(part, F.lit("")) for part in parts])
    return F.substring(F.sha2(joined, 256), 1, 16)


def description_hash(description: Column) -> Column:
    return short_hash(description)


def translation_hash(name: Column, description: Column) -> Column:
    return short_hash(name, description)


def spaced_json_bytes(json_text: Column) -> Column:
    """Bytes of a JSON text when written with a space after each ``,`` and ``:``.

    Spark writes JSON without those spaces; the response limit counts them.
    """
    outside_strings = F.regexp_replace(json_text, r'"(\\.|[^"\\])*"', "")
    spaces = F.length(F.regexp_replace(outside_strings, "[^,:]", ""))
    return F.octet_length(json_text) + spaces


def known(value: Column) -> Column:
    """Null for an empty text, so that it is left out of JSON."""
    return F.when(value != "", value)


def known_list(value: Column) -> Column:
    return F.when(F.size(value) > 0, value)

