"""Nearest strings: a close spelling, else containment or a shared beginning.

Needles and candidates only meet through equal keys that every true match must
share, so no needle is compared with the whole vocabulary.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions import fixed
from shelfspark.functions.text import casefold
from shelfspark.session import written

# Fixed value: how many leading characters must agree with a candidate's first word.
PREFIX_CHARS = 4
GRAM = 3


@F.pandas_udf(T.DoubleType())
def _ratio(needles: pd.Series, keys: pd.Series) -> pd.Series:
    matcher = difflib.SequenceMatcher()
    scores = pd.Series(0.0, index=needles.index)
    for needle, group in keys.groupby(needles):
        matcher.set_seq2(needle)
        for at, key in group.items():
            matcher.set_seq1(key)
            scores[at] = matcher.ratio()
    return scores


def _letters(text: Column) -> Column:
    """The characters as a sorted set of numbers: the n-th `e` differs from the first.

    Sorted so that repeats and late letters, which are rare, come first.
    """
    chars = F.split(text, "")
    return F.array_sort(
        F.transform(
            chars,
            lambda char, at: -(
                F.size(F.filter(F.slice(chars, F.lit(1), at + 1), lambda other: other == char))
                * 2097152
                + F.ascii(char)
            ),
        )
    )


def _needed_letters(size: Column) -> Column:
    """Least number of letters any close match shares with a text of this size.

    A ratio of r needs r/2 of both sizes together, and a partner cannot be shorter
    than the letters it shares.
    """
    half = fixed.CLOSE_RATIO / 2
    shortest = F.ceil(size * half / (1 - half) - 1e-9)
    return F.ceil((size + shortest) * half - 1e-9)


def _with_prefix(df: DataFrame, text: str, name: str) -> DataFrame:
    """Explode the letters of which at least one must agree (prefix filter)."""
    size = F.length(text)
    keep = (size - _needed_letters(size) + 1).cast("int")
    return df.withColumn(f"{name}_letters", _letters(F.col(text))).withColumns(
        {
            f"{name}_prefix": F.slice(f"{name}_letters", F.lit(1), keep),
            "letter": F.explode(F.slice(f"{name}_letters", F.lit(1), keep)),
        }
    )


def _close(needles: DataFrame, keys: DataFrame) -> DataFrame:
    """Pairs whose difflib ratio reaches the cutoff."""
    size = F.length("needle") + F.length("key")
    shared = F.size(F.array_intersect("n_letters", "k_letters"))
    first = F.element_at(F.array_intersect("n_prefix", "k_prefix"), 1)
    pairs = (
        _with_prefix(needles, "needle", "n")
        .join(_with_prefix(keys, "key", "k"), "letter")
        .filter(
            (F.least(F.length("needle"), F.length("key")) * 2 >= size * fixed.CLOSE_RATIO - 1e-9)
            # A pair meets once per common letter; keep the first meeting.
            & (first == F.col("letter"))
            & (shared * 2 >= size * fixed.CLOSE_RATIO - 1e-9)
        )
        .select("needle", "key")
    )
    return pairs.withColumn("ratio", _ratio("needle", "key")).filter(
        F.col("ratio") >= fixed.CLOSE_RATIO
    )


def _grams(text: Column, sizes: Column) -> Column:
    """Distinct substrings of the given sizes."""
    return F.array_distinct(
        F.flatten(
            F.transform(
                sizes,
                lambda n: F.transform(
                    F.sequence(F.lit(1), F.length(text) - n + 1),
                    lambda at: F.substring(text, at, n),
                ),
            )
        )
    )


def _containing(needles: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys that contain a needle, met through the needle's rarest short substring."""
    grams = _grams(F.col("key"), F.sequence(F.lit(1), F.least(F.length("key"), F.lit(GRAM))))
    of_keys = keys.select("key", F.explode(grams).alias("gram"))
    counts = of_keys.groupBy("gram").agg(F.count("*").alias("n"))
    own = _grams(F.col("needle"), F.array(F.least(F.length("needle"), F.lit(GRAM))))
    rarest = (
        needles.select("needle", F.explode(own).alias("gram"))
        .join(counts, "gram", "left")
        .groupBy("needle")
        .agg(F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"))
    )
    return rarest.join(of_keys, "gram").filter(F.contains("key", "needle")).select("needle", "key")


def _contained(needles: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys that are a substring of a needle: equality with one of its substrings."""
    longest = keys.agg(F.coalesce(F.max(F.length("key")), F.lit(1)).alias("longest"))
    sizes = F.sequence(F.lit(1), F.least(F.length("needle"), F.col("longest")))
    return (
        needles.join(F.broadcast(longest))  # one row
        .select("needle", F.explode(_grams(F.col("needle"), sizes)).alias("key"))
        .join(keys.select("key"), "key")
        .select("needle", "key")
    )


def _same_start(needles: DataFrame, keys: DataFrame, limit: int) -> DataFrame:
    """Keys whose first word starts like the needle.

    Only the first keys per beginning can be shown: `limit`, and as many again for
    those already found by spelling.
    """
    word = F.split("key", " ")[0]
    order = Window.partitionBy("start").orderBy("at")
    starts = (
        keys.withColumn("word", word)
        .select(
            "key",
            "at",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.least(F.length("word"), F.lit(PREFIX_CHARS))),
                    lambda n: F.substring("word", F.lit(1), n),
                )
            ).alias("start"),
        )
        .withColumn("nth", F.row_number().over(order))
        .filter(F.col("nth") <= 2 * limit)
    )
    return (
        needles.withColumn("start", F.substring("needle", 1, PREFIX_CHARS))
        .join(starts, "start")
        .select("needle", "key")
    )


def closest(
    wanted: DataFrame, column: str, candidates: DataFrame, limit: int = fixed.MAX_SUGGESTIONS
) -> DataFrame:
    """Up to ``limit`` suggestions per distinct text of ``column``.

    ``candidates`` holds ``candidate`` and its place ``at``. Close spellings come
    first, best ratio first; then containment or a shared beginning, in order of
    ``at``. Returns ``(column, candidate, rank)``.
    """
    texts = written(
        wanted.select(column)
        .distinct()
        .withColumn("needle", casefold(F.trim(column)))
        .filter("needle <> ''"),
        "needles",
    )
    needles = texts.select("needle").distinct()
    # Of several spellings that fold together the last one is shown.
    vocabulary = written(
        candidates.withColumn("key", casefold(F.col("candidate")))
        .groupBy("key")
        .agg(F.max_by("candidate", "at").alias("candidate"), F.min("at").alias("at")),
        "vocabulary",
    )
    keys = vocabulary.select("key", "at")
    by_ratio = Window.partitionBy("needle").orderBy(F.desc("ratio"), F.desc("key"))
    close = (
        _close(needles, keys.select("key"))
        .withColumn("nth", F.row_number().over(by_ratio))
        .filter(F.col("nth") <= limit)
        .select("needle", "key", "nth")
    )
    related = (
        _containing(needles, keys.select("key"))
        .unionByName(_contained(needles, keys.select("key")))
        .unionByName(_same_start(needles, keys, limit))
        .withColumn("nth", F.lit(limit + 1))
    )
    order = Window.partitionBy("needle").orderBy("nth", "at", F.desc("key"))
    ranked = (
        close.unionByName(related)
        .groupBy("needle", "key")
        .agg(F.min("nth").alias("nth"))
        .join(vocabulary, "key")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
    )
    return texts.join(ranked, "needle").select(column, "candidate", "rank")


def name_candidates(products: DataFrame) -> DataFrame:
    """Product names as candidates; a name shared by many stands for the last one."""
    return products.groupBy(F.col("name").alias("candidate")).agg(
        F.min("_ord").alias("at"), F.max_by("product_id", "_ord").alias("product_id")
    )


def suggest_product_ids(requested: DataFrame, column: str, products: DataFrame) -> DataFrame:
    """``(column, did_you_mean)``: ids of the products named most like the text."""
    names = name_candidates(products)
    hits = closest(requested, column, names.select("candidate", "at"))
    return (
        hits.join(names.select("candidate", "product_id"), "candidate")
        .groupBy(column)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "product_id"))).alias("hits"))
        .select(column, F.col("hits.product_id").alias("did_you_mean"))
    )
