"""Joining precomputed texts, as long as they belong to today's product text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import fixed
from shelfspark.functions.fields import description_hash, known, translation_hash
from shelfspark.functions.text import clean_text


def add_translations(products: DataFrame, cache: DataFrame) -> DataFrame:
    """Spanish name and description where the cached hash still matches."""
    fresh = cache.select(
        "product_id",
        F.col("hash").alias("_hash"),
        known(F.substring(clean_text(F.col("name_es")), 1, fixed.MAX_NAME_CHARS)).alias("name_es"),
        known(
            F.substring(clean_text(F.col("description_es")), 1, fixed.MAX_DESCRIPTION_CHARS)
        ).alias("description_es"),
    )
    today = translation_hash(F.col("name"), F.col("description"))
    return (
        products.withColumn("_hash", today)
        .join(fresh, ["product_id", "_hash"], "left")
        .drop("_hash")
    )


def add_pitches(products: DataFrame, cache: DataFrame) -> DataFrame:
    """Replace the cut-off pitch by a cached one written for this description."""
    fresh = cache.select(
        "product_id",
        F.col("hash").alias("_hash"),
        known(F.substring(clean_text(F.col("pitch")), 1, fixed.MAX_PITCH_CHARS)).alias("_pitch"),
    )
    today = F.when(
        F.col("description").isNotNull(), description_hash(F.col("description"))
    )
    return (
        products.withColumn("_hash", today)
        .join(fresh, ["product_id", "_hash"], "left")
        .withColumns(
            {
                "pitch": F.coalesce("_pitch", "pitch"),
                "pitch_truncated": F.col("pitch_truncated") & F.col("_pitch").isNull(),
            }
        )
        .drop("_hash", "_pitch")
    )


def stale_entries(products: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached translations of products whose text has changed since."""
    today = products.select(
        "product_id", translation_hash(F.col("name"), F.col("description")).alias("expected")
    )
    return (
        cache.join(today, "product_id")
        .filter(~F.col("hash").eqNullSafe(F.col("expected")))
        .select("product_id", "hash", "expected")
    )
