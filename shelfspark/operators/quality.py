"""The data-quality report as small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.cleaning import issue_rows


def quarantine_counts(classified: DataFrame) -> DataFrame:
    return (
        classified.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n_rows"))
    )


def issue_counts(products: DataFrame) -> DataFrame:
    """Soft issues of accepted rows, counted by ``field:kind``."""
    return (
        issue_rows(products)
        .groupBy(F.concat("field", F.lit(":"), "kind").alias("issue"))
        .agg(F.count("*").alias("n_rows"))
    )


def load_summary(classified: DataFrame) -> DataFrame:
    """Rows read, loaded and quarantined (also by reason), in one pass."""
    reasons = [
        "missing_product_id", "duplicate_product_id", "missing_name", "unparseable_price",
    ]
    return classified.agg(
        F.count("*").alias("rows_read"),
        F.count_if(F.col("reason").isNull()).alias("products_loaded"),
        F.count_if(F.col("reason").isNotNull()).alias("quarantined_total"),
        *[F.count_if(F.col("reason") == reason).alias(reason) for reason in reasons],
    )


def duplicate_group_count(products: DataFrame) -> DataFrame:
    """How many groups of linked copies there are."""
    return products.agg(
        F.count_if(F.col("duplicate_group_id") == F.col("product_id")).alias("duplicate_groups")
    )
