"""Linking the copies of one product that are listed under several ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import casefold
from shelfspark.operators.skew import HOT_ROWS, attach


def duplicate_groups(products: DataFrame) -> DataFrame:
    """One row per group of two or more copies: same name, brand and price."""
    return (
        products.select(
            twin_key().alias("_twin"), "product_id", "category"
        )
        .groupBy("_twin")
        .agg(
            F.min("product_id").alias("duplicate_group_id"),
            F.collect_set("category").alias("categories"),
            F.count("*").alias("n_rows"),
        )
        .filter("n_rows > 1")
    )


def twin_key():
    return F.struct(
        casefold(F.col("name")).alias("name"),
        casefold(F.coalesce("brand", F.lit(""))).alias("brand"),
        F.col("price_eur").alias("price"),
    )


def link_duplicates(products: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the group id (the least member id) and the categories of the others."""
    linked = attach(
        products.withColumn("_twin", twin_key()),
        duplicate_groups(products),
        "_twin",
        F.col("product_id"),
        hot_rows=hot_rows,
    )
    others = F.array_sort(F.array_except("categories", F.array("category")))
    return linked.withColumn(
        "also_in_categories", F.coalesce(others, F.array().cast("array<string>"))
    ).drop("_twin", "categories")
