"""Canonical categories, their summary, and the filter vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import fixed
from shelfspark.functions.text import (
    category_key,
    clean_text,
    nfkc,
    slugify,
    spelling_order,
    title_case_score,
)
from shelfspark.operators.nearest import closest
from shelfspark.operators.skew import HOT_ROWS, attach
from shelfspark.operators.ranks import ranked
from shelfspark.session import written


def category_spellings(products: DataFrame) -> DataFrame:
    return (
        products.filter("category_key <> ''")
        .groupBy("category_key", "category_raw")
        .agg(F.count("*").alias("n"))
    )


def display_names(spellings: DataFrame) -> DataFrame:
    """The best-looking spelling per key: most capitals, then most used, then first."""
    raw = F.col("category_raw")
    best = F.max(
        F.struct(title_case_score(raw), F.col("n"), spelling_order(raw), raw.alias("raw"))
    )
    return spellings.groupBy("category_key").agg(
        best["raw"].alias("category"), F.sum("n").alias("n_rows")
    )


def changed_spellings(products: DataFrame) -> DataFrame:
    """Every spelling that was replaced, with its replacement."""
    spellings = category_spellings(products)
    return (
        spellings.join(display_names(spellings).drop("n_rows"), "category_key")
        .filter("category_raw <> category")
        .select("category_raw", "category")
        .distinct()
    )


def resolve_display(products: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Give every product its display category, slug and key."""
    names = display_names(category_spellings(products))
    keyed = products.withColumn(
        "category_key", F.when(F.col("category_key") != "", F.col("category_key"))
    )
    named = attach(keyed, names, "category_key", F.col("product_id"), hot_rows=hot_rows)
    return named.withColumns(
        {
            "category": F.coalesce("category", F.lit("Uncategorised")),
            "category_slug": slugify(F.coalesce("category", F.lit("Uncategorised"))),
            "category_key": F.coalesce("category_key", F.lit("uncategorised")),
        }
    )


def category_summary(products: DataFrame) -> DataFrame:
    """One row per category: counts, price range and subcategories."""
    # Two partial aggregations; distinct subcategories are reduced before they
    # are gathered, so a hot category moves only its distinct values.
    per_shelf = products.groupBy("category", "subcategory").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("stock_level").isin(fixed.RECOMMENDABLE)).alias("buyable"),
        F.min("price_eur").alias("low"),
        F.max("price_eur").alias("high"),
    )
    return per_shelf.groupBy("category").agg(
        slugify(F.col("category")).alias("slug"),
        F.sum("n").alias("product_count"),
        F.sum("buyable").alias("in_stock_count"),
        F.min("low").alias("price_min"),
        F.max("high").alias("price_max"),
        F.array_sort(F.collect_list("subcategory")).alias("subcategories"),
    )


def vocabulary(products: DataFrame) -> DataFrame:
    """``(kind, value, n, rank)`` of categories, occasions and recipients.

    Distinct values are ranked by a sort over all partitions, however many there are of a kind.
    """
    values = products.select(
        F.explode(
            F.concat(
                F.array(
                    F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")),
                    F.struct(F.lit("recipient").alias("kind"), F.col("recipient").alias("value")),
                ),
                F.transform(
                    "occasions",
                    lambda o: F.struct(F.lit("occasion").alias("kind"), o.alias("value")),
                ),
            )
        ).alias("v")
    ).select("v.*")
    counts = values.filter("value IS NOT NULL").groupBy("kind", "value").agg(
        F.count("*").alias("n")
    )
    ranks = ranked(counts.withColumn("rarity", -F.col("n")), ["kind"], ["rarity", "value"])
    return ranks.select("kind", "value", "n", F.col("rank").cast("int").alias("rank"))


def category_dimension(products: DataFrame) -> DataFrame:
    """One row per category: key, display name, slug, and its place in both lists.

    ``place`` is the rank by product count; ``first`` the first product in input
    order, by which slugs are listed.
    """
    found = products.groupBy("category").agg(
        F.min("category_key").alias("category_key"),
        F.count("*").alias("n"),
        F.min("_ord").alias("first"),
    )
    found = found.withColumns({"slug": slugify(F.col("category")), "rarity": -F.col("n")})
    places = ranked(found, [], ["rarity", "category"], "place").drop("rarity")
    return written(places.withColumn("place", F.col("place").cast("int")), "categories")


def category_candidates(dimension: DataFrame) -> DataFrame:
    """Everything a requested category is compared with: names, then slugs."""
    names = dimension.select(
        F.col("category").alias("candidate"), _place(0, F.col("place")).alias("at")
    )
    slugs = dimension.groupBy("slug").agg(F.min("first").alias("first"))
    slugs = ranked(slugs, [], ["first", "slug"], "nth").select(
        F.col("slug").alias("candidate"), _place(1, F.col("nth").cast("int")).alias("at")
    )
    return names.unionByName(slugs)


def _place(part: int, nth: Column) -> Column:
    return F.struct(F.lit(part).alias("part"), nth.alias("nth"))


def resolve_requested(requested: DataFrame, dimension: DataFrame) -> DataFrame:
    """Resolve distinct ``requested`` category texts.

    Adds ``category`` (null when unknown), ``resolved_by`` (key, slug or nearest)
    and ``did_you_mean``. Only texts without an exact hit are compared.
    """
    wanted = requested.select("requested").distinct().filter("trim(requested) <> ''")
    cleaned = clean_text(F.col("requested"))
    by_key = dimension.select("category_key", F.col("category").alias("by_key"))
    # Two categories may share a slug; the one listed last answers to it.
    by_slug = dimension.groupBy("slug").agg(F.max_by("category", "first").alias("by_slug"))
    exact = written(
        wanted.withColumns(
            {"category_key": category_key(cleaned), "slug": slugify(nfkc(F.col("requested")))}
        )
        .join(by_key, "category_key", "left")
        .join(by_slug, "slug", "left")
        .select("requested", "by_key", "by_slug"),
        "requested",
    )
    unmatched = exact.filter("by_key IS NULL AND by_slug IS NULL").select("requested")
    hits = closest(unmatched, "requested", category_candidates(dimension))
    display = F.coalesce("slug_of", "candidate")
    nearest = (
        hits.join(
            by_slug.select(F.col("slug").alias("candidate_slug"), F.col("by_slug").alias("slug_of")),
            F.lower("candidate") == F.col("candidate_slug"),
            "left",
        )
        .groupBy("requested")
        .agg(F.sort_array(F.collect_list(F.struct("rank", display.alias("name")))).alias("hits"))
        .select("requested", F.array_distinct(F.col("hits.name")).alias("did_you_mean"))
    )
    return exact.join(nearest, "requested", "left").select(
        "requested",
        F.coalesce("by_key", "by_slug", F.try_element_at("did_you_mean", F.lit(1))).alias(
            "category"
        ),
        F.when(F.col("by_key").isNotNull(), "key")
        .when(F.col("by_slug").isNotNull(), "slug")
        .when(F.size("did_you_mean") > 0, "nearest")
        .alias("resolved_by"),
        "did_you_mean",
    )
