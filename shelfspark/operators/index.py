"""The bilingual, field-weighted term index.

A product's terms depend on that product alone, so the index is a map over rows:
no shuffle. Each entry carries what the term is worth in a search. A stored index lies in
buckets of terms, so that a search reads a part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import fixed
from shelfspark.functions.numbers import popularity
from shelfspark.functions.spanish import search_terms
from shelfspark.functions.text import stem, stems, tokens


def _entries(kind: str, any_: str, names: str, tags: str, weights: dict[str, float]) -> Column:
    def worth(term: Column) -> Column:
        return (
            F.lit(weights["any"])
            + F.when(F.array_contains(names, term), weights["name"]).otherwise(0.0)
            + F.when(F.array_contains(tags, term), weights["tag"]).otherwise(0.0)
        )

    return F.transform(
        any_,
        lambda term: F.struct(
            F.lit(kind).alias("kind"), term.alias("term"), worth(term).alias("weight")
        ),
    )


def with_terms(products: DataFrame) -> DataFrame:
    """Add the six term sets and the popularity of each product.

    Optional columns (translations, description) may be absent.
    """

    def col(name: str) -> Column:
        return F.col(name) if name in products.columns else F.lit(None).cast("string")

    spanish = search_terms(F.col("category"), F.col("subcategory"))
    tags = F.concat_ws(" ", "tags")
    everything = [
        "name", "category", "subcategory", "brand", "description",
        "name_es", "description_es", "color_es", "material_es",
    ]
    return (
        products.withColumns(
            {
                "name_tokens": tokens(F.concat_ws(" ", col("name"), col("name_es"))),
                "tag_tokens": tokens(F.concat_ws(" ", tags, F.col("subcategory"), spanish)),
                "tokens": tokens(
                    F.concat_ws(
                        " ",
                        *[col(name) for name in everything],
                        tags,
                        F.concat_ws(" ", "occasions"),
                        spanish,
                    )
                ),
            }
        )
        .withColumns(
            {
                "name_stems": stems(F.col("name_tokens")),
                "tag_stems": stems(F.col("tag_tokens")),
                "stem_tokens": stems(F.col("tokens")),
            }
        )
        .withColumn("popularity", popularity(F.col("rating"), F.col("reviews_count")))
    )


def term_index(products: DataFrame) -> DataFrame:
    """The index as rows: ``(product_id, kind, term, weight)``.

    The entries are made where they become rows. Of a column of entries Spark would first ask
    whether it is empty, making all of them twice, and stems once per entry.
    """
    termed = products if "stem_tokens" in products.columns else with_terms(products)
    entries = F.concat(
        _entries("token", "tokens", "name_tokens", "tag_tokens", fixed.TOKEN_WEIGHTS),
        _entries("stem", "stem_tokens", "name_stems", "tag_stems", fixed.STEM_WEIGHTS),
    )
    return termed.select("product_id", F.inline(entries))


#: Parts of a stored index; a search reads those that its terms are in.
TERM_BUCKETS = 256


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def bucketed(index: DataFrame) -> DataFrame:
    """The index ready to be stored by ``bucket``, a part of the terms each.

    A bucket with a very frequent term is split among tasks, small ones share a task.
    """
    rows = index.withColumn("bucket", term_bucket(F.col("term")))
    return rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "kind", "term")


def asked_entries(index: DataFrame, terms: DataFrame) -> DataFrame:
    """Entries of a stored index in the buckets of ``terms``: other buckets aren't read.

    At most ``TERM_BUCKETS`` numbers pass the driver. An index without buckets is read whole.
    """
    if "bucket" not in index.columns:
        return index
    asked = terms.select(term_bucket(F.col("term")).alias("bucket")).distinct().collect()
    return index.filter(F.col("bucket").isin(sorted(row.bucket for row in asked)))


def gate_violations(products: DataFrame) -> DataFrame:
    """Terms that would score without ever letting a product qualify; must be empty."""
    termed = products if "stem_tokens" in products.columns else with_terms(products)
    finer = F.array_union("name_tokens", "tag_tokens")
    return termed.select(
        "product_id", F.explode(F.array_except(finer, "tokens")).alias("term")
    )


def stem_families(products: DataFrame) -> DataFrame:
    """Which words each stem merges, with the guard values of the stemmer.

    ``shortest_cut`` is the length of the stem if it shortened any word.
    """
    termed = products if "tokens" in products.columns else with_terms(products)
    words = termed.select(F.explode("tokens").alias("word")).distinct()
    stemmed = words.withColumn("stem", stem(F.col("word")))
    return stemmed.groupBy("stem").agg(
        F.array_sort(F.collect_list("word")).alias("words"),
        F.count("*").alias("family_size"),
        F.max(F.when(F.col("word") != F.col("stem"), F.length("stem"))).alias("cut_length"),
    )
