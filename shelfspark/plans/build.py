"""From product exports to the tables every question is answered from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.categories import changed_spellings, resolve_display, vocabulary
from shelfspark.operators.cleaning import accepted, classify, clean_rows, issue_rows, quarantine
from shelfspark.operators.duplicates import link_duplicates
from shelfspark.operators.enrich import add_pitches, add_translations
from shelfspark.operators.index import bucketed, term_index, with_terms
from shelfspark.operators.quality import (
    duplicate_group_count,
    issue_counts,
    load_summary,
    quarantine_counts,
)
from shelfspark.session import written
from shelfspark.sources.caches import PITCH_FIELDS, TRANSLATION_FIELDS, read_cache
from shelfspark.sources.exports import read_export
from shelfspark.sources.tables import pending_folder, read_tables, switch, write_tables


def build_products(
    classified: DataFrame,
    pitches: DataFrame | None = None,
    translations: DataFrame | None = None,
) -> DataFrame:
    """Accepted rows with categories, copies, cached texts and search terms."""
    products = link_duplicates(resolve_display(accepted(classified)))
    if pitches is not None:
        products = add_pitches(products, pitches)
    if translations is not None:
        products = add_translations(products, translations)
    return with_terms(products)


def build_catalogue(
    spark: SparkSession,
    export_paths: list[str] | str,
    folder: str,
    pitches_path: str | None = None,
    translations_path: str | None = None,
    multi_line: bool = True,
) -> dict[str, DataFrame]:
    """Read, clean, link, enrich and index exports; write and return all tables.

    Next to the catalogue these are the quality report: counts of quarantined rows and
    issues, changed spellings, a one-row summary, and the encoding of each file. All are
    written beside ``folder`` and put in its place when they are complete.

    The cleaned rows are written once, because products, quarantine and issues all
    come from them.
    """
    export = read_export(spark, export_paths, multi_line)
    classified = written(classify(clean_rows(export.rows)), "classified")
    pitches = read_cache(spark, pitches_path, PITCH_FIELDS) if pitches_path else None
    translations = (
        read_cache(spark, translations_path, TRANSLATION_FIELDS) if translations_path else None
    )
    products = build_products(classified, pitches, translations)
    pending = pending_folder(folder)
    write_tables({"products": products.drop("issues")}, pending)
    products = spark.read.parquet(f"{pending}/products")
    tables = {
        "quarantine": quarantine(classified),
        "issues": issue_rows(accepted(classified)),
        "term_index": bucketed(term_index(products)),
        "vocabulary": vocabulary(products),
        "quarantine_counts": quarantine_counts(classified),
        "issue_counts": issue_counts(accepted(classified)),
        "changed_spellings": changed_spellings(accepted(classified)),
        "load_summary": load_summary(classified)
        .crossJoin(duplicate_group_count(products))  # one row each
        .withColumn("unknown_columns", F.array(*map(F.lit, export.unknown_columns)).cast("array<string>")),
        "files": spark.createDataFrame(sorted(export.encodings.items()), "file string, encoding string"),
    }
    write_tables(tables, pending)
    switch(spark, pending, folder)
    return read_tables(spark, folder, "products", *tables)
