"""Inputs of the registered queries, derived from the given tables.

The texts below are expressions both Spark and DuckDB understand, so that the
queries and their SQL twins start from the same rows. Nothing here is an operator:
it only makes a product table, a deliberately dirty export and request tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.duplicates import link_duplicates
from shelfspark.operators.index import with_terms
from shelfspark.operators.skew import unsent
from shelfspark.session import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- A clean product table ------------------------------------------------------

_TITLE = "upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2))"
_TEXT = (
    "'A ' || p_name || ' by ' || p_brand || ', size ' || CAST(p_size AS STRING) "
    "|| '. Made for every home.'"
)

PRODUCT_COLUMNS = {
    "product_id": "CAST(p_partkey AS STRING)",
    "name": "p_name",
    "price_eur": "floor(p_retailprice / 10) * 10 + 0.5E0",
    "category": f"{_TITLE} || ' & Co'",
    "category_key": "lower(p_type) || ' & co'",
    "subcategory": "CASE WHEN p_partkey % 31 <> 0 THEN split_part(p_name, ' ', 2) END",
    "brand": "p_brand",
    "first_tag": "split_part(p_name, ' ', 1)",
    "second_tag": "split_part(p_name, ' ', 2)",
    "third_tag": "lower(p_brand)",
    "stock": "CASE WHEN p_partkey % 17 <> 0 THEN p_size % 13 END",
    "stock_level": (
        "CASE WHEN p_partkey % 17 = 0 THEN 'unknown' WHEN p_size % 13 = 0 THEN 'out_of_stock' "
        "WHEN p_size % 13 <= 5 THEN 'low' ELSE 'in_stock' END"
    ),
    "rated": "p_partkey % 23 <> 0",
    "color": "split_part(p_name, ' ', 1)",
    "material": (
        "CASE p_size % 4 WHEN 0 THEN 'Steel, oak' WHEN 1 THEN 'Moon dust,cotton' "
        "WHEN 2 THEN 'glass' END"
    ),
    "gift_wrap": "CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END",
    "shipping_days": "p_size % 7",
    "description": _TEXT,
    "_ord": "p_partkey",
}


def product_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products from parts; ratings from their sales, occasions and recipient from orders."""
    part = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", *[f"{text} AS {name}" for name, text in PRODUCT_COLUMNS.items()]
    )
    lines = table(spark, sf_dir, "lineitem")
    sales = lines.groupBy("l_partkey").agg(
        (F.floor(F.avg("l_quantity") + 0.5) / 10.0).alias("avg_rating"),
        F.count("*").alias("reviews_count"),
    )
    buyers = (
        lines.select("l_partkey", "l_orderkey")
        .join(unsent(table(spark, sf_dir, "orders")), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(unsent(table(spark, sf_dir, "customer")), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("l_partkey", F.lower("o_orderpriority").alias("occasion"),
                 F.lower("c_mktsegment").alias("segment"))
        .agg(F.count("*").alias("n"))
    )
    occasions = buyers.groupBy("l_partkey").agg(
        F.array_sort(F.collect_set("occasion")).alias("occasions")
    )
    segments = (
        buyers.groupBy("l_partkey", "segment")
        .agg(F.sum("n").alias("n"))
        .groupBy("l_partkey")
        .agg(F.min(F.struct((-F.col("n")).alias("n"), "segment"))["segment"].alias("segment"))
    )
    joined = (
        part.join(sales, F.col("p_partkey") == sales.l_partkey, "left").drop("l_partkey")
        .join(occasions, F.col("p_partkey") == occasions.l_partkey, "left").drop("l_partkey")
        .join(segments, F.col("p_partkey") == segments.l_partkey, "left").drop("l_partkey")
    )
    return joined.select(
        "product_id", "name", "price_eur", "category", "category_key", "subcategory", "brand",
        F.array("first_tag", "second_tag", "third_tag").alias("tags"),
        "stock", "stock_level",
        F.when(F.col("rated"), F.col("avg_rating")).alias("rating"),
        "reviews_count",
        F.coalesce("occasions", F.array().cast("array<string>")).alias("occasions"),
        F.when(F.col("segment") == "household", "anyone").otherwise(F.col("segment")).alias(
            "recipient"
        ),
        "color", "material", "gift_wrap", "shipping_days", "description",
        F.col("description").alias("pitch"),
        "_ord",
    )


def linked_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product table with copies linked and search terms added."""
    return with_terms(link_duplicates(product_table(spark, sf_dir)))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linked product table, written as the build does, ready to be asked."""
    return written(linked_products(spark, sf_dir), "products")


# --- A dirty export ----------------------------------------------------------------

_K = "p_partkey"
_ID = "lpad(CAST({k} AS STRING), 8, '0')"
_WHOLE = f"CAST(floor((({_K} % 12) * 11525 + 990) / 100) AS BIGINT)"
_CENTS = f"lpad(CAST((({_K} % 12) * 11525 + 990) % 100 AS STRING), 2, '0')"
_THOUSANDS = f"CAST(floor({_WHOLE} / 1000) AS BIGINT)"


def _grouped(mark: str) -> str:
    return (
        f"CASE WHEN {_WHOLE} >= 1000 THEN CAST({_THOUSANDS} AS STRING) || '{mark}' || "
        f"lpad(CAST({_WHOLE} % 1000 AS STRING), 3, '0') ELSE CAST({_WHOLE} AS STRING) END"
    )


RAW_COLUMNS = {
    "product_id": (
        f"CASE WHEN {_K} % 97 = 5 THEN '' "
        f"WHEN {_K} % 89 = 7 THEN 'GA-' || {_ID.format(k=_K + ' - 1')} "
        f"WHEN {_K} % 3 = 1 THEN ' ga-' || {_ID.format(k=_K)} || ' ' "
        f"WHEN {_K} % 3 = 2 THEN 'GA- ' || {_ID.format(k=_K)} "
        f"ELSE 'GA-' || {_ID.format(k=_K)} END"
    ),
    "name": (
        f"CASE WHEN {_K} % 101 = 3 THEN '   ' "
        f"WHEN {_K} % 5 = 0 THEN '<b>' || p_name || '</b>' "
        f"WHEN {_K} % 5 = 1 THEN 'R&amp;D  ' || p_name "
        f"WHEN {_K} % 5 = 2 THEN p_name || ' “X”' "
        f"WHEN {_K} % 5 = 3 THEN repeat(p_name || ' ', 20) ELSE p_name END"
    ),
    "category": (
        f"CASE WHEN {_K} % 53 = 0 THEN '' "
        f"WHEN {_K} % 4 = 0 THEN {_TITLE} || ' & Gifts' "
        f"WHEN {_K} % 4 = 1 THEN lower(p_type) || ' and gifts' "
        f"WHEN {_K} % 4 = 2 THEN ' ' || upper(p_type) || '  &  GIFTS' "
        f"ELSE {_TITLE} || ' And Gifts' END"
    ),
    "subcategory": f"CASE WHEN {_K} % 31 = 0 THEN '' ELSE split_part(p_name, ' ', 2) END",
    "brand": "p_brand",
    "price_eur": (
        f"CASE WHEN {_K} % 103 = 4 THEN 'banana' WHEN {_K} % 107 = 6 THEN '-5.00' "
        f"WHEN {_K} % 6 = 0 THEN CAST({_WHOLE} AS STRING) || '.' || {_CENTS} "
        f"WHEN {_K} % 6 = 1 THEN '€ ' || CAST({_WHOLE} AS STRING) || ',' || {_CENTS} "
        f"WHEN {_K} % 6 = 2 THEN 'EUR ' || CAST({_WHOLE} AS STRING) || '.' || {_CENTS} "
        f"WHEN {_K} % 6 = 3 THEN '€' || {_grouped('.')} || ',' || {_CENTS} "
        f"WHEN {_K} % 6 = 4 THEN {_grouped(',')} || '.' || {_CENTS} "
        f"ELSE '  +' || CAST({_WHOLE} AS STRING) || '.' || {_CENTS} || '  ' END"
    ),
    "stock": (
        f"CASE WHEN {_K} % 17 = 0 THEN 'N/A' WHEN {_K} % 19 = 0 THEN '' "
        f"WHEN {_K} % 43 = 0 THEN '-3' WHEN {_K} % 2 = 0 THEN CAST(p_size % 13 AS STRING) "
        f"ELSE CAST(p_size % 13 AS STRING) || '.9' END"
    ),
    "rating": (
        f"CASE WHEN {_K} % 23 = 0 THEN '' WHEN {_K} % 29 = 0 THEN '9.5' "
        f"WHEN {_K} % 37 = 0 THEN 'good' "
        f"WHEN {_K} % 2 = 0 THEN '4,' || CAST({_K} % 10 AS STRING) "
        f"ELSE '3.' || CAST({_K} % 10 AS STRING) || '5' END"
    ),
    "reviews_count": (
        f"CASE WHEN {_K} % 41 = 0 THEN 'many' WHEN {_K} % 7 = 0 THEN '' "
        f"WHEN {_K} % 3 = 0 THEN '1,' || lpad(CAST({_K} % 1000 AS STRING), 3, '0') "
        f"ELSE CAST({_K} % 500 AS STRING) END"
    ),
    "recipient": (
        f"CASE {_K} % 4 WHEN 0 THEN 'Anyone' WHEN 1 THEN ' HER ' WHEN 2 THEN 'him' ELSE '' END"
    ),
    "occasion": (
        f"CASE {_K} % 5 WHEN 0 THEN 'Birthday|Christmas' WHEN 1 THEN 'birthday; wedding ;' "
        f"WHEN 2 THEN 'Easter, Christmas ,easter' WHEN 3 THEN 'new home/Birthday' ELSE '' END"
    ),
    "tags": (
        f"CASE {_K} % 3 WHEN 0 THEN replace(p_name, ' ', '|') "
        f"WHEN 1 THEN replace(upper(p_name), ' ', ' ; ') ELSE p_name END"
    ),
    "color": f"CASE WHEN {_K} % 13 = 0 THEN '' ELSE split_part(p_name, ' ', 1) END",
    "material": (
        f"CASE {_K} % 4 WHEN 0 THEN 'Steel, oak' WHEN 1 THEN 'Moon dust,cotton' "
        f"WHEN 2 THEN 'GLASS' ELSE '' END"
    ),
    "gift_wrap": (
        f"CASE {_K} % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'No' WHEN 2 THEN 'maybe' WHEN 3 THEN '' "
        f"ELSE 'Sì' END"
    ),
    "shipping_days": (
        f"CASE WHEN {_K} % 47 = 0 THEN '999' WHEN {_K} % 59 = 0 THEN 'soon' "
        f"WHEN {_K} % 61 = 0 THEN '-2' ELSE CAST({_K} % 9 AS STRING) END"
    ),
    "description": (
        f"CASE WHEN {_K} % 67 = 0 THEN '' "
        f"WHEN {_K} % 71 = 0 THEN repeat('Good ' || p_name || '. ', 50) "
        f"WHEN {_K} % 73 = 0 THEN repeat('Good ' || p_name || ', ', 50) "
        f"ELSE '<p>A ' || p_name || ' by ' || p_brand || '.</p>   Fits &amp; lasts .' END"
    ),
}
RAGGED = f"CASE WHEN {_K} % 79 = 0 THEN 'missing columns' END"


def dirty_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as the raw, untrusted rows of an export."""
    return table(spark, sf_dir, "part").selectExpr(
        f"{_K} AS _ord", f"{RAGGED} AS _ragged",
        *[f"{text} AS {name}" for name, text in RAW_COLUMNS.items()],
    )


# --- Numbers and labels as untidy text --------------------------------------------------

_CENT_COUNT = "CAST(round(l_extendedprice * 100) AS BIGINT)"
_EUROS = f"CAST(floor({_CENT_COUNT} / 100) AS BIGINT)"
_REST = f"lpad(CAST({_CENT_COUNT} % 100 AS STRING), 2, '0')"


def _thousands(mark: str) -> str:
    return (
        f"CASE WHEN {_EUROS} >= 1000 THEN CAST(CAST(floor({_EUROS} / 1000) AS BIGINT) AS STRING) "
        f"|| '{mark}' || lpad(CAST({_EUROS} % 1000 AS STRING), 3, '0') "
        f"ELSE CAST({_EUROS} AS STRING) END"
    )


MONEY_TEXT = (
    f"CASE WHEN l_suppkey % 50 = 7 THEN 'banana' WHEN l_suppkey % 50 = 8 THEN '-' || "
    f"CAST({_EUROS} AS STRING) WHEN l_suppkey % 50 = 9 THEN '1.000.' || {_thousands('.')} "
    f"WHEN l_suppkey % 50 = 10 THEN '' "
    f"WHEN l_suppkey % 50 = 11 THEN CAST({_EUROS} AS STRING) || ',,' "
    f"WHEN l_suppkey % 50 = 12 THEN CAST({_EUROS} AS STRING) || ',5,' "
    f"WHEN l_linenumber = 1 THEN CAST({_EUROS} AS STRING) || '.' || {_REST} "
    f"WHEN l_linenumber = 2 THEN '€' || {_thousands('.')} || ',' || {_REST} "
    f"WHEN l_linenumber = 3 THEN {_thousands(',')} || '.' || {_REST} "
    f"WHEN l_linenumber = 4 THEN 'EUR  ' || CAST({_EUROS} AS STRING) || ',' || {_REST} "
    f"WHEN l_linenumber = 5 THEN {_thousands(',')} || ' euros' "
    f"ELSE '  +' || CAST({_EUROS} AS STRING) || '.' || {_REST} || ' $' END"
)
INT_TEXT = (
    f"CASE l_linenumber WHEN 1 THEN {_thousands(',')} WHEN 2 THEN '-' || CAST({_EUROS} AS STRING) "
    f"WHEN 3 THEN CAST({_EUROS} AS STRING) || '.99' WHEN 4 THEN 'about ' || CAST({_EUROS} AS STRING) "
    f"WHEN 5 THEN '1_0' || CAST({_EUROS} % 10 AS STRING) WHEN 6 THEN '' ELSE ' 2e3 ' END"
)
FLOAT_TEXT = (
    f"CASE l_linenumber WHEN 1 THEN CAST({_EUROS} AS STRING) || ',' || {_REST} "
    f"WHEN 2 THEN '-' || CAST({_EUROS} AS STRING) || '.' || {_REST} "
    f"WHEN 3 THEN {_thousands(',')} || '.' || {_REST} WHEN 4 THEN 'inf' WHEN 5 THEN '12f' "
    f"WHEN 6 THEN '' ELSE ' ' || CAST({_EUROS} AS STRING) || ' ' END"
)
BOOL_TEXT = (
    "CASE l_orderkey % 9 WHEN 0 THEN 'Yes' WHEN 1 THEN ' y ' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'no' "
    "WHEN 4 THEN '0' WHEN 5 THEN 'maybe' WHEN 6 THEN 'SÌ' WHEN 7 THEN '<b>f</b>' ELSE '' END"
)
SHELF_TEXT = (
    "CASE p_size % 5 WHEN 0 THEN 'Home & Living' WHEN 1 THEN 'PETS' WHEN 2 THEN 'Jewellery' "
    "WHEN 3 THEN p_type END"
)
SUBSHELF_TEXT = (
    "CASE p_partkey % 5 WHEN 0 THEN 'Knives' WHEN 1 THEN 'board games' WHEN 2 THEN 'Tea' "
    "WHEN 3 THEN split_part(p_name, ' ', 2) END"
)


# --- Requests ------------------------------------------------------------------------

# One request per customer; the part with the customer's number lends its words.
_C = "c_custkey"
SEARCH_COLUMNS = {
    "request_id": _C,
    "query": (
        f"CASE {_C} % 5 WHEN 0 THEN split_part(p_name, ' ', 2) || 's' WHEN 1 THEN p_name "
        f"WHEN 2 THEN 'a ' || split_part(p_name, ' ', 1) || ' for ' || lower(p_type) "
        f"WHEN 4 THEN CASE WHEN {_C} % 20 = 4 THEN 'qqq' || CAST({_C} AS STRING) "
        f"ELSE split_part(p_name, ' ', 1) END END"
    ),
    "category": (
        f"CASE WHEN {_C} % 61 = 0 THEN '##' WHEN {_C} % 7 = 0 THEN ' ' || upper(p_type) || ' AND CO' "
        f"WHEN {_C} % 7 = 1 THEN lower(p_type) || '-co' WHEN {_C} % 7 = 2 THEN {_TITLE} || ' & Co' "
        f"WHEN {_C} % 5 = 3 THEN {_TITLE} || ' & Co' END"
    ),
    "occasion": (
        f"CASE WHEN {_C} % 11 = 0 THEN '2-high' WHEN {_C} % 11 = 1 THEN '5-low' "
        f"WHEN {_C} % 37 = 2 THEN 'never' END"
    ),
    "recipient": (
        f"CASE WHEN {_C} % 6 = 0 THEN CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'anyone' "
        f"ELSE lower(c_mktsegment) END END"
    ),
    "max_price": (
        f"CASE WHEN {_C} % 13 = 0 THEN 100.0E0 WHEN {_C} % 3 = 0 THEN 900.5E0 + ({_C} % 10) * 10 END"
    ),
    "min_price": f"CASE WHEN {_C} % 8 = 0 THEN 940.5E0 END",
    "include_out_of_stock": f"{_C} % 9 = 0",
    "sort": (
        f"CASE {_C} % 6 WHEN 0 THEN 'price_asc' WHEN 1 THEN 'price_desc' WHEN 2 THEN 'rating' "
        f"WHEN 3 THEN 'relevance' END"
    ),
    "limit": f"CASE WHEN {_C} % 6 <> 1 THEN CAST({_C} % 15 AS INT) END",
}
_NOTHING = {
    "request_id": _C,
    "query": "CAST(NULL AS STRING)",
    "category": "CAST(NULL AS STRING)",
    "occasion": "CAST(NULL AS STRING)",
    "recipient": "CAST(NULL AS STRING)",
    "max_price": "CAST(NULL AS DOUBLE)",
    "min_price": "CAST(NULL AS DOUBLE)",
    "include_out_of_stock": "false",
    "sort": "CAST(NULL AS STRING)",
    "limit": "CAST(NULL AS INT)",
}


def only(*names: str) -> dict[str, str]:
    """Search requests that use just the named parameters."""
    return {**_NOTHING, **{name: SEARCH_COLUMNS[name] for name in names}}


# Narrow requests, which often find only sold-out or too expensive products.
FALLBACK_COLUMNS = {
    **_NOTHING,
    "query": "p_name",
    "category": f"{_TITLE} || ' & Co'",
    "recipient": f"CASE WHEN {_C} % 2 = 0 THEN 'machinery' END",
    "max_price": f"CASE WHEN {_C} % 3 <> 0 THEN 900.5E0 + ({_C} % 10) * 10 END",
}
BROWSE_COLUMNS = {
    "request_id": _C,
    "category": SEARCH_COLUMNS["category"].replace("% 5 = 3", "% 1 = 0"),
    "offset": f"CASE WHEN {_C} % 4 <> 0 THEN CAST(({_C} % 4) * 7 AS INT) END",
    "limit": f"CASE WHEN {_C} % 6 <> 1 THEN CAST({_C} % 25 AS INT) END",
    "max_price": f"CASE WHEN {_C} % 10 = 0 THEN 100.0E0 WHEN {_C} % 3 = 0 THEN 930.5E0 END",
    "include_out_of_stock": f"{_C} % 9 = 0",
    "sort": (
        f"CASE {_C} % 5 WHEN 0 THEN 'price_asc' WHEN 1 THEN 'price_desc' WHEN 2 THEN 'rating' "
        f"WHEN 3 THEN 'popularity' END"
    ),
}
SIMILAR_COLUMNS = {
    "request_id": _C,
    "product_id": (
        f"CASE WHEN {_C} % 50 = 9 THEN 'x-' || CAST({_C} AS STRING) "
        f"WHEN {_C} % 2 = 0 THEN ' ' || CAST(p_partkey AS STRING) ELSE CAST(p_partkey AS STRING) END"
    ),
    "max_price": f"CASE WHEN {_C} % 3 = 0 THEN 900.5E0 + ({_C} % 7) * 10 WHEN {_C} % 40 = 1 THEN 5.0E0 END",
    "include_out_of_stock": f"{_C} % 9 = 0",
    "limit": f"CASE WHEN {_C} % 4 <> 1 THEN CAST({_C} % 9 AS INT) END",
}


def requests(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    part = table(spark, sf_dir, "part")
    joined = table(spark, sf_dir, "customer").join(unsent(part), F.expr("p_partkey = c_custkey"))
    return joined.selectExpr(*[f"{text} AS `{name}`" for name, text in columns.items()])
