"""From raw export rows to typed product rows, quarantine and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import fixed
from shelfspark.functions.fields import known, split_multi
from shelfspark.functions.numbers import (
    parse_bool,
    parse_float,
    parse_int,
    parse_money,
    round_exact,
    stock_level,
)
from shelfspark.functions.spanish import translate_color, translate_material
from shelfspark.functions.text import category_key, clean_text, product_id, truncate
from shelfspark.operators.skew import HOT_ROWS, attach, spread
from shelfspark.session import written

RAW_COLUMNS = fixed.REQUIRED_COLUMNS + fixed.OPTIONAL_COLUMNS


def _issue(condition: Column, name: str, kind: str, detail: Column | str = "") -> Column:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return F.when(
        condition,
        F.struct(F.lit(name).alias("field"), F.lit(kind).alias("kind"), detail.alias("detail")),
    )


def clean_rows(raw: DataFrame) -> DataFrame:
    """Row-local cleaning: typed fields, soft issues, and the untouched raw cells.

    Cleaning a row costs far more than reading it, so rows of few large files are first
    spread over all tasks; apart from that no row meets another.
    """
    text = spread(raw, "_ord").select(
        "_ord",
        "_ragged",
        F.struct(*RAW_COLUMNS).alias("raw"),
        *[clean_text(F.col(name)).alias(name) for name in RAW_COLUMNS],
    )
    c = F.col
    parsed = text.select(
        "_ord",
        "_ragged",
        "raw",
        product_id(c("product_id")).alias("product_id"),
        truncate(c("name"), fixed.MAX_NAME_CHARS).alias("name"),
        parse_money(c("price_eur")).alias("price_eur"),
        c("category").alias("category_raw"),
        category_key(c("category")).alias("category_key"),
        known(F.substring("subcategory", 1, fixed.MAX_ATTRIBUTE_CHARS)).alias("subcategory"),
        known(F.substring("brand", 1, fixed.MAX_BRAND_CHARS)).alias("brand"),
        c("stock").alias("stock_text"),
        parse_int(c("stock")).alias("stock"),
        c("rating").alias("rating_text"),
        parse_float(c("rating")).alias("rating"),
        c("reviews_count").alias("reviews_text"),
        parse_int(c("reviews_count")).alias("reviews_count"),
        known(F.substring(F.lower("recipient"), 1, fixed.MAX_ATTRIBUTE_CHARS)).alias("recipient"),
        split_multi(c("occasion")).alias("occasions"),
        split_multi(c("tags")).alias("tags"),
        known(F.substring("color", 1, fixed.MAX_ATTRIBUTE_CHARS)).alias("color"),
        known(F.substring("material", 1, fixed.MAX_ATTRIBUTE_CHARS)).alias("material"),
        c("gift_wrap").alias("wrap_text"),
        parse_bool(c("gift_wrap")).alias("gift_wrap"),
        c("shipping_days").alias("shipping_text"),
        parse_int(c("shipping_days")).alias("shipping_days"),
        (c("description") != "").alias("described"),
        truncate(c("description"), fixed.MAX_DESCRIPTION_CHARS).alias("description"),
        truncate(c("description"), fixed.MAX_PITCH_CHARS).alias("pitch"),
    )
    rated = c("rating").between(0.0, 5.0)
    issues = [
        _issue(c("name.cut"), "name", "truncated"),
        _issue(c("_ragged").isNotNull(), "__row__", "ragged_row", c("_ragged")),
        _issue(c("category_key") == "", "category", "missing"),
        _issue(c("stock_text") == "", "stock", "missing"),
        _issue(
            (c("stock_text") != "") & c("stock").isNull(), "stock", "unparseable", c("stock_text")
        ),
        _issue(c("stock") < 0, "stock", "negative_clamped"),
        _issue(c("rating_text") == "", "rating", "missing"),
        _issue((c("rating_text") != "") & c("rating").isNull(), "rating", "unparseable"),
        _issue(~rated, "rating", "out_of_range", c("rating").cast("string")),
        _issue(
            (c("reviews_text") != "") & ~F.coalesce(c("reviews_count") >= 0, F.lit(False)),
            "reviews_count",
            "unparseable",
        ),
        _issue(F.size("occasions") == 0, "occasion", "missing"),
        _issue(c("color").isNull(), "color", "missing"),
        _issue(c("material").isNull(), "material", "missing"),
        _issue(
            c("gift_wrap").isNull() & (c("wrap_text") != ""),
            "gift_wrap",
            "unrecognised",
            c("wrap_text"),
        ),
        _issue(
            c("shipping_days") > fixed.IMPLAUSIBLE_SHIPPING_DAYS,
            "shipping_days",
            "implausible",
            c("shipping_days").cast("string"),
        ),
        _issue(
            (c("shipping_text") != "") & ~F.coalesce(c("shipping_days") >= 0, F.lit(False)),
            "shipping_days",
            "unparseable",
        ),
        _issue(c("description.cut"), "description", "truncated"),
        _issue(~c("described"), "description", "missing"),
    ]
    stock = F.greatest("stock", F.lit(0).cast("bigint"))
    stock = F.when(c("stock").isNotNull(), stock)
    return parsed.select(
        "_ord",
        "raw",
        "product_id",
        c("name.text").alias("name"),
        "price_eur",
        "category_raw",
        "category_key",
        "subcategory",
        "brand",
        stock.alias("stock"),
        stock_level(stock).alias("stock_level"),
        F.when(rated, round_exact(F.abs("rating"), 1)).alias("rating"),
        F.when(c("reviews_count") >= 0, c("reviews_count")).alias("reviews_count"),
        "recipient",
        "occasions",
        "tags",
        "color",
        "material",
        translate_color(c("color")).alias("color_es"),
        translate_material(c("material")).alias("material_es"),
        "gift_wrap",
        F.when(c("shipping_days") >= 0, c("shipping_days")).alias("shipping_days"),
        F.when(c("described"), c("description.text")).alias("description"),
        (c("described") & c("description.cut")).alias("description_truncated"),
        F.when(c("described"), c("pitch.text")).alias("pitch"),
        (c("described") & c("pitch.cut")).alias("pitch_truncated"),
        F.filter(F.array(*issues), lambda issue: issue.isNotNull()).alias("issues"),
    )


def classify(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``reason``: why a row is quarantined, null for an accepted one.

    The first row that is valid by itself takes an id; every later row with the id
    is a duplicate, whatever else is wrong with it. One partial aggregation per id
    finds that row; only ids that occur twice are joined back. Rows are written first,
    as every reader of the result would clean them anew, and twice.
    """
    rows = written(rows, "cleaned")
    keyed = rows.withColumn("_key", known(F.col("product_id")))
    valid = (F.col("name") != "") & F.col("price_eur").isNotNull()
    first = (
        keyed.filter("_key IS NOT NULL")
        .groupBy("_key")
        .agg(F.min(F.when(valid, F.col("_ord"))).alias("_first"), F.count("*").alias("n_rows"))
        .filter("n_rows > 1")
    )
    reason = (
        F.when(F.col("_key").isNull(), "missing_product_id")
        .when(F.col("_first") < F.col("_ord"), "duplicate_product_id")
        .when(F.col("name") == "", "missing_name")
        .when(F.col("price_eur").isNull(), "unparseable_price")
    )
    joined = attach(keyed, first, "_key", F.col("_ord"), hot_rows=hot_rows)
    return joined.withColumn("reason", reason).drop("_key", "_first")


def accepted(classified: DataFrame) -> DataFrame:
    return classified.filter("reason IS NULL").drop("reason", "raw")


def quarantine(classified: DataFrame) -> DataFrame:
    """The dropped rows as they came, with the first reason that applied."""
    return classified.filter("reason IS NOT NULL").select("_ord", "raw.*", "reason")


def issue_rows(products: DataFrame) -> DataFrame:
    """One row per soft issue.

    The outer form keeps Spark from deriving a filter on the size of the array,
    which would evaluate all cleaning expressions a second time.
    """
    return (
        products.select("product_id", F.explode_outer("issues").alias("issue"))
        .filter("issue IS NOT NULL")
        .select("product_id", "issue.*")
    )
