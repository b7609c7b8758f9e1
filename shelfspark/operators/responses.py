"""Product projections, response payloads and their size limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import fixed
from shelfspark.functions import phrases as say
from shelfspark.functions.fields import known, known_list, spaced_json_bytes


def summary(base_url: str | None = None) -> Column:
    """A product as it appears in a list. Unknown values are null, so JSON omits them."""
    return F.struct(*_summary_fields(base_url))


def _summary_fields(base_url: str | None) -> list[Column]:
    if base_url:
        page = F.concat(F.lit(f"{base_url}/p/"), F.col("product_id"))
        image = F.concat(page, F.lit("/image.svg"))
    else:
        page = image = F.lit(None).cast("string")
    return [
        F.col("product_id"),
        F.col("name"),
        F.col("price_eur"),
        known(F.col("pitch")).alias("pitch"),
        F.col("stock_level"),
        F.col("shipping_days"),
        F.col("gift_wrap"),
        F.col("rating"),
        F.col("reviews_count"),
        page.alias("product_url"),
        image.alias("image_url"),
    ]


def detail(base_url: str | None = None) -> Column:
    """Everything known about one product."""
    return F.struct(
        *_summary_fields(base_url),
        known(F.col("brand")).alias("brand"),
        known(F.col("color")).alias("color"),
        known(F.col("material")).alias("material"),
        known_list(F.col("occasions")).alias("occasions"),
        known(F.col("recipient")).alias("recipient"),
        known_list(F.col("tags")).alias("tags"),
        F.col("stock"),
        known(F.col("description")).alias("description"),
        known_list(F.col("also_in_categories")).alias("also_in_categories"),
    )


def _bytes(value: Column) -> Column:
    return spaced_json_bytes(F.to_json(value))


def enforce_budget(
    rows: DataFrame, fields: list[str], max_bytes: int = fixed.MAX_RESPONSE_BYTES
) -> DataFrame:
    """Fit every response into ``max_bytes``, in a fixed order, and say what was cut.

    ``fields`` names the payload columns, among them ``products`` (at most a page),
    ``returned`` and ``notes``. Long pitches are shortened, then two fields dropped,
    then products from the tail, never below one. The size is that of the JSON text
    with spaces after separators, in which missing notes are written as null.
    """
    no_notes = F.when(F.col("notes").isNull(), len(', "notes": null')).otherwise(0)
    sized = rows.withColumn("_bytes", _bytes(F.struct(*fields)) + no_notes)
    limit = fixed.SHORT_PITCH_CHARS
    long_pitch = F.exists("products", lambda p: F.length(p["pitch"]) > limit)

    def shorten(product: Column) -> Column:
        pitch = product["pitch"]
        cut = F.concat(F.rtrim(F.substring(pitch, 1, limit - 1)), F.lit("…"))
        return product.withField("pitch", F.when(F.length(pitch) > limit, cut).otherwise(pitch))

    def strip(product: Column) -> Column:
        return product.withField("reviews_count", F.lit(None).cast("bigint")).withField(
            "gift_wrap", F.lit(None).cast("boolean")
        )

    over = F.col("_bytes") > max_bytes
    short = sized.withColumns(
        {
            "_short": F.transform("products", shorten),
            "_had_long": over & F.coalesce(long_pitch, F.lit(False)),
        }
    ).withColumn("_rest", F.col("_bytes") - _bytes(F.col("products")))
    bare = short.withColumn(
        "_over", over & (F.col("_rest") + _bytes(F.col("_short")) > max_bytes)
    ).withColumn("_bare", F.transform("_short", strip))
    listed = F.size("products")
    fitting = F.filter(
        F.sequence(F.lit(1), F.greatest(listed, F.lit(1))),
        lambda n: F.col("_rest") + _bytes(F.slice("_bare", F.lit(1), n)) <= max_bytes,
    )
    kept = F.when(F.col("_over") & (listed > 1), F.coalesce(F.array_max(fitting), F.lit(1)))
    cut = bare.withColumn("_kept", F.coalesce(kept, listed))
    trims = F.array(
        F.when(F.col("_had_long"), say.TRIMMED_PITCHES),
        F.when(F.col("_over"), say.TRIMMED_FIELDS),
        F.when(
            F.col("_kept") < listed,
            say.fill(say.TRIMMED_PRODUCTS, kept=F.col("_kept"), listed=listed),
        ),
    )
    none = F.array().cast("array<string>")
    announced = F.array(say.fill(say.TRIMMED, trims=F.array_join(trims, "; ")))
    return cut.withColumns(
        {
            "products": F.when(F.col("_over"), F.slice("_bare", F.lit(1), F.col("_kept")))
            .when(over, F.col("_short"))
            .otherwise(F.col("products")),
            "returned": F.when(over, F.col("_kept")).otherwise(F.col("returned")),
            "notes": F.when(over, F.concat(F.coalesce("notes", none), announced)).otherwise(
                F.col("notes")
            ),
        }
    ).drop("_bytes", "_short", "_had_long", "_rest", "_over", "_bare", "_kept")


# Fixed value: the order of the fields of a list response.
LIST_FIELDS = [
    "status", "message", "reason", "total_matches", "returned", "filters_applied", "products",
    "has_more", "did_you_mean", "available_categories", "suggestions", "notes",
]


def as_json(rows: DataFrame, key: str = "request_id") -> DataFrame:
    """``(request_id, status, response)`` with the response as JSON text."""
    return rows.select(key, "status", F.to_json(F.struct(*LIST_FIELDS)).alias("response"))


def _notes(*notes: Column) -> Column:
    present = F.filter(F.array(*notes), lambda note: note.isNotNull())
    return known_list(present)


def empty_result(category: Column, similar_to: Column | None = None) -> dict[str, Column]:
    """message, suggestions and notes for rows whose ``reason`` says why they are empty.

    Reads ``reason``, ``n_price``, ``sold_out`` and ``nearest`` (summaries), the
    category of the nearest product, and ``cheapest_overall``.
    """
    reason = F.col("reason")
    near = {
        "nearest_name": F.col("nearest.name"),
        "nearest_price": say.short_number(F.col("nearest.price_eur")),
    }
    other = F.col("cheapest_overall")
    scope = F.coalesce(category, F.lit(say.WHOLE_CATALOGUE))
    sold_out = F.concat(
        say.fill(say.SOLD_OUT_MESSAGE, n_price=F.col("n_price")),
        F.coalesce(say.fill(say.SOLD_OUT_NEAREST, **near), F.lit("")),
    )
    message = (
        F.when(reason == "out_of_stock_only", sold_out)
        .when(reason == "budget_too_low", say.fill(say.BUDGET_MESSAGE, scope=scope, **near))
        .when(reason == "no_query_match", say.NO_QUERY_MESSAGE)
        .when(reason == "over_constrained", say.CONSTRAINED_MESSAGE)
    )
    if similar_to is not None:
        under = F.when(
            (F.col("max_price") > 0),
            say.fill(say.NOTHING_SIMILAR_UNDER, bound=say.short_number(F.col("max_price"))),
        ).otherwise(".")
        message = F.when(
            reason.isNotNull(), F.concat(say.fill(say.NOTHING_SIMILAR, name=similar_to), under)
        )
    relax = (
        F.when(
            reason == "out_of_stock_only",
            _notes(
                say.fill(say.SOLD_OUT_RELAX_NEAREST, **near),
                say.fill(say.SOLD_OUT_RELAX, first_id=F.col("sold_out")[0]["product_id"]),
            ),
        )
        .when(
            reason == "budget_too_low",
            _notes(
                say.fill(say.BUDGET_RELAX, **near),
                F.when(
                    other["category"] != F.col("nearest_category"),
                    say.fill(
                        say.BUDGET_RELAX_CATEGORY,
                        other_category=other["category"],
                        other_price=say.short_number(other["price_eur"]),
                    ),
                ),
            ),
        )
        .when(reason == "no_query_match", F.array(*[F.lit(t) for t in say.NO_QUERY_RELAX]))
        .when(reason == "over_constrained", F.array(*[F.lit(t) for t in say.CONSTRAINED_RELAX]))
    )
    shows_sold_out = reason == "out_of_stock_only"
    shows_nearest = reason.isin("out_of_stock_only", "budget_too_low")
    suggestions = F.struct(
        F.when(shows_nearest, F.col("nearest")).alias("cheapest_in_scope"),
        F.when(shows_sold_out, F.col("sold_out")).alias("out_of_stock_matches"),
        relax.alias("relax"),
    )
    note = (
        F.when(reason == "out_of_stock_only", say.SOLD_OUT_NOTE)
        .when(reason == "budget_too_low", say.BUDGET_NOTE)
        .when(reason == "no_query_match", say.NO_QUERY_NOTE)
        .when(reason == "over_constrained", say.CONSTRAINED_NOTE)
    )
    return {
        "message": message,
        "suggestions": F.when(reason.isNotNull(), suggestions),
        "notes": F.when(reason.isNotNull(), F.array(note)),
    }


def page_notes(op: str) -> Column:
    """Notes of a page with results: what was not shown, and what was hidden."""
    shown = F.col("offset") + F.col("returned")
    more = F.col("total_matches") - shown
    hidden = F.col("n_price") - F.col("n_available")
    more_text, hidden_text = {
        "search": (say.MORE_SEARCH, say.HIDDEN_SEARCH),
        "browse": (say.MORE_BROWSE, say.HIDDEN_BROWSE),
    }[op]
    return _notes(
        F.when(more > 0, say.fill(more_text, more=more, category=F.col("category"))),
        F.when(hidden > 0, say.fill(hidden_text, hidden=hidden)),
    )


def similar_notes() -> Column:
    return _notes(
        say.fill(
            say.RANKED_SIMILAR,
            name=F.col("target_name"),
            price=say.short_number(F.col("price")),
        ),
        F.when(F.col("total_matches") == 1, say.ONLY_SIMILAR),
    )
