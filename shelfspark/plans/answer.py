"""The five operations over a table of requests.

Each takes products (as built, or any table with the same columns) and requests,
and returns ``(request_id, status, response)`` with the response as JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import fixed
from shelfspark.functions import phrases as say
from shelfspark.functions.fields import known, known_list
from shelfspark.functions.text import clean_text, product_id
from shelfspark.operators import responses as respond
from shelfspark.operators import search as find
from shelfspark.operators import similar as compare
from shelfspark.operators.categories import (
    category_dimension,
    category_summary,
    resolve_requested,
    vocabulary,
)
from shelfspark.operators.nearest import suggest_product_ids
from shelfspark.operators.skew import attach
from shelfspark.session import written

EMPTY_TEXTS = "array<string>"


def _summaries(
    mentions: DataFrame, products: DataFrame, key: str, base_url: str | None
) -> DataFrame:
    """Per question the products it shows: ``products``, ``sold_out``, ``nearest``.

    Any product may be shown by very many questions, hence the salted join.
    """
    wanted = mentions.groupBy("product_id").agg(F.count("*").alias("n_rows"))
    shown = products.select(
        "product_id", respond.summary(base_url).alias("summary"), F.col("category").alias("shelf")
    ).join(wanted, "product_id")
    told = attach(mentions, shown, "product_id", F.col(key))

    def ranked(role: str) -> Column:
        item = F.when(F.col("role") == role, F.struct("rank", "summary"))
        return F.transform(F.array_sort(F.collect_list(item)), lambda one: one["summary"])

    def only(column: str) -> Column:
        return F.max(F.when(F.col("role") == "nearest", F.col(column)))

    return told.groupBy(key).agg(
        ranked("result").alias("products"),
        ranked("sold_out").alias("sold_out"),
        F.first(
            F.when(F.col("role") == "nearest", F.col("summary")), ignorenulls=True
        ).alias("nearest"),
        only("shelf").alias("nearest_category"),
    )


def _with_categories(requests: DataFrame, dimension: DataFrame) -> DataFrame:
    """Resolve the requested categories; keeps the request text as ``requested``."""
    named = requests.withColumn("requested", F.nullif("category", F.lit(""))).drop("category")
    asked = named.filter("requested IS NOT NULL").groupBy("requested").agg(
        F.count("*").alias("n_rows")
    )
    resolved = resolve_requested(asked, dimension)
    lookup = asked.join(resolved, "requested", "left")
    return attach(named, lookup, "requested", F.col("request_id"))


def resolved_requests(
    products: DataFrame, requests: DataFrame, needs_category: bool
) -> tuple[DataFrame, DataFrame]:
    """Requests whose category is known (or not needed), and the others."""
    dimension = category_dimension(products)
    resolved = written(_with_categories(requests, dimension), "requests")
    is_known = F.col("category").isNotNull()
    if not needs_category:
        is_known = is_known | F.col("requested").isNull()
    return resolved.filter(is_known), resolved.filter(~is_known)


def with_ask(normal: DataFrame) -> DataFrame:
    """Add ``ask``, equal for requests that ask the same thing."""
    return normal.withColumn("ask", F.sha2(F.to_json(F.struct(*find.PARAMETERS)), 256))


def _unknown(rows: DataFrame, dimension: DataFrame, filters: Column) -> DataFrame:
    """Responses to requests for a category that does not exist."""
    every = dimension.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("place", "category"))), lambda c: c["category"]
        ).alias("available_categories")
    )
    hint = F.try_element_at("did_you_mean", F.lit(1))
    return rows.crossJoin(F.broadcast(every)).select(  # one row
        "request_id",
        F.lit("unknown_category").alias("status"),
        F.concat(
            say.fill(say.UNKNOWN_CATEGORY, requested=F.col("requested")),
            F.coalesce(say.fill(say.UNKNOWN_CATEGORY_HINT, hint=hint), F.lit("")),
        ).alias("message"),
        filters.alias("filters_applied"),
        known_list(F.col("did_you_mean")).alias("did_you_mean"),
        "available_categories",
        F.array(F.lit(say.UNKNOWN_CATEGORY_NOTE)).alias("notes"),
    )


def _invalid_sort(rows: DataFrame, orders: list[str]) -> DataFrame:
    """Responses to requests for an order that does not exist."""
    *most, last = [f"'{name}'" for name in orders]
    allowed = F.lit(f"{', '.join(most)} or {last}")
    return rows.select(
        "request_id",
        F.lit("invalid_parameter").alias("status"),
        say.fill(say.INVALID_SORT, value=F.col("sort"), allowed=allowed).alias("message"),
        F.array(*map(F.lit, orders)).alias("did_you_mean"),
        F.array(F.lit(say.INVALID_SORT_NOTE)).alias("notes"),
    )


def _finish(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Complete the payload columns, fit the size limit and write JSON."""
    defaults = {
        "total_matches": F.lit(0).cast("bigint"),
        "returned": F.lit(0),
        "reason": F.lit(None).cast("string"),
        "message": F.lit(None).cast("string"),
        "has_more": F.lit(None).cast("boolean"),
        "did_you_mean": F.lit(None).cast(EMPTY_TEXTS),
        "available_categories": F.lit(None).cast(EMPTY_TEXTS),
        "suggestions": F.lit(None).cast("string"),
    }
    missing = {name: value for name, value in defaults.items() if name not in rows.columns}
    rows = rows.withColumns(missing)
    return respond.as_json(respond.enforce_budget(rows, respond.LIST_FIELDS, max_bytes))


def _answer_list(
    products: DataFrame,
    requests: DataFrame,
    op: str,
    base_url: str | None,
    max_bytes: int,
    index: DataFrame | None = None,
) -> DataFrame:
    dimension = category_dimension(products)
    orders = fixed.SEARCH_SORTS if op == "search" else fixed.BROWSE_SORTS
    orderly = F.coalesce(F.col("sort").isin(orders), F.lit(True))
    invalid = _invalid_sort(requests.filter(~orderly), orders)
    known_rows, unknown_rows = resolved_requests(products, requests.filter(orderly), op == "browse")
    if op == "search":
        normalise, filters = find.as_search, _search_filters
    else:
        normalise, filters = find.as_browse, _browse_filters
    normal = with_ask(normalise(known_rows))
    questions = written(with_ask(find.distinct_questions(normal)), "questions")
    envelopes, mentions = find.answer_questions(products, questions, index)
    answers = (
        envelopes.drop("nearest")
        .join(_summaries(mentions, products, "question_id", base_url), "question_id", "left")
        .crossJoin(F.broadcast(find.cheapest_overall(products)))  # one row
    )
    empty = respond.empty_result(F.col("category"))
    none = F.array().cast(_products_type(answers))
    answered = (
        answers.withColumn("products", F.coalesce("products", none))
        .withColumn("returned", F.size("products"))
        .withColumns(
            {
                "status": F.when(F.col("reason").isNull(), "ok").otherwise("no_match"),
                "message": empty["message"],
                "suggestions": empty["suggestions"],
                "has_more": F.when(
                    F.col("reason").isNull(),
                    F.col("total_matches") > F.col("offset") + F.col("returned"),
                ),
                "notes": F.coalesce(empty["notes"], respond.page_notes(op)),
            }
        )
    )
    shown = ["status", "message", "reason", "total_matches", "returned", "products", "has_more",
             "suggestions", "notes"]
    told = attach(
        normal.select("request_id", "ask"),
        answered.select("ask", "n_rows", *shown),
        "ask",
        F.col("request_id"),
    ).join(
        known_rows.select("request_id", filters().alias("filters_applied")), "request_id"
    )
    unknown = _unknown(unknown_rows, dimension, filters())
    rows = told.drop("ask").unionByName(
        unknown.unionByName(invalid, allowMissingColumns=True).withColumns(
            {
                "products": none,
                "returned": F.lit(0),
                "total_matches": F.lit(0).cast("bigint"),
            }
        ),
        allowMissingColumns=True,
    )
    return _finish(rows, max_bytes)


def _products_type(answers: DataFrame):
    return answers.schema["products"].dataType


def _search_filters() -> Column:
    return F.struct(
        known(F.col("query")).alias("query"),
        known(F.col("occasion")).alias("occasion"),
        known(F.col("recipient")).alias("recipient"),
        F.col("max_price").alias("max_price_eur"),
        F.col("min_price").alias("min_price_eur"),
        F.coalesce("include_out_of_stock", F.lit(False)).alias("include_out_of_stock"),
        F.coalesce("sort", F.lit("relevance")).alias("sort"),
        find.clamp(F.col("limit"), fixed.SEARCH_LIMITS).alias("limit"),
        F.col("category").alias("category"),
        F.lit(None).cast("int").alias("offset"),
    )


def _browse_filters() -> Column:
    return F.struct(
        F.coalesce("category", "requested").alias("category"),
        find.clamp(F.col("limit"), fixed.BROWSE_LIMITS).alias("limit"),
        F.greatest(F.coalesce("offset", F.lit(0)), F.lit(0)).alias("offset"),
        F.coalesce("sort", F.lit("popularity")).alias("sort"),
        F.coalesce("include_out_of_stock", F.lit(False)).alias("include_out_of_stock"),
        F.col("max_price").alias("max_price_eur"),
    )


def search_products(
    products: DataFrame,
    requests: DataFrame,
    base_url: str | None = None,
    max_bytes: int = fixed.MAX_RESPONSE_BYTES,
    index: DataFrame | None = None,
) -> DataFrame:
    """Free-text and filtered search.

    Request columns: request_id (long), query, category, occasion, recipient,
    max_price, min_price, include_out_of_stock, sort, limit. ``index`` is the stored
    term index that ``build_catalogue`` returns; without one it is made anew.
    """
    return _answer_list(products, requests, "search", base_url, max_bytes, index)


def products_by_category(
    products: DataFrame,
    requests: DataFrame,
    base_url: str | None = None,
    max_bytes: int = fixed.MAX_RESPONSE_BYTES,
) -> DataFrame:
    """One page of a category.

    Request columns: request_id (long), category, limit, offset, sort, max_price,
    include_out_of_stock.
    """
    return _answer_list(products, requests, "browse", base_url, max_bytes)


def lookup_ids(requests: DataFrame) -> DataFrame:
    """Normalise the requested id; keeps the request text as ``requested``."""
    return requests.withColumnRenamed("product_id", "requested").withColumn(
        "product_id", product_id(clean_text(F.col("requested")))
    )


def _not_found(requests: DataFrame, products: DataFrame) -> DataFrame:
    asked = requests.groupBy("requested").agg(F.count("*").alias("n_rows"))
    hints = suggest_product_ids(asked, "requested", products)
    lookup = asked.join(hints, "requested", "left")
    return attach(requests, lookup, "requested", F.col("request_id")).withColumns(
        {
            "status": F.lit("not_found"),
            "message": say.fill(say.NOT_FOUND, requested=F.coalesce("requested", F.lit(""))),
            "did_you_mean": known_list(F.col("did_you_mean")),
            "notes": F.array(F.lit(say.NOT_FOUND_NOTE)),
        }
    )


def find_similar_products(
    products: DataFrame,
    requests: DataFrame,
    base_url: str | None = None,
    max_bytes: int = fixed.MAX_RESPONSE_BYTES,
    level_kinds: int = compare.LEVEL_KINDS,
) -> DataFrame:
    """Products of the same kind as a given one.

    Request columns: request_id (long), product_id, max_price,
    include_out_of_stock, limit.
    """
    asked = lookup_ids(requests)
    per_id = asked.groupBy("product_id").agg(F.count("*").alias("n_rows"))
    facts = products.select(
        "product_id", F.col("name").alias("target_name"), F.col("price_eur").alias("target_price")
    ).join(per_id, "product_id")
    placed = written(attach(asked, facts, "product_id", F.col("request_id")), "asked")
    found = placed.filter("target_name IS NOT NULL")
    filters = F.struct(
        F.col("requested").alias("product_id"),
        find.clamp(F.col("limit"), fixed.SIMILAR_LIMITS).alias("limit"),
        F.coalesce("include_out_of_stock", F.lit(False)).alias("include_out_of_stock"),
        F.col("max_price").alias("max_price_eur"),
    )
    normal = compare.as_similar(found)
    ask = ["product_id", "bound", "all_stock", "limit"]
    questions = written(
        normal.groupBy(*ask).agg(
            F.min("request_id").alias("request_id"), F.count("*").alias("n_rows")
        ),
        "questions",
    )
    ranked, totals, targets = compare.similar(products, questions.drop("n_rows"), level_kinds)
    totals = written(totals, "totals")
    reasons, fallen = compare.fallbacks(products, targets, totals, level_kinds)
    results = ranked.select("request_id", F.lit("result").alias("role"), "rank", "product_id")
    shown = _summaries(results.unionByName(fallen), products, "request_id", base_url)
    bound = F.when(F.col("bound") < compare.NO_BOUND, F.col("bound"))
    answers = (
        questions.join(shown, "request_id", "left")
        .join(totals, "request_id", "left")
        .join(reasons, "request_id", "left")
        .join(facts.drop("n_rows"), "product_id")
        .withColumns({"max_price": bound, "price": F.col("target_price")})
        .crossJoin(F.broadcast(find.cheapest_overall(products)))  # one row
    )
    empty = respond.empty_result(F.lit(None).cast("string"), F.col("target_name"))
    none = F.array().cast(_products_type(answers))
    answered = (
        answers.withColumns(
            {
                "products": F.coalesce("products", none),
                "total_matches": F.coalesce("total_matches", F.lit(0)).cast("bigint"),
            }
        )
        .withColumn("returned", F.size("products"))
        .withColumns(
            {
                "ask": _similar_ask(),
                "status": F.when(F.col("reason").isNull(), "ok").otherwise("no_match"),
                "message": empty["message"],
                "suggestions": empty["suggestions"],
                "has_more": F.when(
                    F.col("reason").isNull(), F.col("total_matches") > F.col("limit")
                ),
                "notes": F.coalesce(empty["notes"], respond.similar_notes()),
            }
        )
    )
    columns = ["status", "message", "reason", "total_matches", "returned", "products", "has_more",
               "suggestions", "notes"]
    told = attach(
        normal.withColumn("ask", _similar_ask()).select("request_id", "ask"),
        answered.select("ask", "n_rows", *columns),
        "ask",
        F.col("request_id"),
    ).join(found.select("request_id", filters.alias("filters_applied")), "request_id")
    lost = _not_found(placed.filter("target_name IS NULL"), products).select(
        "request_id", "status", "message", "did_you_mean", "notes",
        filters.alias("filters_applied"), none.alias("products"),
        F.lit(0).alias("returned"), F.lit(0).cast("bigint").alias("total_matches"),
    )
    return _finish(
        told.drop("ask").unionByName(lost, allowMissingColumns=True), max_bytes
    )


def _similar_ask() -> Column:
    bound = F.col("bound").cast("string").alias("bound")
    return F.sha2(F.to_json(F.struct("product_id", bound, "all_stock", "limit")), 256)


def get_product_details(
    products: DataFrame, requests: DataFrame, base_url: str | None = None
) -> DataFrame:
    """The full record of one product, with alternatives when it is sold out.

    Request columns: request_id (long), product_id.
    """
    asked = lookup_ids(requests.select("request_id", "product_id"))
    per_id = asked.groupBy("product_id").agg(F.count("*").alias("n_rows"))
    wanted = written(products.join(per_id, "product_id"), "wanted")
    sold_out = wanted.filter("stock_level = 'out_of_stock'").select(
        F.col("product_id").alias("request_id"),
        "product_id",
        F.lit(compare.NO_BOUND).alias("bound"),
        F.lit(False).alias("all_stock"),
        F.lit(fixed.DETAIL_ALTERNATIVES).alias("limit"),
    )
    ranked, _, _ = compare.similar(products, sold_out)
    shown = _summaries(
        ranked.select("request_id", F.lit("result").alias("role"), "rank", "product_id"),
        products,
        "request_id",
        base_url,
    ).select(
        F.col("request_id").alias("product_id"), known_list(F.col("products")).alias("alternatives")
    )
    is_out = F.col("stock_level") == "out_of_stock"
    facts = wanted.join(shown, "product_id", "left").select(
        "product_id",
        "n_rows",
        respond.detail(base_url).alias("product"),
        "alternatives",
        F.when(is_out, say.fill(say.DETAIL_SOLD_OUT, name=F.col("name"))).alias("message"),
        F.when(is_out, F.array(F.lit(say.DETAIL_SOLD_OUT_NOTE))).alias("notes"),
    )
    placed = attach(asked, facts, "product_id", F.col("request_id"))
    found = placed.filter("product IS NOT NULL").withColumn("status", F.lit("ok"))
    lost = _not_found(
        placed.filter("product IS NULL").select("request_id", "requested"), products
    ).drop("requested")
    fields = ["status", "message", "product", "alternatives", "did_you_mean", "notes"]
    rows = found.unionByName(lost, allowMissingColumns=True)
    return rows.select("request_id", "status", F.to_json(F.struct(*fields)).alias("response"))


def get_categories(products: DataFrame) -> DataFrame:
    """One row: every category with its numbers, and the filter vocabulary."""
    words = vocabulary(products)
    place = words.filter("kind = 'category'").select(F.col("value").alias("category"), "rank")
    info = F.struct(
        F.col("category").alias("name"),
        "slug",
        "product_count",
        "in_stock_count",
        F.struct(F.col("price_min").alias("min"), F.col("price_max").alias("max")).alias(
            "price_range_eur"
        ),
        "subcategories",
    )
    listed = (
        category_summary(products)
        .join(place, "category")
        .agg(F.array_sort(F.collect_list(F.struct("rank", info.alias("info")))).alias("all"))
    )

    def values(kind: str) -> Column:
        item = F.when(F.col("kind") == kind, F.struct("rank", "value"))
        return F.transform(F.array_sort(F.collect_list(item)), lambda one: one["value"])

    filters = words.agg(
        values("occasion").alias("occasions"), values("recipient").alias("recipients")
    )
    return listed.crossJoin(filters).select(  # one row each
        F.lit("ok").alias("status"),
        F.to_json(
            F.struct(
                F.lit("ok").alias("status"),
                F.col("all.info").alias("categories"),
                F.struct("occasions", "recipients").alias("filter_vocabulary"),
                F.array(*[F.lit(note) for note in say.CATEGORIES_NOTES]).alias("notes"),
            )
        ).alias("response"),
    )
