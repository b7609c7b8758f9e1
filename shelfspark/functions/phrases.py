"""Response texts. ``{name}`` marks are filled from columns of the same row."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.numbers import round_exact
from shelfspark.functions.text import let

# Texts of responses that callers read or compare.
MORE_SEARCH = (
    "{more} more products match. Narrow with occasion, recipient or a tighter budget rather "
    "than asking for a longer list."
)
HIDDEN_SEARCH = "{hidden} matching product(s) hidden because they are out of stock."
MORE_BROWSE = (
    "{more} more product(s) in {category}. Prefer narrowing with search_products over paging - "
    "the shopper wants two good options, not a list."
)
HIDDEN_BROWSE = "{hidden} product(s) hidden because they are out of stock."
RANKED_SIMILAR = (
    "Ranked by similarity to {name} ({price} EUR). For each one, explain the trade-off against "
    "{name}, or say plainly that it is a different kind of thing. Never invent a use case to "
    "make one fit."
)
ONLY_SIMILAR = (
    "This is the only comparable product in scope. Offering one honest option beats padding the "
    "list with something that merely costs about the same."
)
SOLD_OUT_MESSAGE = "{n_price} product(s) match, but every one is currently out of stock."
SOLD_OUT_NEAREST = " {nearest_name} is in stock at {nearest_price} EUR, just over the budget."
SOLD_OUT_RELAX_NEAREST = "raise max_price_eur to {nearest_price} for {nearest_name}"
SOLD_OUT_RELAX = (
    "call find_similar_products with product_id '{first_id}' to offer an in-stock replacement"
)
SOLD_OUT_NOTE = (
    "Tell the shopper plainly that these are unavailable, then offer an alternative. Do not "
    "recommend them as if they could be bought."
)
BUDGET_MESSAGE = (
    "Nothing in {scope} fits that budget. The cheapest match is {nearest_name} at "
    "{nearest_price} EUR."
)
BUDGET_RELAX = "raise max_price_eur to {nearest_price}"
BUDGET_RELAX_CATEGORY = "try category '{other_category}', which starts at {other_price} EUR"
BUDGET_NOTE = (
    "Be honest about the gap rather than silently widening the search. Offer the cheapest match, "
    "or ask whether the budget can move."
)
WHOLE_CATALOGUE = "the catalogue"
INVALID_SORT = "'{value}' is not a valid value for sort. Input should be {allowed}"
INVALID_SORT_NOTE = (
    "Correct the sort parameter and call the tool again. "
    "Call get_categories if you need the list of valid values."
)
NO_QUERY_MESSAGE = "Nothing in the catalogue matches that description."
NO_QUERY_RELAX = [
    "retry with fewer or more general words",
    "drop the query and filter by category, occasion and budget instead",
]
NO_QUERY_NOTE = "Call get_categories if you need to see what the catalogue covers."
CONSTRAINED_MESSAGE = "No product matches all of those filters at once."
CONSTRAINED_RELAX = ["remove the least important filter and search again"]
CONSTRAINED_NOTE = "Prefer dropping occasion or recipient before widening the budget."
NOTHING_SIMILAR = "Nothing comparable to {name} is available"
NOTHING_SIMILAR_UNDER = " under {bound} EUR."
UNKNOWN_CATEGORY = "There is no category called '{requested}'."
UNKNOWN_CATEGORY_HINT = " Did you mean '{hint}'?"
UNKNOWN_CATEGORY_NOTE = (
    "Retry with one of the categories listed in available_categories, or use search_products "
    "with a free-text query instead."
)
NOT_FOUND = "No product with id '{requested}' exists in this catalogue."
NOT_FOUND_NOTE = (
    "Product ids look like 'HL-003'. If you are working from a product name rather than an id, "
    "call search_products to find the id first."
)
DETAIL_SOLD_OUT = "{name} is currently out of stock."
DETAIL_SOLD_OUT_NOTE = (
    "Say it is unavailable before offering anything else, then suggest one of the alternatives. "
    "Do not recommend this product as if it could be bought."
)
CATEGORIES_NOTES = [
    "Pass these exact strings as the category, occasion and recipient parameters of "
    "search_products. Values not listed here match nothing.",
    "This response describes the catalogue, not products. Call search_products to get something "
    "you can recommend.",
]
TRIMMED = "Response trimmed to fit the context budget: {trims}."
TRIMMED_PITCHES = "descriptions shortened"
TRIMMED_FIELDS = "some fields omitted"
TRIMMED_PRODUCTS = "{kept} of {listed} products shown"


def fill(template: str, **values: Column) -> Column:
    """The template as a column; null when a value is."""
    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(values[name].cast("string"))
    return F.concat(*parts)


def short_number(value: Column) -> Column:
    """A price with at most six significant digits and no trailing zeros."""

    def shorten(v: Column) -> Column:
        rounded = (
            F.when(v < 10_000, v)
            .when(v < 99_999.95, round_exact(v, 1))
            .otherwise(round_exact(v, 0))
        )
        plain = F.regexp_replace(F.format_string("%.2f", rounded), r"\.?0+$", "")
        return F.when(v >= 999_999.5, F.lit("1e+06")).otherwise(plain)

    return F.when(value.isNotNull(), let(value, shorten))
