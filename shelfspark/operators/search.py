"""Batch search: all requests against all products in one job.

Requests that ask the same thing are one question, and questions with the same words
and attribute filters one scope. A scope meets products through an equal key (a search
term of the index, or without words its category, occasion or recipient); its matches
are written once. A question is counted without meeting them, by running sums over the prices of its scope.
Its page and fallbacks are read from blocks of prices, which keep their first products in
the orders that the questions of a scope ask for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions import fixed
from shelfspark.functions.text import nfkc, stems, tokens
from shelfspark.operators.index import asked_entries, term_index, with_terms
from shelfspark.operators.ranks import ranked, running
from shelfspark.operators.skew import beside, spread, unsent
from shelfspark.operators.tops import range_tops
from shelfspark.session import written

PARAMETERS = [
    "words", "category", "occasion", "recipient", "max_price", "min_price",
    "include_out_of_stock", "sort", "limit", "offset",
]
SCOPE = PARAMETERS[:4]
#: Orders that don't look at the score.
STATIC_SORTS = ["price_asc", "price_desc", "rating", "popularity"]


def clamp(limit: Column, bounds: tuple[int, int]) -> Column:
    default, most = bounds
    return F.greatest(F.lit(1), F.least(F.coalesce(limit, F.lit(default)), F.lit(most)))


def as_search(requests: DataFrame) -> DataFrame:
    """Normalise free-text search requests; ``category`` must be resolved already."""
    return requests.select(
        "request_id",
        F.array_sort(tokens(nfkc(F.col("query")))).alias("words"),
        "category",
        F.nullif("occasion", F.lit("")).alias("occasion"),
        F.nullif("recipient", F.lit("")).alias("recipient"),
        "max_price",
        "min_price",
        F.coalesce("include_out_of_stock", F.lit(False)).alias("include_out_of_stock"),
        F.coalesce("sort", F.lit("relevance")).alias("sort"),
        clamp(F.col("limit"), fixed.SEARCH_LIMITS).alias("limit"),
        F.lit(0).alias("offset"),
    )


def as_browse(requests: DataFrame) -> DataFrame:
    """Normalise category-browse requests: a page of one category."""
    text = F.lit(None).cast("string")
    return requests.select(
        "request_id",
        F.array().cast("array<string>").alias("words"),
        "category",
        text.alias("occasion"),
        text.alias("recipient"),
        "max_price",
        F.lit(None).cast("double").alias("min_price"),
        F.coalesce("include_out_of_stock", F.lit(False)).alias("include_out_of_stock"),
        F.coalesce("sort", F.lit("popularity")).alias("sort"),
        clamp(F.col("limit"), fixed.BROWSE_LIMITS).alias("limit"),
        F.greatest(F.coalesce("offset", F.lit(0)), F.lit(0)).alias("offset"),
    )


def distinct_questions(normalised: DataFrame) -> DataFrame:
    """One row per distinct question, named after its first request."""
    return normalised.groupBy(*PARAMETERS).agg(
        F.min("request_id").alias("question_id"), F.count("*").alias("n_rows")
    )


def scope_id() -> Column:
    """Equal for questions with the same words and attribute filters.

    Prices, stock, order and page don't change what a question is matched with, so
    all questions of a scope share its matches.
    """
    return F.sha2(F.to_json(F.struct(*SCOPE)), 256)


def scopes(questions: DataFrame) -> DataFrame:
    """The distinct scopes, with the keys by which they meet products.

    Words and their stems; a scope without words uses its narrowest filter.
    """

    def key(kind: str, term: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), term.alias("term"))

    filters = (
        F.when(F.col("category").isNotNull(), key("category", F.col("category")))
        .when(F.col("occasion").isNotNull(), key("occasion", F.col("occasion")))
        .when(F.col("recipient").isNotNull(), key("recipient", F.col("recipient")))
        .otherwise(key("all", F.lit("")))
    )
    words = F.concat(
        F.transform("words", lambda word: key("token", word)),
        F.transform(stems(F.col("words")), lambda word: key("stem", word)),
    )
    return questions.select(*SCOPE).distinct().select(
        scope_id().alias("scope_id"),
        *[F.col(name).alias(f"q_{name}") for name in SCOPE[1:]],
        (F.size("words") > 0).alias("worded"),
        F.when(F.size("words") > 0, words).otherwise(F.array(filters)).alias("keys"),
    )


def _facts(products: DataFrame) -> DataFrame:
    """What filters, scores and orders look at."""
    termed = products if "popularity" in products.columns else with_terms(products)
    return termed.select(
        "product_id",
        "duplicate_group_id",
        "category",
        "occasions",
        "recipient",
        "price_eur",
        "stock_level",
        "rating",
        "reviews_count",
        "popularity",
        "_ord",
    )


def scope_profiles(
    products: DataFrame, questions: DataFrame, index: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(facts, pairs): products with their ``profile_id``, and the profiles that each scope takes.

    Products with the same asked terms, category, occasions and recipient have one profile, and
    no scope tells them apart but by price, stock and order. So scopes meet profiles: words, once for all
    scopes that ask them, by equal terms, and then the filters. A pair is a scope, a profile and its ``text_score``.
    Where every product has terms of its own that are asked, profiles are as many as products.

    ``index`` is the stored term index of ``products``, of which the buckets of asked terms are
    read; without one it is made.
    """
    asked = beside(written(scopes(questions).withColumn("words_id", F.sha2(F.to_json("keys"), 256)), "scopes"))
    sets = asked.filter("worded").select("words_id", "keys").dropDuplicates(["words_id"])
    terms = written(sets.select("words_id", F.inline("keys")), "terms")
    index = term_index(products) if index is None else asked_entries(index, terms)
    entry = F.struct("kind", "term", "weight")
    entries = (
        index.join(terms.select("kind", "term").distinct(), ["kind", "term"], "left_semi")
        .groupBy("product_id")
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    )
    profile = ["entries", "category", "occasions", "recipient"]
    facts = written(
        _facts(products)
        .join(unsent(entries), "product_id", "left")
        .withColumn("profile_id", F.sha2(F.to_json(F.struct(*profile)), 256)),
        "facts",
    )
    profiles = written(facts.select("profile_id", *profile).dropDuplicates(["profile_id"]), "profiles")
    # Few words and profiles make very many pairs, so they are spread first.
    scored = spread(
        profiles.select("profile_id", "category", "occasions", "recipient", F.inline("entries"))
        .join(beside(terms), ["kind", "term"])
        .groupBy("words_id", "profile_id")
        .agg(
            F.sum("weight").alias("text_score"),
            *[F.first(name).alias(name) for name in profile[1:]],  # equal within a profile
        ),
        "words_id", "profile_id",
    )
    worded = asked.filter("worded").drop("keys", "worded")
    within = worded.filter(_given("q_category")).withColumn("category", F.col("q_category"))
    anywhere = worded.filter(~_given("q_category"))

    def place(kind: str, term: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), term.alias("term"))

    places = F.concat(
        F.array(
            place("category", F.col("category")),
            place("recipient", F.col("recipient")),
            place("all", F.lit("")),
        ),
        F.transform(F.array_distinct("occasions"), lambda occasion: place("occasion", occasion)),
    )
    wordless = asked.filter("NOT worded").select("*", F.inline("keys")).drop("keys", "worded")
    placed = (
        spread(profiles.drop("entries"), "profile_id")
        .select("*", F.inline(places))
        .join(wordless, ["kind", "term"])
        .withColumn("text_score", F.lit(0.0))
    )
    columns = ["scope_id", "profile_id", "text_score", "q_occasion", "q_recipient"]
    filters = ["q_category", "category", "occasions", "recipient"]
    met = [scored.join(within, ["words_id", "category"]), scored.join(anywhere, "words_id"), placed]
    pairs = reduce(DataFrame.unionByName, [part.select(*columns, *filters) for part in met]).filter(
        (~_given("q_category") | (F.col("q_category") == F.col("category")))
        & (~_given("q_occasion") | F.array_contains("occasions", F.col("q_occasion")))
        & (~_given("q_recipient") | (F.col("q_recipient") == F.col("recipient")))
    )
    return facts.drop(*profile), written(pairs.select(*columns), "scope_profiles")


def profile_matches(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (scope, product) matches that pairs of scopes and profiles stand for."""
    return pairs.join(facts, "profile_id").drop("profile_id")


def scope_matches(
    products: DataFrame, questions: DataFrame, index: DataFrame | None = None
) -> DataFrame:
    """Every (scope, product) that passes the attribute filters and shares a word, if any is given."""
    return profile_matches(*scope_profiles(products, questions, index))


def _given(column: str) -> Column:
    return F.col(column).isNotNull()


def matches(
    products: DataFrame, questions: DataFrame, index: DataFrame | None = None
) -> DataFrame:
    """Every (question, product) that passes the attribute filters, scored.

    Only the matches of scopes are written; those of questions are made from them
    when they are ranked, and never stored.
    """
    met = written(scope_matches(products, questions, index), "scope_matches")
    return asked_matches(met, products, questions)


def asked_matches(met: DataFrame, products: DataFrame, questions: DataFrame) -> DataFrame:
    """The scored matches of questions, from those of their scopes; ``n_rows`` stays if it is there."""
    asking = questions.select(
        "question_id",
        scope_id().alias("scope_id"),
        *[F.col(name).alias(f"q_{name}") for name in PARAMETERS[4:8]],
    )
    top = products.agg(F.max("popularity").alias("max_popularity"))
    buyable = F.col("stock_level").isin(fixed.RECOMMENDABLE) | F.col("q_include_out_of_stock")
    in_price = (~_given("q_max_price") | (F.col("price_eur") <= F.col("q_max_price"))) & (
        ~_given("q_min_price") | (F.col("price_eur") >= F.col("q_min_price"))
    )
    first, second = _order(F.col("q_sort"), F.col("score"))
    return (
        met.join(asking, "scope_id")
        .crossJoin(F.broadcast(top))  # one row
        .withColumns({"score": score(), "buyable": buyable, "in_price": in_price})
        .select(
            "question_id", "product_id", "duplicate_group_id", "price_eur", "popularity",
            "_ord", "score", "buyable", "in_price",
            (F.col("buyable") & F.col("in_price")).alias("available"),
            first.alias("first"),
            second.alias("second"),
            *[name for name in met.columns if name == "n_rows"],
        )
    )


def budget_bonus() -> Column:
    """What a price adds to the score by its share of the highest price."""
    ratio = F.col("price_eur") / F.nullif("q_max_price", F.lit(0.0))
    tiers = F
    for low, high, bonus in fixed.BUDGET_TIERS:
        upper = ratio <= high if high == 1.0 else ratio < high
        tiers = tiers.when((ratio >= low) & upper, bonus)
    return tiers.otherwise(0.0)


def score(bonus: Column | None = None) -> Column:
    """The search score of a matched product; filters already hold. ``bonus`` is that of its price."""
    catch_all = F.col("q_recipient") == fixed.CATCH_ALL_RECIPIENT
    return (
        F.col("text_score")
        + F.when(_given("q_occasion"), fixed.OCCASION_BONUS).otherwise(0.0)
        + F.when(_given("q_recipient") & ~catch_all, fixed.RECIPIENT_BONUS).otherwise(0.0)
        + (budget_bonus() if bonus is None else bonus)
        - F.when(F.col("stock_level") == "low", fixed.LOW_STOCK_PENALTY).otherwise(0.0)
        + F.when(
            F.col("max_popularity") > 0,
            F.lit(fixed.POPULARITY_BONUS) * (F.col("popularity") / F.col("max_popularity")),
        ).otherwise(0.0)
    )


def _order(sort: Column, points: Column) -> tuple[Column, Column]:
    """Two ascending sort keys per sort name; the product id follows."""
    rating = F.coalesce(F.nullif("rating", F.lit(0.0)), F.lit(-1.0))
    reviews = F.coalesce("reviews_count", F.lit(0)).cast("double")
    none = F.lit(0.0)
    keys = {
        "price_asc": (F.col("price_eur"), none),
        "price_desc": (-F.col("price_eur"), none),
        "rating": (-rating, -reviews),
        "popularity": (-F.col("popularity"), none),
    }
    first, second = F, F
    for name, (one, two) in keys.items():
        first = first.when(sort == name, one)
        second = second.when(sort == name, two)
    return first.otherwise(-points), second.otherwise(-F.col("popularity"))


def first_copies(facts: DataFrame, sort: str = "relevance") -> DataFrame:
    """Facts with the copies of a product that differ in no price, stock or profile as one row of ``n_rows``.

    The row is the copy that comes first in the order, whatever a scope adds to the score of all
    of them, so the others are never the best of their group.
    """
    same = ["profile_id", "duplicate_group_id", "price_eur", "stock_level"]
    first, second = _order(F.lit(sort), F.lit(0.0))
    best = F.struct(first.alias("first"), second.alias("second"), "product_id", *[c for c in facts.columns if c not in [*same, "product_id"]])
    copies = (
        facts.filter("duplicate_group_id IS NOT NULL")
        .groupBy(*same)
        .agg(F.min(best).alias("best"), F.count("*").alias("n_rows"))
        .select(*[c if c in same else f"best.{c}" for c in facts.columns], "n_rows")
    )
    single = facts.filter("duplicate_group_id IS NULL").withColumn("n_rows", F.lit(1).cast("long"))
    return single.unionByName(copies)


def collapse_duplicates(available: DataFrame) -> DataFrame:
    """Keep the best-ranked member of each duplicate group per question.

    Products outside any group need no shuffle; a group shrinks to one row per
    task before it moves.
    """
    best = F.struct("first", "second", "product_id", "score")
    single = available.filter("duplicate_group_id IS NULL").select("question_id", best.alias("b"))
    grouped = (
        available.filter("duplicate_group_id IS NOT NULL")
        .groupBy("question_id", "duplicate_group_id")
        .agg(F.min(best).alias("b"))
        .select("question_id", "b")
    )
    return single.unionByName(grouped).select("question_id", "b.*")


#: Pages that end within so many ranks are cut to it per task; a deeper one is found by a sort.
SHALLOW = 200


def page(collapsed: DataFrame, questions: DataFrame) -> DataFrame:
    """The requested page per question.

    Shallow pages keep the first ``SHALLOW`` ranks of a question at most, and tasks drop later
    ones before anything is shuffled. A question whose page lies deeper doesn't raise that
    bound for others: its products alone are ranked by a sort over all partitions.
    """
    reach = F.col("offset") + F.col("limit")
    paging = written(questions.select("question_id", "offset", "limit", reach.alias("reach")), "paging")
    shallow = paging.filter(F.col("reach") <= SHALLOW)
    order = Window.partitionBy("question_id").orderBy("first", "second", "product_id")
    ranks = collapsed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SHALLOW)
    pages = ranks.join(shallow, "question_id")
    if paging.filter(F.col("reach") > SHALLOW).limit(1).count():
        deep = paging.filter(F.col("reach") > SHALLOW)
        among = collapsed.join(deep.select("question_id"), "question_id")
        ranks = ranked(among, ["question_id"], ["first", "second", "product_id"])
        pages = pages.unionByName(ranks.withColumn("rank", F.col("rank").cast("int")).join(deep, "question_id"))
    return pages.filter((F.col("rank") > F.col("offset")) & (F.col("rank") <= F.col("reach"))).select(
        "question_id", "rank", "product_id", "score"
    )


def _price_ranges(questions: DataFrame) -> DataFrame:
    """The price ranges of each question in which a price adds the same bonus to the score.

    Only an order by score under a highest price needs more than one: the tiers follow each other up to that
    price. A tier begins at the least number whose ratio reaches it, which rounding puts within
    a few units of the last place around the product.
    """
    above_none = F.when(_given("min_price") | _given("max_price"), F.coalesce("min_price", F.lit(float("-inf"))))

    def cut(share: float) -> Column:
        near = F.col("max_price") * share
        places = F.array(*[near + near * (k * 2.0**-53) for k in range(-8, 9)])
        return F.array_min(F.filter(places, lambda x: x / F.col("max_price") >= share))

    def piece(low: Column, high: Column, open_: bool, bonus: float) -> Column:
        return F.struct(
            low.alias("low"), high.alias("high"), F.lit(open_).alias("open"), F.lit(bonus).alias("bonus")
        )

    most = F.col("max_price")
    tiers = sorted(fixed.BUDGET_TIERS)
    begins = [F.greatest(above_none, cut(low)) for low, _, _ in tiers]
    pieces = [piece(above_none, cut(tiers[0][0]), True, 0.0)]
    for k, (_, high, bonus) in enumerate(tiers):
        ends = most if high == 1.0 else cut(tiers[k + 1][0])
        pieces.append(piece(begins[k], ends, high != 1.0, bonus))
    tiered = ~F.col("sort").isin(*STATIC_SORTS) & (most > 0)
    return questions.select(
        "question_id",
        scope_id().alias("scope_id"),
        "sort",
        F.col("include_out_of_stock").alias("every_stock"),
        (F.col("offset") + F.col("limit")).alias("n"),
        F.inline(F.when(tiered, F.array(*pieces)).otherwise(F.array(piece(above_none, most, False, 0.0)))),
    )


def _list_id(*names: str) -> Column:
    return F.concat_ws(":", "scope_id", *[F.col(name).cast("string") for name in names], _free().cast("string"))


def _free() -> Column:
    """Ranges of all prices and of none."""
    return F.col("low").isNull() & F.col("high").isNull()


def _list_is_free() -> Column:
    """If the ranges of a list are of all prices, as its id says."""
    return F.col("list_id").endswith(":true")


def _with_top(met: DataFrame, products: DataFrame) -> DataFrame:
    return met.crossJoin(F.broadcast(products.agg(F.max("popularity").alias("max_popularity"))))  # one row


def top_pages(met: DataFrame, products: DataFrame, questions: DataFrame) -> DataFrame:
    """The requested page of each question, as ``page`` gives it, from the matches of scopes.

    As ``profile_pages``, but every list is made of all matches of its scope.
    """
    questions = written(questions, "paging")
    asked = _shallow_ranges(questions)
    lists = asked.select("list_id", "scope_id", "sort", "every_stock", "bonus").distinct()
    first, second = _order(F.col("sort"), score(F.col("bonus")))
    buyable = F.col("stock_level").isin(fixed.RECOMMENDABLE)
    listed = (
        _with_top(met, products)
        .join(lists, "scope_id")
        .filter(buyable | F.col("every_stock"))
        .select("list_id", "duplicate_group_id", _item(first, second).alias("item"))
    )
    return _listed_pages(listed, asked, met, products, questions)


def profile_pages(facts: DataFrame, pairs: DataFrame, products: DataFrame, questions: DataFrame) -> DataFrame:
    """The requested page of each question, as ``page`` gives it, without a scope meeting all its products.

    Each order that the questions of a scope ask for is a list of its products, copies as one (they share a
    price), and a page the first of a price range of it. Only products that can be on a page come on the list
    (``_leading``). Only pages beyond ``SHALLOW`` are made by sorting all matches of their questions.
    """
    questions = written(questions, "paging")
    asked = _shallow_ranges(questions)
    lists = asked.withColumn(
        "family", F.when(F.col("sort").isin(*STATIC_SORTS), F.col("sort")).otherwise("popularity")
    )
    first, second = _order(F.col("family"), F.lit(0.0))
    item = _item(*_order(F.col("sort"), score(F.col("bonus"))))
    listed = _leading(
        facts, _with_top(pairs, products), lists, ["sort", "every_stock", "bonus"],
        F.struct(first.alias("first"), second.alias("second"), "product_id"), item, copies=True,
    )
    return _listed_pages(listed, asked, profile_matches(facts, pairs), products, questions)


def _shallow_ranges(questions: DataFrame) -> DataFrame:
    ranges = _price_ranges(questions.filter(F.col("offset") + F.col("limit") <= SHALLOW))
    return written(ranges.withColumn("list_id", _list_id("sort", "every_stock", "bonus")), "price_ranges")


def _item(first: Column, second: Column) -> Column:
    return F.struct(
        first.alias("first"), second.alias("second"), "product_id", "price_eur", "text_score", "stock_level",
        "popularity",
    )


def _leading(
    facts: DataFrame, pairs: DataFrame, asked: DataFrame, terms: list[str], order: Column, item: Column, copies: bool
) -> DataFrame:
    """``list_id, duplicate_group_id, item``: the products of lists that a range of ``asked`` can want.

    ``order`` is that of ``family`` within a profile, price and kind of stock, where all lists that ask for it
    agree; ``item`` orders a whole list, by its ``terms`` and by what ``pairs`` know. Such a cell keeps its first
    ``n`` products. A list meets the first product of each cell; a price range has all products of a
    price or none, so those behind the ``n`` first of them at a price are left out, with all of
    their cell, and only the cells that remain give their other products. Lists without a price range do
    so for all prices at once. With ``copies`` these count as one.
    """
    most = asked.agg(F.max("n")).first()[0] or 1
    lists = written(
        asked.groupBy("list_id", "scope_id", "family", _free().alias("free"), *terms).agg(
            F.min(F.coalesce("low", F.lit(float("-inf")))).alias("least"),
            F.max(F.coalesce("high", F.lit(float("inf")))).alias("highest"),
        ),
        "lists",
    )
    low = F.col("stock_level") == "low"
    stock = F.when(low, "low").when(F.col("stock_level").isin(fixed.RECOMMENDABLE), "other").otherwise("gone")
    cell = ["profile_id", "family", "free", "stock", "at"]
    placed = (
        facts.withColumn("stock", stock)
        .crossJoin(F.broadcast(lists.select("family", "free").distinct()))  # a few orders
        .withColumn("at", F.when(F.col("free"), 0.0).otherwise(F.col("price_eur")))
        .filter("at IS NOT NULL")
        .withColumn("own", order)
    )
    kept = ["price_eur", "product_id", "duplicate_group_id", "stock_level", "popularity", "rating", "reviews_count", "_ord"]
    placed = placed.select(*cell, F.struct("own", *kept).alias("product"))
    if copies:
        group = "product.duplicate_group_id"
        as_one = placed.filter(F.col(group).isNotNull()).groupBy(*cell, F.col(group).alias("copies"))
        placed = placed.filter(F.col(group).isNull()).unionByName(
            as_one.agg(F.min("product").alias("product")).drop("copies")
        )
    best = Window.partitionBy(*cell).orderBy("product")
    heads = written(
        placed.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= most).select(
            *cell, "place", *[F.col(f"product.{name}").alias(name) for name in kept]
        ),
        "heads",
    )
    n_first, n_other = heads.agg(F.count_if(F.col("place") == 1), F.count_if(F.col("place") > 1)).first()
    within = F.col("free") | F.col("at").between(F.col("least"), F.col("highest"))
    firsts = written(
        spread(pairs, "scope_id", "profile_id")
        .join(beside(lists), "scope_id")
        .join(beside(heads.filter("place = 1"), n_first), ["profile_id", "family", "free"])
        .filter(within & ((F.col("stock") != "gone") | F.col("every_stock")))
        .withColumn("item", item)
        .drop("scope_id", "least", "highest"),
        "firsts",
    )
    unit = F.struct("duplicate_group_id", "product_id")
    if copies:
        unit = F.struct("duplicate_group_id", F.when(F.col("duplicate_group_id").isNull(), F.col("product_id")))
    nth = Window.partitionBy("list_id", "at").orderBy("item")
    last = written(
        firsts.groupBy("list_id", "at", unit.alias("unit"))
        .agg(F.min("item").alias("item"))
        .withColumn("nth", F.row_number().over(nth))
        .filter(F.col("nth") == most)
        .select("list_id", "at", F.col("item").alias("last")),
        "last",
    )
    wanted = F.col("last").isNull() | (F.col("item") <= F.col("last"))
    remain = written(firsts.join(beside(last), ["list_id", "at"], "left").filter(wanted), "remain")
    others = (
        remain.drop("place", "item", *kept)
        .join(beside(heads.filter("place > 1"), n_other), cell)
        .withColumn("item", item)
        .filter(wanted)
    )
    columns = ["list_id", "duplicate_group_id", "item"]
    return written(remain.select(columns).unionByName(others.select(columns)), "leading")


def _listed_pages(
    listed: DataFrame, asked: DataFrame, met: DataFrame, products: DataFrame, questions: DataFrame
) -> DataFrame:
    """Pages from lists of products; ``met`` is read for pages beyond ``SHALLOW`` alone."""
    copies = (
        listed.filter("duplicate_group_id IS NOT NULL")
        .groupBy("list_id", "duplicate_group_id")
        .agg(F.min("item").alias("item"))
    )
    units = listed.filter("duplicate_group_id IS NULL").select("list_id", "item").unionByName(
        copies.select("list_id", "item")
    )
    # Without a price range a page is the beginning of its list, cut to its length per task.
    begin = Window.partitionBy("list_id").orderBy("item.first", "item.second", "item.product_id")
    found = (
        units.filter(_list_is_free())
        .withColumn("place", F.row_number().over(begin))
        .filter(F.col("place") <= SHALLOW)
        .join(unsent(asked.filter(_free()).select("question_id", "list_id", "n")), "list_id")
        .filter(F.col("place") <= F.col("n"))
        .select("question_id", "item")
    )
    ranged = asked.filter(~_free())
    if not ranged.isEmpty():
        within = range_tops(
            units.filter(~_list_is_free()).select("list_id", F.col("item.price_eur").alias("at"), "item"),
            ranged.select(F.struct("question_id", "bonus").alias("ask_id"), "list_id", "low", "high", "open", "n"),
        )
        found = found.unionByName(within.select("ask_id.question_id", "item"))
    order = Window.partitionBy("question_id").orderBy("item.first", "item.second", "item.product_id")
    terms = questions.select(
        "question_id", "offset", (F.col("offset") + F.col("limit")).alias("reach"),
        *[F.col(name).alias(f"q_{name}") for name in ("occasion", "recipient", "max_price")],
    )
    shown = (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= SHALLOW)
        .join(unsent(terms), "question_id")
        .filter((F.col("rank") > F.col("offset")) & (F.col("rank") <= F.col("reach")))
        .select("*", "item.*")
    )
    pages = _with_top(shown, products).select("question_id", "rank", "product_id", score().alias("score"))
    deep = questions.filter(F.col("offset") + F.col("limit") > SHALLOW)
    if deep.isEmpty():
        return pages
    among = asked_matches(met, products, deep).filter("available")
    return pages.unionByName(page(collapse_duplicates(among), deep))


def _sold_out_ranges(questions: DataFrame, n: int) -> DataFrame:
    asked = questions.filter(~F.col("include_out_of_stock")).withColumn("sort", F.lit("popularity"))
    return _price_ranges(asked).withColumn("n", F.lit(n)).withColumn("list_id", _list_id())


def _most_popular() -> Column:
    return F.struct((-F.col("popularity")).alias("first"), "_ord", "product_id", "price_eur")


def top_sold_out(met: DataFrame, questions: DataFrame, n: int = 2) -> DataFrame:
    """Per question the ``n`` most popular products in its price range that can't be bought.

    Of questions that take any stock there are none.
    """
    asked = written(_sold_out_ranges(questions, n), "price_ranges")
    gone = met.filter(~F.col("stock_level").isin(fixed.RECOMMENDABLE)).join(
        asked.select("scope_id", "list_id").distinct(), "scope_id"
    )
    return _popular(gone.select("list_id", _most_popular().alias("item")), asked, n)


def profile_sold_out(facts: DataFrame, pairs: DataFrame, questions: DataFrame, n: int = 2) -> DataFrame:
    """As ``top_sold_out``, without a scope meeting all its products."""
    asked = written(_sold_out_ranges(questions, n).withColumn("family", F.lit("popularity")), "price_ranges")
    if asked.isEmpty():
        product = F.lit(None).cast(facts.schema["product_id"].dataType).alias("product_id")
        return asked.select("question_id", F.lit(0).alias("rank"), product).limit(0)
    gone = facts.filter(~F.col("stock_level").isin(fixed.RECOMMENDABLE))
    every = asked.withColumn("every_stock", F.lit(True))
    return _popular(
        _leading(gone, pairs, every, ["every_stock"], _most_popular(), _most_popular(), copies=False), asked, n
    )


def _popular(gone: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    found = range_tops(
        gone.select("list_id", F.col("item.price_eur").alias("at"), "item"),
        asked.select(F.col("question_id").alias("ask_id"), "list_id", "low", "high", "open", "n"),
    )
    order = Window.partitionBy("question_id").orderBy("item")
    return (
        found.withColumnRenamed("ask_id", "question_id")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select("question_id", "rank", F.col("item.product_id").alias("product_id"))
    )


#: What is counted of a scope at each price: products, those that can be bought, and both with
#: the copies of a product as one.
COUNTED = ["n_all", "n_buy", "n_all_collapsed", "n_buy_collapsed"]
#: The first products at a price by input order, of all and of those that can be bought.
FIRST = ["first_all", "first_buy"]
#: Order at equal prices: where a least price begins, the products, where a highest price ends.
BEGINS, PRODUCTS, ENDS = 0, 1, 2


def scope_prices(met: DataFrame) -> DataFrame:
    """The products of each scope counted by price: ``COUNTED`` and ``FIRST`` per scope and price.

    Copies share a price, so those of a scope that count as one meet here; a product with
    very many copies shrinks to a row per task before it moves.
    """
    buyable = F.col("stock_level").isin(fixed.RECOMMENDABLE)
    found = F.struct("price_eur", "_ord", "product_id")
    single = F.when(F.col("duplicate_group_id").isNull(), F.col("product_id"))
    units = met.groupBy("scope_id", "price_eur", "duplicate_group_id", single.alias("single")).agg(
        F.count("*").alias("n_all"),
        F.count_if(buyable).alias("n_buy"),
        F.min(found).alias("first_all"),
        F.min(F.when(buyable, found)).alias("first_buy"),
    )
    return units.groupBy("scope_id", "price_eur").agg(
        F.sum("n_all").alias("n_all"),
        F.sum("n_buy").alias("n_buy"),
        F.count("*").alias("n_all_collapsed"),
        F.count_if(F.col("n_buy") > 0).alias("n_buy_collapsed"),
        F.min("first_all").alias("first_all"),
        F.min("first_buy").alias("first_buy"),
    )


def profile_prices(facts: DataFrame, pairs: DataFrame, firsts: bool = True) -> DataFrame:
    """As ``scope_prices``, without a scope meeting its products; ``FIRST`` on demand.

    The products of a profile are counted by price before scopes meet them. Only copies
    whose profiles differ have to meet per scope, as those it takes are one.
    """
    buyable = F.col("stock_level").isin(fixed.RECOMMENDABLE)
    found = F.struct("price_eur", "_ord", "product_id")
    single = F.when(F.col("duplicate_group_id").isNull(), F.col("product_id"))
    unit = ["price_eur", "duplicate_group_id", "single"]
    first = {"first_all": F.min(found), "first_buy": F.min(F.when(buyable, found))} if firsts else {}
    cells = written(
        facts.withColumn("single", single)
        .groupBy("profile_id", *unit)
        .agg(
            F.count("*").alias("n_all"),
            F.count_if(buyable).alias("n_buy"),
            *[value.alias(name) for name, value in first.items()],
        )
        .withColumn("n_profiles", F.count("*").over(Window.partitionBy(*unit))),
        "cells",
    )
    alone, for_sale = F.col("n_profiles") == 1, F.col("n_buy") > 0
    sums = [F.sum(name).alias(name) for name in COUNTED]
    least = [F.min(name).alias(name) for name in first]
    by_price = cells.groupBy("profile_id", "price_eur").agg(
        F.sum("n_all").alias("n_all"),
        F.sum("n_buy").alias("n_buy"),
        F.count_if(alone).alias("n_all_collapsed"),
        F.count_if(alone & for_sale).alias("n_buy_collapsed"),
        *least,
    )
    places = pairs.select("scope_id", "profile_id")
    whole = places.join(unsent(by_price), "profile_id").groupBy("scope_id", "price_eur").agg(*sums, *least)
    none = F.lit(0).cast("long")
    mixed = (
        places.join(unsent(cells.filter(~alone)), "profile_id")
        .groupBy("scope_id", *unit)
        .agg(F.max("n_buy").alias("n_buy"))
        .groupBy("scope_id", "price_eur")
        .agg(
            F.count("*").alias("n_all_collapsed"),
            F.count_if(for_sale).alias("n_buy_collapsed"),
        )
        .withColumns({"n_all": none, "n_buy": none})
    )
    both = whole.unionByName(mixed, allowMissingColumns=True)
    return both.groupBy("scope_id", "price_eur").agg(*sums, *least)


def question_counts(met: DataFrame, questions: DataFrame) -> DataFrame:
    """How many products survive each filter stage, from the written matches of scopes."""
    return priced_counts(scope_prices(met), questions)


def priced_counts(prices: DataFrame, questions: DataFrame) -> DataFrame:
    """How many products survive each filter stage, from the products of scopes counted by price.

    Per question: ``n_attributes, n_buyable, n_price, n_available, n_beyond`` (can be bought, but not
    at the price), ``total_matches`` (available
    ones, copies as one) and ``nearest``, the cheapest product that can be bought outside
    the price range, if ``prices`` has ``FIRST``. No question meets its matches: a scope's products are counted by price, the
    bounds of its questions take their places in the order of prices, and running
    sums there are the answers. What is shuffled are matches, prices and questions.
    """
    prices = written(prices, "scope_prices")
    firsts = [name for name in FIRST if name in prices.columns]
    asked = questions.select(
        "question_id", scope_id().alias("scope_id"), "max_price", "min_price",
        F.col("include_out_of_stock").alias("every_stock"),
    )

    def bound(name: str, side: int) -> DataFrame:
        return asked.filter(F.col(name).isNotNull()).select(
            "scope_id", F.col(name).alias("price_eur"), F.lit(side).alias("side"), "question_id"
        )

    places = prices.filter("price_eur IS NOT NULL").withColumn("side", F.lit(PRODUCTS)).unionByName(
        bound("min_price", BEGINS).unionByName(bound("max_price", ENDS)), allowMissingColumns=True
    )
    sums = running(places, ["scope_id"], ["price_eur", "side", "question_id"], COUNTED, firsts)

    def at(side: int, name: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(name)))

    found = sums.filter(F.col("side") != PRODUCTS).groupBy("question_id").agg(
        *[at(BEGINS, f"up_to_{n}").alias(f"below_{n}") for n in COUNTED],
        *[at(ENDS, f"up_to_{n}").alias(f"within_{n}") for n in COUNTED],
        *[at(ENDS, f"next_{n}").alias(f"next_{n}") for n in firsts],
    )
    priced = F.col("price_eur").isNotNull()
    whole = prices.groupBy("scope_id").agg(
        *[F.sum(n).alias(n) for n in COUNTED],
        *[F.sum(F.when(priced, F.col(n))).alias(f"priced_{n}") for n in COUNTED],
        *[F.min(F.when(priced, F.col(n))).alias(n) for n in firsts],
    )
    bounded = _given("max_price") | _given("min_price")

    def in_price(name: str) -> Column:
        up_to = F.coalesce(f"within_{name}", f"priced_{name}", F.lit(0))
        some = F.greatest(up_to - F.coalesce(f"below_{name}", F.lit(0)), F.lit(0))
        return F.when(bounded, some).otherwise(F.col(name))

    def stock(name: str, of=F.col) -> Column:
        return F.when(F.col("every_stock"), of(f"{name}_all")).otherwise(of(f"{name}_buy"))

    def collapsed() -> Column:
        return F.when(F.col("every_stock"), in_price("n_all_collapsed")).otherwise(in_price("n_buy_collapsed"))

    nearest = []
    if firsts:
        first, following = stock("first"), stock("next_first")
        nearest = [
            F.when(_given("min_price") & (first["price_eur"] < F.col("min_price")), first)
            .when(_given("max_price"), following)
            .alias("nearest")
        ]
    return (
        asked.join(unsent(whole), "scope_id")
        .join(unsent(found), "question_id", "left")
        .select(
            "question_id",
            F.col("n_all").alias("n_attributes"),
            stock("n").alias("n_buyable"),
            in_price("n_all").alias("n_price"),
            stock("n", in_price).alias("n_available"),
            F.when(bounded, stock("priced_n") - stock("n", in_price)).otherwise(0).alias("n_beyond"),
            collapsed().alias("total_matches"),
            *nearest,
        )
    )


def over_budget(products: DataFrame, questions: DataFrame) -> DataFrame:
    """Per question what passes the attribute filters and can be bought, but not at the price.

    ``question_id, n_over_budget, cheapest`` (price), where there is any.
    """
    counts = priced_counts(profile_prices(*scope_profiles(products, questions)), questions)
    return counts.filter("n_beyond > 0").select(
        "question_id", F.col("n_beyond").alias("n_over_budget"), F.col("nearest.price_eur").alias("cheapest")
    )


def score_sums(
    products: DataFrame, questions: DataFrame, index: DataFrame | None = None
) -> DataFrame:
    """How many products each question matches, and their summed, highest and lowest score.

    Within equal text score, price and stock a score follows popularity, so
    scopes are reduced to a row for each of these before their questions meet them.
    """
    facts, pairs = scope_profiles(products, questions, index)
    low = F.when(F.col("stock_level") == "low", "low").alias("stock_level")
    gathered = [
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"),
    ]
    cells = facts.groupBy("profile_id", "price_eur", low).agg(
        F.count("*").alias("n"),
        F.sum("popularity").alias("total"),
        F.min("popularity").alias("least"),
        F.max("popularity").alias("most"),
    )
    shelf = ["scope_id", "text_score", "q_occasion", "q_recipient", "price_eur", "stock_level"]
    shelves = written(pairs.join(cells, "profile_id").groupBy(*shelf).agg(*gathered), "shelves")
    asking = questions.select("question_id", scope_id().alias("scope_id"), F.col("max_price").alias("q_max_price"))

    # Either side may be small enough to be sent to all tasks, and the other is then what makes tasks.
    shelves = spread(shelves, "scope_id", "text_score", "price_eur", "stock_level")
    met = _with_top(shelves, products).join(spread(asking, "question_id"), "scope_id")
    plain = met.withColumn("popularity", F.lit(0.0)).withColumn("base", score())
    best = plain.withColumn("popularity", F.col("most")).withColumn("highest", score())
    worst = best.withColumn("popularity", F.col("least")).withColumn("lowest", score())
    share = F.when(
        F.col("max_popularity") > 0, F.lit(fixed.POPULARITY_BONUS) * (F.col("total") / F.col("max_popularity"))
    ).otherwise(0.0)
    return worst.groupBy("question_id").agg(
        F.sum("n").alias("n_products"),
        F.sum(F.col("n") * F.col("base") + share).alias("sum_score"),
        F.max("highest").alias("max_score"),
        F.min("lowest").alias("min_score"),
    )


def diagnose() -> Column:
    """Why a question came back empty; null when it did not."""
    bounded = _given("max_price") | _given("min_price")
    return (
        F.when(F.col("n_available") > 0, None)
        .when(F.col("n_price") > 0, "out_of_stock_only")
        .when((F.col("n_buyable") > 0) & bounded, "budget_too_low")
        .when(F.size("words") > 0, "no_query_match")
        .otherwise("over_constrained")
    )


def cheapest_overall(products: DataFrame) -> DataFrame:
    """One row: the cheapest product that can be bought, or the cheapest at all."""
    buyable = F.col("stock_level").isin(fixed.RECOMMENDABLE)
    found = F.struct("price_eur", "_ord", "product_id", "category")
    return products.agg(
        F.coalesce(F.min(F.when(buyable, found)), F.min(found)).alias("cheapest_overall")
    )


def answer_questions(
    products: DataFrame,
    questions: DataFrame,
    index: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(envelopes, mentions) for distinct questions.

    Envelopes hold one row per question: counts, reason, total. Mentions name every
    product a response shows, with its role (result, sold_out, nearest) and rank.
    """
    facts, pairs = scope_profiles(products, questions, index)
    numbers = ["n_attributes", "n_buyable", "n_price", "n_available", "total_matches"]
    envelopes = written(
        questions.join(unsent(priced_counts(profile_prices(facts, pairs), questions)), "question_id", "left")
        .fillna(0, numbers)
        .withColumn("reason", diagnose()),
        "envelopes",
    )
    empty = envelopes.select("question_id", "reason", "max_price", "min_price", "nearest")
    # Only questions that found something are ranked, and only sold-out ones look for the popular.
    full = envelopes.filter("n_available > 0").select(questions.columns)
    gone = envelopes.filter("reason = 'out_of_stock_only'").select(questions.columns)
    sold_out = profile_sold_out(facts, pairs, gone).withColumn("role", F.lit("sold_out"))
    bounded = _given("max_price") | _given("min_price")
    nearest = empty.filter(
        F.col("reason").isin("out_of_stock_only", "budget_too_low")
        & bounded
        & _given("nearest")
    ).select(
        "question_id",
        F.lit(1).alias("rank"),
        F.col("nearest.product_id").alias("product_id"),
        F.lit("nearest").alias("role"),
    )
    results = profile_pages(facts, pairs, products, full).withColumn("role", F.lit("result"))
    columns = ["question_id", "role", "rank", "product_id"]
    mentions = reduce(
        DataFrame.unionByName, [part.select(columns) for part in (results, sold_out, nearest)]
    )
    return envelopes, mentions
