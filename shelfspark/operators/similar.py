"""Similar products for many targets, without ever pairing all products of a tag.

Whether two products compare, and most of their similarity, depends only on their
kind: category, subcategory and tags. So kinds are compared, not products:

1. Kinds meet through a shared subcategory or tag. Keys have levels, by how many
   kinds hold them. At a level, kinds are reduced to their keys of that level and
   above: the more common a key, the fewer distinct reduced kinds hold it. A pair
   is scored exactly at the lowest level it shares a key on; at a higher level the
   score leaves out rarer keys and is never above the true one.
2. Products of one kind and price lie on one shelf and differ only in popularity
   and id, so a shelf keeps its first few. A kind has no more shelves than there
   are prices.
3. Price closeness falls off on both sides of the target's price, so the nearest
   shelves on either side hold every possible winner. Only at a price of nothing are
   all prices from one on equally far; their most popular products are taken as well.
4. Kinds that cannot reach the page (enough better ones exist) are left out.

Nothing is sampled: these bounds only drop what provably ranks too low.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions import fixed
from shelfspark.operators.search import clamp
from shelfspark.operators.skew import HOT_ROWS, attach
from shelfspark.session import written

# Keys held by up to this many kinds have level 0; every doubling is one level more.
LEVEL_KINDS = 500
# Own copies are excluded only at the end, so one more candidate is kept.
KEEP = fixed.SIMILAR_LIMITS[1] + 1


def listings(products: DataFrame) -> DataFrame:
    """Products that can be compared at all, with their kind and blocking keys."""
    subcategory = F.nullif("subcategory", F.lit(""))
    tags = F.array_sort(F.array_distinct("tags"))
    keys = F.concat(
        F.when(subcategory.isNotNull(), F.array(F.concat(F.lit("s:"), subcategory))).otherwise(
            F.array().cast("array<string>")
        ),
        F.transform(tags, lambda tag: F.concat(F.lit("t:"), tag)),
    )
    kind = F.sha2(F.to_json(F.struct("category", subcategory.alias("sub"), tags.alias("tags"))), 256)
    return products.select(
        "product_id",
        F.coalesce("duplicate_group_id", "product_id").alias("own"),
        "category",
        "price_eur",
        "popularity",
        "_ord",
        F.col("stock_level").isin(fixed.RECOMMENDABLE).alias("buyable"),
        kind.alias("kind"),
        keys.alias("keys"),
    ).filter(F.size("keys") > 0)


def kinds(listed: DataFrame, level_kinds: int = LEVEL_KINDS) -> DataFrame:
    """One row per kind: category, and its keys as (level, key)."""
    distinct = listed.groupBy("kind", "category", "keys").agg(F.count("*").alias("n"))
    each = distinct.select("kind", F.explode("keys").alias("key"))
    doublings = F.ceil(F.log2(F.col("n_rows") / level_kinds)).cast("int")
    levels = (
        each.groupBy("key")
        .agg(F.count("*").alias("n_rows"))
        .withColumn("level", F.greatest(F.lit(0), doublings))
    )
    leveled = (
        attach(each, levels, "key", F.col("kind"))
        .groupBy("kind")
        .agg(F.array_sort(F.collect_list(F.struct("level", "key"))).alias("keys"))
    )
    sizes = distinct.select("kind", "category", F.col("n").alias("n_rows"))
    return sizes.join(leveled, "kind")


def with_levels(listed: DataFrame, kind_table: DataFrame, hot_rows: int) -> DataFrame:
    """Listings whose keys carry their level. A kind may hold very many products."""
    lookup = kind_table.select("kind", "keys", "n_rows")
    return attach(listed.drop("keys"), lookup, "kind", F.col("product_id"), hot_rows=hot_rows)


def placed_at(table: DataFrame, level: int) -> DataFrame:
    """Rows that hold a key of the level, with their unit: the kind reduced to it.

    The unit follows from the row itself, so nothing is joined.
    """
    cut = table.withColumns(_at(level)).withColumn("n_tags", _n_tags(F.col("keys.key")))
    unit = F.sha2(F.to_json(F.struct("category", "kept", "n_tags")), 256)
    return cut.filter(F.size("meet") > 0).withColumn("unit", unit)


def _at(level: int, keys: str = "keys") -> dict[str, Column]:
    """What a key set is at a level: the keys kept, those that meet, those above."""

    def those(test) -> Column:
        return F.transform(F.filter(keys, lambda k: test(k["level"])), lambda k: k["key"])

    return {
        "kept": those(lambda found: found >= level),
        "meet": those(lambda found: found == level),
        "above": those(lambda found: found > level),
    }


def _levels(kind_table: DataFrame) -> list[int]:
    """The levels in use: a few numbers, as each is twice as common as the last."""
    levels = kind_table.select(F.explode("keys.level").alias("level")).distinct()
    return sorted(row.level for row in levels.collect())


def _n_tags(keys: Column) -> Column:
    return F.size(F.filter(keys, lambda key: key.startswith("t:")))


def overlapping(left: DataFrame, right: DataFrame, meet: str) -> DataFrame:
    """Join rows of which the arrays ``meet`` share an element, each pair once.

    Left and right columns come back as ``a_*`` and ``b_*``. A pair meets at every
    common key and is kept at the first, so nothing has to be deduplicated.
    """
    a = left.select(*[F.col(c).alias(f"a_{c}") for c in left.columns], F.explode(meet).alias("key"))
    b = right.select(
        *[F.col(c).alias(f"b_{c}") for c in right.columns], F.explode(meet).alias("key")
    )
    common = F.array_intersect(f"a_{meet}", f"b_{meet}")
    return a.join(b, "key").filter(F.get(common, F.lit(0)) == F.col("key")).drop("key")


def kind_score() -> Column:
    """Similarity of two kinds by the keys kept; the price is added later."""
    shared = F.size(F.array_intersect("a_tags", "b_tags"))
    union = F.col("a_n_tags") + F.col("b_n_tags") - shared
    return (
        F.when(F.col("a_sub") == F.col("b_sub"), fixed.SIMILAR_SUBCATEGORY).otherwise(0.0)
        + F.when(F.col("a_category") == F.col("b_category"), fixed.SIMILAR_CATEGORY).otherwise(0.0)
        + F.when(union > 0, F.lit(fixed.SIMILAR_TAGS) * shared / union).otherwise(0.0)
    )


def _tiers(
    kind_table: DataFrame, wanted: DataFrame, levels: list[int]
) -> list[tuple[int, DataFrame]]:
    """(level, pairs) per level: which units compare, and how alike they are.

    Only units of ``wanted`` kinds ask. A pair ``counts`` at the highest level it
    shares a key on, so that every two kinds count once.
    """
    asked = kind_table.join(wanted.select("kind").distinct(), "kind", "left_semi")
    tiers = []
    for level in levels:

        def units(table: DataFrame) -> DataFrame:
            tags = F.filter("kept", lambda key: key.startswith("t:"))
            sub = F.get(F.filter("kept", lambda key: key.startswith("s:")), F.lit(0))
            return placed_at(table, level).withColumns({"tags": tags, "sub": sub})

        columns = ["unit", "category", "n_tags", "tags", "sub", "meet", "above"]
        pairs = overlapping(
            units(asked).select(*columns).distinct(),
            units(kind_table).select(*columns).distinct(),
            "meet",
        ).select(
            "a_unit",
            "b_unit",
            kind_score().alias("kind_score"),
            (~F.arrays_overlap("a_above", "b_above")).alias("counts"),
        )
        tiers.append((level, written(pairs, "pairs")))
    return tiers


def _in_scopes(listed: DataFrame) -> DataFrame:
    """Each listing once for 'everything' and, if it can be bought, once for that."""
    scopes = F.when(F.col("buyable"), F.array(F.lit(True), F.lit(False))).otherwise(
        F.array(F.lit(True))
    )
    return listed.withColumn("all_stock", F.explode(scopes))


def _shelves(scoped: DataFrame, level: int) -> DataFrame:
    """One row per (scope, unit, price): its leading products, and how many surely are there.

    ``best`` holds one product per group of copies, most popular first. ``n_own`` counts a group of copies once
    in each unit, where it is cheapest, and ``n_home`` once in all units.
    """
    located = placed_at(scoped, level)
    shelf = ["all_stock", "unit", "price_eur"]
    leader = F.struct((-F.col("popularity")).alias("minus_popularity"), "product_id", "own")
    per_own = located.groupBy(*shelf, "own").agg(F.min(leader).alias("leader"))
    order = Window.partitionBy(*shelf).orderBy("leader")
    best = (
        per_own.withColumn("nth", F.row_number().over(order))
        .filter(F.col("nth") <= KEEP)
        .groupBy(*shelf)
        .agg(F.array_sort(F.collect_list("leader")).alias("best"))
    )
    cheapest = (
        per_own.filter("own IS NOT NULL AND price_eur IS NOT NULL")
        .groupBy("all_stock", "unit", "own")
        .agg(F.min("price_eur").alias("price_eur"))
    )
    homes = cheapest.groupBy("all_stock", "own").agg(F.min(F.struct("unit", "price_eur")).alias("home"))
    owns = cheapest.groupBy(*shelf).agg(F.count("*").alias("n_own"))
    at_home = homes.groupBy("all_stock", "home.unit", "home.price_eur").agg(F.count("*").alias("n_home"))
    return best.join(owns, shelf, "left").join(at_home, shelf, "left").fillna(0, ["n_own", "n_home"])


def as_of(
    shelves: DataFrame, points: DataFrame, unit: list[str], value: Column, above: bool = False
) -> DataFrame:
    """Per point the value of the last shelf at or below ``at``, or of the first above.

    Points and shelves are sorted together per unit. Both are distinct prices, so a
    unit is never larger than the range of prices.
    """
    rows = shelves.select(*unit, F.col("price_eur").alias("at"), F.lit(0).alias("point"), value.alias("value"))
    asked = points.select(
        *unit, "at", F.lit(1).alias("point"), F.lit(None).cast(rows.schema["value"].dataType).alias("value")
    )
    order = [F.desc("at"), F.desc("point")] if above else [F.col("at"), F.col("point")]
    upto = Window.partitionBy(*unit).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.unionByName(asked)
        .withColumn("value", F.last("value", ignorenulls=True).over(upto))
        .filter("point = 1")
        .drop("point")
    )


def _running(shelves: DataFrame, unit: list[str], number: str) -> DataFrame:
    upto = Window.partitionBy(*unit).orderBy("price_eur").rowsBetween(Window.unboundedPreceding, 0)
    return shelves.withColumn(number, F.sum(number).over(upto))


NO_BOUND = float("inf")


def _tier_candidates(
    scoped: DataFrame, level: int, pairs: DataFrame, classes: DataFrame
) -> DataFrame:
    """The leading products for every class of targets, within one tier.

    A class is (unit, scope, price, price bound): its targets differ only in which
    copies are their own.
    """
    shelf_unit = ["all_stock", "unit"]
    shelves = written(_shelves(scoped, level), "shelves")
    # Units that can still reach the page, by how many products surely beat them.
    scopes = classes.select("a_unit", "all_stock", "bound").distinct()
    reach = scopes.join(pairs.select("a_unit", "b_unit", "kind_score"), "a_unit").withColumnRenamed(
        "b_unit", "unit"
    )
    sold = as_of(
        _running(_running(shelves, shelf_unit, "n_own"), shelf_unit, "n_home"),
        reach.select(*shelf_unit, F.col("bound").alias("at")).distinct(),
        shelf_unit,
        F.struct("n_own", "n_home"),
    ).select(*shelf_unit, F.col("at").alias("bound"), "value.*")
    better = (
        Window.partitionBy("a_unit", "all_stock", "bound")
        .orderBy(F.round(F.col("kind_score") * -1e9).cast("bigint"))
        .rangeBetween(Window.unboundedPreceding, -int(fixed.SIMILAR_PRICE * 1e9) - 2)
    )
    reachable = (
        reach.join(sold, [*shelf_unit, "bound"])
        # A group of copies may lie in many units: its home counts it once, and so does any one unit.
        .withColumn("n_better", F.greatest(F.sum("n_home").over(better), F.max("n_own").over(better), F.lit(0)))
        .filter(F.col("n_better") < KEEP)
        .drop("n_better", "n_home", "n_own")
    )
    reachable = written(reachable, "reachable")
    asking = classes.join(reachable, ["a_unit", "all_stock", "bound"]).withColumn(
        "at", F.least("price", "bound")
    )
    points = asking.select(*shelf_unit, "at").distinct()
    by_price = Window.partitionBy(*shelf_unit).orderBy("price_eur")
    shelf = F.struct("price_eur", "best")
    lists = shelves.withColumns(
        {
            "below": F.collect_list(shelf).over(by_price.rowsBetween(-(KEEP - 1), 0)),
            "beyond": F.collect_list(shelf).over(by_price.rowsBetween(0, KEEP - 1)),
        }
    )
    below = as_of(lists, points, shelf_unit, F.col("below")).withColumnRenamed("value", "below")
    beyond = as_of(lists, points, shelf_unit, F.col("beyond"), above=True).withColumnRenamed(
        "value", "beyond"
    )
    none = F.array().cast(lists.schema["below"].dataType)
    near = below.join(beyond, [*shelf_unit, "at"]).select(
        *shelf_unit,
        "at",
        F.concat(F.coalesce("below", none), F.coalesce("beyond", none)).alias("near"),
    )
    ranked = F.struct((-F.col("score")).alias("minus_score"), "minus_popularity", "product_id")
    free = classes.filter("price = 0").join(reachable, ["a_unit", "all_stock", "bound"])
    leader = F.struct("minus_popularity", "product_id", "own")
    popular = (
        free.select(*shelf_unit, "bound")
        .distinct()
        .join(shelves.filter("price_eur >= 1"), shelf_unit)
        .filter(F.col("price_eur") <= F.col("bound"))
        .select(*shelf_unit, "bound", F.inline("best"))
        .groupBy(*shelf_unit, "bound", "own")
        .agg(F.min(leader).alias("leader"))
        .withColumn(
            "nth",
            F.row_number().over(Window.partitionBy(*shelf_unit, "bound").orderBy("leader")),
        )
        .filter(F.col("nth") <= KEEP)
        .select(*shelf_unit, "bound", "leader.*")
    )
    equally_far = (
        free.join(popular, [*shelf_unit, "bound"])
        .withColumn("score", F.col("kind_score"))
        .select("class_id", "own", ranked.alias("ranked"))
    )
    return (
        asking.join(near, [*shelf_unit, "at"])
        .select("class_id", _near_first().alias("found"))
        .select("class_id", F.inline("found"))
        .unionByName(equally_far)
    )


def _near_first() -> Column:
    """The first ``KEEP`` candidates on the shelves of ``near``, copies as one, as ``ranked`` and ``own``.

    A class needs no more of any unit, so the others never leave their row.
    """

    def on_shelf(shelf: Column) -> Column:
        highest = F.greatest(shelf["price_eur"], F.col("price"), F.lit(1.0))
        closeness = 1.0 - F.abs(shelf["price_eur"] - F.col("price")) / highest
        score = F.col("kind_score") + fixed.SIMILAR_PRICE * closeness
        return F.transform(
            shelf["best"],
            lambda one: F.struct(
                F.struct((-score).alias("minus_score"), one["minus_popularity"], one["product_id"]).alias("ranked"),
                one["own"].alias("own"),
            ),
        )

    affordable = F.filter("near", lambda shelf: shelf["price_eur"] <= F.col("bound"))
    found = F.array_sort(F.flatten(F.transform(affordable, on_shelf)))
    # Only a group with several prices comes twice; later copies are left out.
    owns = F.transform(found, lambda one: one["own"])
    once = F.filter(found, lambda one, k: ~F.exists(F.slice(found, F.lit(1), k), lambda other: other["own"].eqNullSafe(one["own"])))
    distinct = F.size(F.array_distinct(owns)) == F.size(owns)
    return F.slice(F.when(distinct, found).otherwise(once), 1, KEEP)


def _top_per_class(candidates: DataFrame) -> DataFrame:
    order = Window.partitionBy("class_id").orderBy("ranked")
    return (
        candidates.groupBy("class_id", "own")
        .agg(F.min("ranked").alias("ranked"))
        .withColumn("nth", F.row_number().over(order))
        .filter(F.col("nth") <= KEEP)
        .groupBy("class_id")
        .agg(F.collect_list(F.struct("ranked", "own")).alias("top"))
    )


def as_similar(requests: DataFrame) -> DataFrame:
    """Normalise similar-product requests; ``product_id`` is a known id."""
    return requests.select(
        "request_id",
        "product_id",
        F.coalesce("max_price", F.lit(NO_BOUND)).alias("bound"),
        F.coalesce("include_out_of_stock", F.lit(False)).alias("all_stock"),
        clamp(F.col("limit"), fixed.SIMILAR_LIMITS).alias("limit"),
    )


def located_targets(listed: DataFrame, questions: DataFrame) -> DataFrame:
    """Add kind, group and price of each target. Many may ask for one product."""
    wanted = questions.groupBy("product_id").agg(F.count("*").alias("n_rows"))
    facts = listed.select(
        "product_id", "kind", "category", "keys", "own", F.col("price_eur").alias("price")
    ).join(wanted, "product_id")
    return attach(questions, facts, "product_id", F.col("request_id"))


def similar(
    products: DataFrame,
    questions: DataFrame,
    level_kinds: int = LEVEL_KINDS,
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranked, totals, targets) for normalised similar-product questions.

    ``ranked`` holds (request_id, rank, product_id, score); ``totals`` how many
    products compare in all, one per group of copies.
    """
    listed = listings(products)
    kind_table = written(kinds(listed, level_kinds), "kinds")
    levels = _levels(kind_table)
    listed = written(with_levels(listed, kind_table, hot_rows), "listings")
    targets = written(located_targets(listed, questions), "targets")
    known = targets.filter("kind IS NOT NULL")
    tiers = _tiers(kind_table, known, levels)
    scoped = _in_scopes(listed)
    ranked = _rank(scoped, tiers, known, hot_rows)
    totals = _totals(scoped, known, levels, hot_rows)
    return ranked, totals, targets


def _rank(
    scoped: DataFrame,
    tiers: list[tuple[int, DataFrame]],
    targets: DataFrame,
    hot_rows: int,
) -> DataFrame:
    parts = []
    for level, pairs in tiers:
        placed = placed_at(targets, level)
        alike = ["unit", "all_stock", "price", "bound"]
        classes = placed.groupBy(*alike).agg(F.count("*").alias("n_rows"))
        class_id = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string") for c in alike])), 256)
        named = classes.withColumn("class_id", class_id).withColumnRenamed("unit", "a_unit")
        top = _top_per_class(_tier_candidates(scoped, level, pairs, named.drop("n_rows")))
        answered = top.join(named.select("class_id", "n_rows"), "class_id")
        parts.append(
            attach(
                placed.withColumn("class_id", class_id),
                answered,
                "class_id",
                F.col("request_id"),
                hot_rows=hot_rows,
            ).select("request_id", "limit", F.col("own").alias("target_own"), F.inline("top"))
        )
    order = Window.partitionBy("request_id").orderBy("ranked")
    return (
        reduce(DataFrame.unionByName, parts)
        .filter("own <> target_own")
        .groupBy("request_id", "limit", "own")
        .agg(F.min("ranked").alias("ranked"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= F.col("limit"))
        .select(
            "request_id",
            "rank",
            F.col("ranked.product_id").alias("product_id"),
            (-F.col("ranked.minus_score")).alias("score"),
        )
    )


def _totals(
    scoped: DataFrame,
    targets: DataFrame,
    levels: list[int],
    hot_rows: int,
) -> DataFrame:
    """How many distinct products compare with each target, within its bounds.

    A group of copies compares when any key of any copy does, so a group is its set
    of keys, and groups with equal sets and price are counted together.
    """
    per_own = written(
        scoped.select("all_stock", "own", "price_eur", F.explode("keys").alias("key"))
        .groupBy("all_stock", "own", "price_eur")
        .agg(F.array_sort(F.collect_set("key")).alias("keys")),
        "key_sets",
    )
    shelf_unit = ["all_stock", "unit"]
    unit = F.sha2(F.to_json(F.struct("kept")), 256)
    sizes = targets
    for level in levels:

        def cut(table: DataFrame) -> DataFrame:
            return table.withColumns(_at(level)).withColumn("unit", unit)

        sets = cut(per_own).filter(F.size("meet") > 0)
        asking = cut(targets).filter(F.size("meet") > 0)
        columns = ["unit", "meet", "above"]
        pairs = (
            overlapping(
                asking.select(*columns).distinct(), sets.select(*columns).distinct(), "meet"
            )
            .filter(~F.arrays_overlap("a_above", "b_above"))
            .select("a_unit", F.col("b_unit").alias("unit"))
        )
        shelves = sets.groupBy(*shelf_unit, "price_eur").agg(F.count("*").alias("n"))
        scopes = asking.select(F.col("unit").alias("a_unit"), "all_stock", "bound").distinct()
        wanted = scopes.join(pairs, "a_unit")
        counted = as_of(
            _running(shelves, shelf_unit, "n"),
            wanted.select(*shelf_unit, F.col("bound").alias("at")).distinct(),
            shelf_unit,
            F.col("n"),
        ).withColumnsRenamed({"at": "bound", "value": "n"})
        found = (
            wanted.join(counted, [*shelf_unit, "bound"])
            .groupBy("a_unit", "all_stock", "bound")
            .agg(F.sum("n").alias(f"n_{level}"))
        )
        bound = F.col("bound").cast("string")
        ask = F.sha2(F.to_json(F.struct("unit", "all_stock", bound.alias("bound"))), 256)
        asked = cut(sizes).withColumn("ask", ask).drop("kept", "meet", "above")
        per_ask = asked.groupBy("ask", F.col("unit").alias("a_unit"), "all_stock", "bound").agg(
            F.count("*").alias("n_rows")
        )
        lookup = per_ask.join(found, ["a_unit", "all_stock", "bound"]).select(
            "ask", "n_rows", f"n_{level}"
        )
        sizes = attach(asked, lookup, "ask", F.col("request_id"), hot_rows=hot_rows).drop(
            "ask", "unit"
        )
    # The target's own copies were counted where they compare; take them out again.
    asked = sizes.withColumn("group", F.struct("all_stock", "own"))
    n_asked = asked.groupBy("group").agg(F.count("*").alias("n_rows"))
    own = per_own.select(
        F.struct("all_stock", "own").alias("group"),
        F.col("price_eur").alias("own_price"),
        F.col("keys").alias("own_keys"),
    ).join(n_asked, "group")
    return attach(asked, own, "group", F.col("request_id"), hot_rows=hot_rows).select(
        "request_id",
        (
            sum((F.coalesce(f"n_{level}", F.lit(0)) for level in levels), F.lit(0))
            - F.when(
                (F.col("own_price") <= F.col("bound"))
                & F.arrays_overlap("keys.key", "own_keys.key"),
                1,
            ).otherwise(0)
        ).alias("total_matches"),
    )


def fallbacks(
    products: DataFrame,
    targets: DataFrame,
    totals: DataFrame,
    level_kinds: int = LEVEL_KINDS,
) -> tuple[DataFrame, DataFrame]:
    """(reasons, mentions) for targets to which nothing in scope compares.

    Again kinds meet, not products: what is sold out or over the bound is first
    reduced to a few products per kind and price.
    """
    listed = listings(products)
    kind_table = written(kinds(listed, level_kinds), "kinds")
    listed = written(with_levels(listed, kind_table, HOT_ROWS), "listings")
    empty = targets.join(totals.filter("total_matches > 0"), "request_id", "left_anti")
    known = empty.filter("kind IS NOT NULL")
    met = []
    for level, pairs in _tiers(kind_table, known, _levels(kind_table)):
        asked = placed_at(known, level).select(
            "request_id", "own", "bound", "all_stock", F.col("unit").alias("a_unit")
        )
        counted = pairs.filter("counts").select("a_unit", F.col("b_unit").alias("unit"))
        met.append((level, asked.join(counted, "a_unit")))
    sold_out, numbers, nearest = [], [], []
    product = F.struct((-F.col("popularity")).alias("minus_popularity"), "_ord", "product_id", "own")
    for level, pairs in met:
        gone = placed_at(listed.filter("NOT buyable"), level)
        # Own copies never show; two rows per group leave two others on the shelf.
        in_group = Window.partitionBy("unit", "price_eur", "own").orderBy(product)
        on_shelf = Window.partitionBy("unit", "price_eur").orderBy(product)
        leaders = (
            gone.withColumn("nth", F.row_number().over(in_group))
            .filter("nth <= 2")
            .withColumn("nth", F.row_number().over(on_shelf))
            .filter("nth <= 4")
            .select("unit", "price_eur", product.alias("shown"))
        )
        affordable = F.col("price_eur") <= F.col("bound")
        asked = pairs.withColumnRenamed("own", "target_own")
        sold_out.append(
            asked.join(leaders, "unit")
            .filter(affordable & (F.col("shown.own") != F.col("target_own")))
            .select("request_id", "shown")
        )
        per_shelf = gone.groupBy("unit", "price_eur").agg(F.count("*").alias("n"))
        per_own = gone.groupBy("unit", "price_eur", "own").agg((-F.count("*")).alias("n"))
        numbers.append(asked.join(per_shelf, "unit").filter(affordable).select("request_id", "n"))
        numbers.append(
            pairs.join(per_own, ["unit", "own"]).filter(affordable).select("request_id", "n")
        )
        cheap = F.struct("price_eur", "_ord", "product_id", "own")
        for_sale = placed_at(_in_scopes(listed), level)
        by_group = for_sale.groupBy("all_stock", "unit", "price_eur", "own").agg(
            F.min(cheap).alias("cheap")
        )
        in_order = Window.partitionBy("all_stock", "unit", "price_eur").orderBy("cheap")
        first = (
            by_group.withColumn("nth", F.row_number().over(in_order))
            .filter("nth <= 2")
            .select("all_stock", "unit", "cheap")
        )
        nearest.append(
            asked.join(first, ["all_stock", "unit"])
            .filter(
                (F.col("cheap.price_eur") > F.col("bound"))
                & (F.col("cheap.own") != F.col("target_own"))
            )
            .select("request_id", "cheap")
        )
    by_popularity = Window.partitionBy("request_id").orderBy("shown")
    shown = (
        reduce(DataFrame.unionByName, sold_out)
        .distinct()
        .withColumn("rank", F.row_number().over(by_popularity))
        .filter("rank <= 2")
        .select(
            "request_id",
            F.lit("sold_out").alias("role"),
            "rank",
            F.col("shown.product_id").alias("product_id"),
        )
    )
    n_price = (
        reduce(DataFrame.unionByName, numbers)
        .groupBy("request_id")
        .agg(F.sum("n").alias("n_price"))
    )
    closest = (
        reduce(DataFrame.unionByName, nearest)
        .groupBy("request_id")
        .agg(F.min("cheap").alias("cheap"))
    )
    sold = F.coalesce("n_price", F.lit(0)) > 0
    reasons = written(
        empty.join(n_price, "request_id", "left")
        .join(closest, "request_id", "left")
        .select(
            "request_id",
            F.when(F.col("all_stock"), F.lit(0)).otherwise(F.coalesce("n_price", F.lit(0))).alias("n_price"),
            F.when(sold & ~F.col("all_stock"), "out_of_stock_only")
            .when(F.col("cheap").isNotNull() & (F.col("bound") < NO_BOUND), "budget_too_low")
            .otherwise("over_constrained")
            .alias("reason"),
            F.when(F.col("bound") < NO_BOUND, F.col("cheap.product_id")).alias("nearest_id"),
        ),
        "reasons",
    )
    near = reasons.filter("nearest_id IS NOT NULL").select(
        "request_id",
        F.lit("nearest").alias("role"),
        F.lit(1).alias("rank"),
        F.col("nearest_id").alias("product_id"),
    )
    shown = shown.join(
        reasons.filter("reason = 'out_of_stock_only'").select("request_id"), "request_id"
    )
    return reasons.drop("nearest_id"), shown.unionByName(near)
