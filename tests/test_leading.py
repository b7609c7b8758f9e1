import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import search
from shelfspark.session import written

FACTS = (
    "product_id string, duplicate_group_id string, price_eur double, stock_level string, rating double, "
    "reviews_count bigint, popularity double, _ord long, profile_id string"
)
PAIRS = "scope_id string, profile_id string, text_score double, q_occasion string, q_recipient string"
ASKED = (
    "question_id long, words array<string>, category string, occasion string, recipient string, max_price double, "
    "min_price double, include_out_of_stock boolean, sort string, `limit` int, offset int"
)
SORTS = ["relevance", "relevance", "price_asc", "price_desc", "rating", "popularity"]


@pytest.fixture(scope="module")
def shop(spark):
    """Many products of few profiles; copies in several profiles and stocks, ties, ids that come twice, no price."""
    rnd = random.Random(11)
    facts = []
    for k in range(4000):
        group = f"g{k % 150}" if k % 4 == 0 else None
        price = float(k % 150 // 8) if group else rnd.choice([None, *map(float, range(12)), *map(float, range(12))])
        facts.append((
            f"p{k // 2 if k % 50 < 2 else k:04d}", group, price, rnd.choice(["low", "in_stock", "unknown", "out_of_stock", None]),
            rnd.choice([None, 0.0, 3.5, 4.8]), rnd.choice([None, 5, 200]), float(rnd.randrange(300)), k, f"f{rnd.randrange(9)}",
        ))
    asked = [
        (k, [rnd.choice("uvw")], None, None, rnd.choice([None, "her"]), rnd.choice([None, None, 8.0, 10.0, 10.5, 14.0]),
         rnd.choice([None, None, 4.0]), rnd.random() < 0.4, rnd.choice(SORTS), rnd.choice([3, 12]), rnd.choice([0, 0, 9]))
        for k in range(120)
    ]
    questions = written(spark.createDataFrame(asked, ASKED), "questions")
    scopes = questions.select(search.scope_id().alias("s"), "recipient").distinct().collect()
    pairs = [(r.s, f"f{p}", float(rnd.randrange(4)), None, r.recipient) for r in scopes for p in range(9) if rnd.random() < 0.7]
    facts = written(spark.createDataFrame(facts, FACTS), "facts")
    return facts, written(spark.createDataFrame(pairs, PAIRS), "pairs"), questions


def all_pages(facts, pairs, questions):
    matched = search.asked_matches(search.profile_matches(facts, pairs), facts, questions).filter("available")
    return search.page(search.collapse_duplicates(matched), questions)


def as_rows(pages):
    return sorted((r.question_id, r.rank, r.product_id, r.score) for r in pages.collect())


def test_pages_are_those_of_all_matches(shop):
    facts, pairs, questions = shop
    got = as_rows(search.profile_pages(facts, pairs, facts, questions))
    assert got == as_rows(all_pages(facts, pairs, questions)) and len(got) > 500


def test_deep_pages_too(shop):
    facts, pairs, questions = shop
    some = questions.filter("question_id < 20").withColumn("offset", F.when(F.col("question_id") < 5, 195).otherwise(0))
    assert as_rows(search.profile_pages(facts, pairs, facts, some)) == as_rows(all_pages(facts, pairs, some))


def test_sold_out_products(shop):
    facts, pairs, questions = shop
    whole = search.top_sold_out(search.profile_matches(facts, pairs), questions)
    got = search.profile_sold_out(facts, pairs, questions)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and got.count() > 50


def test_lists_have_few_of_their_products(shop):
    facts, pairs, questions = shop
    few = questions.filter("sort = 'popularity'").withColumns({"limit": F.lit(3), "offset": F.lit(0)})
    asked = search._shallow_ranges(few)
    item = search._most_popular()
    lists = asked.withColumn("family", F.col("sort"))
    rows = search._leading(facts, pairs, lists, ["sort", "every_stock", "bonus"], item, item, copies=True)
    whole = search.profile_matches(facts, pairs).join(lists.select("scope_id", "list_id").distinct(), "scope_id")
    assert 0 < 3 * rows.count() < whole.count()


def test_first_copies_stand_for_all(shop):
    """As many listed and as many left when collapsed, the same best members, from fewer rows."""
    facts, pairs, questions = shop
    relevant = questions.filter("sort = 'relevance'")

    def counted(of):
        matched = search.asked_matches(search.profile_matches(of, pairs), facts, relevant).filter("available")
        best = search.collapse_duplicates(matched).select("question_id", "first", "second", "product_id")
        return sorted(map(tuple, matched.groupBy("question_id").agg(F.sum("n_rows")).collect())), best

    copies = search.first_copies(facts)
    (listed, best), (all_listed, all_best) = counted(copies), counted(facts.withColumn("n_rows", F.lit(1)))
    assert listed == all_listed and sorted(map(tuple, best.collect())) == sorted(map(tuple, all_best.collect()))
    assert copies.count() < facts.count() and copies.agg(F.sum("n_rows")).first()[0] == facts.count()
