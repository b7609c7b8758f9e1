import random

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import fixed
from shelfspark.operators import search
from shelfspark.operators.tops import range_tops
from shelfspark.session import written

MET = (
    "scope_id string, product_id string, text_score double, duplicate_group_id string, recipient string, price_eur double, "
    "stock_level string, rating double, reviews_count bigint, popularity double, _ord long, q_occasion string, q_recipient string"
)
ASKED = (
    "question_id long, words array<string>, category string, occasion string, recipient string, max_price double, "
    "min_price double, include_out_of_stock boolean, sort string, `limit` int, offset int"
)


def test_first_rows_of_ranges(spark):
    """Over three levels of blocks, against a sort of each range; ties, nulls, empty and whole ranges."""
    rnd = random.Random(5)
    sizes = {"big": 18000, "small": 70, "one": 1}
    items = [
        (name, None if k % 97 == 5 else float(rnd.randrange(3000)), float(rnd.randrange(40)), k)
        for name, size in sizes.items()
        for k in range(size)
    ]
    asks = []
    for k in range(120):
        low, high = sorted((float(rnd.randrange(3000)), float(rnd.randrange(3000))))
        low, high = rnd.choice([(low, high), (low, None), (float("-inf"), high), (None, None), (high, low), (low, low)])
        asks.append((k, rnd.choice([*sizes, "none"]), low, high, rnd.random() < 0.3, rnd.choice([1, 7, 30])))
    frame = spark.createDataFrame(items, "list_id string, at double, first double, k long")
    frame = frame.select("list_id", "at", F.struct("first", "k").alias("item"))
    asked = spark.createDataFrame(asks, "ask_id long, list_id string, low double, high double, open boolean, n int")
    found: dict[int, list] = {}
    for row in range_tops(frame, asked).collect():
        found.setdefault(row.ask_id, []).append((row.item.first, row.item.k))

    def inside(at, low, high, open_):
        if at is None:
            return low is None
        return (low is None or at >= low) and (high is None or (at < high if open_ else at <= high))

    for ask, name, low, high, open_, n in asks:
        whole = sorted((first, k) for list_id, at, first, k in items if list_id == name and inside(at, low, high, open_))
        got = sorted(found.get(ask, []))
        assert got[:n] == whole[:n]
        assert set(got) <= set(whole) and len(got) == len(set(got))


def test_no_items_or_asks(spark):
    frame = spark.createDataFrame([("a", 1.0, 2)], "list_id string, at double, k long").select("list_id", "at", F.struct("k").alias("item"))
    asked = spark.createDataFrame([(1, "a", None, None, False, 3)], "ask_id long, list_id string, low double, high double, open boolean, n int")
    assert range_tops(frame.limit(0), asked).count() == 0
    assert range_tops(frame, asked.limit(0)).count() == 0
    assert range_tops(frame, asked).count() == 1


def made_up(spark, n_products, n_questions, seed):
    rnd = random.Random(seed)
    met = []
    for k in range(n_products):
        group = f"g{k % 40}" if k % 5 == 0 else None
        # Copies share a price; many prices are round shares of the highest prices asked.
        price = float(k % 40) + 1 if group else rnd.choice([7.0, 12.6, 14.0, 28.0, 29.4, 70.0, round(rnd.uniform(0, 90), 2)])
        rating = rnd.choice([None, 0.0, 3.5, 4.8])
        met.append((
            f"p{k:04d}", float(rnd.randrange(4)), group, price, rnd.choice(["low", "in_stock", "unknown", "out_of_stock"]),
            rating, rnd.choice([None, 5, 200]), (rating or 0.0) * rnd.choice([1.0, 1.3, 0.7]), k,
        ))
    asked = [
        (k, ["w"], None, None, None, rnd.choice([None, 18.0, 20.0, 40.0, 42.0, 100.0, 0.0, round(rnd.uniform(1, 90), 2)]),
         rnd.choice([None, None, 5.0, 14.0, 60.0]), rnd.random() < 0.4, rnd.choice(["relevance", "relevance", "price_asc", "price_desc", "rating", "popularity"]),
         rnd.choice([3, 12]), rnd.choice([0, 0, 9]))
        for k in range(n_questions)
    ]
    questions = written(spark.createDataFrame(asked, ASKED), "questions")
    scope = questions.select(search.scope_id().alias("s")).first().s
    rows = [(scope, p, t, g, None, price, *rest, None, None) for p, t, g, price, *rest in met]
    return written(spark.createDataFrame(rows, MET), "met"), questions


def as_rows(pages):
    return sorted((r.question_id, r.rank, r.product_id, r.score) for r in pages.collect())


@pytest.fixture(scope="module")
def world(spark):
    met, questions = made_up(spark, 1500, 150, 8)
    return met, met.select("popularity"), questions


def test_pages_are_those_of_all_matches(world):
    """Scores, ties, tiers at round shares, copies and stock as when each question sorts its matches."""
    met, products, questions = world
    matched = search.asked_matches(met, products, questions)
    plain = search.page(search.collapse_duplicates(matched.filter("available")), questions)
    got = as_rows(search.top_pages(met, products, questions))
    assert got == as_rows(plain) and len(got) > 500


def test_deep_pages_too(world):
    met, products, questions = world
    deep = questions.filter("question_id < 6").withColumn("offset", F.lit(195)).unionByName(questions.filter("question_id > 145"))
    matched = search.asked_matches(met, products, deep)
    plain = search.page(search.collapse_duplicates(matched.filter("available")), deep)
    assert as_rows(search.top_pages(met, products, deep)) == as_rows(plain)


def test_sold_out_products(world):
    met, _, questions = world
    expected = []
    rows = [r for r in met.collect() if r.stock_level not in fixed.RECOMMENDABLE]
    for q in questions.filter("NOT include_out_of_stock").collect():
        inside = [
            r for r in rows
            if (q.max_price is None or r.price_eur <= q.max_price) and (q.min_price is None or r.price_eur >= q.min_price)
        ]
        inside.sort(key=lambda r: (-r.popularity, r._ord))
        expected += [(q.question_id, k, r.product_id) for k, r in enumerate(inside[:2], 1)]
    got = sorted((r.question_id, r.rank, r.product_id) for r in search.top_sold_out(met, questions).collect())
    assert got == sorted(expected)


def test_tiers_begin_where_the_ratio_does(spark):
    rnd = random.Random(3)
    prices = [(k, round(rnd.uniform(0.01, 5000), rnd.choice([1, 2, 6]))) for k in range(3000)]
    asked = spark.createDataFrame(prices, "question_id long, max_price double").selectExpr(
        "question_id", "array('w') AS words", "CAST(NULL AS STRING) AS category", "CAST(NULL AS STRING) AS occasion",
        "CAST(NULL AS STRING) AS recipient", "max_price", "CAST(NULL AS DOUBLE) AS min_price", "false AS include_out_of_stock",
        "'relevance' AS sort", "5 AS `limit`", "0 AS offset")
    import math

    most = dict(prices)
    for row in search._price_ranges(asked).filter("bonus > 0").collect():
        share = {bonus: low for low, _, bonus in fixed.BUDGET_TIERS}[row.bonus]
        assert row.low / most[row.question_id] >= share > math.nextafter(row.low, 0) / most[row.question_id]
