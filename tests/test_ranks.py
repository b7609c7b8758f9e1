import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import search
from shelfspark.operators.index import with_terms
from shelfspark.operators.ranks import ranked, running
from shelfspark.session import written


@pytest.fixture
def many_partitions(spark):
    """Small tables stay in as many partitions as large ones have."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_running_equals_plain_sums(spark, many_partitions):
    """One key holds most rows and lies in all partitions."""
    chance = random.Random(4)
    rows = [
        (chance.choice("aaaaaabc"), chance.choice([None, *range(40)]), k, chance.choice([None, 1, 2, 3]), chance.choice([None, 7, 8, 9]))
        for k in range(400)
    ]
    df = spark.createDataFrame(rows, "k string, x int, id int, n long, m int")
    got = running(df, ["k"], ["x", "id"], ["n"], ["m"])
    assert got.columns == ["k", "x", "id", "n", "m", "up_to_n", "next_m"]
    order = lambda row: (row[1] is not None, row[1] or 0, row[2])
    expected = []
    for key in "abc":
        group = sorted((r for r in rows if r[0] == key), key=order)
        for at, row in enumerate(group):
            later = [r[4] for r in group[at + 1 :] if r[4] is not None]
            expected.append((*row, sum(r[3] or 0 for r in group[: at + 1]), min(later, default=None)))
    found = got.collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_one_order_of_all_rows(spark, many_partitions):
    df = spark.range(1000).selectExpr("id * 37 % 1000 AS x")
    assert ranked(df, [], ["x"]).filter("rank != x + 1").count() == 0
    assert ranked(df.limit(0), [], ["x"]).count() == 0


MET = (
    "scope_id string, product_id string, duplicate_group_id string, price_eur double, stock_level string, _ord long"
)
ASKED = (
    "question_id long, words array<string>, category string, occasion string, recipient string, max_price double, "
    "min_price double, include_out_of_stock boolean"
)


def plain_counts(met, question):
    _, low, high, every = question
    buyable = [m for m in met if every or m[4] != "out_of_stock"]
    if not met:
        return None
    within = lambda m: (high is None or m[3] <= high) and (low is None or m[3] >= low)
    available = [m for m in buyable if within(m)]
    outside = sorted((m[3], m[5], m[1]) for m in buyable if not within(m))
    units = {m[2] or "id:" + m[1] for m in available}
    nearest = outside[0][2] if outside else None
    return (len(met), len(buyable), sum(map(within, met)), len(available), len(units), nearest)


def counted(spark, met, questions):
    asked = spark.createDataFrame(
        [(k, ["w", scope], None, None, None, high, low, every) for k, (scope, low, high, every) in enumerate(questions)], ASKED
    )
    ids = {tuple(r.words): r.s for r in asked.select("words", search.scope_id().alias("s")).distinct().collect()}
    rows = [(ids.get(("w", scope), scope), *row) for scope, *row in met]
    table = written(spark.createDataFrame(rows, MET), "met")
    found = search.question_counts(table, asked)
    return {
        r.question_id: (
            r.n_attributes, r.n_buyable, r.n_price, r.n_available, r.total_matches, r.nearest.product_id if r.nearest else None
        )
        for r in found.collect()
    }


def test_counts_of_questions_equal_plain_counts(spark, many_partitions):
    """Bounds at, between and beyond prices, crossed bounds, equal bounds, scopes without matches, hot scope."""
    chance = random.Random(6)
    met = []
    for scope, n in (("hot", 300), ("few", 6), ("one", 1)):
        for k in range(n):
            price = float(chance.choice([1, 2, 3, 5, 8, 8, 13]))
            group = chance.choice([None, None, f"g{price}"])
            met.append((scope, f"{scope}{k}", group, price, chance.choice(["low", "out_of_stock", "unknown"]), chance.randint(0, 50)))
    bounds = [None, 0.0, 1.0, 2.5, 3.0, 8.0, 13.0, 20.0]
    questions = [
        (chance.choice(["hot", "hot", "few", "one", "none"]), chance.choice(bounds), chance.choice(bounds), chance.random() < 0.3)
        for _ in range(200)
    ]
    expected = {k: plain_counts([m for m in met if m[0] == q[0]], q) for k, q in enumerate(questions)}
    assert counted(spark, met, questions) == {k: v for k, v in expected.items() if v}


def test_questions_do_not_meet_their_matches(spark):
    """No operator makes more rows than matches, prices and questions, where all questions share a scope."""
    met = [("s", f"p{k}", None, float(k % 50), "low", k) for k in range(500)]
    questions = [("s", None, float(k % 60), False) for k in range(500)]
    asked = spark.createDataFrame(
        [(k, ["w"], None, None, None, high, None, False) for k, (_, _, high, _) in enumerate(questions)], ASKED
    )
    scope = asked.select(search.scope_id().alias("s")).first().s
    table = written(spark.createDataFrame([(scope, *row[1:]) for row in met], MET), "met")
    found = search.question_counts(table, asked)
    found.write.format("noop").mode("overwrite").save()
    assert {r.n_price for r in found.filter("question_id = 10").collect()} == {110}
    rows = most_rows(found)
    assert rows is not None and rows <= 3 * (len(met) + len(questions))


def most_rows(df):
    """The largest number of rows that an operator of an executed plan has made."""
    df.collect()
    most, waiting = None, [df._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
        if "QueryStage" in node.getClass().getSimpleName():
            waiting.append(node.plan())
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            most = max(most or 0, metric.get().value())
        children = node.children()
        waiting += [children.apply(k) for k in range(children.size())]
    return most


def test_deep_pages_leave_the_others_alone(spark, many_partitions):
    rows = [(q, float(k * 7 % 400), 0.0, f"p{k:03d}", 1.0) for q in (1, 2, 3) for k in range(400)]
    collapsed = spark.createDataFrame(rows, "question_id long, first double, second double, product_id string, score double")
    asked = [(1, 0, 5), (2, 300, 20), (3, 390, 20), (4, 0, 5)]
    questions = spark.createDataFrame(asked, "question_id long, offset int, `limit` int")
    got = sorted((r.question_id, r.rank, r.product_id) for r in search.page(collapsed, questions).collect())
    in_order = [p for _, p in sorted((first, p) for q, first, _, p, _ in rows if q == 1)]
    expected = []
    for question, offset, limit in asked[:3]:
        page = list(enumerate(in_order, 1))[offset : offset + limit]
        expected += [(question, rank, p) for rank, p in page]
    assert got == expected


def test_scopes_meet_profiles_not_products(spark):
    """Counts by price through profiles are those of the products, copies of other profiles, nulls and twin ids included."""
    r = random.Random(5)
    rows = []
    for k in range(400):
        name, brand = r.choice(["red lamp", "red chair", "blue lamp"]), r.choice(["Lumo", "Solo"])
        price = r.choice([None, 5.0, 7.0, 9.0])
        group = f"g-{name}-{brand}-{price}" if r.random() < 0.6 else None
        rows.append((
            None if k % 97 == 0 else f"p{k // 2 if k % 31 == 0 else k}", group, name, brand, r.choice(["Home", "Pets", None]), None, ["x"],
            r.choice([[], ["easter"], ["easter", "birthday"]]), r.choice(["her", "anyone", None]), price,
            r.choice(["in_stock", "low", "out_of_stock", "unknown"]), 4.0, k, k,
        ))
    products = spark.createDataFrame(
        rows,
        "product_id string, duplicate_group_id string, name string, brand string, category string, subcategory string, "
        "tags array<string>, occasions array<string>, recipient string, price_eur double, stock_level string, "
        "rating double, reviews_count int, _ord long",
    )
    asked = spark.createDataFrame(
        [(k, r.choice([None, "lamp", "red lamps", "red chair", "zzz"]), r.choice([None, "Home", "Pets"]),
          r.choice([None, "easter"]), r.choice([None, "her"]), None, None, False, None, None) for k in range(120)],
        "request_id long, query string, category string, occasion string, recipient string, max_price double, "
        "min_price double, include_out_of_stock boolean, sort string, limit int",
    )
    questions = written(search.distinct_questions(search.as_search(asked)), "questions")
    facts, pairs = search.scope_profiles(products, questions)
    met = written(search.profile_matches(facts, pairs), "met")
    columns = ["scope_id", "price_eur", *search.COUNTED, *search.FIRST]

    def by_scope(table):
        return sorted(map(repr, table.select(columns).collect()))

    assert by_scope(search.profile_prices(facts, pairs)) == by_scope(search.scope_prices(met))
    plain = search.question_counts(met, questions).drop("nearest")
    assert plain.exceptAll(search.priced_counts(search.profile_prices(facts, pairs, firsts=False), questions)).isEmpty()
    assert 0 < pairs.count() < met.count() / 2


def test_scores_and_budgets_of_profiles(spark):
    """Sums of scores and what lies over a budget, as all matches of a question give them."""
    r = random.Random(8)
    rows = [
        (f"p{k}", None, r.choice(["red lamp", "red chair"]), None, r.choice(["Home", "Pets"]), None, ["x"], ["easter"],
         r.choice(["her", "anyone"]), r.choice([None, 5.0, 7.0, 9.0]), r.choice(["in_stock", "low", "out_of_stock"]),
         r.choice([None, 3.0, 4.5]), r.randrange(50), k) for k in range(200)
    ]
    products = with_terms(spark.createDataFrame(
        rows,
        "product_id string, duplicate_group_id string, name string, brand string, category string, subcategory string, "
        "tags array<string>, occasions array<string>, recipient string, price_eur double, stock_level string, "
        "rating double, reviews_count int, _ord long",
    ))
    asked = spark.createDataFrame(
        [(k, r.choice([None, "lamp", "red lamps"]), r.choice([None, "Home"]), r.choice([None, "easter"]), r.choice([None, "her"]),
          r.choice([None, 6.0, 7.0, 10.0]), r.choice([None, 6.0, 9.0]), r.random() < 0.5, None, None) for k in range(150)],
        "request_id long, query string, category string, occasion string, recipient string, max_price double, "
        "min_price double, include_out_of_stock boolean, sort string, limit int",
    )
    questions = written(search.distinct_questions(search.as_search(asked)), "questions")
    matched = written(search.matches(products, questions), "matches")
    plain = {
        row.question_id: row
        for row in matched.groupBy("question_id").agg(
            F.count("*").alias("n"), F.sum("score").alias("s"), F.max("score").alias("m"), F.min("score").alias("l")
        ).collect()
    }
    sums = search.score_sums(products, questions).collect()
    assert len(sums) == len(plain) > 20
    for row in sums:
        other = plain[row.question_id]
        assert row.sum_score == pytest.approx(other.s, abs=1e-9) and (row.n_products, row.max_score, row.min_score) == (other.n, other.m, other.l)
    beyond = matched.filter("buyable AND NOT in_price").groupBy("question_id").agg(F.count("*").alias("n"), F.min("price_eur").alias("c"))
    found = search.over_budget(products, questions)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, beyond.collect())) != []
