"""What joins of the search send to all tasks: tables of few rows, never tables that are small as files alone."""

import random

import pytest
from pyspark.sql import functions as F

from checks import queries
from shelfspark.operators import search
from shelfspark.operators.skew import attach, beside, unsent
from shelfspark.session import written
from tests.test_leading import all_pages, as_rows, shop  # noqa: F401


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_table_is_sent_by_its_rows(spark):
    """A thousand equal rows are a file of a few hundred bytes."""
    many = written(spark.range(1000).select((F.col("id") % 3).alias("k"), F.lit("x" * 64).alias("text")), "many")
    other = written(spark.range(10).withColumnRenamed("id", "k"), "other")
    few, lots = other.join(beside(many, few_rows=1000), "k"), other.join(beside(many, few_rows=999), "k")
    assert "BroadcastHashJoin" in plan_of(few) and "BroadcastHashJoin" not in plan_of(lots)
    assert few.count() == lots.count() == 1000


def test_pairs_and_counts_are_not_sent(shop):  # noqa: F811
    facts, pairs, questions = shop
    prices = search.profile_prices(facts, pairs)
    assert "BroadcastHashJoin" not in plan_of(prices)
    whole = search.scope_prices(search.profile_matches(facts, pairs))
    columns = ["scope_id", "price_eur", *search.COUNTED, *search.FIRST]
    assert {tuple(r) for r in prices.select(columns).collect()} == {tuple(r) for r in whole.select(columns).collect()}


def test_pages_where_nothing_is_sent(shop, monkeypatch):  # noqa: F811
    facts, pairs, questions = shop
    monkeypatch.setattr(search, "beside", lambda table, n_rows=None: unsent(table))
    pages = search.profile_pages(facts, pairs, facts, questions)
    assert "BroadcastHashJoin" not in plan_of(pages)
    assert as_rows(pages) == as_rows(all_pages(facts, pairs, questions))


def test_attach_to_a_lookup_of_many_rows(spark):
    rows = written(spark.range(40).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("k")), "rows")
    lookup = spark.range(5).select(F.col("id").alias("k"), F.lit(9).alias("n_rows"), F.array("id", "id").alias("all"))
    sent = attach(rows, lookup, "k", F.col("id"))
    apart = attach(rows, lookup, "k", F.col("id"), few_rows=4)
    assert "BroadcastHashJoin" in plan_of(sent) and "BroadcastHashJoin" not in plan_of(apart)
    assert sorted(map(str, sent.collect())) == sorted(map(str, apart.collect())) and apart.count() == 40


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Parts of few names, customers who ask for them, and what they bought."""
    rnd = random.Random(3)
    folder = str(tmp_path_factory.mktemp("tables"))

    def store(name, rows, columns):
        spark.createDataFrame(rows, columns).write.parquet(f"{folder}/{name}.parquet")

    parts = [
        (k, f"{rnd.choice(['red', 'old', 'hot'])} {rnd.choice(['ring', 'bolt', 'plate'])}", f"Brand#{rnd.randrange(3)}",
         rnd.choice(["LARGE", "SMALL"]), rnd.randrange(50), 900.0 + rnd.randrange(80))
        for k in range(300)
    ]
    store("part", parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    customers = [(k, rnd.choice(["HOUSEHOLD", "MACHINERY", "FURNITURE"])) for k in range(400)]
    store("customer", customers, "c_custkey long, c_mktsegment string")
    orders = [(k, rnd.randrange(400), rnd.choice(["2-HIGH", "5-LOW"])) for k in range(500)]
    store("orders", orders, "o_orderkey long, o_custkey long, o_orderpriority string")
    lines = [(rnd.randrange(500), rnd.randrange(300), float(rnd.randrange(1, 50))) for _ in range(1500)]
    store("lineitem", lines, "l_orderkey long, l_partkey long, l_quantity double")
    return folder


@pytest.mark.parametrize("name", ["w7_envelope", "a11_empty_reasons"])
def test_whole_answers_where_nothing_is_sent(spark, tables, monkeypatch, name):
    """The requests aren't sent either, though their files are small; rows are the same."""
    expected = queries.QUERIES[name](spark, tables)
    assert "BroadcastHashJoin" not in plan_of(expected)
    rows = sorted(map(str, expected.collect()))
    monkeypatch.setattr(search, "beside", lambda table, n_rows=None: unsent(table))
    assert sorted(map(str, queries.QUERIES[name](spark, tables).collect())) == rows and len(rows) > 20


def test_no_sold_out_questions_run_no_steps(shop, monkeypatch):  # noqa: F811
    """The same columns as with some, without a product being placed."""
    facts, pairs, questions = shop
    some = search.profile_sold_out(facts, pairs, questions)
    monkeypatch.setattr(search, "_leading", None)
    none = search.profile_sold_out(facts, pairs, questions.filter("question_id < 0"))
    assert none.count() == 0 and none.dtypes == some.dtypes
