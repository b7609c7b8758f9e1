import json
import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators.cleaning import classify
from shelfspark.operators import index, search
from shelfspark.operators.index import term_index, with_terms
from shelfspark.plans import answer
from shelfspark.session import new_path, written
from shelfspark.sources.tables import read_tables, write_tables
from shelfspark.streaming.intake import clean_arrivals

ASKED = (
    "request_id long, query string, category string, occasion string, recipient string, "
    "max_price double, min_price double, include_out_of_stock boolean, sort string, `limit` int"
)


@pytest.fixture(scope="module")
def products(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(80):
        noun = rnd.choice(["Lamp", "Candle", "Knife", "Ring"])
        rows.append((
            f"P{i:02d}", i, f"{rnd.choice(['Red', 'Glass', 'Old'])} {noun}", rnd.choice(["Home & Co", "Kids"]),
            {"Knife": "Knives"}.get(noun, noun + "s"), [noun.lower(), rnd.choice(["gift", "new"])], float(rnd.choice([10, 20, 35, 80])),
            rnd.choice([None, 0, 3, 9]), rnd.choice([None, 3.5, 4.8]), rnd.choice([None, 5, 200]),
            rnd.sample(["birthday", "easter"], rnd.choice([0, 1, 2])), rnd.choice(["anyone", "her", None]),
        ))
    df = spark.createDataFrame(rows, (
        "product_id string, _ord long, name string, category string, subcategory string, tags array<string>, "
        "price_eur double, stock bigint, rating double, reviews_count bigint, occasions array<string>, recipient string"))
    level = (F.when(F.col("stock").isNull(), "unknown").when(F.col("stock") == 0, "out_of_stock")
             .when(F.col("stock") <= 5, "low").otherwise("in_stock"))
    text = F.lit(None).cast("string")
    return with_terms(df.withColumns({
        "category_key": F.lower("category"), "stock_level": level, "brand": text, "description": text,
        "pitch": F.concat(F.lit("A very "), F.repeat(F.lit("fine "), F.lit(30)), "name"),
        "shipping_days": F.lit(3).cast("bigint"), "gift_wrap": F.lit(True),
        "duplicate_group_id": F.when(F.col("_ord").isin(3, 7, 11), F.lit("P03")),
        "color": text, "material": text, "also_in_categories": F.array().cast("array<string>"),
    })).cache()


def responses(df):
    return {r.request_id: json.loads(r.response) for r in df.collect()}


def test_operations_with_a_made_and_a_stored_index(spark, products):
    asked = [
        (1, "old lamps", None, None, None, None, None, False, None, None),
        (2, "old lamps", None, None, None, None, None, False, None, None),
        (3, "zzz", None, None, None, None, None, False, None, None),
        (4, None, "home and co", "birthday", "her", 50.0, None, False, "price_asc", 99),
        (5, None, "kids", None, None, 1.0, None, False, None, None),
        (6, None, "Sorcery", None, None, None, None, False, None, None),
        (7, "cuchillos", None, None, None, None, None, True, "rating", 2),
        (8, "old lamps", None, None, None, None, None, False, "cheapest", None),
    ]
    requests = spark.createDataFrame(asked, ASKED)
    got = responses(answer.search_products(products, requests))
    stored = responses(answer.search_products(products, requests, index=written(term_index(products), "index")))
    assert got == stored and len(got) == 8
    assert got[1]["products"] == got[2]["products"] and len(got[1]["products"]) == 5
    assert all(p["stock_level"] != "out_of_stock" for p in got[1]["products"])
    assert got[1]["products"][0]["name"] == "Old Lamp"
    assert got[3]["reason"] == "no_query_match" and got[3]["products"] == []
    assert got[4]["filters_applied"]["category"] == "Home & Co" and got[4]["filters_applied"]["limit"] == 12
    prices = [p["price_eur"] for p in got[4]["products"]]
    assert prices == sorted(prices) and max(prices) <= 50
    assert got[5]["reason"] == "budget_too_low" and got[5]["suggestions"]["relax"][0] == "raise max_price_eur to 10"
    assert got[6]["status"] == "unknown_category" and len(got[6]["available_categories"]) == 2
    assert got[7]["status"] == "ok" and got[7]["returned"] == 2
    assert all("Knife" in p["name"] for p in got[7]["products"])
    assert got[8]["status"] == "invalid_parameter" and got[8]["products"] == []
    assert got[8]["message"].endswith("Input should be 'relevance', 'price_asc', 'price_desc' or 'rating'")
    assert got[8]["did_you_mean"] == ["relevance", "price_asc", "price_desc", "rating"]


def files_read(df):
    """How many files the scans of a table read, and whether a scan has a filter on partitions."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.getClass().getSimpleName() in ("WholeStageCodegenExec", "ColumnarToRowExec", "InputAdapter", "ProjectExec", "FilterExec"):
        plan = plan.children().apply(0)
    pruned = "PartitionFilters: [" in plan.verboseStringWithOperatorId() and "bucket" in plan.toString().split("PartitionFilters")[1]
    return plan.metrics().apply("numFiles").value(), pruned


def test_entries_are_made_once(spark, products):
    bare = products.drop("tokens", "name_tokens", "tag_tokens", "stem_tokens", "name_stems", "tag_stems")
    plan = term_index(bare)._jdf.queryExecution().optimizedPlan().toString()
    # Two lookups for tokens and two for stems, in the generator and nowhere else.
    assert plan.count("array_contains") == 4 and "size(" not in plan
    assert term_index(bare).exceptAll(term_index(products)).isEmpty() and term_index(bare).count() == term_index(products).count()


def test_searches_read_the_buckets_of_their_terms(spark, products):
    folder = new_path(spark, "catalogue")
    made = term_index(products)
    write_tables({"term_index": index.bucketed(made)}, folder)
    stored = read_tables(spark, folder, "term_index")["term_index"]
    assert stored.drop("bucket").exceptAll(made).isEmpty() and stored.count() == made.count()
    terms = made.select("term").distinct().orderBy("term")
    every, _ = files_read(stored)
    few, pruned = files_read(index.asked_entries(stored, terms.limit(2)))
    most, _ = files_read(index.asked_entries(stored, terms))
    assert pruned and 1 <= few <= 4 < most <= every
    assert index.asked_entries(stored, terms.limit(0)).count() == 0
    asked = spark.createDataFrame(
        [(1, "old lamps", None, None, None, None, None, False, None, None), (2, "gift", None, None, None, 30.0, 5.0, True, None, None)], ASKED
    )
    questions = search.distinct_questions(search.as_search(asked))
    whole = search.scope_matches(products, questions)
    assert search.scope_matches(products, questions, stored).exceptAll(whole).isEmpty()
    assert responses(answer.search_products(products, asked, index=stored)) == responses(answer.search_products(products, asked))


def test_budget_is_kept_and_announced(spark, products):
    requests = spark.createDataFrame([(1, "gift", None, None, None, None, None, True, None, 12)], ASKED)
    whole = responses(answer.search_products(products, requests))[1]
    small = responses(answer.search_products(products, requests, max_bytes=1500))[1]
    assert len(json.dumps(whole).encode()) > 1500
    assert small["total_matches"] == whole["total_matches"] and small["returned"] == len(small["products"]) < 12
    assert "trimmed" in small["notes"][-1] and "rating" not in str(small["products"][0].get("reviews_count"))
    assert all(len(p["pitch"]) <= 90 for p in small["products"])


def test_stream_cleans_files_as_the_batch_reader_does(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    head = "product_id,name,category,price_eur\n"
    (folder / "a.csv").write_text(head + ' a-1 ,Lamp,Home,"1,50"\nA-1,Lamp again,Home,2\nA-2,Ring,Home,3,spill\n')
    run = lambda: clean_arrivals(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    run()
    (folder / "b.csv").write_bytes((head + "B-1,Café,Home,4\n").encode("cp1252"))
    run()
    rows = classify(spark.read.parquet(str(tmp_path / "out")))
    got = sorted((r.product_id, r.name, r.price_eur, r.reason) for r in rows.collect())
    assert got == [
        ("A-1", "Lamp", 1.5, None), ("A-1", "Lamp again", 2.0, "duplicate_product_id"), ("A-2", "Ring", 3.0, None), ("B-1", "Café", 4.0, None),
    ]
    assert any("ragged_row" in str(r.issues) for r in rows.collect() if r.product_id == "A-2")
