import random

from pyspark.sql import functions as F
from test_similar import CATALOGUE, expected

from shelfspark.operators import similar as compare


def shop():
    """Every product has copies, in other kinds, too; eight groups or more in most kinds."""
    rnd = random.Random(4)
    made = []
    for group in range(240):
        tags = ["gift", f"t{group % 6}"]
        price = float(3 * (group // 24) + 5)
        for copy in range(3):
            made.append({
                "product_id": f"P{group:03d}{copy}", "_ord": len(made), "category": "XY"[copy % 2],
                "subcategory": f"s{group % 6}", "tags": tags, "price_eur": price,
                "stock_level": rnd.choice(["in_stock", "in_stock", "out_of_stock"]),
                "popularity": float(rnd.randrange(9)), "duplicate_group_id": f"P{group:03d}0",
            })
    return made


def test_copies_too_leave_out_kinds_that_cannot_reach_the_page(spark, monkeypatch):
    rows = shop()
    tables = {}
    written = compare.written

    def noted(df, name):
        tables.setdefault(name, []).append(table := written(df, name))
        return table

    monkeypatch.setattr(compare, "written", noted)
    products = spark.createDataFrame(rows, CATALOGUE)
    asked = [(k, r["product_id"], [None, 14.0][k % 2], k % 3 == 0, 6) for k, r in enumerate(rows[::20])]
    requests = spark.createDataFrame(
        asked, "request_id long, product_id string, max_price double, include_out_of_stock boolean, `limit` int")
    ranked, totals, _ = compare.similar(products, compare.as_similar(requests))
    got, numbers = {}, {r.request_id: r.total_matches for r in totals.collect()}
    for r in ranked.orderBy("rank").collect():
        got.setdefault(r.request_id, []).append(r.product_id)
    by_id = {r["product_id"]: r for r in rows}
    for k, target, bound, everything, limit in asked:
        assert (got.get(k, []), numbers[k]) == expected(rows, by_id[target], bound, everything, limit)
    pairs = sum(t.count() for t in tables["pairs"])
    unbounded = sum(t.filter(F.col("bound") > 20).count() for t in tables["reachable"])
    assert 0 < unbounded < pairs  # a pair in two scopes would be twice as many


def test_a_group_with_several_prices_counts_once_among_the_first(spark):
    """Later copies make no room for themselves among the first ones of a row."""
    shelves = [(float(price), [(-9.0 + own / 8, f"p{own}{price}", f"g{own}") for own in range(price % 4 + 5)]) for price in range(1, 15)]
    near = "array<struct<price_eur: double, best: array<struct<minus_popularity: double, product_id: string, own: string>>>>"
    row = spark.createDataFrame([(shelves, 7.0, 12.0, 3.0)], f"near {near}, price double, bound double, kind_score double")
    got = [r.own for r in row.select(F.inline(compare._near_first())).collect()]
    points = sorted(
        (-(3.0 + 0.25 * (1 - abs(price - 7) / max(price, 7, 1))), popular, name, own)
        for price, best in shelves if price <= 12 for popular, name, own in best
    )
    assert got == list(dict.fromkeys(own for *_, own in points))[: compare.KEEP]
