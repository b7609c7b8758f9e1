import random

import pytest

from shelfspark.operators import similar as compare

CATALOGUE = (
    "product_id string, _ord long, category string, subcategory string, tags array<string>, "
    "price_eur double, stock_level string, popularity double, duplicate_group_id string"
)


@pytest.fixture(scope="module")
def rows():
    """Small shop: one tag on half of all products, copies across categories, equal prices."""
    rnd = random.Random(5)
    made = []
    for i in range(120):
        tags = rnd.sample("abcdefghij", rnd.choice([0, 1, 2, 3, 4]))
        if rnd.random() < 0.5:
            tags.append("gift")
        made.append({
            "product_id": f"P{i:03d}", "_ord": i, "category": rnd.choice("XYZ"),
            "subcategory": rnd.choice([None, "s1", "s2", "s3"]), "tags": tags,
            "price_eur": float(rnd.choice([0, 0, 0, 0, 0, 0.5, *range(3, 90, 3), 51, 250])),
            "stock_level": rnd.choice(["in_stock", "low", "unknown", "out_of_stock"]),
            "popularity": float(rnd.choice([0, 1, 2, 4.5])), "duplicate_group_id": None,
        })
    for _ in range(15):
        members = rnd.sample(made, rnd.choice([2, 3]))
        if not any(m["duplicate_group_id"] for m in members):
            first = min(m["product_id"] for m in members)
            for m in members:
                m["duplicate_group_id"], m["price_eur"] = first, members[0]["price_eur"]
    return made


def related(rows, target):
    for r in rows:
        group = r["duplicate_group_id"]
        if r["product_id"] == target["product_id"] or (group and group == target["duplicate_group_id"]):
            continue
        if (r["subcategory"] and r["subcategory"] == target["subcategory"]) or (
            set(r["tags"]) & set(target["tags"])
        ):
            yield r


def likeness(r, t):
    points = 2.0 * bool(r["subcategory"] and r["subcategory"] == t["subcategory"])
    points += r["category"] == t["category"]
    either = set(r["tags"]) | set(t["tags"])
    points += 3 * len(set(r["tags"]) & set(t["tags"])) / len(either) if either else 0
    return points + 0.25 * (1 - abs(r["price_eur"] - t["price_eur"]) / max(r["price_eur"], t["price_eur"], 1))


def expected(rows, target, bound, everything, limit):
    found = [r for r in related(rows, target)
             if (bound is None or r["price_eur"] <= bound) and (everything or r["stock_level"] != "out_of_stock")]
    found.sort(key=lambda r: (-round(likeness(r, target), 9), -r["popularity"], r["product_id"]))
    groups = list(dict.fromkeys(r["duplicate_group_id"] or r["product_id"] for r in found))
    best = {}
    for r in found:
        best.setdefault(r["duplicate_group_id"] or r["product_id"], r["product_id"])
    return [best[g] for g in groups][: max(1, min(limit or 3, 6))], len(groups)


@pytest.mark.parametrize(("level_kinds", "hot_rows"), [(500, 1_000_000), (3, 2)])
def test_equals_brute_force(spark, rows, level_kinds, hot_rows):
    rnd = random.Random(9)
    asked = [(i, rnd.choice(rows)["product_id"], rnd.choice([None, None, 3.0, 15.0, 51.0]),
              rnd.random() < 0.3, rnd.choice([None, 1, 6, 99])) for i in range(250)]
    requests = spark.createDataFrame(
        asked, "request_id long, product_id string, max_price double, include_out_of_stock boolean, `limit` int")
    products = spark.createDataFrame(rows, CATALOGUE)
    ranked, totals, _ = compare.similar(products, compare.as_similar(requests), level_kinds, hot_rows)
    got = {}
    for row in ranked.collect():
        got.setdefault(row.request_id, []).append((row["rank"], row.product_id))
    count = {row.request_id: row.total_matches for row in totals.collect()}
    by_id = {r["product_id"]: r for r in rows}
    for request, product, bound, everything, limit in asked:
        ids, total = expected(rows, by_id[product], bound, everything, limit)
        assert [p for _, p in sorted(got.get(request, []))] == ids, request
        assert count.get(request, 0) == total, request


def test_fallbacks(spark, rows):
    """Targets without a result: what is sold out, what is just too dear."""
    asked = [(i, r["product_id"], 4.0, False, 3) for i, r in enumerate(rows)]
    requests = spark.createDataFrame(
        asked, "request_id long, product_id string, max_price double, include_out_of_stock boolean, `limit` int")
    products = spark.createDataFrame(rows, CATALOGUE)
    _, totals, targets = compare.similar(products, compare.as_similar(requests), 3)
    reasons, shown = compare.fallbacks(products, targets, totals, 3)
    why = {r.request_id: (r.reason, r.n_price) for r in reasons.collect()}
    seen = {}
    for r in shown.collect():
        seen.setdefault((r.request_id, r.role), []).append((r["rank"], r.product_id))
    for request, product, bound, _, _ in asked:
        target = rows[request]
        others = list(related(rows, target))
        cheap = [r for r in others if r["price_eur"] <= bound]
        if any(r["stock_level"] != "out_of_stock" for r in cheap) or not (target["subcategory"] or target["tags"]):
            continue
        dear = [r for r in others if r["price_eur"] > bound and r["stock_level"] != "out_of_stock"]
        reason = "out_of_stock_only" if cheap else "budget_too_low" if dear else "over_constrained"
        assert why[request] == (reason, len(cheap)), request
        top = sorted(cheap, key=lambda r: (-r["popularity"], r["_ord"]))[:2]
        assert [p for _, p in sorted(seen.get((request, "sold_out"), []))] == [r["product_id"] for r in top]
        nearest = sorted(dear, key=lambda r: (r["price_eur"], r["_ord"]))[:1]
        assert [p for _, p in seen.get((request, "nearest"), [])] == [r["product_id"] for r in nearest]
