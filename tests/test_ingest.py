import json

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import cleaning, quality
from shelfspark.plans.build import build_catalogue
from shelfspark.sources.caches import TRANSLATION_FIELDS, read_cache
from shelfspark.sources.exports import read_export
from shelfspark.functions.fields import translation_hash

HEADER = ("product_id,name,category,subcategory,brand,price_eur,stock,rating,reviews_count,recipient,"
          "occasion,tags,color,material,gift_wrap,shipping_days,description")
ROWS = [
    'T-1,Plain Lamp,Home & Garden,Lamps,Lumo,42.00,14,4.6,212,anyone,birthday|christmas,lamp|warm,Black,Ceramic,yes,3,A lamp.',
    'T-2,Dear Lamp,home and garden,,,"€1.234,56",5,9.5,,,,,,,maybe,999,Costly.',
    ',No Id,Home & Garden,,,1,,,,,,,,,,,x',
    'T-4,,Home & Garden,,,1,,,,,,,,,,,x',
    'T-5,No Price,Home & Garden,,,banana,,,,,,,,,,,x',
    ' t-1 ,Again,Home & Garden,,,2,,,,,,,,,,,x',
    'T-5,Second Try,HOME & GARDEN,,,3,-5,"4,6",,,,,,,,,"First line.\nSecond ""line""."',
    'T-8,Short Row,Home & Garden,,,30.00,5',
    'T-9,Long Row,Home & Garden,Lamps,B,30.00,N/A,4.5,10,anyone,birthday,tag,Red,Wood,yes,3,Ok.,SPILL,MORE',
]


@pytest.fixture(scope="module")
def export(tmp_path_factory):
    path = tmp_path_factory.mktemp("export") / "products.csv"
    path.write_text("﻿" + "\r\n".join([HEADER, *ROWS]) + "\r\n", encoding="utf-8", newline="")
    return str(path)


@pytest.fixture(scope="module")
def classified(spark, export):
    return cleaning.classify(cleaning.clean_rows(read_export(spark, export).rows)).cache()


def test_a_large_export_is_several_files(spark, tmp_path, monkeypatch):
    from checks import queries

    monkeypatch.setattr(queries, "FILE_ROWS", 7)
    rows = [tuple(f'{name} {k}, "so"\nagain' for name in cleaning.RAW_COLUMNS) for k in range(50)]
    made = spark.createDataFrame(rows, ", ".join(f"{name} string" for name in cleaning.RAW_COLUMNS)).coalesce(1)
    queries._write_csv(made, str(tmp_path / "export"))
    assert len(list((tmp_path / "export").glob("*.csv"))) == 8
    read = read_export(spark, str(tmp_path / "export")).rows.orderBy("_ord").select(*cleaning.RAW_COLUMNS)
    assert [tuple(r) for r in read.collect()] == rows


def test_quarantine(classified):
    summary = quality.load_summary(classified).first().asDict()
    assert summary == {"rows_read": 9, "products_loaded": 5, "quarantined_total": 4,
                       "missing_product_id": 1, "duplicate_product_id": 1, "missing_name": 1,
                       "unparseable_price": 1}


def test_first_valid_row_keeps_the_id(classified):
    names = {r.product_id: r.name for r in cleaning.accepted(classified).collect()}
    assert names["T-1"] == "Plain Lamp" and names["T-5"] == "Second Try"


def test_hot_ids_are_spread(spark, export):
    rows = cleaning.clean_rows(read_export(spark, export).rows)
    salted = cleaning.classify(rows, hot_rows=1)
    assert quality.load_summary(salted).first().quarantined_total == 4


def test_fields_and_issues(classified):
    rows = {r.product_id: r for r in cleaning.accepted(classified).collect()}
    assert rows["T-2"].price_eur == 1234.56 and rows["T-2"].rating is None
    assert rows["T-5"].stock == 0 and rows["T-5"].stock_level == "out_of_stock" and rows["T-5"].rating == 4.6
    assert rows["T-5"].description == 'First line. Second "line".'
    assert rows["T-9"].stock is None and rows["T-9"].stock_level == "unknown"
    assert rows["T-9"].description == "Ok." and rows["T-8"].price_eur == 30.0
    counts = {r.issue: r.n_rows for r in quality.issue_counts(cleaning.accepted(classified)).collect()}
    assert counts["__row__:ragged_row"] == 2 and counts["stock:negative_clamped"] == 1
    assert counts["gift_wrap:unrecognised"] == 1 and counts["shipping_days:implausible"] == 1
    details = {(i.field, i.detail) for r in rows.values() for i in r.issues}
    assert {("__row__", "extra columns"), ("__row__", "missing columns")} <= details


def test_missing_required_column(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("product_id,name,category\nX,Y,Z\n")
    with pytest.raises(ValueError, match="missing required column"):
        read_export(spark, str(tmp_path / "bad.csv"))


def test_encodings(spark, tmp_path):
    head, row = "product_id,name,category,price_eur\n", "A{},Café {},Home,1\n"
    (tmp_path / "a.csv").write_bytes((head + row.format(1, "€")).encode("utf-8"))
    (tmp_path / "b.csv").write_bytes((head + row.format(2, "€")).encode("cp1252"))
    (tmp_path / "c.csv").write_bytes((head + row.format(3, "\x81")).encode("latin-1"))
    export = read_export(spark, str(tmp_path))
    assert sorted(r.name for r in export.rows.collect()) == ["Café \x81", "Café €", "Café €"]
    assert sorted(export.encodings.values()) == ["ISO-8859-1", "UTF-8", "windows-1252"]


def test_cache_and_build(spark, export, tmp_path):
    one = spark.range(1).select(translation_hash(F.lit("Plain Lamp"), F.lit("A lamp.")).alias("h"))
    cache = {"T-1": {"hash": one.first().h, "name_es": "Lámpara", "description_es": ""},
             "T-2": {"hash": "old", "name_es": "Viejo"}}
    (tmp_path / "es.json").write_text(json.dumps(cache), encoding="utf-8")
    tables = build_catalogue(spark, export, str(tmp_path / "out"),
                             translations_path=str(tmp_path / "es.json"))
    rows = {r.product_id: r for r in tables["products"].collect()}
    assert rows["T-1"].name_es == "Lámpara" and rows["T-1"].description_es is None
    assert rows["T-2"].name_es is None and rows["T-2"].category == "Home & Garden"
    assert "lampara" in rows["T-1"].name_tokens and "hogar" not in rows["T-1"].tokens
    assert tables["quarantine"].count() == 4


def test_missing_and_broken_caches_are_empty(spark, tmp_path):
    assert read_cache(spark, str(tmp_path / "none.json"), TRANSLATION_FIELDS).count() == 0
    (tmp_path / "broken.json").write_text("{not json")
    assert read_cache(spark, str(tmp_path / "broken.json"), TRANSLATION_FIELDS).count() == 0


def test_the_last_of_repeated_entries_counts(spark, tmp_path):
    first, second = tmp_path / "a.json", tmp_path / "b.json"
    entry = lambda h: {"hash": h, "name_es": h, "description_es": None}
    first.write_text(json.dumps({"P1": entry("new"), "P2": entry("kept")}))
    second.write_text(json.dumps({"P1": entry("old")}))
    got = {r.product_id: r.hash for r in read_cache(spark, str(tmp_path / "*.json"), TRANSLATION_FIELDS).collect()}
    assert got == {"P1": "old", "P2": "kept"}
    lines = "\n".join(json.dumps({"product_id": p, **entry(h)}) for p, h in [("P1", "x"), ("P2", "y"), ("P1", "z")])
    (tmp_path / "lines.txt").write_text(lines)
    rows = read_cache(spark, str(tmp_path / "lines.txt"), TRANSLATION_FIELDS, one_entry_per_line=True).collect()
    assert sorted((r.product_id, r.hash) for r in rows) == [("P1", "z"), ("P2", "y")]


def test_cleaning_is_spread_and_done_once(spark):
    raw = spark.createDataFrame(
        [(k, None, *[str(k)] * len(cleaning.RAW_COLUMNS)) for k in range(64)],
        "_ord long, _ragged string, " + ", ".join(f"{name} string" for name in cleaning.RAW_COLUMNS),
    ).coalesce(1)
    tasks = cleaning.clean_rows(raw).select(F.spark_partition_id().alias("task")).distinct()
    assert tasks.count() > 1
    classified = cleaning.classify(cleaning.clean_rows(raw))
    assert classified.filter("reason IS NULL").count() == 64
    assert all("/cleaned-" in file for file in classified.inputFiles() if "/lookup-" not in file)
