"""The registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.views import table
from shelfspark.functions import fields, fixed, numbers, spanish, text
from shelfspark.operators import categories, cleaning, duplicates, enrich, index, nearest, quality
from shelfspark.operators import responses as respond
from shelfspark.operators import search as find
from shelfspark.operators import similar as compare
from shelfspark.operators.skew import attach, spread, unsent
from shelfspark.plans import answer
from shelfspark.plans.build import build_products
from shelfspark.session import new_path, written
from shelfspark.sources.caches import TRANSLATION_FIELDS, read_cache
from shelfspark.sources.exports import file_facts, read_export
from shelfspark.sources.tables import read_tables, write_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def joined(values) -> F.Column:
    return F.array_join(values, ",")


def as_set(values) -> F.Column:
    return F.array_join(F.array_sort(values), ",")


# --- Sources and sinks -------------------------------------------------------------


def _csv_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty export in file form: accents, quotes, separators and a line break."""
    return views.dirty_export(spark, sf_dir).select(
        "_ord",
        *[
            F.concat("description", F.lit(' "so they say",\nabout 3 EUR')).alias(name)
            if name == "description"
            else F.col(name)
            for name in cleaning.RAW_COLUMNS
        ],
    )


#: Rows of a file of an export.
FILE_ROWS = 100_000


def _write_csv(rows: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """Write rows as an export would come, a large one in several files; trimming nothing."""
    rows.write.mode("append").options(
        maxRecordsPerFile=FILE_ROWS, header=True, escape='"', encoding=encoding, emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


@query
def s1_csv_scan(spark, sf_dir):
    path = new_path(spark, "export")
    _write_csv(_csv_columns(spark, sf_dir).drop("_ord"), path)
    rows = read_export(spark, path).rows
    return rows.select(
        *[F.coalesce(name, F.lit("")).alias(name) for name in cleaning.RAW_COLUMNS],
        F.col("_ragged").isNotNull().alias("ragged"),
    )


@query
def s2_encoding_fallback(spark, sf_dir):
    path = new_path(spark, "encodings")
    rows = _csv_columns(spark, sf_dir).withColumn("recipient", F.lit("Ñandú é"))
    odd = F.when(F.col("_ord") % 3 == 2, "\u0081odd")
    rows = rows.withColumn("brand", F.coalesce(odd, "brand")).drop("description", "name")
    # Windows-1252 keeps its euro sign in a byte that Latin-1 reads as U+0080.
    euro = {0: "EUR", 1: "\u0080", 2: "EUR"}
    for rest, encoding in enumerate(["UTF-8", "ISO-8859-1", "ISO-8859-1"]):
        part = rows.filter(F.col("_ord") % 3 == rest).drop("_ord").withColumn(
            "name", F.concat(F.lit("Café "), F.col("subcategory"))
        )
        price = F.replace("price_eur", F.lit("€"), F.lit(euro[rest]))
        _write_csv(part.withColumn("price_eur", price), path, encoding)
    facts = file_facts(spark, path).select("file", "encoding")
    rows = read_export(spark, path).rows
    return (
        rows.withColumn("file", F.col("_ord.file"))
        .join(F.broadcast(facts), "file")  # one row per file
        .select(F.coalesce("product_id", F.lit("")).alias("product_id"), "name", "recipient",
                "price_eur", "encoding")
    )


@query
def s3_header_names(spark, sf_dir):
    path = new_path(spark, "headers")
    rows = _csv_columns(spark, sf_dir).select(
        F.col("product_id").alias(" Product ID"),
        F.col("name").alias("NAME"),
        F.col("category").alias("category "),
        F.col("price_eur").alias("Price-EUR"),
        F.col("shipping_days").alias("Shipping  days"),
    )
    _write_csv(rows, path)
    return read_export(spark, path).rows.select(
        *[F.coalesce(n, F.lit("")).alias(n) for n in
          ("product_id", "name", "category", "price_eur", "shipping_days")]
    )


@query
def s4_unknown_columns(spark, sf_dir):
    path = new_path(spark, "columns")
    rows = _csv_columns(spark, sf_dir).select(
        "product_id", "name", "category", "price_eur",
        F.col("stock").alias("Warehouse"), F.col("brand").alias("EAN code"),
    )
    _write_csv(rows, path)
    export = read_export(spark, path)
    return export.rows.groupBy("category").agg(
        F.count("*").alias("n_rows"),
        F.first(F.lit(",".join(export.unknown_columns))).alias("unknown_columns"),
    ).withColumn("category", F.coalesce("category", F.lit("")))


@query
def s5_ragged_rows(spark, sf_dir):
    path = new_path(spark, "ragged")
    line = F.concat_ws(
        ",", F.col("p_partkey").cast("string"), "p_name", "p_type", F.lit('"1,5"'),
        F.when(F.col("p_partkey") % 5 != 1, F.col("p_brand")),
        F.when(F.col("p_partkey") % 5 == 2, F.lit('spill,"a,b"')),
    )
    lines = table(spark, sf_dir, "part").select(line.alias("value"))
    lines.mapInPandas(_add_header, "value string").write.text(path)
    return read_export(spark, path, multi_line=False).rows.select(
        "product_id", "name", "price_eur", "brand", F.col("_ragged").alias("ragged")
    )


def _add_header(batches):
    """Every written file starts with its own header line."""
    import pandas as pd

    first = True
    for batch in batches:
        if first:
            yield pd.DataFrame({"value": ["product_id,name,category,price_eur,brand"]})
            first = False
        yield batch


def _translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations of all products; every fifth is of an older text."""
    name, description = F.col("name"), F.col("description")
    old = F.when(F.col("_ord") % 5 == 0, F.lit("old ")).otherwise("")
    return views.product_table(spark, sf_dir).select(
        "product_id",
        text_hash(F.concat(old, name), description).alias("hash"),
        F.concat(F.lit("Artículo "), name).alias("name_es"),
        F.when(F.col("_ord") % 7 != 0, F.concat(F.lit("Un <i>artículo</i>: "), description)).alias(
            "description_es"
        ),
        "_ord",
    )


def text_hash(name, description):
    return F.substring(F.sha2(F.concat_ws("\n", name, description), 256), 1, 16)


def _written_cache(spark: SparkSession, entries: DataFrame, names: list[str]) -> str:
    """Cache files of one JSON object each, for 1000 products or fewer."""
    path = new_path(spark, "cache")
    entry = F.struct("hash", *names)
    entries.groupBy(F.floor(F.col("_ord") / 1000).alias("file")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("product_id", entry)))).alias("value")
    ).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


@query
def s6_json_cache(spark, sf_dir):
    entries = _translations(spark, sf_dir)
    path = _written_cache(spark, entries, TRANSLATION_FIELDS)
    return read_cache(spark, path, TRANSLATION_FIELDS)


@query
def s7_table_sink(spark, sf_dir):
    products = build_products(_classified(spark, sf_dir)).drop("issues")
    folder = new_path(spark, "catalogue")
    write_tables({"products": products}, folder)
    stored = read_tables(spark, folder, "products")["products"]
    write_tables({"term_index": index.term_index(stored)}, folder)
    tables = read_tables(spark, folder, "products", "term_index")
    per_product = tables["term_index"].groupBy("product_id").agg(F.count("*").alias("n_terms"))
    return (
        tables["products"]
        .join(per_product, "product_id")
        .groupBy("category")
        .agg(F.count("*").alias("n_products"), F.sum("n_terms").alias("n_terms"))
    )


# --- Scalar cleaning ------------------------------------------------------------------


@query
def f1_clean_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", text.clean_text(F.col("html")).alias("text")
    )


@query
def f2_truncate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", text.clean_text(F.col("text")).alias("text")
    )
    return docs.select(
        "doc_id",
        text.truncate(F.col("text"), fixed.MAX_DESCRIPTION_CHARS).alias("d"),
        text.truncate(F.col("text"), fixed.MAX_PITCH_CHARS).alias("p"),
    ).select(
        "doc_id",
        F.col("d.text").alias("description"), F.col("d.cut").alias("description_cut"),
        F.col("p.text").alias("pitch"), F.col("p.cut").alias("pitch_cut"),
    )


@query
def f3_slugify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.slugify(F.col("text")).alias("slug")
    )


@query
def f4_product_id(spark, sf_dir):
    return views.dirty_export(spark, sf_dir).select(
        "_ord", text.product_id(text.clean_text(F.col("product_id"))).alias("product_id")
    )


@query
def f5_parse_money(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", f"{views.MONEY_TEXT} AS raw"
    )
    return lines.withColumn("amount", numbers.parse_money(text.clean_text(F.col("raw"))))


@query
def f6_parse_int(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", f"{views.INT_TEXT} AS raw"
    )
    return lines.withColumn("number", numbers.parse_int(text.clean_text(F.col("raw"))))


@query
def f7_parse_float(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", f"{views.FLOAT_TEXT} AS raw"
    )
    return lines.withColumn("number", numbers.parse_float(text.clean_text(F.col("raw"))))


@query
def f8_parse_bool(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", f"{views.BOOL_TEXT} AS raw"
    )
    return lines.withColumn("flag", numbers.parse_bool(text.clean_text(F.col("raw"))))


@query
def f9_split_multi(spark, sf_dir):
    raw = views.dirty_export(spark, sf_dir)
    return raw.select(
        "_ord",
        *[
            F.array_join(fields.split_multi(text.clean_text(F.col(name))), ",").alias(name)
            for name in ("occasion", "tags")
        ],
    )


@query
def f10_category_key(spark, sf_dir):
    raw = views.dirty_export(spark, sf_dir)
    return raw.select(
        "_ord", text.category_key(text.clean_text(F.col("category"))).alias("category_key")
    )


@query
def f11_stock_level(spark, sf_dir):
    return cleaning.clean_rows(views.dirty_export(spark, sf_dir)).select(
        "_ord", "stock", "stock_level"
    )


@query
def f12_soft_issues(spark, sf_dir):
    rows = cleaning.clean_rows(views.dirty_export(spark, sf_dir))
    return cleaning.issue_rows(rows.withColumn("product_id", F.col("_ord"))).select(
        F.col("product_id").alias("_ord"),
        F.concat("field", F.lit(":"), "kind").alias("issue"),
    )


@query
def f13_content_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", text.clean_text(F.col("text")).alias("text")
    )
    return docs.select(
        "doc_id",
        fields.description_hash(F.col("text")).alias("description_hash"),
        fields.translation_hash(F.col("source"), F.col("text")).alias("translation_hash"),
    )


@query
def f14_tokenize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", as_set(text.tokens(F.col("text"))).alias("tokens")
    )


@query
def f15_stem(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(
        F.explode(text.tokens(F.col("text"))).alias("token")
    )
    return words.distinct().withColumn("stem", text.stem(F.col("token")))


@query
def f16_translate_color(spark, sf_dir):
    return views.dirty_export(spark, sf_dir).select(
        "_ord", "color", spanish.translate_color(F.nullif("color", F.lit(""))).alias("color_es")
    )


@query
def f17_translate_material(spark, sf_dir):
    return views.dirty_export(spark, sf_dir).select(
        "_ord", "material",
        spanish.translate_material(F.nullif("material", F.lit(""))).alias("material_es"),
    )


@query
def f18_search_terms(spark, sf_dir):
    part = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", f"{views.SHELF_TEXT} AS category", f"{views.SUBSHELF_TEXT} AS subcategory"
    )
    return part.withColumn("terms", spanish.search_terms(F.col("category"), F.col("subcategory")))


@query
def f19_popularity(spark, sf_dir):
    return views.product_table(spark, sf_dir).select(
        "product_id",
        F.round(numbers.popularity(F.col("rating"), F.col("reviews_count")), 6).alias("popularity"),
    )


@query
def f20_title_case_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.title_case_score(F.col("text")).alias("capitals")
    )


@query
def f21_summary_json(spark, sf_dir):
    return views.product_table(spark, sf_dir).select(
        "product_id", F.to_json(respond.summary("https://shop.example")).alias("summary")
    )


@query
def f21_detail_json(spark, sf_dir):
    return duplicates.link_duplicates(views.product_table(spark, sf_dir)).select(
        "product_id", F.to_json(respond.detail()).alias("detail")
    )


# --- Ingest: quarantine, categories, copies, caches --------------------------------


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.classify(cleaning.clean_rows(views.dirty_export(spark, sf_dir)))


@query
def p1_quarantine(spark, sf_dir):
    return cleaning.quarantine(_classified(spark, sf_dir)).select("_ord", "price_eur", "reason")


@query
def w1_first_row_wins(spark, sf_dir):
    return cleaning.accepted(_classified(spark, sf_dir)).select(
        "_ord", "product_id", "name", "price_eur", "rating", "reviews_count", "recipient",
        "gift_wrap", "shipping_days",
    )


@query
def a3_quarantine_counts(spark, sf_dir):
    return quality.quarantine_counts(_classified(spark, sf_dir))


@query
def a4_issue_counts(spark, sf_dir):
    return quality.issue_counts(cleaning.accepted(_classified(spark, sf_dir)))


@query
def a5_load_summary(spark, sf_dir):
    classified = written(_classified(spark, sf_dir), "classified")
    products = build_products(classified)
    return quality.load_summary(classified).crossJoin(
        quality.duplicate_group_count(products)  # one row each
    )


@query
def a6_canonical_categories(spark, sf_dir):
    products = categories.resolve_display(cleaning.accepted(_classified(spark, sf_dir)))
    return products.select("product_id", "category", "category_slug", "category_key")


@query
def a6_changed_spellings(spark, sf_dir):
    return categories.changed_spellings(cleaning.accepted(_classified(spark, sf_dir)))


@query
def a7_duplicate_groups(spark, sf_dir):
    linked = duplicates.link_duplicates(views.product_table(spark, sf_dir))
    return linked.filter("duplicate_group_id IS NOT NULL").select(
        "product_id", "duplicate_group_id", joined("also_in_categories").alias("also_in_categories")
    )


@query
def j2_translation_cache(spark, sf_dir):
    cache = _translations(spark, sf_dir).drop("_ord")
    return enrich.add_translations(views.product_table(spark, sf_dir), cache).select(
        "product_id", "name_es", "description_es"
    )


@query
def j2_pitch_cache(spark, sf_dir):
    products = views.product_table(spark, sf_dir).withColumn("pitch_truncated", F.lit(True))
    cache = products.filter("_ord % 3 <> 2").select(
        "product_id",
        F.substring(
            F.sha2(F.concat(F.when(F.col("_ord") % 3 == 0, "").otherwise("x"), "description"), 256),
            1, 16,
        ).alias("hash"),
        F.when(F.col("_ord") % 9 != 0, F.concat(F.lit("Buy  the "), "name")).otherwise(" ").alias(
            "pitch"
        ),
    )
    return enrich.add_pitches(products, cache).select("product_id", "pitch", "pitch_truncated")


@query
def j2_stale_entries(spark, sf_dir):
    cache = _translations(spark, sf_dir).drop("_ord")
    return enrich.stale_entries(views.product_table(spark, sf_dir), cache)


@query
def a1_category_summary(spark, sf_dir):
    summary = categories.category_summary(views.product_table(spark, sf_dir))
    return summary.withColumn("subcategories", joined("subcategories"))


@query
def a2_vocabulary(spark, sf_dir):
    return categories.vocabulary(views.product_table(spark, sf_dir))


# --- Index -----------------------------------------------------------------------------


@query
def i1_term_index(spark, sf_dir):
    return index.term_index(views.product_table(spark, sf_dir))


@query
def i2_gate_superset(spark, sf_dir):
    return index.gate_violations(views.product_table(spark, sf_dir))


@query
def a13_stem_families(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        text.tokens(F.col("text")).alias("tokens")
    )
    return index.stem_families(docs).withColumn("words", joined("words"))


# --- Lookups and category resolution ------------------------------------------------------


@query
def j1_product_lookup(spark, sf_dir):
    asked = answer.lookup_ids(views.requests(spark, sf_dir, views.SIMILAR_COLUMNS))
    per_id = asked.groupBy("product_id").agg(F.count("*").alias("n_rows"))
    facts = views.product_table(spark, sf_dir).join(per_id, "product_id").select(
        "product_id", "n_rows", "name"
    )
    return attach(asked, facts, "product_id", F.col("request_id")).select(
        "request_id", F.col("name").alias("found"), F.col("name").isNull().alias("not_found")
    )


@query
def j6_category_resolution(spark, sf_dir):
    dimension = categories.category_dimension(views.product_table(spark, sf_dir))
    wanted = views.requests(spark, sf_dir, views.SEARCH_COLUMNS).select(
        F.col("category").alias("requested")
    )
    return categories.resolve_requested(wanted.filter("requested IS NOT NULL"), dimension).select(
        "requested", "category", "resolved_by"
    )


@query
def j7_nearest_categories(spark, sf_dir):
    """Misspelt categories: every part type with two letters exchanged."""
    products = views.product_table(spark, sf_dir)
    dimension = categories.category_dimension(products)
    wanted = table(spark, sf_dir, "part").selectExpr(
        "substr(lower(p_type), 1, 1 + p_partkey % 3) || substr(lower(p_type), 3 + p_partkey % 4) "
        "AS requested"
    )
    return nearest.closest(wanted, "requested", categories.category_candidates(dimension))


@query
def j7_nearest_names(spark, sf_dir):
    """Product names typed as ids, one letter short."""
    products = views.product_table(spark, sf_dir)
    wanted = products.selectExpr(
        "substr(name, 1, _ord % 5) || substr(name, _ord % 5 + 2) AS requested"
    )
    names = nearest.name_candidates(products).select("candidate", "at")
    return nearest.closest(wanted, "requested", names)


# --- Search ---------------------------------------------------------------------------------


def _asked(spark: SparkSession, sf_dir: str, columns: dict[str, str], browse: bool = False):
    """(products, request rows, distinct questions) for one request table."""
    products = views.catalogue(spark, sf_dir)
    wanted = views.requests(spark, sf_dir, columns)
    known, _ = answer.resolved_requests(products, wanted, browse)
    normal = answer.with_ask((find.as_browse if browse else find.as_search)(known))
    questions = written(answer.with_ask(find.distinct_questions(normal)), "questions")
    return products, normal, questions


def _per_request(normal: DataFrame, questions: DataFrame, results: DataFrame) -> DataFrame:
    """Give every request the rows of its question; a page at most per question."""
    columns = [name for name in results.columns if name != "question_id"]
    packed = results.groupBy("question_id").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    lookup = questions.select("ask", "question_id", "n_rows").join(unsent(packed), "question_id")
    # Requests without rows go, so that either side might be sent to all tasks; neither is.
    return attach(
        normal.select("request_id", "ask"), lookup, "ask", F.col("request_id"), few_rows=0
    ).select("request_id", F.inline("rows"))


COUNTS = ["n_attributes", "n_buyable", "n_price", "n_available"]


def _stage_counts(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    products, normal, questions = _asked(spark, sf_dir, views.only(*names))
    facts, pairs = find.scope_profiles(products, questions)
    prices = find.profile_prices(facts, pairs, firsts=False)
    counts = find.priced_counts(prices, questions).select("question_id", *COUNTS)
    return _per_request(normal, questions, counts)


@query
def p2_category_filter(spark, sf_dir):
    return _stage_counts(spark, sf_dir, "category")


@query
def p3_occasion_filter(spark, sf_dir):
    return _stage_counts(spark, sf_dir, "occasion")


@query
def p4_recipient_filter(spark, sf_dir):
    return _stage_counts(spark, sf_dir, "recipient")


@query
def p5_token_gate(spark, sf_dir):
    return _stage_counts(spark, sf_dir, "query")


@query
def p6_price_band(spark, sf_dir):
    return _stage_counts(spark, sf_dir, "recipient", "max_price", "min_price")


@query
def p7_availability(spark, sf_dir):
    return _stage_counts(spark, sf_dir, "category", "include_out_of_stock")


@query
def p8_stage_counts(spark, sf_dir):
    return _stage_counts(spark, sf_dir, *views.SEARCH_COLUMNS)


@query
def j3_term_match(spark, sf_dir):
    """Requests with words only: how many products each meets, and their best score."""
    products, normal, questions = _asked(spark, sf_dir, views.only("query"))
    asked = questions.filter(F.size("words") > 0)
    met = find.score_sums(products, asked).select(
        "question_id", "n_products", F.round("max_score", 6).alias("best_score")
    )
    return _per_request(normal, questions, met)


@query
def j3_stored_index(spark, sf_dir):
    """As ``j3_term_match``, on an index that is stored in buckets and read in part."""
    products, normal, questions = _asked(spark, sf_dir, views.only("query"))
    folder = new_path(spark, "catalogue")
    write_tables({"term_index": index.bucketed(index.term_index(products))}, folder)
    stored = read_tables(spark, folder, "term_index")["term_index"]
    asked = questions.filter(F.size("words") > 0)
    met = find.score_sums(products, asked, stored).select(
        "question_id", "n_products", F.round("max_score", 6).alias("best_score")
    )
    return _per_request(normal, questions, met)


@query
def j4_structured_filters(spark, sf_dir):
    return _stage_counts(
        spark, sf_dir, "category", "occasion", "recipient", "max_price", "include_out_of_stock"
    )


@query
def a8_max_popularity(spark, sf_dir):
    return views.catalogue(spark, sf_dir).agg(
        F.round(F.max("popularity"), 6).alias("max_popularity")
    )


@query
def a9_search_score(spark, sf_dir):
    """The summed score of everything a request matches, all bonuses included."""
    products, normal, questions = _asked(spark, sf_dir, views.SEARCH_COLUMNS)
    sums = find.score_sums(products, questions).select(
        "question_id",
        F.round("sum_score", 4).alias("sum_score"),
        F.round("max_score", 6).alias("max_score"),
        F.round("min_score", 6).alias("min_score"),
    )
    return _per_request(normal, questions, sums)


def _ranked(spark, sf_dir, columns, browse=False):
    products, normal, questions = _asked(spark, sf_dir, columns, browse)
    pages = find.profile_pages(*find.scope_profiles(products, questions), products, questions)
    pages = pages.withColumn("score", F.round("score", 6))
    return _per_request(normal, questions, pages)


@query
def w2_relevance_order(spark, sf_dir):
    names = [name for name in views.SEARCH_COLUMNS if name not in ("sort", "limit")]
    return _ranked(spark, sf_dir, views.only(*names))


@query
def w3_sort_orders(spark, sf_dir):
    return _ranked(spark, sf_dir, views.only("query", "sort")).drop("score")


@query
def w5_top_k(spark, sf_dir):
    return _ranked(spark, sf_dir, views.SEARCH_COLUMNS)


@query
def w6_offset_paging(spark, sf_dir):
    return _ranked(spark, sf_dir, views.BROWSE_COLUMNS, browse=True).drop("score")


@query
def w4_collapse_duplicates(spark, sf_dir):
    products, normal, questions = _asked(spark, sf_dir, views.only("query", "category"))
    facts, pairs = find.scope_profiles(products, questions)
    copies = written(spread(find.first_copies(facts), "profile_id"), "copies")
    matched = find.asked_matches(find.profile_matches(copies, pairs), products, questions).filter("available")
    before = matched.groupBy("question_id").agg(F.sum("n_rows").alias("n_listed"))
    after = find.collapse_duplicates(matched).groupBy("question_id").agg(
        F.count("*").alias("n_products")
    )
    return _per_request(normal, questions, before.join(after, "question_id"))


def _envelopes(spark, sf_dir, columns, browse=False):
    products, normal, questions = _asked(spark, sf_dir, columns, browse)
    envelopes, mentions = find.answer_questions(products, questions)
    return normal, questions, envelopes, mentions


@query
def w7_envelope(spark, sf_dir):
    normal, questions, envelopes, mentions = _envelopes(spark, sf_dir, views.SEARCH_COLUMNS)
    shown = mentions.filter("role = 'result'").groupBy("question_id").agg(
        F.count("*").alias("returned")
    )
    rows = envelopes.join(unsent(shown), "question_id", "left").select(
        "question_id",
        "total_matches",
        F.coalesce("returned", F.lit(0).cast("bigint")).alias("returned"),
        (F.col("total_matches") > F.col("limit")).alias("has_more"),
        (F.col("n_price") - F.col("n_available")).alias("hidden"),
    )
    return _per_request(normal, questions, rows)


@query
def a11_empty_reasons(spark, sf_dir):
    normal, questions, envelopes, _ = _envelopes(spark, sf_dir, views.SEARCH_COLUMNS)
    rows = envelopes.filter("reason IS NOT NULL").select("question_id", "reason")
    return _per_request(normal, questions, rows)


@query
def a12_fallback_products(spark, sf_dir):
    normal, questions, _, mentions = _envelopes(spark, sf_dir, views.FALLBACK_COLUMNS)
    rows = mentions.filter("role <> 'result'")
    return _per_request(normal, questions, rows)


@query
def x1_token_overlap(spark, sf_dir):
    """Shared and united terms of a product's name and its tags."""
    return views.catalogue(spark, sf_dir).select(
        "product_id",
        as_set(F.array_intersect("name_tokens", "tag_tokens")).alias("shared"),
        as_set(F.array_union("name_tokens", "tag_tokens")).alias("united"),
        F.arrays_overlap("tags", "occasions").alias("overlap"),
    )


@query
def x2_over_budget(spark, sf_dir):
    """What passes the attribute filters and can be bought, but not at the price."""
    products, normal, questions = _asked(spark, sf_dir, views.SEARCH_COLUMNS)
    return _per_request(normal, questions, find.over_budget(products, questions))


# --- Similar products -------------------------------------------------------------------


def _similar(spark, sf_dir, **options):
    """Every product as a target, in one job."""
    products = views.catalogue(spark, sf_dir)
    wanted = products.select(F.col("product_id").alias("request_id"), "product_id").withColumns(
        {
            "max_price": F.lit(None).cast("double"),
            "include_out_of_stock": F.lit(False),
            "limit": F.lit(6),
            **options,
        }
    )
    return compare.similar(products, compare.as_similar(wanted))


@query
def j5_comparable_products(spark, sf_dir):
    _, totals, _ = _similar(spark, sf_dir, include_out_of_stock=F.lit(True))
    return totals


@query
def w8_similarity_rank(spark, sf_dir):
    ranked, _, _ = _similar(spark, sf_dir)
    return ranked.withColumn("score", F.round("score", 6))


@query
def a10_tag_jaccard(spark, sf_dir):
    """Every two kinds of product that share a tag or subcategory, with their tag overlap."""
    kinds = compare.kinds(compare.listings(views.catalogue(spark, sf_dir)))
    side = kinds.select(
        "category",
        F.col("keys.key").alias("keys"),
        F.size(F.filter("keys.key", lambda key: key.startswith("t:"))).alias("n_tags"),
    )
    pairs = compare.overlapping(side, side, "keys")
    shared = F.size(
        F.filter(F.array_intersect("a_keys", "b_keys"), lambda key: key.startswith("t:"))
    )
    union = F.col("a_n_tags") + F.col("b_n_tags") - shared
    return pairs.groupBy(F.col("a_category").alias("category"), F.col("b_category").alias("other")).agg(
        F.count("*").alias("n_pairs"), F.round(F.sum(shared / union), 4).alias("sum_jaccard")
    )


@query
def j8_alternatives(spark, sf_dir):
    products = views.catalogue(spark, sf_dir)
    sold_out = products.filter("stock_level = 'out_of_stock'").select(
        F.col("product_id").alias("request_id"), "product_id",
        F.lit(compare.NO_BOUND).alias("bound"), F.lit(False).alias("all_stock"),
        F.lit(fixed.DETAIL_ALTERNATIVES).alias("limit"),
    )
    ranked, _, _ = compare.similar(products, sold_out)
    return ranked.select(F.col("request_id").alias("product_id"), "rank",
                         F.col("product_id").alias("alternative"))


# --- Whole responses -----------------------------------------------------------------------


@query
def w9_byte_budget(spark, sf_dir):
    """Per customer the page of a category, cut to a small byte budget."""
    products, normal, questions = _asked(
        spark, sf_dir, {**views.BROWSE_COLUMNS, "limit": "20"}, browse=True
    )
    pages = find.profile_pages(*find.scope_profiles(products, questions), products, questions)
    shown = products.select("product_id", respond.summary().alias("summary"))
    listed = (
        pages.join(shown, "product_id")
        .groupBy("question_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "summary"))).alias("all"))
        .select(
            "question_id",
            F.lit("ok").alias("status"),
            F.size("all").alias("returned"),
            F.col("all.summary").alias("products"),
            F.lit(None).cast("array<string>").alias("notes"),
        )
    )
    cut = respond.enforce_budget(listed, ["status", "returned", "products", "notes"], 2000)
    rows = cut.select(
        "question_id",
        "returned",
        F.to_json(F.col("products")).alias("products"),
        F.array_join("notes", " ").alias("notes"),
    )
    return _per_request(normal, questions, rows)


@query
def response_search(spark, sf_dir):
    return answer.search_products(
        views.catalogue(spark, sf_dir), views.requests(spark, sf_dir, views.SEARCH_COLUMNS)
    )


@query
def response_by_category(spark, sf_dir):
    return answer.products_by_category(
        views.catalogue(spark, sf_dir), views.requests(spark, sf_dir, views.BROWSE_COLUMNS)
    )


@query
def response_similar(spark, sf_dir):
    return answer.find_similar_products(
        views.catalogue(spark, sf_dir), views.requests(spark, sf_dir, views.SIMILAR_COLUMNS)
    )


@query
def response_details(spark, sf_dir):
    return answer.get_product_details(
        views.catalogue(spark, sf_dir), views.requests(spark, sf_dir, views.SIMILAR_COLUMNS)
    )


@query
def response_categories(spark, sf_dir):
    return answer.get_categories(views.product_table(spark, sf_dir))


@query
def best_per_category(spark, sf_dir):
    """The five best available products per category, copies collapsed."""
    products = views.catalogue(spark, sf_dir)
    per_category = products.groupBy("category").agg(F.min("_ord").alias("request_id"))
    wanted = per_category.withColumns(
        {"limit": F.lit(5), "offset": F.lit(0), "sort": F.lit("popularity"),
         "max_price": F.lit(None).cast("double"), "include_out_of_stock": F.lit(False)}
    )
    questions = find.distinct_questions(find.as_browse(wanted))
    pages = find.profile_pages(*find.scope_profiles(products, questions), products, questions)
    facts = products.select("product_id", "name", F.round("popularity", 6).alias("popularity"))
    return (
        pages.join(facts, "product_id")
        .join(questions.select("question_id", "category"), "question_id")
        .select("category", "rank", "product_id", "name", "popularity")
    )
