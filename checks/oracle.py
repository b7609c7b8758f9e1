"""SQL twins of the registered queries, for DuckDB over the same tables.

They start from the expressions in ``checks.views`` and compute the results their
own way: by brute force over all pairs, by list functions, or directly from the
clean values an untidy text was made of.
"""

from __future__ import annotations

from checks import views
from shelfspark.functions import fixed, spanish
from shelfspark.functions import phrases as say

ORACLES: dict[str, str] = {}
K = "p_partkey"


def select_list(columns: dict[str, str]) -> str:
    return ", ".join(f'{text} AS "{name}"' for name, text in columns.items())


def string(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(string(v) for v in values) + "]"


def whens(key: str, values: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(
        f"WHEN {string(k)} THEN {string(v)}" for k, v in values.items()
    ) + " END"


# --- Text -----------------------------------------------------------------------------

STOPWORDS = strings(fixed.STOPWORDS_ENGLISH + fixed.STOPWORDS_SPANISH)


def cleaned(text: str) -> str:
    """For ASCII and precomposed letters, with the entities that occur in the tables."""
    text = f"regexp_replace({text}, '<[^>]+>', ' ', 'g')"
    for entity, char in [("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"),
                         ("&gt;", ">"), ("&amp;", "&")]:
        text = f"replace({text}, '{entity}', '{char}')"
    text = f"regexp_replace({text}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g')"
    text = f"regexp_replace({text}, '[\\s\\x{{a0}}]+', ' ', 'g')"
    return f"trim(regexp_replace({text}, ' +([.,;:!?])', '\\1', 'g'))"


def ascii_only(text: str) -> str:
    return f"regexp_replace(strip_accents({text}), '[^\\x00-\\x7f]', '', 'g')"


def words(text: str) -> str:
    return (
        f"list_distinct(list_filter(regexp_extract_all({ascii_only(f'lower({text})')}, "
        f"'[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains({STOPWORDS}, w)))"
    )


def stemmed(token: str) -> str:
    """A subquery-free stem: suffix, then doubled consonant, then silent e."""
    irregular = " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in fixed.IRREGULAR_PLURALS.items()
    )
    suffix = (
        f"CASE {token} {irregular} ELSE CASE "
        f"WHEN length({token}) >= 6 AND {token} LIKE '%ing' THEN left({token}, length({token}) - 3) "
        f"WHEN length({token}) >= 5 AND {token} LIKE '%ed' THEN left({token}, length({token}) - 2) "
        f"WHEN length({token}) >= 5 AND {token} LIKE '%es' THEN left({token}, length({token}) - 2) "
        f"WHEN length({token}) >= 4 AND {token} LIKE '%s' AND {token} NOT LIKE '%ss' "
        f"THEN left({token}, length({token}) - 1) ELSE {token} END END"
    )
    return suffix


def stem_list(tokens: str) -> str:
    once = f"list_transform({tokens}, lambda t: {stemmed('t')})"
    single = (
        "CASE WHEN length(b) > 3 AND right(b, 1) = substr(b, length(b) - 1, 1) "
        "AND right(b, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'y') THEN left(b, length(b) - 1) ELSE b END"
    )
    silent = (
        "CASE WHEN length(c) > 3 AND right(c, 1) = 'e' THEN left(c, length(c) - 1) ELSE c END"
    )
    return (
        f"list_distinct(list_transform(list_transform({once}, lambda b: {single}), "
        f"lambda c: {silent}))"
    )


def truncated(text: str, limit: int) -> tuple[str, str]:
    w = f"substr({text}, 1, {limit})"

    def rfind(mark: str) -> str:
        found = f"instr(reverse({w}), '{mark[::-1]}')"
        return f"CASE WHEN {found} > 0 THEN length({w}) - {found} - {len(mark) - 1} ELSE -1 END"

    end = f"greatest({rfind('. ')}, {rfind('! ')}, {rfind('? ')})"
    space = rfind(" ")
    short = (
        f"CASE WHEN {end} >= {limit // 3} THEN trim(substr({w}, 1, {end} + 1)) "
        f"ELSE rtrim(CASE WHEN {space} > 0 THEN substr({w}, 1, {space}) ELSE {w} END, ' ,;:-') || '…' END"
    )
    cut = f"length({text}) > {limit}"
    return f"CASE WHEN {cut} THEN {short} ELSE {text} END", cut


def slug(text: str) -> str:
    folded = f"lower({ascii_only(text)})"
    plain = f"trim(regexp_replace({folded}, '[^a-z0-9]+', '-', 'g'), '-')"
    return f"coalesce(nullif({plain}, ''), 'uncategorised')"


ORACLES["f1_clean_text"] = f"SELECT page_id, {cleaned('html')} AS text FROM pages"
_d, _dc = truncated("text", 600)
_p, _pc = truncated("text", 140)
ORACLES["f2_truncate"] = f"""
WITH docs AS (SELECT doc_id, {cleaned('text')} AS text FROM documents)
SELECT doc_id, {_d} AS description, {_dc} AS description_cut, {_p} AS pitch, {_pc} AS pitch_cut
FROM docs"""
ORACLES["f3_slugify"] = f"SELECT doc_id, {slug('text')} AS slug FROM documents"
ORACLES["f13_content_hash"] = f"""
WITH docs AS (SELECT doc_id, source, {cleaned('text')} AS text FROM documents)
SELECT doc_id, substr(sha256(text), 1, 16) AS description_hash,
  substr(sha256(source || chr(10) || text), 1, 16) AS translation_hash FROM docs"""
ORACLES["f14_tokenize"] = f"""
SELECT doc_id, array_to_string(list_sort({words('text')}), ',') AS tokens FROM documents"""
ORACLES["f15_stem"] = f"""
WITH tokens AS (SELECT DISTINCT unnest({words('text')}) AS token FROM documents)
SELECT token, {stem_list('[token]')}[1] AS stem FROM tokens"""
ORACLES["a13_stem_families"] = f"""
WITH tokens AS (SELECT DISTINCT unnest({words('text')}) AS word FROM documents),
stems AS (SELECT word, {stem_list('[word]')}[1] AS stem FROM tokens)
SELECT stem, string_agg(word, ',' ORDER BY word) AS words, count(*) AS family_size,
  max(CASE WHEN word <> stem THEN length(stem) END) AS cut_length
FROM stems GROUP BY stem"""
ORACLES["f20_title_case_score"] = """
SELECT doc_id, len(list_filter(regexp_split_to_array(trim(text), '\\s+'),
  lambda w: regexp_matches(w, '^\\p{Lu}'))) AS capitals FROM documents"""

# --- Numbers, from what the text was made of ---------------------------------------------

_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
_EUROS = f"({_CENTS} // 100)"
ORACLES["f5_parse_money"] = f"""
SELECT l_orderkey, l_linenumber, {views.MONEY_TEXT} AS raw,
  CASE WHEN l_suppkey % 50 IN (7, 8, 10) THEN NULL
    -- Two dots are thousands separators; three more digits exceed the cap.
    WHEN l_suppkey % 50 = 9 THEN CASE WHEN {_EUROS} < 100
      THEN CAST('1000' || CAST({_EUROS} AS STRING) AS DOUBLE) END
    -- A comma with nothing or one digit and a comma after it separates thousands.
    WHEN l_suppkey % 50 = 11 THEN CAST({_EUROS} AS DOUBLE)
    WHEN l_suppkey % 50 = 12 THEN CASE WHEN {_EUROS} * 10 + 5 <= {fixed.MAX_PRICE_EUR} THEN {_EUROS} * 10 + 5.0E0 END
    -- The currency pattern takes `eur` and leaves `os`.
    WHEN l_linenumber = 5 THEN NULL
    ELSE {_CENTS} / 100.0E0 END AS amount
FROM lineitem"""
ORACLES["f6_parse_int"] = f"""
SELECT l_orderkey, l_linenumber, {views.INT_TEXT} AS raw,
  CASE l_linenumber WHEN 1 THEN {_EUROS} WHEN 2 THEN -{_EUROS} WHEN 3 THEN {_EUROS}
    WHEN 5 THEN 100 + {_EUROS} % 10 WHEN 7 THEN 2000 END AS number
FROM lineitem"""
ORACLES["f7_parse_float"] = f"""
SELECT l_orderkey, l_linenumber, {views.FLOAT_TEXT} AS raw,
  CASE l_linenumber WHEN 1 THEN {_CENTS} / 100.0E0 WHEN 2 THEN -{_CENTS} / 100.0E0
    WHEN 3 THEN CASE WHEN {_EUROS} < 1000 THEN {_CENTS} / 100.0E0 END
    WHEN 7 THEN CAST({_EUROS} AS DOUBLE) END AS number
FROM lineitem"""
ORACLES["f8_parse_bool"] = f"""
SELECT l_orderkey, l_linenumber, {views.BOOL_TEXT} AS raw,
  CASE WHEN l_orderkey % 9 IN (0, 1, 2, 6) THEN true WHEN l_orderkey % 9 IN (3, 4, 7) THEN false
  END AS flag
FROM lineitem"""

# --- The dirty export, cleaned by construction ----------------------------------------------

_SIXTH = {str(d): repr(round(float(f"3.{d}5"), 1)) for d in range(1, 10, 2)}
_ROUNDED = f"CAST({whens(f'CAST({K} % 10 AS STRING)', _SIXTH)} AS DOUBLE)"
_CENT_COUNT = f"(({K} % 12) * 11525 + 990)"
_ADJECTIVE, _NOUN = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_CATEGORY_RAW = (
    f"CASE WHEN {K} % 53 = 0 THEN '' WHEN {K} % 4 = 0 THEN {views._TITLE} || ' & Gifts' "
    f"WHEN {K} % 4 = 1 THEN lower(p_type) || ' and gifts' "
    f"WHEN {K} % 4 = 2 THEN upper(p_type) || ' & GIFTS' ELSE {views._TITLE} || ' And Gifts' END"
)
_LONG_NAME = "rtrim(repeat(p_name || ' ', 20))"
_CUT_NAME, _ = truncated(_LONG_NAME, 120)
_STOCK = (
    f"CASE WHEN {K} % 17 = 0 OR {K} % 19 = 0 THEN NULL WHEN {K} % 43 = 0 THEN 0 "
    f"ELSE p_size % 13 END"
)
CLEAN = {
    "_ord": K,
    "product_id": (
        f"CASE WHEN {K} % 97 = 5 THEN '' "
        f"ELSE 'GA-' || lpad(CAST({K} - CASE WHEN {K} % 89 = 7 THEN 1 ELSE 0 END AS STRING), 8, '0') END"
    ),
    "name": (
        f"CASE WHEN {K} % 101 = 3 THEN '' WHEN {K} % 5 = 1 THEN 'R&D ' || p_name "
        f"WHEN {K} % 5 = 2 THEN p_name || ' “X”' WHEN {K} % 5 = 3 THEN {_CUT_NAME} ELSE p_name END"
    ),
    "price_eur": (
        f"CASE WHEN {K} % 103 = 4 OR {K} % 107 = 6 THEN NULL ELSE {_CENT_COUNT} / 100.0E0 END"
    ),
    "category_raw": _CATEGORY_RAW,
    "category_key": f"CASE WHEN {K} % 53 = 0 THEN '' ELSE lower(p_type) || ' & gifts' END",
    "subcategory": f"CASE WHEN {K} % 31 <> 0 THEN {_NOUN} END",
    "brand": "p_brand",
    "stock": _STOCK,
    "stock_level": (
        f"CASE WHEN ({_STOCK}) IS NULL THEN 'unknown' WHEN ({_STOCK}) = 0 THEN 'out_of_stock' "
        f"WHEN ({_STOCK}) <= 5 THEN 'low' ELSE 'in_stock' END"
    ),
    "rating": (
        f"CASE WHEN {K} % 23 = 0 OR {K} % 29 = 0 OR {K} % 37 = 0 THEN NULL "
        f"WHEN {K} % 2 = 0 THEN CAST('4.' || CAST({K} % 10 AS STRING) AS DOUBLE) ELSE {_ROUNDED} END"
    ),
    "reviews_count": (
        f"CASE WHEN {K} % 41 = 0 OR {K} % 7 = 0 THEN NULL WHEN {K} % 3 = 0 THEN 1000 + {K} % 1000 "
        f"ELSE {K} % 500 END"
    ),
    "recipient": f"CASE {K} % 4 WHEN 0 THEN 'anyone' WHEN 1 THEN 'her' WHEN 2 THEN 'him' END",
    "gift_wrap": f"CASE {K} % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 4 THEN true END",
    "shipping_days": (
        f"CASE WHEN {K} % 47 = 0 THEN 999 WHEN {K} % 59 = 0 OR {K} % 61 = 0 THEN NULL ELSE {K} % 9 END"
    ),
}
_OCCASION_ITEMS = (
    f"CASE {K} % 5 WHEN 0 THEN 'birthday,christmas' WHEN 1 THEN 'birthday,wedding' "
    f"WHEN 2 THEN 'easter,christmas' WHEN 3 THEN 'new home,birthday' ELSE '' END"
)
_TAG_ITEMS = f"CASE WHEN {K} % 3 = 2 THEN p_name ELSE replace(lower(p_name), ' ', ',') END"
_ISSUES = {
    "name:truncated": f"{K} % 5 = 3 AND {K} % 101 <> 3",
    "__row__:ragged_row": f"{K} % 79 = 0",
    "category:missing": f"{K} % 53 = 0",
    "stock:unparseable": f"{K} % 17 = 0",
    "stock:missing": f"{K} % 17 <> 0 AND {K} % 19 = 0",
    "stock:negative_clamped": f"{K} % 17 <> 0 AND {K} % 19 <> 0 AND {K} % 43 = 0",
    "rating:missing": f"{K} % 23 = 0",
    "rating:out_of_range": f"{K} % 23 <> 0 AND {K} % 29 = 0",
    "rating:unparseable": f"{K} % 23 <> 0 AND {K} % 29 <> 0 AND {K} % 37 = 0",
    "reviews_count:unparseable": f"{K} % 41 = 0",
    "occasion:missing": f"{K} % 5 = 4",
    "color:missing": f"{K} % 13 = 0",
    "material:missing": f"{K} % 4 = 3",
    "gift_wrap:unrecognised": f"{K} % 5 = 2",
    "shipping_days:implausible": f"{K} % 47 = 0",
    "shipping_days:unparseable": f"{K} % 47 <> 0 AND ({K} % 59 = 0 OR {K} % 61 = 0)",
    "description:missing": f"{K} % 67 = 0",
    "description:truncated": f"{K} % 67 <> 0 AND ({K} % 71 = 0 OR {K} % 73 = 0)",
}
_ISSUE_ROWS = " UNION ALL ".join(
    f"SELECT {K} AS _ord, '{name}' AS issue FROM part WHERE {where}"
    for name, where in _ISSUES.items()
)
CLASSIFIED = f"""
clean AS (SELECT {select_list(CLEAN)} FROM part),
firsts AS (SELECT product_id, min(_ord) AS first FROM clean
  WHERE product_id <> '' AND name <> '' AND price_eur IS NOT NULL GROUP BY 1),
classified AS (
  SELECT clean.*, CASE WHEN clean.product_id = '' THEN 'missing_product_id'
    WHEN first < _ord THEN 'duplicate_product_id' WHEN name = '' THEN 'missing_name'
    WHEN price_eur IS NULL THEN 'unparseable_price' END AS reason
  FROM clean LEFT JOIN firsts USING (product_id)),
accepted AS (SELECT * FROM classified WHERE reason IS NULL),
spellings AS (
  SELECT category_key, category_raw, count(*) AS n,
    len(list_filter(string_split(category_raw, ' '), lambda w: regexp_matches(w, '^[A-Z]'))) AS capitals
  FROM accepted WHERE category_key <> '' GROUP BY 1, 2),
display AS (
  SELECT category_key, category_raw AS category FROM spellings
  QUALIFY row_number() OVER (PARTITION BY category_key ORDER BY capitals DESC, n DESC, category_raw) = 1),
named AS (
  SELECT accepted.* EXCLUDE (category_key), coalesce(category, 'Uncategorised') AS category,
    coalesce(nullif(accepted.category_key, ''), 'uncategorised') AS category_key
  FROM accepted LEFT JOIN display USING (category_key))"""

_RAW = {name: f"{text}" for name, text in views.RAW_COLUMNS.items()}
_FILE_RAW = {**_RAW, "description": f"({_RAW['description']}) || ' \"so they say\",' || chr(10) || 'about 3 EUR'"}
ORACLES["s1_csv_scan"] = f"SELECT {select_list(_FILE_RAW)}, false AS ragged FROM part"
ORACLES["s2_encoding_fallback"] = f"""
SELECT {_RAW['product_id']} AS product_id, 'Café ' || ({_RAW['subcategory']}) AS name,
  'Ñandú é' AS recipient, CASE WHEN {K} % 3 = 1 THEN {_RAW['price_eur']} ELSE replace({_RAW['price_eur']}, '€', 'EUR') END AS price_eur,
  CASE {K} % 3 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'windows-1252' ELSE 'ISO-8859-1' END AS encoding
FROM part"""
ORACLES["s3_header_names"] = "SELECT " + ", ".join(
    f"{_RAW[n]} AS {n}" for n in ("product_id", "name", "category", "price_eur", "shipping_days")
) + " FROM part"
ORACLES["s4_unknown_columns"] = f"""
SELECT category, count(*) AS n_rows, 'ean_code,warehouse' AS unknown_columns
FROM (SELECT {_RAW['category']} AS category FROM part) GROUP BY 1"""
ORACLES["s5_ragged_rows"] = f"""
SELECT CAST({K} AS STRING) AS product_id, p_name AS name, '1,5' AS price_eur,
  CASE WHEN {K} % 5 <> 1 THEN p_brand END AS brand,
  CASE {K} % 5 WHEN 1 THEN 'missing columns' WHEN 2 THEN 'extra columns' END AS ragged
FROM part"""
ORACLES["f4_product_id"] = f"SELECT {K} AS _ord, {CLEAN['product_id']} AS product_id FROM part"
ORACLES["f9_split_multi"] = (
    f"SELECT {K} AS _ord, {_OCCASION_ITEMS} AS occasion, {_TAG_ITEMS} AS tags FROM part"
)
ORACLES["f10_category_key"] = f"SELECT {K} AS _ord, {CLEAN['category_key']} AS category_key FROM part"
ORACLES["f11_stock_level"] = (
    f"SELECT {K} AS _ord, {CLEAN['stock']} AS stock, {CLEAN['stock_level']} AS stock_level FROM part"
)
ORACLES["f12_soft_issues"] = _ISSUE_ROWS
_COLOR = f"({_RAW['color']})"
ORACLES["f16_translate_color"] = f"""
SELECT {K} AS _ord, {_COLOR} AS color,
  nullif(coalesce({whens(_COLOR, spanish.COLOURS)}, {_COLOR}), '') AS color_es
FROM part"""
ORACLES["f17_translate_material"] = f"""
SELECT {K} AS _ord, {_RAW['material']} AS material,
  CASE {K} % 4 WHEN 0 THEN 'Acero, roble' WHEN 1 THEN 'Moon dust, algodón' WHEN 2 THEN 'Vidrio' END
  AS material_es FROM part"""
_SHELVES = spanish.SHELF_TERMS
ORACLES["f18_search_terms"] = f"""
SELECT p_partkey, {views.SHELF_TEXT} AS category, {views.SUBSHELF_TEXT} AS subcategory,
  concat_ws(' ', {whens(f'lower({views.SHELF_TEXT})', _SHELVES)},
    {whens(f'lower({views.SUBSHELF_TEXT})', _SHELVES)}) AS terms FROM part"""
ORACLES["p1_quarantine"] = f"""
WITH {CLASSIFIED}
SELECT _ord, {_RAW['price_eur']} AS price_eur, reason FROM classified JOIN part ON {K} = _ord
WHERE reason IS NOT NULL"""
ORACLES["w1_first_row_wins"] = f"""
WITH {CLASSIFIED}
SELECT _ord, product_id, name, price_eur, rating, reviews_count, recipient, gift_wrap, shipping_days
FROM accepted"""
ORACLES["a3_quarantine_counts"] = f"""
WITH {CLASSIFIED}
SELECT reason, count(*) AS n_rows FROM classified WHERE reason IS NOT NULL GROUP BY 1"""
ORACLES["a4_issue_counts"] = f"""
WITH {CLASSIFIED}, issues AS ({_ISSUE_ROWS})
SELECT issue, count(*) AS n_rows FROM issues JOIN accepted USING (_ord) GROUP BY 1"""
ORACLES["a5_load_summary"] = f"""
WITH {CLASSIFIED}, groups AS (
  SELECT lower(name), lower(brand), price_eur FROM accepted GROUP BY 1, 2, 3 HAVING count(*) > 1)
SELECT count(*) AS rows_read, count(*) FILTER (reason IS NULL) AS products_loaded,
  count(reason) AS quarantined_total,
  {", ".join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in
             ("missing_product_id", "duplicate_product_id", "missing_name", "unparseable_price"))},
  (SELECT count(*) FROM groups) AS duplicate_groups
FROM classified"""
ORACLES["a6_canonical_categories"] = f"""
WITH {CLASSIFIED}
SELECT product_id, category, {slug('category')} AS category_slug, category_key FROM named"""
ORACLES["a6_changed_spellings"] = f"""
WITH {CLASSIFIED}
SELECT category_raw, category FROM spellings JOIN display USING (category_key)
WHERE category_raw <> category"""

# --- The product table ---------------------------------------------------------------------

_P = views.PRODUCT_COLUMNS
PRODUCTS = f"""
sales AS (SELECT l_partkey AS part_key, floor(avg(l_quantity) + 0.5) / 10.0E0 AS avg_rating,
  count(*) AS reviews_count FROM lineitem GROUP BY 1),
buyers AS (
  SELECT l_partkey AS part_key, lower(o_orderpriority) AS occasion, lower(c_mktsegment) AS segment
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
suits AS (SELECT part_key, list_sort(list(DISTINCT occasion)) AS occasions FROM buyers GROUP BY 1),
segments AS (
  SELECT part_key, segment FROM buyers GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY part_key ORDER BY count(*) DESC, segment) = 1),
plain AS (
  SELECT {select_list({n: t for n, t in _P.items() if n not in ('first_tag', 'second_tag', 'third_tag', 'rated')})},
    [{_P['first_tag']}, {_P['second_tag']}, {_P['third_tag']}] AS tags,
    CASE WHEN {_P['rated']} THEN avg_rating END AS rating, reviews_count,
    coalesce(occasions, []) AS occasions,
    CASE WHEN segment = 'household' THEN 'anyone' ELSE segment END AS recipient,
    {_P['description']} AS pitch
  FROM part LEFT JOIN sales ON sales.part_key = p_partkey
    LEFT JOIN suits ON suits.part_key = p_partkey
    LEFT JOIN segments ON segments.part_key = p_partkey),
copies AS (
  SELECT lower(name) AS n, lower(brand) AS b, price_eur AS e, min(product_id) AS duplicate_group_id,
    list(DISTINCT category) AS shelves FROM plain GROUP BY 1, 2, 3 HAVING count(*) > 1),
products AS (
  SELECT plain.*, duplicate_group_id, coalesce(duplicate_group_id, product_id) AS own,
    list_sort(list_filter(coalesce(shelves, []), lambda s: s <> category)) AS also_in_categories,
    stock_level <> 'out_of_stock' AS recommendable,
    coalesce(rating * log10(coalesce(reviews_count, 0) + 10), 0) AS popularity
  FROM plain LEFT JOIN copies ON n = lower(name) AND b = lower(brand) AND e = price_eur)"""

ORACLES["f19_popularity"] = (
    f"WITH {PRODUCTS} SELECT product_id, round(popularity, 6) AS popularity FROM products"
)
ORACLES["a1_category_summary"] = f"""
WITH {PRODUCTS}
SELECT category, {slug('category')} AS slug, count(*) AS product_count,
  count(*) FILTER (recommendable) AS in_stock_count, min(price_eur) AS price_min,
  max(price_eur) AS price_max, array_to_string(list_sort(list(DISTINCT subcategory)
  FILTER (subcategory IS NOT NULL)), ',') AS subcategories
FROM products GROUP BY category"""
_VOCABULARY = """
SELECT 'category' AS kind, category AS value FROM products
UNION ALL SELECT 'recipient', recipient FROM products WHERE recipient IS NOT NULL
UNION ALL SELECT 'occasion', unnest(occasions) FROM products"""
ORACLES["a2_vocabulary"] = f"""
WITH {PRODUCTS}, vals AS ({_VOCABULARY})
SELECT kind, value, count(*) AS n,
  row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, value) AS rank
FROM vals GROUP BY 1, 2"""
ORACLES["a7_duplicate_groups"] = f"""
WITH {PRODUCTS}
SELECT product_id, duplicate_group_id, array_to_string(also_in_categories, ',') AS also_in_categories
FROM products WHERE duplicate_group_id IS NOT NULL"""
ORACLES["a8_max_popularity"] = (
    f"WITH {PRODUCTS} SELECT round(max(popularity), 6) AS max_popularity FROM products"
)


def number(value: str) -> str:
    return f"CAST({value} AS STRING)"


def json_pairs(pairs: list[tuple[str, str, bool]]) -> str:
    """A JSON object from (key, SQL, is text); null values are left out."""
    parts = []
    for key, value, is_text in pairs:
        shown = f"'\"' || {value} || '\"'" if is_text else number(value)
        parts.append(f"'\"{key}\":' || {shown}")
    return f"'{{' || concat_ws(',', {', '.join(parts)}) || '}}'"


def json_list(values: str) -> str:
    items = f"array_to_string(list_transform({values}, lambda v: '\"' || v || '\"'), ',')"
    return f"CASE WHEN len({values}) > 0 THEN '[' || {items} || ']' END"


_SUMMARY = [
    ("product_id", "product_id", True), ("name", "name", True), ("price_eur", "price_eur", False),
    ("pitch", "pitch", True), ("stock_level", "stock_level", True),
    ("shipping_days", "shipping_days", False), ("gift_wrap", "gift_wrap", False),
    ("rating", "rating", False), ("reviews_count", "reviews_count", False),
]
_URLS = [
    ("product_url", "'https://shop.example/p/' || product_id", True),
    ("image_url", "'https://shop.example/p/' || product_id || '/image.svg'", True),
]
_DETAIL = [
    ("brand", "brand", True), ("color", "color", True), ("material", "material", True),
    ("occasions", json_list("occasions"), False), ("recipient", "recipient", True),
    ("tags", json_list("tags"), False), ("stock", "stock", False),
    ("description", "description", True),
    ("also_in_categories", json_list("also_in_categories"), False),
]
ORACLES["f21_summary_json"] = (
    f"WITH {PRODUCTS} SELECT product_id, {json_pairs(_SUMMARY + _URLS)} AS summary FROM products"
)
ORACLES["f21_detail_json"] = (
    f"WITH {PRODUCTS} SELECT product_id, {json_pairs(_SUMMARY + _DETAIL)} AS detail FROM products"
)


def hashed(*parts: str) -> str:
    return f"substr(sha256({' || chr(10) || '.join(parts)}), 1, 16)"


_ENTRIES = f"""
entries AS (
  SELECT product_id, {hashed("CASE WHEN _ord % 5 = 0 THEN 'old ' ELSE '' END || name", 'description')} AS hash,
    'Artículo ' || name AS name_es,
    CASE WHEN _ord % 7 <> 0 THEN 'Un <i>artículo</i>: ' || description END AS description_es
  FROM products)"""
ORACLES["s6_json_cache"] = f"WITH {PRODUCTS}, {_ENTRIES} SELECT * FROM entries"
ORACLES["j2_translation_cache"] = f"""
WITH {PRODUCTS}
SELECT product_id, CASE WHEN _ord % 5 <> 0 THEN 'Artículo ' || name END AS name_es,
  CASE WHEN _ord % 5 <> 0 AND _ord % 7 <> 0 THEN 'Un artículo: ' || description END AS description_es
FROM products"""
ORACLES["j2_pitch_cache"] = f"""
WITH {PRODUCTS}
SELECT product_id, CASE WHEN _ord % 3 = 0 AND _ord % 9 <> 0 THEN 'Buy the ' || name ELSE pitch END AS pitch,
  NOT (_ord % 3 = 0 AND _ord % 9 <> 0) AS pitch_truncated FROM products"""
ORACLES["j2_stale_entries"] = f"""
WITH {PRODUCTS}, {_ENTRIES}
SELECT product_id, hash, {hashed('name', 'description')} AS expected
FROM entries JOIN products USING (product_id) WHERE hash <> {hashed('name', 'description')}"""

# --- Terms --------------------------------------------------------------------------------

_SPANISH = f"""concat_ws(' ', {whens('lower(category)', _SHELVES)}, {whens('lower(subcategory)', _SHELVES)})"""
_TAGS_TEXT = "array_to_string(tags, ' ')"
_ALL_TEXT = (
    f"concat_ws(' ', name, category, subcategory, brand, description, {_TAGS_TEXT}, "
    f"array_to_string(occasions, ' '), {_SPANISH})"
)
TERMS = f"""
worded AS (
  SELECT *, {words('name')} AS name_words,
    {words(f"concat_ws(' ', {_TAGS_TEXT}, subcategory, {_SPANISH})")} AS tag_words,
    {words(_ALL_TEXT)} AS all_words
  FROM products),
stemmed AS (
  SELECT *, {stem_list('name_words')} AS name_stems, {stem_list('tag_words')} AS tag_stems,
    {stem_list('all_words')} AS all_stems
  FROM worded),
terms AS (
  SELECT product_id, kind, term, sum(weight) AS weight FROM (
    SELECT product_id, 'token' AS kind, unnest(name_words) AS term, 3.0E0 AS weight FROM stemmed
    UNION ALL SELECT product_id, 'token', unnest(tag_words), 2.0E0 FROM stemmed
    UNION ALL SELECT product_id, 'token', unnest(all_words), 1.0E0 FROM stemmed
    UNION ALL SELECT product_id, 'stem', unnest(name_stems), 1.5E0 FROM stemmed
    UNION ALL SELECT product_id, 'stem', unnest(tag_stems), 1.0E0 FROM stemmed
    UNION ALL SELECT product_id, 'stem', unnest(all_stems), 0.5E0 FROM stemmed)
  GROUP BY 1, 2, 3)"""
ORACLES["i1_term_index"] = (
    f"WITH {PRODUCTS}, {TERMS} SELECT product_id, kind, term, weight FROM terms"
)
ORACLES["i2_gate_superset"] = f"""
WITH {PRODUCTS}, {TERMS}
SELECT product_id, term FROM (
  SELECT product_id, all_words, unnest(list_distinct(name_words || tag_words)) AS term FROM stemmed)
WHERE NOT list_contains(all_words, term)"""
ORACLES["x1_token_overlap"] = f"""
WITH {PRODUCTS}, {TERMS}
SELECT product_id, array_to_string(list_sort(list_intersect(name_words, tag_words)), ',') AS shared,
  array_to_string(list_sort(list_distinct(name_words || tag_words)), ',') AS united,
  list_has_any(tags, occasions) AS overlap FROM stemmed"""

# s7: cleaned export, linked and indexed. The texts that make up a term set, rebuilt.
_DESCRIPTION = (
    f"CASE WHEN {K} % 67 = 0 THEN NULL WHEN {K} % 71 = 0 OR {K} % 73 = 0 THEN 'Good ' || p_name "
    f"ELSE 'A ' || p_name || ' by ' || p_brand || '. Fits & lasts.' END"
)
_COLOR_ES = f"coalesce({whens(_COLOR, spanish.COLOURS)}, {_COLOR})"
_MATERIAL_ES = (
    f"CASE {K} % 4 WHEN 0 THEN 'Acero, roble' WHEN 1 THEN 'Moon dust, algodón' WHEN 2 THEN 'Vidrio' END"
)
_INGESTED_TEXT = (
    f"concat_ws(' ', name, category, subcategory, brand, {_DESCRIPTION}, {_TAG_ITEMS}, "
    f"{_OCCASION_ITEMS}, {_COLOR_ES}, {_MATERIAL_ES}, {_SPANISH})"
)
ORACLES["s7_table_sink"] = f"""
WITH {CLASSIFIED},
worded AS (SELECT category, {words(_INGESTED_TEXT)} AS all_words FROM named JOIN part ON {K} = _ord)
SELECT category, count(*) AS n_products,
  sum(len(all_words) + len({stem_list('all_words')})) AS n_terms
FROM worded GROUP BY category"""

# --- Requests --------------------------------------------------------------------------------


def request_rows(columns: dict[str, str]) -> str:
    return f"raw_requests AS (SELECT {select_list(columns)} FROM customer JOIN part ON p_partkey = c_custkey)"


_KEY = (
    "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(requested)), '\\s+and\\s+', ' & ', 'g'), "
    "'\\s*&\\s*', ' & ', 'g'), '\\s+', ' ', 'g'))"
)
SHELVES = f"""
shelves AS (SELECT DISTINCT category, category_key, {slug('category')} AS slug FROM products)"""
ORACLES["j6_category_resolution"] = f"""
WITH {PRODUCTS}, {SHELVES}, {request_rows(views.SEARCH_COLUMNS)},
wanted AS (SELECT DISTINCT category AS requested FROM raw_requests WHERE category IS NOT NULL)
SELECT requested, coalesce(k.category, s.category) AS category,
  CASE WHEN k.category IS NOT NULL THEN 'key' WHEN s.category IS NOT NULL THEN 'slug' END AS resolved_by
FROM wanted LEFT JOIN shelves k ON k.category_key = {_KEY} LEFT JOIN shelves s ON s.slug = {slug('requested')}"""
ORACLES["j1_product_lookup"] = f"""
WITH {PRODUCTS}, {request_rows(views.SIMILAR_COLUMNS)}
SELECT request_id, name AS found, name IS NULL AS not_found
FROM raw_requests r LEFT JOIN products p ON p.product_id = upper(replace(trim(r.product_id), ' ', ''))"""


def search_ctes(columns: dict[str, str], browse: bool = False) -> str:
    """Brute force: every request against every product that passes its filters."""
    most, default = (20, 8) if browse else (12, 5)
    sort = "popularity" if browse else "relevance"
    absent = [n for n in ("query", "occasion", "recipient", "min_price", "offset") if n not in columns]
    columns = {**columns, **{n: "NULL" for n in absent}}
    need = "category IS NOT NULL" if browse else "(category IS NOT NULL OR requested IS NULL)"
    return f"""{PRODUCTS}, {TERMS}, {SHELVES}, {request_rows(columns)},
asked AS (SELECT * EXCLUDE (category), nullif(category, '') AS requested FROM raw_requests),
resolved AS (
  SELECT r.request_id, coalesce(k.category, s.category) AS category, requested,
    CASE WHEN query IS NULL THEN [] ELSE {words("coalesce(CAST(query AS STRING), '')")} END AS q_words,
    CAST(occasion AS STRING) AS q_occasion, CAST(recipient AS STRING) AS q_recipient,
    CAST(max_price AS DOUBLE) AS max_price, CAST(min_price AS DOUBLE) AS min_price,
    include_out_of_stock, coalesce(sort, '{sort}') AS sort,
    greatest(1, least(coalesce("limit", {default}), {most})) AS "limit",
    greatest(coalesce(CAST("offset" AS INT), 0), 0) AS "offset"
  FROM asked r LEFT JOIN shelves k ON k.category_key = {_KEY}
    LEFT JOIN shelves s ON s.slug = {slug('requested')}),
request AS (SELECT * FROM resolved WHERE {need}),
request_terms AS (
  SELECT request_id, 'token' AS kind, unnest(q_words) AS term FROM request
  UNION ALL SELECT request_id, 'stem', unnest({stem_list('q_words')}) FROM request),
text_scores AS (
  SELECT request_id, product_id, sum(weight) AS text_score
  FROM request_terms JOIN terms USING (kind, term) GROUP BY 1, 2),
met AS (
  SELECT request_id, product_id, text_score FROM text_scores
  UNION ALL SELECT request_id, product_id, 0.0E0 FROM request, products
  WHERE len(q_words) = 0),
matched AS (
  SELECT r.*, p.* EXCLUDE (category), text_score,
    (r.max_price IS NULL OR price_eur <= r.max_price) AND (r.min_price IS NULL OR price_eur >= r.min_price) AS in_price,
    recommendable OR include_out_of_stock AS buyable,
    text_score + CASE WHEN q_occasion IS NOT NULL THEN 2 ELSE 0 END
      + CASE WHEN q_recipient <> 'anyone' THEN 1.5 ELSE 0 END
      + CASE WHEN price_eur / r.max_price BETWEEN 0.7 AND 1.0 THEN 1.0
          WHEN price_eur / r.max_price >= 0.4 AND price_eur / r.max_price < 0.7 THEN 0.5 ELSE 0 END
      - CASE WHEN stock_level = 'low' THEN 1 ELSE 0 END
      + 0.5E0 * (popularity / (SELECT max(popularity) FROM products)) AS score
  FROM met JOIN request r USING (request_id) JOIN products p USING (product_id)
  WHERE (r.category IS NULL OR r.category = p.category)
    AND (q_occasion IS NULL OR list_contains(occasions, q_occasion))
    AND (q_recipient IS NULL OR recipient = q_recipient)),
keyed AS (
  SELECT *, buyable AND in_price AS available,
    CASE sort WHEN 'price_asc' THEN price_eur WHEN 'price_desc' THEN -price_eur
      WHEN 'rating' THEN -coalesce(nullif(rating, 0), -1) WHEN 'popularity' THEN -popularity ELSE -score END AS first,
    CASE sort WHEN 'price_asc' THEN 0 WHEN 'price_desc' THEN 0
      WHEN 'rating' THEN -coalesce(reviews_count, 0) WHEN 'popularity' THEN 0 ELSE -popularity END AS second
  FROM matched),
collapsed AS (
  SELECT * FROM keyed WHERE available
  QUALIFY row_number() OVER (PARTITION BY request_id, own ORDER BY first, second, product_id) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY first, second, product_id) AS rank
  FROM collapsed),
counts AS (
  SELECT request_id, count(product_id) AS n_attributes, count(*) FILTER (buyable) AS n_buyable,
    count(*) FILTER (in_price) AS n_price, count(*) FILTER (available) AS n_available
  FROM keyed GROUP BY 1)"""


def stage_counts(*names: str) -> str:
    return f"WITH {search_ctes(views.only(*names))} SELECT * FROM counts"


ORACLES["p2_category_filter"] = stage_counts("category")
ORACLES["p3_occasion_filter"] = stage_counts("occasion")
ORACLES["p4_recipient_filter"] = stage_counts("recipient")
ORACLES["p5_token_gate"] = stage_counts("query")
ORACLES["p6_price_band"] = stage_counts("recipient", "max_price", "min_price")
ORACLES["p7_availability"] = stage_counts("category", "include_out_of_stock")
ORACLES["p8_stage_counts"] = stage_counts(*views.SEARCH_COLUMNS)
ORACLES["j4_structured_filters"] = stage_counts(
    "category", "occasion", "recipient", "max_price", "include_out_of_stock"
)
ORACLES["j3_term_match"] = f"""
WITH {search_ctes(views.only('query'))}
SELECT request_id, count(*) AS n_products, round(max(score), 6) AS best_score
FROM keyed WHERE len(q_words) > 0 GROUP BY 1"""
ORACLES["j3_stored_index"] = ORACLES["j3_term_match"]
ORACLES["a9_search_score"] = f"""
WITH {search_ctes(views.SEARCH_COLUMNS)}
SELECT request_id, round(sum(score), 4) AS sum_score, round(max(score), 6) AS max_score,
  round(min(score), 6) AS min_score FROM keyed GROUP BY 1"""
_PAGE = 'rank > "offset" AND rank <= "offset" + "limit"'
_RELEVANCE = [name for name in views.SEARCH_COLUMNS if name not in ("sort", "limit")]
ORACLES["w2_relevance_order"] = f"""
WITH {search_ctes(views.only(*_RELEVANCE))}
SELECT request_id, rank, product_id, round(score, 6) AS score FROM ranked WHERE {_PAGE}"""
ORACLES["w3_sort_orders"] = f"""
WITH {search_ctes(views.only('query', 'sort'))}
SELECT request_id, rank, product_id FROM ranked WHERE {_PAGE}"""
ORACLES["w5_top_k"] = f"""
WITH {search_ctes(views.SEARCH_COLUMNS)}
SELECT request_id, rank, product_id, round(score, 6) AS score FROM ranked WHERE {_PAGE}"""
ORACLES["w6_offset_paging"] = f"""
WITH {search_ctes(views.BROWSE_COLUMNS, browse=True)}
SELECT request_id, rank, product_id FROM ranked WHERE {_PAGE}"""
ORACLES["w4_collapse_duplicates"] = f"""
WITH {search_ctes(views.only('query', 'category'))},
after AS (SELECT request_id, count(*) AS n_products FROM collapsed GROUP BY 1)
SELECT request_id, n_available AS n_listed, n_products FROM counts JOIN after USING (request_id)"""
_TOTALS = """
totals AS (
  SELECT r.*, coalesce(n_price, 0) AS n_price, coalesce(n_available, 0) AS n_available,
    coalesce(n_buyable, 0) AS n_buyable, coalesce(n, 0) AS total_matches
  FROM request r LEFT JOIN counts USING (request_id)
    LEFT JOIN (SELECT request_id, count(*) AS n FROM collapsed GROUP BY 1) USING (request_id)),
reasons AS (
  SELECT request_id, CASE WHEN n_available > 0 THEN NULL WHEN n_price > 0 THEN 'out_of_stock_only'
    WHEN n_buyable > 0 AND (max_price IS NOT NULL OR min_price IS NOT NULL) THEN 'budget_too_low'
    WHEN len(q_words) > 0 THEN 'no_query_match' ELSE 'over_constrained' END AS reason FROM totals)"""
ORACLES["w7_envelope"] = f"""
WITH {search_ctes(views.SEARCH_COLUMNS)}, {_TOTALS}
SELECT request_id, total_matches, least(total_matches, "limit") AS returned,
  total_matches > "limit" AS has_more, n_price - n_available AS hidden FROM totals"""
ORACLES["a11_empty_reasons"] = f"""
WITH {search_ctes(views.SEARCH_COLUMNS)}, {_TOTALS}
SELECT request_id, reason FROM reasons WHERE reason IS NOT NULL"""
ORACLES["a12_fallback_products"] = f"""
WITH {search_ctes(views.FALLBACK_COLUMNS)}, {_TOTALS},
empty AS (SELECT request_id, reason, k.* EXCLUDE (request_id) FROM reasons JOIN keyed k USING (request_id)
  WHERE reason IS NOT NULL)
SELECT request_id, 'sold_out' AS role, rank, product_id FROM (
  SELECT request_id, product_id, row_number() OVER (PARTITION BY request_id ORDER BY popularity DESC, _ord) AS rank
  FROM empty WHERE reason = 'out_of_stock_only' AND in_price)
WHERE rank <= 2
UNION ALL
SELECT request_id, 'nearest', 1, product_id FROM empty
WHERE reason IN ('out_of_stock_only', 'budget_too_low') AND buyable AND NOT in_price
  AND (max_price IS NOT NULL OR min_price IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY price_eur, _ord) = 1"""
ORACLES["x2_over_budget"] = f"""
WITH {search_ctes(views.SEARCH_COLUMNS)}
SELECT request_id, count(*) AS n_over_budget, min(price_eur) AS cheapest FROM keyed
WHERE buyable AND NOT in_price GROUP BY 1"""
_BEST = {
    "request_id": "c_custkey", "category": views.SEARCH_COLUMNS["category"],
}
ORACLES["best_per_category"] = f"""
WITH {PRODUCTS},
kept AS (SELECT * FROM products WHERE recommendable
  QUALIFY row_number() OVER (PARTITION BY category, own ORDER BY popularity DESC, product_id) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY popularity DESC, product_id) AS rank
  FROM kept)
SELECT category, rank, product_id, name, round(popularity, 6) AS popularity FROM ranked WHERE rank <= 5"""

# --- Byte budget ------------------------------------------------------------------------------

_BARE = [pair for pair in _SUMMARY if pair[0] not in ("gift_wrap", "reviews_count")]


def spaces(json: str) -> str:
    """Bytes of the JSON text, and one for a space after each separator."""
    bare = f"""regexp_replace({json}, '"[^"]*"', '', 'g')"""
    return (
        f"(octet_length(encode({json})) + length(regexp_replace({bare}, '[^,:]', '', 'g')))"
    )


ORACLES["w9_byte_budget"] = f"""
WITH {search_ctes({**views.BROWSE_COLUMNS, 'limit': '20'}, browse=True)},
pages AS (SELECT request_id, rank, {json_pairs(_SUMMARY)} AS whole, {json_pairs(_BARE)} AS bare
  FROM (SELECT request_id, rank, p.* FROM ranked r JOIN products p USING (product_id) WHERE {_PAGE})),
sized AS (
  SELECT *, sum({spaces('bare')} + CASE WHEN rank = first_rank THEN 0 ELSE 2 END)
      OVER (PARTITION BY request_id ORDER BY rank) AS upto
  FROM (SELECT *, min(rank) OVER (PARTITION BY request_id) AS first_rank FROM pages)),
-- The envelope around the products: status, returned, products, notes.
totals AS (
  SELECT request_id, count(*) AS n, sum({spaces('whole')}) + 2 * (count(*) - 1) AS whole_bytes,
    length('{{"status": "ok", "returned": , "products": [], "notes": null}}') + length(CAST(count(*) AS STRING)) AS rest
  FROM sized GROUP BY 1),
fit AS (
  SELECT request_id, n, rest + whole_bytes > 2000 AS cut,
    greatest(1, count(*) FILTER (rest + upto <= 2000)) AS kept
  FROM sized JOIN totals USING (request_id) GROUP BY ALL)
SELECT request_id, CASE WHEN cut THEN kept ELSE n END AS returned,
  '[' || string_agg(CASE WHEN cut THEN bare ELSE whole END, ',' ORDER BY rank) || ']' AS products,
  CASE WHEN cut THEN 'Response trimmed to fit the context budget: some fields omitted'
    || CASE WHEN kept < n THEN '; ' || kept || ' of ' || n || ' products shown' ELSE '' END || '.' END AS notes
FROM sized JOIN fit USING (request_id)
WHERE NOT cut OR rank - first_rank < kept
GROUP BY request_id, cut, kept, n"""

# --- Similar products ----------------------------------------------------------------------------

_SIMILAR = """
pairs AS (
  SELECT t.product_id AS request_id, c.product_id, c.own, c.popularity, c.recommendable,
    CASE WHEN c.subcategory = t.subcategory THEN 2 ELSE 0 END
      + CASE WHEN c.category = t.category THEN 1 ELSE 0 END
      + 3.0E0 * len(list_intersect(c.tags, t.tags)) / len(list_distinct(c.tags || t.tags))
      + 0.25E0 * (1 - abs(c.price_eur - t.price_eur) / greatest(c.price_eur, t.price_eur, 1)) AS score
  FROM products t JOIN products c ON c.own <> t.own
    AND (c.subcategory = t.subcategory OR list_has_any(c.tags, t.tags)))"""
_SIMILAR_RANKED = """
kept AS (SELECT * FROM pairs WHERE recommendable
  QUALIFY row_number() OVER (PARTITION BY request_id, own
    ORDER BY round(score, 9) DESC, popularity DESC, product_id) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY request_id
    ORDER BY round(score, 9) DESC, popularity DESC, product_id) AS rank FROM kept)"""
ORACLES["j5_comparable_products"] = f"""
WITH {PRODUCTS}, {_SIMILAR}
SELECT product_id AS request_id, coalesce(n, 0) AS total_matches FROM products
LEFT JOIN (SELECT request_id, count(DISTINCT own) AS n FROM pairs GROUP BY 1) s ON s.request_id = product_id"""
ORACLES["w8_similarity_rank"] = f"""
WITH {PRODUCTS}, {_SIMILAR}, {_SIMILAR_RANKED}
SELECT request_id, rank, product_id, round(score, 6) AS score FROM placed WHERE rank <= 6"""
ORACLES["j8_alternatives"] = f"""
WITH {PRODUCTS}, {_SIMILAR}, {_SIMILAR_RANKED}
SELECT request_id AS product_id, rank, product_id AS alternative FROM placed
WHERE rank <= 2 AND request_id IN (SELECT product_id FROM products WHERE stock_level = 'out_of_stock')"""
ORACLES["a10_tag_jaccard"] = f"""
WITH {PRODUCTS},
kinds AS (SELECT DISTINCT category, subcategory, list_sort(tags) AS tags FROM products)
SELECT a.category, b.category AS other, count(*) AS n_pairs,
  round(sum(1.0E0 * len(list_intersect(a.tags, b.tags)) / len(list_distinct(a.tags || b.tags))), 4) AS sum_jaccard
FROM kinds a JOIN kinds b ON a.subcategory = b.subcategory OR list_has_any(a.tags, b.tags)
GROUP BY 1, 2"""


# --- Whole responses --------------------------------------------------------------------------


def quoted(text: str) -> str:
    """A Python text as a SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def json_texts(texts: list[str]) -> str:
    return quoted("[" + ",".join(f'"{text}"' for text in texts) + "]")


def filled(template: str, **values: str) -> str:
    """A response text with SQL values in its places."""
    out = quoted(template)
    for name, value in values.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


def joined_values(kind: str) -> str:
    return f"""(SELECT string_agg('"' || value || '"', ',' ORDER BY rank) FROM ranks WHERE kind = '{kind}')"""


_CATEGORY_JSON = [
    ("name", "category", True), ("slug", "slug", True), ("product_count", "product_count", False),
    ("in_stock_count", "in_stock_count", False),
    ("price_range_eur", "'{\"min\":' || price_min || ',\"max\":' || price_max || '}'", False),
    ("subcategories", "'[' || subcategories || ']'", False),
]
ORACLES["response_categories"] = f"""
WITH {PRODUCTS}, vals AS ({_VOCABULARY}),
ranks AS (SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, value) AS rank
  FROM vals GROUP BY 1, 2),
summary AS (
  SELECT category, {slug('category')} AS slug, count(*) AS product_count,
    count(*) FILTER (recommendable) AS in_stock_count, min(price_eur) AS price_min, max(price_eur) AS price_max,
    array_to_string(list_transform(list_sort(list(DISTINCT subcategory) FILTER (subcategory IS NOT NULL)),
      lambda s: '"' || s || '"'), ',') AS subcategories
  FROM products GROUP BY category)
SELECT 'ok' AS status, '{{"status":"ok","categories":[' ||
  (SELECT string_agg({json_pairs(_CATEGORY_JSON)}, ',' ORDER BY rank)
   FROM summary JOIN ranks ON kind = 'category' AND value = category)
  || '],"filter_vocabulary":{{"occasions":[' || {joined_values('occasion')} || '],"recipients":['
  || {joined_values('recipient')} || ']}},"notes":' || {json_texts(say.CATEGORIES_NOTES)} || '}}' AS response"""
_DETAILS_JSON = [
    ("status", "status", True), ("message", "message", True), ("product", "product", False),
    ("alternatives", "alternatives", False), ("notes", "notes", False),
]
ORACLES["response_details"] = f"""
WITH {PRODUCTS}, {_SIMILAR}, {_SIMILAR_RANKED}, {request_rows(views.SIMILAR_COLUMNS)},
others AS (
  SELECT request_id AS product_id, '[' || string_agg(summary, ',' ORDER BY rank) || ']' AS alternatives
  FROM placed JOIN (SELECT product_id, {json_pairs(_SUMMARY)} AS summary FROM products) USING (product_id)
  WHERE rank <= {fixed.DETAIL_ALTERNATIVES} GROUP BY 1),
facts AS (
  SELECT product_id, {json_pairs(_SUMMARY + _DETAIL)} AS product, stock_level = 'out_of_stock' AS gone, name,
    CASE WHEN stock_level = 'out_of_stock' THEN alternatives END AS alternatives
  FROM products LEFT JOIN others USING (product_id)),
told AS (
  SELECT r.request_id, CASE WHEN name IS NULL THEN 'not_found' ELSE 'ok' END AS status,
    CASE WHEN name IS NULL THEN {filled(say.NOT_FOUND, requested='r.product_id')}
      WHEN gone THEN {filled(say.DETAIL_SOLD_OUT, name='name')} END AS message,
    product, alternatives,
    CASE WHEN name IS NULL THEN {json_texts([say.NOT_FOUND_NOTE])}
      WHEN gone THEN {json_texts([say.DETAIL_SOLD_OUT_NOTE])} END AS notes
  FROM raw_requests r LEFT JOIN facts p ON p.product_id = upper(replace(trim(r.product_id), ' ', '')))
SELECT request_id, status, {json_pairs(_DETAILS_JSON)} AS response FROM told"""
