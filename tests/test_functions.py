import html
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import fields, numbers, spanish, text
from shelfspark.functions.phrases import short_number



def check(evaluate, expression, cases):
    assert evaluate(expression, list(cases)) == list(cases.values())


def test_clean_text(evaluate):
    check(evaluate, text.clean_text(F.col("x")), {
        None: "", "  a\t b ": "a b", "<b>Bold</b> &amp; <i>thin</i>.": "Bold & thin.",
        "&lt;b&gt;x": "<b>x", "ﬁne print​!": "fine print!", "a\x07b\x0bc": "a b c",
        "line\r\nnext": "line next",
    })


def test_money(evaluate):
    check(evaluate, numbers.parse_money(text.clean_text(F.col("x"))), {
        "42.00": 42.0, "  42  ": 42.0, "€1.234,56": 1234.56, "1,234.56": 1234.56, "EUR 89": 89.0,
        "6,5": 6.5, "banana": None, "": None, "-5.00": None, "99999999999": None,
        "1.234.567": None, "1,234": 1234.0, "+7": 7.0, "inf": None, "1f": None, "2.675": 2.67,
        "1.000.5": 10005.0, "1e3": 1000.0, "1_0": 10.0, "12,,": 12.0, "1,2,": 12.0, "12,5,": 125.0,
    })


def test_other_numbers(evaluate):
    check(evaluate, numbers.parse_int(text.clean_text(F.col("x"))), {
        "1,234": 1234, "7.9": 7, "-3": -3, "N/A": None, "1_000": 1000, "inf": None, "": None})
    check(evaluate, numbers.parse_float(text.clean_text(F.col("x"))), {
        "4,6": 4.6, "9.5": 9.5, "1,2.5": None, "nan": None, "": None})
    check(evaluate, numbers.parse_bool(text.clean_text(F.col("x"))), {
        "yes": True, "Y": True, "TRUE": True, "sì": True, "no": False, "0": False, "maybe": None, "": None})


def test_rounding_matches_binary_value(spark):
    rnd = random.Random(7)
    values = [0.125, 2.675, 4.25, 4.35, 0.0, 999999.995] + [
        round(rnd.uniform(0, 1000), rnd.choice([2, 3, 4])) for _ in range(3000)
    ]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", numbers.round_exact(F.col("x"), 2).alias("a"), numbers.round_exact(F.col("x"), 1).alias("b"))
    for row in got.collect():
        assert (row.a, row.b) == (round(row.x, 2), round(row.x, 1)), row.x


def test_split_multi(evaluate):
    check(evaluate, fields.split_multi(text.clean_text(F.col("x"))), {
        "a|b|c": ["a", "b", "c"], "a; b ;c": ["a", "b", "c"], "a/b": ["a", "b"], "Single": ["single"],
        "a|a|b": ["a", "b"], "": [], "|||": [], "b,a/c": ["b", "a/c"], "x &amp;amp; y|z": ["x & y", "z"],
        ",".join(f"t{i}" for i in range(20)): [f"t{i}" for i in range(12)],
    })


def test_truncate(evaluate):
    """Limit 30: whole texts, a cut after a sentence in the last two thirds, else after a word."""
    cases = {
        "short": ("short", False),
        "exactly thirty characters long": ("exactly thirty characters long", False),
        "One sentence here. Another one that is long": ("One sentence here.", True),
        "Is it so? Well. Then it goes on and on": ("Is it so? Well.", True),
        "A. Then only words that follow each other": ("A. Then only words that…", True),
        "words, words, words and then, some, more": ("words, words, words and then…", True),
        "a" * 50: ("a" * 30 + "…", True),
    }
    got = evaluate(text.truncate(F.col("x"), 30), list(cases))
    assert [(g.text, g.cut) for g in got] == list(cases.values())


def test_truncate_keeps_a_prefix_that_ends_at_a_boundary(evaluate):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab é.!?,;- ") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    texts = [" ".join(t.split()) for t in texts]
    for value, got in zip(texts, evaluate(text.truncate(F.col("x"), 30), texts)):
        assert got.cut == (len(value) > 30)
        kept = got.text.removesuffix("…") if got.cut else got.text
        assert value.startswith(kept) and len(kept) <= 30
        if not got.cut:
            assert kept == value
        elif not got.text.endswith("…"):
            assert kept[-1] in ".!?" and value[len(kept)] == " " and len(kept) > 10
        elif " " in value[1:30]:
            # Cut at a space, whatever punctuation stood before it.
            assert value[len(kept) :].lstrip(",;:-")[:1] in (" ", "")


def test_slug_id_and_category_key(evaluate):
    check(evaluate, text.slugify(F.col("x")), {"Home & Living": "home-living", "Café—Crème": "cafecreme",
                                      "###": "uncategorised", "straße": "strae"})
    check(evaluate, text.product_id(text.clean_text(F.col("x"))), {" hl- 003 ": "HL-003", None: ""})
    check(evaluate, text.category_key(text.clean_text(F.col("x"))), {
        " Home & Living": "home & living", "Home and Living": "home & living", "home&living": "home & living"})


def test_tokens(evaluate):
    got = evaluate(text.tokens(F.col("x")), ["Juegos de mesa", "acupresión", "té", "A b cd, CD!", "Straße 12"])
    assert [sorted(g) for g in got] == [["juegos", "mesa"], ["acupresion"], ["te"], ["cd"], ["12", "strae"]]


@pytest.mark.parametrize("family", [
    ("bake", "baking", "baked"), ("knife", "knives"), ("glass", "glasses"), ("run", "running"),
    ("box", "boxes"), ("candle", "candles"), ("dish", "dishes")])
def test_stems_agree(evaluate, family):
    assert len(set(evaluate(text.stem(F.col("x")), list(family)))) == 1


@pytest.mark.parametrize("pair", [
    ("bread", "breeze"), ("glass", "glaze"), ("ring", "rinse"), ("card", "care"), ("board", "boar")])
def test_stems_differ(evaluate, pair):
    assert len(set(evaluate(text.stem(F.col("x")), list(pair)))) == 2


def test_accents_fold_like_a_decomposition(evaluate):
    chars = [chr(c) for c in range(0xC0, 0x250)]
    plain = [unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in chars]
    single = [(c, p) for c, p in zip(chars, plain) if len(p) <= 1]
    assert evaluate(text.fold_accents(F.col("x")), [c for c, _ in single]) == [p for _, p in single]


def test_glossaries(evaluate):
    check(evaluate, spanish.translate_color(F.col("x")), {"Red": "Rojo", "Mauve": "Mauve", None: None})
    check(evaluate, spanish.translate_material(F.col("x")), {"Steel, oak": "Acero, roble", "moon,glass": "Moon, vidrio"})
    check(evaluate, spanish.search_terms(F.col("x")), {"Board Games": "juegos de mesa", "Nothing": ""})


def test_display_order(evaluate):
    check(evaluate, text.title_case_score(F.col("x")), {"Home And Living": 3, "home & living": 0, "": 0})


def test_json_size(evaluate):
    check(evaluate, fields.spaced_json_bytes(F.col("x")), {
        '{"a":1,"b":"x,y:z"}': len('{"a": 1, "b": "x,y:z"}'),
        r'{"a":"q\",\":"}': len(r'{"a": "q\",\":"}'), '["é"]': 6})


def test_short_numbers(spark):
    values = [68.0, 6.5, 1234.56, 0.01, 12345.67, 123456.78, 999999.99, 100.0, 1000000.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r.y for r in df.select(short_number(F.col("x")).alias("y")).collect()] == [f"{v:g}" for v in values]


def test_text_that_normalisation_cannot_change_stays_in_the_jvm(spark):
    """Settled characters stay as they are in any company; all others are seen as unsettled."""
    chance = random.Random(2)
    settled = [chr(c) for low, high in text.settled_ranges() for c in range(low, high + 1)]
    for _ in range(200):
        line = "".join(chance.choices(settled + ["a", " "], k=200))
        assert unicodedata.normalize("NFKC", line) == line
    assert {"é", "ß", "€", "–", "“", "ñ", "ж", "中"} <= set(settled)
    odd = ["e\u0301", "\u1100\u1161", "ﬁ", "½", "\u212b", "x\xa0y", "ª", "가\u11a8", "𝐀", "q\u0323\u0307", "…", "™"]
    rows = spark.createDataFrame([(x,) for x in [*odd, "Café – “ß” 12 €", "plain"]], "x string")
    found = rows.select("x", text.unsettled(rows.x).alias("odd"), text.nfkc(rows.x).alias("y")).collect()
    assert all(r.y == unicodedata.normalize("NFKC", r.x) for r in found)
    assert [r.x for r in found if not r.odd] == ["Café – “ß” 12 €", "plain"]


def test_ampersands_that_begin_no_entity(evaluate):
    cases = ["a & b", "a &amp; b", "&", "&;", "x&&lt;", "&<b>amp;", "AT&T", "&#65;", "R&D &eacute", "é & ü"]
    expected = [text_module_clean(x) for x in cases]
    assert evaluate(text.clean_text(F.col("x")), cases) == expected


def text_module_clean(value):
    value = html.unescape(re.sub("<[^>]+>", " ", unicodedata.normalize("NFKC", value)))
    return re.sub(r" +([.,;:!?])", r"\1", re.sub(r"\s+", " ", value)).strip()
