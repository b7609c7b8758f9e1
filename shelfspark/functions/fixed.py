"""Limits, word lists and weights that results must agree on."""

# Length and range caps applied while cleaning.
MAX_NAME_CHARS = 120
MAX_BRAND_CHARS = 80
MAX_ATTRIBUTE_CHARS = 60
MAX_DESCRIPTION_CHARS = 600
MAX_PITCH_CHARS = 140
MAX_LIST_ITEMS = 12
MAX_LIST_ITEM_CHARS = 40
MAX_PRICE_EUR = 1_000_000.0
IMPLAUSIBLE_SHIPPING_DAYS = 60

# Columns of a product export.
REQUIRED_COLUMNS = ["product_id", "name", "category", "price_eur"]
OPTIONAL_COLUMNS = [
    "subcategory", "brand", "stock", "rating", "reviews_count", "recipient",
    "occasion", "tags", "color", "material", "gift_wrap", "shipping_days",
    "description",
]

# Spellings of yes and no.
YES_WORDS = ["yes", "y", "true", "t", "1", "si", "sì"]
NO_WORDS = ["no", "n", "false", "f", "0"]

# Function words that never count as search terms.
STOPWORDS_ENGLISH = """
a an and are as at be but by for from in is it its of on or that the then this
to was which with you your
""".split()
STOPWORDS_SPANISH = """
al algo como con cual cuando de del donde el ella ellos en era es esa ese eso
esta este esto hay la las le les lo los mas me mi mis muy nos para pero por
porque que se ser si sin sobre son su sus tambien tiene tienen un una unas uno
unos ya yo
""".split()

# Plurals that no suffix rule reaches, and the suffix rules.
IRREGULAR_PLURALS = {
    "knives": "knife",
    "leaves": "leaf",
    "shelves": "shelf",
    "children": "child",
}
SUFFIX_PATTERN = r"^(.{3,}?)(?:ing|ed|es|(?<!s)s)$"
DOUBLED_PATTERN = r"^(.{2,})([^aeiouy])\2$"
SILENT_E_PATTERN = r"^(.{3,})e$"

# Page sizes (default, maximum) per operation.
SEARCH_LIMITS = (5, 12)
BROWSE_LIMITS = (8, 20)
SIMILAR_LIMITS = (3, 6)
DETAIL_ALTERNATIVES = 2

# Stock levels that may be recommended.
RECOMMENDABLE = ["in_stock", "low", "unknown"]

# What one matching term is worth, by the field it is found in.
TOKEN_WEIGHTS = {"name": 3.0, "tag": 2.0, "any": 1.0}
STEM_WEIGHTS = {"name": 1.5, "tag": 1.0, "any": 0.5}

# The bonuses of a search score.
OCCASION_BONUS = 2.0
RECIPIENT_BONUS = 1.5
CATCH_ALL_RECIPIENT = "anyone"
BUDGET_TIERS = [(0.7, 1.0, 1.0), (0.4, 0.7, 0.5)]
LOW_STOCK_PENALTY = 1.0
POPULARITY_BONUS = 0.5

# The weights of a similarity score.
SIMILAR_SUBCATEGORY = 2.0
SIMILAR_CATEGORY = 1.0
SIMILAR_TAGS = 3.0
SIMILAR_PRICE = 0.25

# Nearest-string suggestions.
CLOSE_RATIO = 0.6
MAX_SUGGESTIONS = 3

# Size of one response.
MAX_RESPONSE_BYTES = 12_288
SHORT_PITCH_CHARS = 90

# The orders that a search and a category page can be asked in.
SEARCH_SORTS = ["relevance", "price_asc", "price_desc", "rating"]
BROWSE_SORTS = ["popularity", "price_asc", "price_desc", "rating"]
