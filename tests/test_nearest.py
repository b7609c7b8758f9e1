import difflib
import random

import pytest

from shelfspark.operators.nearest import closest

SHELVES = ["Home & Living", "Kitchen", "Games", "Garden Tools", "Gift Cards", "Tea"]


def suggestions(spark, needles, values):
    candidates = spark.createDataFrame(list(enumerate(values)), "at long, candidate string")
    wanted = spark.createDataFrame([(n,) for n in needles], "requested string")
    found = {n: [] for n in needles}
    for row in sorted(closest(wanted, "requested", candidates).collect(), key=lambda r: r["rank"]):
        found[row.requested].append(row.candidate)
    return found


def test_written_out_suggestions(spark):
    expected = {
        "kitchin": ["Kitchen"],
        "GAMES": ["Games"],
        "gamse": ["Games"],
        "home": ["Home & Living"],
        "gard": ["Garden Tools"],
        "gift box": ["Gift Cards"],
        "tee": ["Tea"],
        "a cup of tea": ["Tea"],
        "": [],
        "  ": [],
        "zzzz": [],
    }
    assert suggestions(spark, expected, SHELVES) == expected


def test_suggestions_have_the_properties_they_should(spark):
    """Close spellings first, best first; then only values that contain, are contained, or begin alike."""
    rnd = random.Random(11)
    words = ["lamp", "lamps", "garden", "home", "glass", "gift", "giftbox", "ring", "tea", "table"]
    values = list(dict.fromkeys(" ".join(rnd.sample(words, rnd.choice([1, 2, 3]))).title() for _ in range(60)))
    needles = {"g", "ho", "gift", "homeware", "zzzz", "the old garden table", "x-9"}
    for value in values:
        letters = list(value.lower())
        for _ in range(rnd.choice([0, 1, 2, 4])):
            letters[rnd.randrange(len(letters))] = rnd.choice("abcdeghilmnrst ")
        needles.add("".join(letters))

    for needle, found in suggestions(spark, needles, values).items():
        asked = needle.strip().lower()
        alike = {v: difflib.SequenceMatcher(None, v.lower(), asked).ratio() for v in values}
        close = [v for v in values if alike[v] >= 0.6]
        assert len(found) <= 3 and len(set(found)) == len(found)
        first, rest = found[: len(close)], found[len(close) :]
        assert [alike[v] for v in first] == pytest.approx(sorted(alike.values(), reverse=True)[: len(first)])
        related = [
            v for v in values
            if v not in first and (asked in v.lower() or v.lower() in asked or v.lower().split()[0].startswith(asked[:4]))
        ]
        assert rest == related[: 3 - len(first)], needle
