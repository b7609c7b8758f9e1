import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, fp long, n int"


@pytest.fixture(scope="session")
def corpus(spark):
    """Odd documents: null, empty, only white space, very long, copies, near copies, a repeated row.

    Extra columns have names that the operators use inside.
    """
    chance = random.Random(3)
    syllables = ["an", "ter", "ou", "the", "is", "re", "and", "lo", "mi", "ka"]

    def prose(n):
        return " ".join("".join(chance.choices(syllables, k=chance.randint(1, 3))) for _ in range(n))

    base = prose(200)
    texts = [None, "", " \n\t ", "one", "One  one\none", "é🙂 é🙂", prose(20_000)]
    texts += [base, base, base.replace(" ", "\n", 3), base + " extra"]
    texts += [prose(chance.randint(1, 300)) for _ in range(60)]
    rows = [(k, t, chance.choice(["en", "de", None]), chance.choice(["a", "b", None]), 0, 1, 2, 3) for k, t in enumerate(texts)]
    rows += [rows[7], (None, base, "en", "a", 0, 1, 2, 3), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(k, int(k % 5 != 0), int(k % 7 == 0)) for k in range(0, 70, 2)] + [(2, 1, 0), (None, 1, 0), (4, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
