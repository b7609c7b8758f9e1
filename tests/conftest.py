import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Evaluate a column expression over texts."""

    def run(expression, texts):
        rows = [(i, text) for i, text in enumerate(texts)]
        df = spark.createDataFrame(rows, "i long, x string")
        return [r.y for r in df.select("i", expression.alias("y")).orderBy("i").collect()]

    return run
