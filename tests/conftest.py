import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tallymark.session import build_session

    session = build_session(4, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def texts(spark):
    """Texts as a document table with doc_id 0, 1, ..."""

    def make(*values):
        return spark.createDataFrame(list(enumerate(values)), "doc_id int, text string")

    return make


@pytest.fixture
def column(spark):
    """Values of a Column expression over one string column ``s``."""

    def run(expr, values, schema="i int, s string"):
        df = spark.createDataFrame(list(enumerate(values)), schema)
        return [r[1] for r in sorted(df.select("i", expr).collect(), key=lambda r: r[0])]

    return run
