import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from daftar.session import local_session

    session = local_session("tests", cores="8", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def as_lines(spark):
    """Documents given as {id: [text, …]} to a table of lines."""

    def make(docs: dict[str, list[str]]):
        rows = [(d, i, t) for d, texts in docs.items() for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id string, line_no int, text string")

    return make
