import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpus_tables import edge_rows, frame  # noqa: E402


@pytest.fixture(scope="session")
def edges():
    return edge_rows()


@pytest.fixture(scope="session")
def edge_docs(spark, edges):
    return frame(spark, edges).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, [])
