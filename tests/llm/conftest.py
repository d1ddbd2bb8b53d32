import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from equiscope.session import local_session
    return local_session(cpus=4, shuffle_partitions=4, app="equiscope-tests")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, a column named like a new one."""
    long = " ".join(f"word{i % 97}" for i in range(30_000))
    rows = [(1, "a b c d e f g", "s", "x"), (2, "a  b c d e f\tg", "s", "x"), (2, "a  b c d e f\tg", "s", "x"), (3, None, None, None), (4, "", "s", "x"), (None, "only", None, "x"),
            (5, long, "t", "x"), (6, long + " more", "t", "x"), (7, " \t\n", "t", "x"), (8, "Grüße 12 €", "é", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string")
