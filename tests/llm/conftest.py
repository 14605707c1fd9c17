import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from docket.session import build_session
    return build_session(master="local[*]", shuffle_partitions=8)


@pytest.fixture(scope="session")
def docs(spark):
    """Whole documents table of the middle size, as rows."""
    return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
            .select("doc_id", "text").collect()]


EDGE = [(1, None, "s", "x"), (2, "", None, "x"), (3, "word", "s", None), (None, "a b c d", "t", "y"),
        (5, "a b c d", "t", "y"), (5, "a b c d", "t", "y"), (7, "Straße ÉTÉ ́x \x1c y\x85z\n\n", "t", "y"),
        (8, "long words here " * 40_000, "t", "y"), (9, "same text again and again " * 30, "t", "y"),
        (10, "same text again and again " * 30, "t", "y"), (11, "\n \t ", "s", "z")]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, clashing extra columns."""
    rows = [(d, t, lang, src, 0 if t is None else len(t), "a", 1, 2.0) for d, t, src, lang in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                                 "n_chars long, size string, key int, h double")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")
