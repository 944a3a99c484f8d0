import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tillcast.session import get_session
    return get_session("local[8]", 8, app_name="tillcast-llm-tests")


@pytest.fixture(scope="session")
def docs():
    import pandas as pd
    return pd.read_parquet(f"{SF}/documents.parquet")


def rows(df, key):
    return {r[key]: r for r in df.collect()}


#: documents with every awkward case: nulls, empties, ties, repeated rows, long texts, other scripts
EDGE = [
    (None, "one two three four five six seven", "x"), (None, None, None), (1, "", "x"), (2, None, "x"),
    (3, " \t\n ", "x"), (4, "One two THREE", "y"), (5, "one TWO three", "y"), (5, "one TWO three", "y"),
    (6, "ÉCOLE été 日本語 text with  spaces here", "z"), (7, "w " * 30_000, "z"),
    (8, " ".join(f"v{i % 977}x{i % 31}" for i in range(40_000)), "z"), (9, "a\nb\nc\n\na\nb\nc\nd", "z"),
    (10, "a\nb\nc", "z"), (10, "b\nc\nd\ne", "z"), (11, "\n\n\n", "z"),
]


@pytest.fixture(scope="session")
def edge(spark):
    schema = "doc_id long, text string, source string, score double, component_id long, n_lines int, fp long, low long, rest string"
    return spark.createDataFrame([(a, b, c, 0.5, 1, 2, 3, 4, "r") for a, b, c in EDGE], schema)
