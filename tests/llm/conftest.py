import random

import pytest

EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, spans string, kept boolean, id long, first int, best double"


@pytest.fixture(scope="session")
def edge(spark):
    """Rows that operators must not stumble over: nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    rng = random.Random(5)
    words = ["le", "and", "Über", "naïve", "x" * 30, "42", "a@b.co", "\u4e2d\u6587", "🙂"]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    texts = [None, "", " \n\t", "one", "one", "same text for two rows that are equal", "same text for two rows that are equal", long, long + " end", "no\x00nul ÿ", "!!! ???"]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None, 7, "x", True, 1, 2, 0.5) for i, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    rows.append((None, "a row without an id", "en", "s1", 1, 7, "x", True, 1, 2, 0.5))
    return spark.createDataFrame(rows, EDGE_SCHEMA)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
