from __future__ import annotations

import pytest

AWKWARD = [
    (1, None, "en", "s0", 0), (2, "", None, None, None), (3, "one", "en", "s1", 3), (3, "one", "en", "s1", 3), (None, "word " * 60, "xx", "s0", 300),
    (4, "the cat of the hill and " * 3000, "en", "s0", 1), (5, "\n\n  \t", "de", "s2", 5), (6, "é漢😀 " * 50, "fr", "s0", 200),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, very long and repeated texts, and columns with names that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"size": F.lit(1), "score": F.lit("x"), "n_words": F.lit(None).cast("int"), "copies": F.lit(2), "ids": F.lit("y"), "rank": F.lit(0)})


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
