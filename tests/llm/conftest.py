import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

#: Texts for edge cases: null, empty, white space, no letters, repeated rows, a very long one.
LONG = "lorem ipsum dolor sit amet consectetur " * 20_000
TEXTS = [(1, "The quick brown fox jumps over the lazy dog again and again today."), (2, None), (3, ""), (4, " \n\t "), (5, "1234 !!"), (6, "The quick brown fox jumps over the lazy dog again and again today."), (7, LONG), (8, "é漢字 🎉 <|im_end|> ▁x"), (8, "é漢字 🎉 <|im_end|> ▁x"), (None, "a row without an id")]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Edge cases, with extra columns whose names clash with results."""
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return df.withColumns({"lang": F.when(F.col("doc_id") < 5, "en"), "score": F.lit("clash"), "ids": F.lit(1), "shard": F.lit("x"), "kept": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long"), "length": F.lit(0), "part": F.lit(3)})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
