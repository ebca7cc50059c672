"""The pipeline's stages on nulls, empty tables, repeated rows and columns whose names clash."""

import random

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    word = lambda v: "".join(r.choice("bdklmnprst") + r.choice(v) for _ in range(r.randint(1, 3)))
    text = lambda v: " ".join(word(v) for _ in range(60))
    rows = [(i, text("aio" if i % 2 else "eu"), ("it" if i % 2 else "fr") if i % 3 else None) for i in range(60)]
    rows += [(100, None, "it"), (101, "", "fr"), (102, "  \n", None), (None, text("eu"), None), (3, rows[3][1], "it"), (103, rows[4][1] + " coda", "fr"), (104, text("aio") + " sotto" * 2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(f"own {c}") for c in ("kept", "failed_rule", "rules_run", "lang_pred", "score", "accepted", "text_hash_")})


def test_stages_keep_the_callers_columns(spark, docs):
    import corpus_pipeline

    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, "")
        assert out.schema.names == docs.schema.names, name
        for r in out.collect():
            assert all(r[c] == f"own {c}" for c in docs.columns[5:])
        rows = out
    ids = [r.doc_id for r in rows.collect()]
    assert not {100, 101, 102, 103} & set(ids) and ids.count(3) == 1 and None in ids and 4 in ids
    pieces = corpus_pipeline.pack_sequences(spark, rows, "").collect()
    assert {p.doc_id for p in pieces} == set(ids)


def test_empty_table_and_nothing_to_learn_from(spark, docs):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").count() == 0
