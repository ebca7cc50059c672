"""The corpus pipeline: quality rules, language identification, near-duplicate removal, packing.

Every stage works on all rows its predecessor kept. Defined cases are those of the operators: a null or empty
text fails the quality rules; a text without letters is rejected by language identification, and so is every text
where no row has both a language and a text to learn from; of each group of near duplicates (five-word shingles,
similarity 0.8) the row with the smallest doc_id stays, and of rows that repeat it one; rows without a doc_id are
compared with none and stay. Texts are read whole, however long. An empty table gives no rows. All but the last
stage return the caller's columns with the caller's values, also where a name is one that a stage's operator
writes. The last stage returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import jaccard, langid, packing, quality
from packetloom.llm.common import materialize, read_table
from packetloom.llm.queries import tokenizer_path


def _aside(docs: DataFrame, made: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """docs with the columns out of the way that an operator would overwrite, and what restores docs' columns."""
    moved = {c: f"{c}_of_caller" for c in docs.columns if c in made}
    return docs.withColumnsRenamed(moved), [F.col(moved.get(c, c)).alias(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, columns = _aside(docs, ("kept", "failed_rule", "rules_run"))
    return quality.quality_cascade(rows).where("kept").select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, columns = _aside(docs, ("lang_pred", "score", "accepted"))
    return langid.identify(rows, langid.fit(docs)).where("accepted").select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, columns = _aside(docs, ("text_hash_",))
    return jaccard.keep_one(rows, k=5, percent=80).select(*columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), keep_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("packing", pack_sequences),
]

#: Language identification has no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs
