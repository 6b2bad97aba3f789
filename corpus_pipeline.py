"""The training-data pipeline: documents in, packed sequences out.

Every stage works on what the one before kept, written as Parquet to the shared
folder and read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from testfloor.llm import decontaminate, language, neardup, packing, pii
from testfloor.llm.queries import END_ID, SEQUENCE_TOKENS, table, tokenizer_file, trained
from testfloor.llm.registry import query
from testfloor.session import materialize

MIN_LANGUAGE_SCORE = 0.4

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language is a guess.

    The model learns from the labelled documents among ``docs``. Without any, no document has a language and none stays.
    """
    judged = language.predict(docs, trained(docs))
    return judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates (five-word shingles, similarity 0.8).

    Repeated rows of a doc_id become one; rows without a doc_id stay.
    """
    kept = neardup.groups(docs, k=5, percent=80).filter("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).union(docs.filter("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item."""
    found = decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts; n_chars follows the new text."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 2048 tokens."""
    cut = packing.pieces(docs.select("doc_id", "text"), tokenizer_file(), END_ID, SEQUENCE_TOKENS, with_ids=False)
    return packing.assign(cut, SEQUENCE_TOKENS)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

# Training a model, similarity joins and tokenizers are beyond SQL.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
