"""The corpus pipeline: five stages, each written as Parquet and read again.

Every stage but the last returns rows of ``documents`` with all their columns;
the last returns doc_id, n_tokens, ids and round_trip.

Defined results, for all stages: an empty table stays empty; rows that repeat
are each a row until the second stage keeps one of them; columns beyond those of
``documents`` are carried along whatever their names; texts of any length are
read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isobar.llm import decontaminate, exact_dedup, language_id, pieces, simhash
from isobar.llm.text import table
from isobar.session import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known; the classifier learns from the rows given.

    Null texts, texts without a letter and texts far from every language go.  Of
    equally near languages the first by name is taken.  Rows without lang teach
    nothing; without any taught language all rows go.
    """
    return language_id.drop_rejected(docs, language_id.fit_documents(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id.

    Texts that differ in A-Z against a-z only are equal, null ones count as
    empty.  A null doc_id is smaller than any other; of rows that agree in
    doc_id and text one (any) stays.
    """
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id.

    Groups are chains of fingerprints at 3 or fewer differing bits; texts without
    words have the fingerprint zero and are one group.  A null doc_id is larger
    than any other; of rows that repeat the smallest doc_id one stays.
    """
    return simhash.keep_representatives(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of a benchmark item.

    Null texts have no words and stay, as do all rows if the benchmark is empty;
    items without words have no window.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each text, and whether decoding gives the text back.

    A null text has no ids and comes back as an empty one.
    """
    return pieces.encode(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash", near),
    ("decontaminate", benchmark_free),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the classifier, SimHash or SentencePiece; tests use brute force.
ORACLE_SQL: str | None = None

QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
