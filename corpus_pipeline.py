"""A corpus pipeline: five stages over the documents table, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wakeline.llm import bpe, exact, langid, mixing, queries, simhash
from wakeline.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty ones too), and those that fit no learned language, go.

    The models learn from docs' own labels. Repeated rows are judged alike; an empty table gives no rows.
    """
    return langid.accepted(docs, langid.fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays, once; null counts as empty, a null id as smallest."""
    return exact.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are similar by five-word shingles (0.8 or more) the one with the smallest doc_id stays.

    SimHash bits find candidates, exact Jaccard similarity decides; groups are connected components. Rows without an
    id stay. Repeated rows of one id stay or go together; null and empty texts are alike; an empty table gives no rows, columns
    of any name pass.
    """
    return simhash.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat as often as the mix takes them; those that it doesn't take go. A null source is one source.

    Rows of one id are taken alike (rows without one are one id); texts without words, null ones too, are of size 0; an empty
    table gives no rows, columns of any name pass.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each taken document, with digests of the ids and of the text decoded from them; a row for each copy.

    A null text counts as empty and has no ids, a null id stays null, ids are numbers; an empty table gives no rows.
    """
    return bpe.bpe_encode(docs, queries.tokenizer_path(), decoded=False)


STAGES = [
    ("language", language),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mix),
    ("bpe", encode),
]

#: No SQL: language models, fingerprints and merges are not SQL's; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table; each but the last is written to the shared folder and read again.

    Odd rows are treated as each stage says; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
