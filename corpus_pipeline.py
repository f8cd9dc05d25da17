"""Training documents from raw ones: five operators, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. All but the last return the columns of documents. Further columns
of any names are carried along by these, and an empty table stays empty through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrastat.llm import catalog, common, decontaminate, exact_dedup, language, sentences, simhash


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and near enough to it; learned as in the query.

    NULL and empty texts and those without a letter go. What is decided depends on the text alone, so
    rows that repeat a text, ties included, stay or go together; without a labelled row all go.
    """
    model = language.fit(docs, catalog.fold("doc_id", 4) != 2)
    found = language.predict(docs, model)
    return found.filter(~found[found.columns[-1]]).select(*[common.col(c) for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, white space apart, the one with the smallest identifier.

    A NULL identifier comes last; rows that repeat identifier and text are one.
    """
    return exact_dedup.first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest identifier of each group of near fingerprints.

    Texts without words have one fingerprint and are one group. A NULL identifier comes last, and
    among rows that share an identifier the smallest text hash decides.
    """
    return simhash.first_of_groups(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; rows that repeat stay or go together.

    Texts are searched whole, however long. Without benchmark items every document stays.
    """
    return decontaminate.clean_rows(docs, catalog.read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, checked by decoding: doc_id, n_tokens, both digests, ids.

    A row for each row: begin and end ids only for an empty text, NULL identifiers carried along.
    """
    return sentences.digests(docs, catalog.sentence_pieces(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("sentencepiece", tokenize),
]

#: The stages are a fitted model, fingerprints, a fuzzy search and a tokenizer: not to be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage's result is a written table."""
    docs = catalog.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
