"""A training corpus in five stages: quality, near-duplicates, decontamination, mixing, token file.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes every stage's rows as Parquet into the shared folder and reads them again for the next.

Defined results of every stage: a null or empty text is a text without words, a null id or source a value of its own,
very long texts are read whole; rows that are there twice are treated alike (near_duplicates keeps one of them); an empty
table stays empty; further columns come back as they were, whatever their names (token_file has columns of its own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm.common import fresh_path, table, written
from quarrymill.llm.decontaminate import drop_contaminated
from quarrymill.llm.mixing import mix
from quarrymill.llm.near_copies import near_copy_groups
from quarrymill.llm.quality import features, fit_on_labels, keep_good
from quarrymill.llm.simhash import keep_one_of_each_group
from quarrymill.llm.token_file import read_tokens, write_tokens

#: SQL can't express the discriminant, XXH64 fingerprints, tokenizers or rANS; tests hold the rows against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.7) go; it is fitted on the labelled ones of these documents.

    Only the measured statistics are joined with the labels, so no text is shuffled; a text is measured twice.
    """
    measured = written(features(docs), "features")
    model = fit_on_labels(measured, table(spark, sf_dir, "labels"))
    return keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Documents are linked at a similarity of 0.8 or more of their sets of five-word shingles, by wide SimHashes with Golay keys.
    """
    return keep_one_of_each_group(docs, near_copy_groups(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word in an occurrence of a benchmark window go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their target sizes."""
    return mix(docs)


def token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus as a token file, read back: id, start, n_tokens and checksum of every entry."""
    path = fresh_path(spark, "corpus_tokens")
    write_tokens(docs, path)
    return read_tokens(spark, path).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_file", token_file),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
