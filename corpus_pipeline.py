"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Each stage works on all rows of the stage before, whole texts.  What holds for every stage: rows with a null id or a null text are
worked on like others; further columns of documents, whatever their names, are kept as they are (the last
stage returns columns of its own); a stage on an empty table returns an empty one with the same columns.  Tables
that a stage makes on its way are deleted when its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelake.llm import bpe, decontaminate, near_dup, suffix_dedup, toxicity
from voxelake.llm.common import documents, drop, persisted_at, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  A null or empty text is never rejected; repeated rows are judged alike;
    without labels of both kinds all stay; a text of any length is judged by its most toxic window."""
    return toxicity.remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the least id (null ids last; of one id the least hashes; of
    equal rows one).  Texts without a word all stay."""
    return near_dup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stood earlier go; every document stays, with an empty text if all of it stood before.  A null text
    becomes an empty one; rows of one id and text are one document; rows without an id come last, each a document of its own; n_chars follows the text."""
    return suffix_dedup.remove_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go, repeated rows all; an empty benchmark removes nothing; null and empty texts stay;
    items with a null id count."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining text as token ids, decoded again: doc_id, n_tokens, ids_sha256, decoded_sha256, a row for each row.  A null
    text is encoded as an empty one."""
    return bpe.report(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]
#: No stage before the last can be put in SQL; tests hold the pipeline against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for i, (name, stage) in enumerate(STAGES):
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            done, path = persisted_at(made, f"stage{i}-{name}", kept=True)
        if before is not None:
            drop(spark, before)
        docs, before = done, path
    return docs
