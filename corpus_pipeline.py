"""The corpus pipeline: stages over documents, each written and read again before the next one.

Every stage works on all that the one before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sextant.llm import jaccard, linededup, mixing, packing, toxicity
from sextant.llm.base import written


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distances reject go.

    Null, empty and wordless texts score what no evidence gives and stay; whole texts are scored, however
    long; repeated rows go or stay alike; an empty table stays empty; other columns stay as they are.
    """
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, up to two edits, go; so do documents of which nothing is left.

    Null and empty texts stay; rows whose id is null or repeats keep their lines; ties go by id, then by
    line; very long texts are split like others; an empty table stays empty; other columns stay, n_chars
    is counted anew.
    """
    return linededup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one stays.

    That with the smallest id, null last, of equal ids the smallest digest.  Null, empty and wordless texts
    link with nothing and stay, one per id and text; whole texts are compared; an empty table stays empty;
    other columns stay as they are.
    """
    return jaccard.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources take part by weight, longer documents a little likelier; a document comes up to twice.

    Null texts have no words; null sources are one, the last; equal rows are taken one by one; a very long
    text is a number of words like others; an empty table stays empty; other columns stay as they are.
    """
    return mixing.mix(docs, appeal=mixing.length_appeal)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of the permitted lengths.

    Null and empty texts are a piece of no words in no sequence; a text that is longer than the longest
    sequence is cut; repeated rows are packed each, ties go by id; an empty table gives no pieces.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxic_documents),
    ("line_dedup", repeated_lines),
    ("ngram_jaccard", near_duplicates),
    ("source_mix", source_mix),
    ("best_fit_packing", packed_sequences),
]

#: No SQL expresses the first stage (compression lengths).  tests/llm holds the stages, one after the other, against a
#: plain scorer, SQL for lines, all pairs of shingle sets, SQL for the mix, and the packing of all sizes at once.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
