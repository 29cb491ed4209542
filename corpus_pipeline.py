"""From documents to packed training sequences: each stage's output is written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import decontam, linededup, packing, quality, simhash
from barloom.llm.common import materialize, read_table
from barloom.llm.queries import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier doesn't reject.

    Null and empty texts are scored like any other, null keys and repeated rows stay or go by their text; of several
    labels of a key the smallest holds; without labels of both classes nothing is learnt and all scores are equal.
    """
    return quality.keep_good(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that repeat an earlier line; those left without a word go.

    Rows with a null key keep their text; null and empty texts stay; rows that repeat key and text count as one
    document and stay alike; of lines that tie the one with the smallest key, text hash and line number stays.
    """
    return linededup.dedup_lines(docs).apply()


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: fingerprints of 3-word shingles within two bits.

    Null and empty texts are one group, of which the smallest key stays; rows with a null key stay; rows that repeat the key that
    stays all stay; an empty table gives none.
    """
    return simhash.drop_near_duplicates(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark passage; null and empty texts and null keys stay, rows that repeat a key go together."""
    return decontam.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 4096 ids, with their ids; null texts hold the end id alone, every row is a document of its own."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", unique_lines),
    ("simhash near-dedup", one_of_near_copies),
    ("benchmark decontamination", without_benchmarks),
    ("packing", packed),
]

#: A trained classifier, edit joins and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
