"""From raw documents to token files: the stages of a training corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as
Parquet and read again as the next one's docs. All but the last return the columns
of the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spanveil.llm.bit_planes import token_table
from spanveil.llm.common import settle, table
from spanveil.llm.decontaminate import clean_documents
from spanveil.llm.fair_mix import mixed_documents
from spanveil.llm.ngram_join import first_of_each_class
from spanveil.llm.toxicity import learn_lexicon, without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a lexicon learned from the labels doesn't find toxic."""
    return without_toxic(docs, learn_lexicon(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies: runs of five words,
    similarity of 0.8 or more."""
    return first_of_each_class(docs, width=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, as often as it takes each."""
    return mixed_documents(docs, weights=(3, 1, 2), percent=150, most=2)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left; a row for each document as the files hold it."""
    return token_table(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: Learned scores, edit distances and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
