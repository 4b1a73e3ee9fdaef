"""Registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spanveil.llm import oracles
from spanveil.llm.bit_planes import token_table
from spanveil.llm.common import table
from spanveil.llm.decontaminate import contamination
from spanveil.llm.fair_mix import mix
from spanveil.llm.ngram_join import ngram_classes
from spanveil.llm.one_bit_search import nearest
from spanveil.llm.periodic_runs import periodic_runs
from spanveil.llm.pu_quality import describe, learn_quality, quality
from spanveil.llm.suffix_dedup import remove_repeats
from spanveil.llm.token_alignment import align_tokens
from spanveil.llm.toxicity import learn_lexicon, toxicity
from spanveil.llm.url_templates import DEPTH, VARIETY, filter_urls
from spanveil.llm.warc import archive_table
from spanveil.llm.wrappers import extract_main_texts

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_join(spark: SparkSession, directory: str) -> DataFrame:
    return ngram_classes(table(spark, directory, "documents"), width=4, num=85, den=100)


#: Host, path and verdict of the rules for pages.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op2_warc(spark: SparkSession, directory: str) -> DataFrame:
    return archive_table(table(spark, directory, "pages"))


def op3_url_filters(spark: SparkSession, directory: str) -> DataFrame:
    return filter_urls(table(spark, directory, "pages"), URL_RULES, depth=None)


def op4_main_texts(spark: SparkSession, directory: str) -> DataFrame:
    return extract_main_texts(table(spark, directory, "pages"))


def op5_token_files(spark: SparkSession, directory: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_table(table(spark, directory, "documents"), path, end_id=2)


def op6_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    return toxicity(documents, learn_lexicon(documents, table(spark, directory, "labels")))


def op7_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    return contamination(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


def op8_quality(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    known = describe(documents)
    model = learn_quality(documents, table(spark, directory, "labels"), known=known)
    return quality(documents, model, known)


def op9_fair_mix(spark: SparkSession, directory: str) -> DataFrame:
    return mix(table(spark, directory, "documents"), weights=(3, 1, 2), percent=150, most=2)


def op10_nearest_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    return nearest(table(spark, directory, "embeddings"), every=50, k=5)


def op11_token_alignment(spark: SparkSession, directory: str) -> DataFrame:
    bytes_, pieces = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align_tokens(table(spark, directory, "documents"), bytes_, pieces)


def op12_suffix_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return remove_repeats(table(spark, directory, "documents"), length=100).drop("spans")


def op13_periodic_runs(spark: SparkSession, directory: str) -> DataFrame:
    return periodic_runs(table(spark, directory, "documents"), planted=True)


QUERIES = [
    op1_ngram_join,
    op2_warc,
    op3_url_filters,
    op4_main_texts,
    op5_token_files,
    op6_toxicity,
    op7_decontamination,
    op8_quality,
    op9_fair_mix,
    op10_nearest_neighbours,
    op11_token_alignment,
    op12_suffix_dedup,
    op13_periodic_runs,
]


def all_queries() -> dict[str, Query]:
    # Stands at the top of the repository and uses the operators of this package.
    import corpus_pipeline

    return {q.__name__: q for q in QUERIES} | {"pipeline": corpus_pipeline.run}


def all_oracles() -> dict[str, str]:
    return {
        "op2_warc": oracles.ARCHIVES,
        "op3_url_filters": oracles.url_templates(URL_RULES, DEPTH, VARIETY),
        "op9_fair_mix": oracles.FAIR_MIX,
        "op12_suffix_dedup": oracles.REPEATED_STRINGS,
    }
