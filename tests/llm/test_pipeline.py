"""The pipeline against a plain statement of its stages."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from spanveil.llm.decontaminate import BUDGET, SHORTEST_PIECE, budget_of, plain, within
from spanveil.llm.toxicity import Scorer, learn_lexicon
from tests.llm import brute

DIRECTORY = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs, labels, bench = (spark.read.parquet(f"{DIRECTORY}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows = {r.doc_id: r for r in docs.collect()}
    scorer = Scorer(learn_lexicon(docs, labels))
    ids = sorted(rows)
    ids = [i for i, s in zip(ids, scorer.score([rows[i].text for i in ids]), strict=True) if s < 0.7]
    classes = brute.ngram_classes([(i, rows[i].text) for i in ids], 5, 80, 100)
    ids = [i for i in ids if classes[i] == i]
    items = [plain(r.text) for r in bench.collect()]
    # The bit-parallel distance is held against plain edit distances elsewhere.
    ids = [i for i in ids if not any(within(t, plain(rows[i].text), budget_of(t, BUDGET, SHORTEST_PIECE)) for t in items)]
    mixed = brute.fair_mix([(i, rows[i].text, rows[i].source) for i in ids])
    library, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i, size, _, taken in sorted(mixed):
        for _ in range(-(-taken // size) if size else 1):
            tokens = np.array([*library.encode(rows[i].text, add_special_tokens=False).ids, 2], "<u4")
            want.append((i, at, len(tokens), zlib.crc32(tokens.tobytes())))
            at += len(tokens)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, DIRECTORY).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(want) and len({i for i, *_ in want}) < len(rows)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, DIRECTORY).columns == docs.columns
