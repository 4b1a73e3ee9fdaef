"""Numbers of links against all pairs in plain Python."""

from __future__ import annotations

import random

import pytest

from spanveil.llm import ngram_join
from tests.llm import brute


def _chained(seed: int) -> list[tuple[int | None, str | None]]:
    """Groups of near copies in which many pairs link, copies, and rows without text or id."""
    rnd = random.Random(seed)
    rows: list[tuple[int | None, str | None]] = []
    for _ in range(4):
        text = [f"w{rnd.randrange(500)}" for _ in range(rnd.choice((7, 40, 90)))]
        for _ in range(20):
            other = list(text)
            for _ in range(rnd.choice((0, 0, 1, 2, 3))):
                other[rnd.randrange(len(other))] = f"x{rnd.randrange(5)}"
            rows.append((len(rows), " ".join(other).upper() if rnd.random() < 0.2 else " ".join(other)))
    rows += [(len(rows) + k, t) for k, t in enumerate((None, "", "one", "One", "two words"))]
    return rows + [(None, rows[0][1]), (3, rows[3][1])]


@pytest.mark.parametrize("block", [512, 4])
def test_all_links_are_counted(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = _chained(block)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.links) for r in ngram_join.ngram_classes(docs).collect() if r.doc_id is not None)
    sets = [(i, brute.shingles(t, 4)) for i, t in rows if i is not None]
    want = sorted(
        (i, sum(100 * len(a & b) >= 85 * len(a | b) for q, (_, b) in enumerate(sets) if q != p) if a else 0)
        for p, (i, a) in enumerate(sets)
    )
    assert got == want
    assert all(r.links == 0 for r in ngram_join.ngram_classes(docs).collect() if r.doc_id is None)
