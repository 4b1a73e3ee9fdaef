"""What is compared in tiles that hold several classes, and that no link is lost there."""

from __future__ import annotations

import random

import numpy as np
import pytest
from spanveil.llm import ngram_join
from tests.llm import brute


@pytest.mark.parametrize("num, den", [(85, 100), (80, 100), (1, 2)])
def test_linking_sets_share_as_many_tiles_as_said(num, den):
    rnd = np.random.default_rng(den)
    for size in [2, 6, 8, 13, 20, 33, 62, 90, 141, 200, 300, 700]:
        for _ in range(20):
            one = np.unique(rnd.integers(0, 2**64, size, dtype=np.uint64))
            for gone, new in ((1, 0), (0, 1), (1, 1)):
                k, other = 0, one
                while True:
                    k += 1
                    fresh = rnd.integers(0, 2**64, k * new, dtype=np.uint64)
                    trial = np.unique(np.concatenate([rnd.permutation(one)[k * gone :], fresh]))
                    both = len(np.intersect1d(one, trial))
                    if k >= size or den * both < num * (len(one) + len(trial) - both):
                        break
                    other = trial
                if other is one:
                    continue
                (a, least_a), (b, least_b) = (ngram_join.tiles_of(x, num, den) for x in (one, other))
                shared = np.intersect1d(a, b)
                odd = int((shared & np.uint64(1)).sum())
                # In one of the groups of bands both sets have tiles.
                groups = [(len(shared) - odd, least_a[0], least_b[0]), (odd, least_a[1], least_b[1])]
                met = [(n, p, q) for n, p, q in groups if p and q]
                assert any(n >= max(p, q) for n, p, q in met)


def test_two_sets_alone_in_a_tile_are_done(spark):
    members = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 6), (2, 7)], "tile long, set_id long")
    classes = spark.createDataFrame([], "id long, class_id long")
    left = ngram_join._open_tiles(members, classes).collect()
    assert sorted((r.tile, r.set_id, r.class_id) for r in left) == [(2, 5, 5), (2, 6, 6), (2, 7, 7)]


def test_largest_tiles_are_left_out(spark):
    """Sets 1 and 2 share three tiles at least, so of four each looks at the two smallest."""
    tiles = {10: [1, 2, 3], 20: [1, 2, 3, 4], 30: [1, 2, 3, 4, 5], 40: [1, 2, 3, 4, 5, 6], 11: [1, 2, 3, 4, 5, 6]}
    rows = [(t, s, s) for t, sets in tiles.items() for s in sets]
    shared = [(s, 3, 0) if s < 3 else (s, 9, 9) for s in range(1, 7)]
    kept = ngram_join._rarest_tiles(
        spark.createDataFrame(rows, "tile long, set_id long, class_id long"),
        spark.createDataFrame(shared, "set_id long, even long, odd long"),
    ).collect()
    assert sorted((r.tile, r.set_id) for r in kept) == [(10, 1), (10, 2), (11, 1), (11, 2), (20, 1), (20, 2)]


def _copies(seed: int) -> list[tuple[int, str]]:
    rnd = random.Random(seed)
    rows = []
    common = [f"c{k}" for k in range(60)]
    for _ in range(6):
        text = common[: rnd.choice((0, 20, 60))] + [f"w{rnd.randrange(900)}" for _ in range(rnd.choice((30, 90, 250)))]
        for _ in range(14):
            other = list(text)
            for _ in range(rnd.choice((0, 1, 2, 4, 9))):
                other[rnd.randrange(len(other))] = f"x{rnd.randrange(9)}"
            rows.append((len(rows), " ".join(other)))
    return rows


@pytest.mark.parametrize("seed, shown", [(1, 2), (2, 16)])
def test_blocks_alone_lose_no_class(spark, monkeypatch, seed, shown):
    for name, value in (("LEADERS", 0), ("CROWDED", 3), ("SHOWN", shown), ("BLOCK", 5)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = _copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_classes(docs, 5, 80, 100, count_links=False).collect()}
    assert got == brute.ngram_classes(rows, 5, 80, 100)
