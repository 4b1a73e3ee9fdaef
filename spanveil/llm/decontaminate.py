"""Benchmark decontamination by pigeonhole edit matching.

A test item is found in a document if some stretch of the document is within an edit
budget of the item. With a budget of k edits the item is split into k + 1 pieces: k edits
leave at least one piece untouched, so every match holds a piece exactly. All pieces of all
items form one automaton that reads each document once; a hit says where the item would lie, and
Myers' bit-parallel algorithm computes the least edit distance of the item to any
stretch there.

The benchmark is what is small here: its pieces are sent to the executors in parts of
bounded size, one pass over the documents for each part. Documents are never
shuffled, and whole texts are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import rows_per_batch, settle

#: Edits allowed, as a share of an item's characters.
BUDGET = 0.06
#: Shortest piece, in characters: shorter items have a smaller budget, so that pieces stay selective.
SHORTEST_PIECE = 14
#: Characters of items whose automaton is sent at once: some 40 bytes each in memory.
PART_CHARS = 4_000_000
#: Texts that a Python worker holds at a time.
TEXTS_PER_BATCH = 500

_WORDS = re.compile(r"[^\W_]+")


def plain(text: str | None) -> str:
    """Words of letters and digits, small, with one space between."""
    return " ".join(_WORDS.findall((text or "").lower()))


def budget_of(item: str, share: float, shortest: int) -> int:
    """Edits that an item allows."""
    return max(0, min(int(len(item) * share), len(item) // shortest - 1))


def pieces_of(item: str, budget: int) -> list[tuple[int, str]]:
    """The item as budget + 1 pieces of nearly the same length, with their places."""
    count = budget + 1
    cuts = [len(item) * k // count for k in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def within(item: str, text: str, budget: int) -> tuple[int, int] | None:
    """Least edit distance of the item to a stretch of the text, and where the first such ends.

    None if it is over the budget. Myers' algorithm with the columns of the matrix as bits
    of one integer; the first row is zero, so that a match may start anywhere.
    """
    length = len(item)
    if not length:
        return None
    full, top = (1 << length) - 1, 1 << (length - 1)
    where: dict[str, int] = {}
    for k, c in enumerate(item):
        where[c] = where.get(c, 0) | (1 << k)
    plus, minus, score = full, 0, length
    best, at = min(length, budget + 1), 0
    for k, c in enumerate(text):
        same = where.get(c, 0)
        vertical = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, at = score, k + 1
    return (best, at) if best <= budget else None


class PieceMatcher:
    """Finds items in texts."""

    def __init__(self, items: list[tuple[int, str]], share: float, shortest: int) -> None:
        import ahocorasick

        self.items = {k: (ident, item) for k, (ident, item) in enumerate(items)}
        self.budgets = {k: budget_of(item, share, shortest) for k, item in enumerate(i for _, i in items)}
        owners: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item) in self.items.items():
            for place, piece in pieces_of(item, self.budgets[k]):
                owners.setdefault(piece, []).append((k, place))
        self.automaton = ahocorasick.Automaton()
        for piece, owned in owners.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), owned))
        if owners:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end in the plain text) of each item with a match, once."""
        if not len(self.automaton):
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (length, owned) in self.automaton.iter(text):
            start = end + 1 - length
            for k, place in owned:
                slack = self.budgets[k]
                low = max(0, start - place - slack)
                high = min(len(text), start - place + len(self.items[k][1]) + slack)
                seen = windows.setdefault(k, [])
                if seen and low <= seen[-1][1]:
                    seen[-1] = (min(low, seen[-1][0]), max(high, seen[-1][1]))
                else:
                    seen.append((low, high))
        found = []
        for k, places in windows.items():
            ident, item = self.items[k]
            best = None
            for low, high in places:
                hit = within(item, text[low:high], self.budgets[k])
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], max(0, low + hit[1] - len(item)), low + hit[1])
            if best:
                found.append((ident, *best))
        return sorted(found)


@lru_cache(maxsize=2)
def _matcher(items: tuple[tuple[int, str], ...], share: float, shortest: int) -> PieceMatcher:
    return PieceMatcher(list(items), share, shortest)


def _parts(items: DataFrame, part_chars: int) -> list[DataFrame]:
    """The items in parts of about `part_chars` characters."""
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-chars // part_chars)
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, count)))
    return [items.where(number == k) for k in range(count)]


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    share: float = BUDGET,
    shortest: int = SHORTEST_PIECE,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """(doc_id, item_id, distance, start, end): the items that each document holds.

    Texts are compared as words of letters and digits, small, one space between; distance,
    start and end count characters of that form. An item may differ by `share` of its
    characters, but never so much that a piece gets shorter than `shortest`; an item shorter than
    that must be whole. Null texts and items without letters and digits match
    nothing. Rows that repeat an id give rows of their own. Empty tables give an empty result.
    """
    schema = pa.schema(
        [(name, pa.int64()) for name in ("doc_id", "item_id", "distance", "start", "end")]
    )
    names = "doc_id long, item_id long, distance long, start long, end long"
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    asked = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    asked = asked.where("text is not null and item_id is not null").distinct()
    found = None
    for part in _parts(asked, part_chars):
        # Bounded by part_chars, whatever the size of the benchmark.
        items = sorted({(row["item_id"], plain(row["text"])) for row in part.collect()})
        items = tuple((i, t) for i, t in items if t)

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(items, share, shortest)
            for batch in batches:
                rows = [
                    (doc_id, *hit)
                    for doc_id, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True)
                    for hit in matcher.find(plain(text))
                ]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], schema=schema
                )

        hits = texts.mapInArrow(run, names)
        found = hits if found is None else found.union(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], names)
    with rows_per_batch(docs.sparkSession, TEXTS_PER_BATCH):
        return settle(found, "contaminated")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document the test items it holds: doc_id, contaminated, item_ids (ascending), distance.

    `distance` is the least of its matches, null without one. See find_items for
    what matches and for the options.
    """
    # At most one entry for each item and document.
    found = find_items(docs, benchmark, **options).groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.min("distance").alias("distance")
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(found.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        "distance",
    )


def clean_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    share: float = BUDGET,
    shortest: int = SHORTEST_PIECE,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """The rows whose text holds no test item, as they are, with all their columns.

    Each row is judged by its own text as it passes, so rows that share an id, or have none, don't
    take each other along; null and empty texts stay. Options are those of find_items.
    """
    at = [c.lower() for c in docs.columns].index("text")
    asked = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    asked = asked.where("text is not null and item_id is not null").distinct()
    for part in _parts(asked, part_chars):
        # Bounded by part_chars, whatever the size of the benchmark.
        items = sorted({(row["item_id"], plain(row["text"])) for row in part.collect()})
        items = tuple((i, t) for i, t in items if t)

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(items, share, shortest)
            for whole in batches:
                for start in range(0, whole.num_rows, TEXTS_PER_BATCH):
                    batch = whole.slice(start, TEXTS_PER_BATCH)
                    texts = batch.column(at).to_pylist()
                    yield batch.filter(pa.array([not matcher.find(plain(t)) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
