"""Runs of words that repeat with a period, found by internal pattern matching.

A run is a maximal stretch of words that repeats itself at least three times. Its block of
2**k words at a multiple of 2**k, with 2**k near the period, occurs once more one period
later, so it is enough to ask where the blocks of a text occur next:

- Suffixes of the words are sorted by doubling, each document for itself. After each turn the
  suffixes that share a block are one range of the *suffix array*; blocks that
  are the only one of their kind are done with.
- What is left of the array goes into a *wavelet tree*. Counting and range successor
  queries on it give the occurrences of a block in the window next to it, without a look at
  the others in the document.
- Few occurrences are candidates as they are. Three and more are an *arithmetic
  progression*, whose difference is a period of the block; then the two stretches of that
  period, around the block and around the progression, lie one candidate apart by their
  starts or by their ends.
- Candidates are extended word by word, and kept if the stretch is long enough and has no
  smaller period.

All documents of a batch go through this at once, on arrays.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import rows_per_batch, settle

#: The smallest block, in words.
SMALLEST = 8
#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Texts that a Python worker gets at a time, and words that are searched at once.
TEXTS_PER_BATCH, WORDS_AT_ONCE = 250, 1_000_000


class WaveletTree:
    """Numbers in the order of an array, ready for queries on its ranges.

    Level by level from the highest bit, the numbers are parted by that bit, zeros
    first; for each place the zeros before it are counted.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.zeros: list[np.ndarray] = []
        for level in reversed(range(self.bits)):
            zero = (values >> level) & 1 == 0
            before = np.zeros(len(values) + 1, dtype=np.int64)
            np.cumsum(zero, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many numbers of each range [low, high) are under its bound."""
        whole = high - low
        count = np.zeros(len(low), dtype=np.int64)
        for level, before in zip(reversed(range(self.bits)), self.zeros, strict=True):
            one = (bound >> level) & 1 == 1
            left, right = before[low], before[high]
            count += np.where(one, right - left, 0)
            low = np.where(one, low - left + before[-1], left)
            high = np.where(one, high - right + before[-1], right)
        return np.where(bound >> self.bits > 0, whole, count)

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The number of rank k, from 0, of each range; k must be less than its length."""
        k = k.copy()
        found = np.zeros(len(low), dtype=np.int64)
        for level, before in zip(reversed(range(self.bits)), self.zeros, strict=True):
            left, right = before[low], before[high]
            one = k >= right - left
            found |= one.astype(np.int64) << level
            k -= np.where(one, right - left, 0)
            low = np.where(one, low - left + before[-1], left)
            high = np.where(one, high - right + before[-1], right)
        return found

    def successor(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The smallest number from the bound on of each range, -1 if there is none."""
        k = self.below(low, high, bound)
        there = k < high - low
        found = np.full(len(low), -1, dtype=np.int64)
        found[there] = self.kth(low[there], high[there], k[there])
        return found


def block_ranges(
    words: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The part of the suffix array whose smallest blocks occur again, and the blocks.

    `words` holds the words of all documents as numbers that no two documents share, `starts`
    and `ends` the places of each document. Per level the blocks are (size, place, low,
    high): the occurrences of the block at a place are the entries [low, high) of
    the array.
    """
    n = len(words)
    sizes = ends - starts
    array = np.argsort(words, kind="stable")
    ordered = words[array]
    slots = np.arange(n)
    first = np.ones(n, dtype=bool)
    first[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, dtype=np.int64)
    rank[array] = np.maximum.accumulate(np.where(first, slots, 0))
    end_of = np.repeat(ends, sizes)
    start_of = np.repeat(starts, sizes)
    # Entries that share their group with another; the others have their final place.
    alone = first & np.append(first[1:], True)
    active = slots[~alone]
    longest = int(sizes.max()) // LEAST_PERIODS if n else 0
    size, levels, kept = 1, [], None
    while True:
        if size >= SMALLEST:
            if kept is None:
                kept = active
            suffixes = array[active]
            begins = np.flatnonzero(np.append(True, rank[suffixes[1:]] != rank[suffixes[:-1]]))
            group = np.zeros(len(active), dtype=np.int64)
            group[begins[1:]] = 1
            group = np.cumsum(group)
            low = active[begins] if len(active) else active
            high = active[np.append(begins[1:], len(active)) - 1] + 1 if len(active) else active
            block = ((suffixes - start_of[suffixes]) % size == 0) & (suffixes + size <= end_of[suffixes])
            levels.append((size, suffixes[block], low[group[block]], high[group[block]]))
        if not len(active) or 2 * size > max(longest, SMALLEST):
            break
        suffixes = array[active]
        behind = suffixes + size
        inside = behind < end_of[suffixes]
        second = np.zeros(len(active), dtype=np.int64)
        second[inside] = rank[behind[inside]] + 1
        order = np.lexsort((second, rank[suffixes]))
        suffixes, second = suffixes[order], second[order]
        array[active] = suffixes
        old = rank[suffixes]
        first = np.ones(len(active), dtype=bool)
        first[1:] = (old[1:] != old[:-1]) | (second[1:] != second[:-1])
        rank[suffixes] = np.maximum.accumulate(np.where(first, active, 0))
        active = active[~(first & np.append(first[1:], True))]
        size *= 2
    if kept is None:
        kept = active[:0]
    # Only this part is asked about from here on.
    place = np.zeros(n + 1, dtype=np.int64)
    place[kept + 1] = 1
    place = np.cumsum(place)
    return array[kept], [(s, p, place[low], place[high]) for s, p, low, high in levels]


def _agreement(words: np.ndarray, i: int, j: int, stop: int) -> int:
    """How many words from i and j on agree, j < stop."""
    done, step = 0, 32
    while j + done < stop:
        step = min(step, stop - j - done)
        same = words[i + done : i + done + step] == words[j + done : j + done + step]
        if not same.all():
            return done + int(np.argmin(same))
        done, step = done + step, 4 * step
    return done


def _agreement_before(words: np.ndarray, i: int, j: int, stop: int) -> int:
    """How many words before i and j agree, i >= stop."""
    done, step = 0, 32
    while i - done > stop:
        step = min(step, i - done - stop)
        same = words[i - done - step : i - done] == words[j - done - step : j - done]
        if not same.all():
            return done + int(np.argmin(same[::-1]))
        done, step = done + step, 4 * step
    return done


def stretch(words: np.ndarray, place: int, period: int, start: int, end: int) -> tuple[int, int]:
    """The longest stretch within [start, end) around a place that has the period."""
    right = _agreement(words, place, place + period, end)
    left = _agreement_before(words, place, place + period, start)
    return place - left, place + period + right


def _is_smallest(words: np.ndarray, start: int, period: int) -> bool:
    """Whether a stretch of two periods and more has no smaller period: only divisors can be one."""
    rest, divisor = period, 2
    while rest > 1:
        if divisor * divisor > rest:
            divisor = rest
        if rest % divisor == 0:
            small = period // divisor
            if np.array_equal(words[start : start + period - small], words[start + small : start + period]):
                return False
            while rest % divisor == 0:
                rest //= divisor
        divisor += 1
    return True


def _candidates(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """Rows (place, period) that a run may have, a period's places being in one of its blocks."""
    entries, levels = block_ranges(words, starts, ends)
    if not len(entries):
        return
    tree = WaveletTree(entries)
    for size, place, low, high in levels:
        if not len(place):
            continue
        # Periods from half the window on; the smallest blocks stand for all below, too.
        nearest = 1 if size == SMALLEST else size
        skipped = tree.below(low, high, place + nearest)
        found = tree.below(low, high, place + 2 * size) - skipped
        most = 2 * SMALLEST if size == SMALLEST else 2
        for k in range(min(most, int(found.max()))):
            some = np.flatnonzero((found > k) & ((found <= most) | (size == SMALLEST)))
            other = tree.kth(low[some], high[some], skipped[some] + k)
            yield np.stack([place[some], other - place[some]], axis=1)
        if size == SMALLEST:
            continue
        some = np.flatnonzero(found > most)
        first = tree.successor(low[some], high[some], place[some] + size)
        second = tree.successor(low[some], high[some], first + 1)
        document = np.searchsorted(starts, place[some], "right") - 1
        rows, known, others = [], (0, 0, -1), (0, 0, -1)
        order = np.argsort(place[some], kind="stable")
        for p, f, s, d in zip(*(x[order].tolist() for x in (place[some], first, second, document)), strict=True):
            step, begin, end = s - f, int(starts[d]), int(ends[d])
            # The block has this period, and so have its occurrences together.
            if not (known[2] == step and known[0] <= p and p + size <= known[1]):
                known = (*stretch(words, p, step, begin, end), step)
            if not (others[2] == step and others[0] <= f and f + size <= others[1]):
                others = (*stretch(words, f, step, begin, end), step)
            rows += [(p, others[k] - known[k]) for k in (0, 1) if size <= others[k] - known[k] < 2 * size]
        if rows:
            yield np.array(rows, dtype=np.int64)


def runs_of(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
    """All runs as (document, start within it, length, period), sorted."""
    some = [rows for rows in _candidates(words, starts, ends) if len(rows)]
    if not some:
        return []
    rows = np.unique(np.concatenate(some), axis=0)
    document = np.searchsorted(starts, rows[:, 0], "right") - 1
    found = []
    order = np.lexsort((rows[:, 0], rows[:, 1], document))
    last = (-1, -1, 0)
    for d, p, q in zip(document[order].tolist(), *rows[order].T.tolist(), strict=True):
        if last[0] == d and last[1] == q and p + q <= last[2]:
            continue  # within the stretch that was just looked at
        begin, end = stretch(words, p, q, int(starts[d]), int(ends[d]))
        last = (d, q, end)
        if end - begin >= max(LEAST_WORDS, LEAST_PERIODS * q) and _is_smallest(words, begin, q):
            found.append((d, begin - int(starts[d]), end - begin, q))
    return sorted(found, key=lambda r: (r[0], r[1], r[3]))


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words; of a tenth of the documents, by their id, all from some word on repeat."""
    if doc_id is None or not words:
        return words
    hashed = zlib.crc32(str(doc_id).encode())
    if hashed % 10:
        return words
    g, n = hashed // 10, len(words)
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    root = words[start : start + period]
    return words[:start] + (root * ((n - start) // period + 1))[: n - start]


def _summary(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """What is returned of a document, from its runs (start, length, period)."""
    best = (None, None, None)
    for start, length, period in runs:
        # Lengths per period are compared as fractions; equal ones leave the earlier run.
        if best[0] is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = words
    if runs:
        dropped = bytearray(len(words))
        for s, length, q in runs:
            dropped[s + q : s + length] = b"\x01" * (length - q)
        kept = [w for w, gone in zip(words, dropped, strict=True) if not gone]
    return (
        len(runs),
        *best,
        None if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(b" ".join(kept)).hexdigest(),
    )


def _search(docs: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each document as (start, length, period)."""
    parts, starts, base = [], [], 0
    for words in docs:
        numbers: dict[bytes, int] = {}
        parts.append(np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64) + base)
        starts.append(len(words))
        base += len(numbers)
    ends = np.cumsum(np.array(starts, dtype=np.int64))
    found: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    for d, start, length, period in runs_of(np.concatenate(parts), ends - starts, ends):
        found[d].append((start, length, period))
    return found


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_runs", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("period", pa.int64()),
        ("exponent_milli", pa.int64()),
        ("runs_sha256", pa.string()),
        ("collapsed_sha256", pa.string()),
    ]
)


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """Per document its runs of words and what is left without their repeats.

    `docs` has `doc_id` and `text`; other columns are not looked at. Words are what white space
    (0x20, 0x09 to 0x0D) separates. A run is a maximal stretch whose smallest period q is the
    distance of equal words, at least 24 words and 3 q long; of each all but the first q words
    are dropped. With `planted`, a tenth of the documents is made periodic first, by a rule of
    their id.

    Texts that are null, empty or blank have no runs and nothing left, and the digests are
    of empty strings. Repeated rows give a row each, null ids stay null and
    have nothing planted, an empty table gives an empty result. Documents of any length are
    searched whole.

    Returns doc_id, n_runs, start, length, period and exponent_milli of the run with the most
    periods (ties: the smallest start, then period; null without runs), runs_sha256 of
    `start,length,period` lines, and collapsed_sha256 of the words that are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                some: list[list[bytes]] = []
                count, first = 0, at
                while at < len(ids) and (count < WORDS_AT_ONCE or at == first):
                    words = texts[at].as_buffer().to_pybytes().split() if texts[at].is_valid else []
                    some.append(planted_period(ids[at], words) if planted else words)
                    count += len(words)
                    at += 1
                rows = [
                    (i, *_summary(words, runs))
                    for i, words, runs in zip(ids[first:at], some, _search(some), strict=True)
                ]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA
                )

    frame = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with rows_per_batch(docs.sparkSession, TEXTS_PER_BATCH):
        found = frame.mapInArrow(
            run,
            "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
            "runs_sha256 string, collapsed_sha256 string",
        )
        # Written here, while batches are small.
        return settle(found, "periodic-runs")
