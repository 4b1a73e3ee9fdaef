"""Tokens of two tokenizers, aligned by the bytes they cover, with corpus-wide counts.

Both tokenizers cut the same bytes. Where both cut, groups of tokens end; within a group each
token of side A is linked with each of side B. How many documents hold a linked pair of
ids is counted by *external spill counting*:

- Each batch of documents is one *run* per radix class of the A ids: its records (A id, B id,
  document, links), side-major, sorted, and packed as planes of Zstandard.
- Runs are dealt out by class and salt, so that a frequent id is spread over tasks. Each task
  merges its runs by a heap of their next pairs and adds up the documents of each pair. What
  the salts have counted is added up by pair.
- The counts of a class, side-major again, give the highest count of each A id while they
  pass, and are written to one file for each class.
- The runs are read once more beside the file of their class, and give back to each
  document of a batch its sums. No record leaves its run for that.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import rows_per_batch, settle, shared_folder
from spanveil.llm.files import existing_file, new_file

#: Classes of the ids of side A. A class's counts are held by a task, at most vocabulary A / CLASSES
#: times vocabulary B entries.
CLASSES = 64
#: Texts of a batch, and links that are sorted at once.
TEXTS_PER_BATCH, LINKS_AT_ONCE = 500, 4_000_000
#: Keys of runs that a task merges at once, and runs that come to it in one batch.
KEYS_AT_ONCE, RUNS_PER_BATCH = 8_000_000, 64
#: Keys of the leading run that a step of the merge takes.
STEP = 8192
#: Compression of runs.
LEVEL = 1
#: White space on which the search of the faster encoder would recurse too far.
_LONG_BLANKS = re.compile(r"\s{2000}")


class Side:
    """One tokenizer: ids of texts, and the bytes of each id."""

    def __init__(self, encode, pieces: list[bytes]) -> None:
        self.encode, self.pieces = encode, pieces
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int64)

    def covers(self, ids: list[int], data: bytes) -> bool:
        """Whether the ids' bytes are the data."""
        return b"".join([self.pieces[i] for i in ids]) == data


def _byte_characters() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable ones
    for themselves, the others for those from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in set(printable)]
    return {chr(c): c for c in printable} | {chr(256 + k): byte for k, byte in enumerate(others)}


@lru_cache(maxsize=2)
def byte_side(path: str) -> Side:
    """A byte-level tokenizer; texts get a space in front.

    Where merges come in the order of ids, ids are ranks, by which texts are encoded some times
    faster. Long white space is left to the tokenizer itself: the other's search recurses.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    model = json.loads(Path(path).read_text())["model"]
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    byte_of = _byte_characters()
    # Special tokens stand beside the model's vocabulary or in it; no text has them.
    decoded = {i: bytes(byte_of[c] for c in t) for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    order = [model["vocab"][t] for t in made]
    pieces = [decoded.get(i, b"") for i in range(own.get_vocab_size())]
    plain = tiktoken.Encoding(
        "ranks",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks={decoded[i]: i for i in {*order, *(i for i, b in decoded.items() if len(b) == 1)}},
        special_tokens={},
    )

    def encode(texts: list[str]) -> list[list[int]]:
        return [
            own.encode(" " + t, add_special_tokens=False).ids
            if _LONG_BLANKS.search(t)
            else plain.encode_ordinary(" " + t)
            for t in texts
        ]

    if order != sorted(order):
        return Side(lambda texts: [own.encode(" " + t, add_special_tokens=False).ids for t in texts], pieces)
    return Side(encode, pieces)


@lru_cache(maxsize=2)
def piece_side(path: str) -> Side:
    """A tokenizer of pieces, which puts the space in front itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
        for i in range(model.get_piece_size())
        for p in [model.id_to_piece(i)]
    ]
    return Side(lambda texts: model.encode(texts, num_threads=1), pieces)


@lru_cache(maxsize=2)
def _written(count_a: int, count_b: int) -> list[bytes]:
    """Ids as they are written, with what follows: A inside and at the end of a group, then B."""
    parts = ((count_a, b","), (count_a, b"|"), (count_b, b","), (count_b, b";"))
    return [b"%d%b" % (i, mark) for count, mark in parts for i in range(count)]


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit integers as planes of bytes, without those that are all zero."""
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    used = 8
    while used > 1 and not raw[:, used - 1].any():
        used -= 1
    return bytes([used]) + raw[:, :used].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    used = data[0]
    count = (len(data) - 1) // used
    raw = np.zeros((count, 8), dtype=np.uint8)
    raw[:, :used] = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(used, count).T
    return raw.reshape(-1).view("<u8").astype(np.int64)


def _frame(*arrays: np.ndarray) -> bytes:
    """Arrays in one Zstandard frame."""
    parts = [pack(a) for a in arrays]
    head = b"".join(len(p).to_bytes(8, "little") for p in parts)
    data = len(parts).to_bytes(1, "little") + head + b"".join(parts)
    return zstandard.ZstdCompressor(level=LEVEL).compress(data)


def _arrays(frame: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(frame)
    count = data[0]
    lengths = [int.from_bytes(data[1 + 8 * k : 9 + 8 * k], "little") for k in range(count)]
    at, found = 1 + 8 * count, []
    for length in lengths:
        found.append(unpack(data[at : at + length]))
        at += length
    return found


class Alignment:
    """The groups of some documents whose tokens cover the same bytes on both sides."""

    def __init__(self, ids_a: list[list[int]], ids_b: list[list[int]], a: Side, b: Side) -> None:
        self.counts_a = np.array([len(x) for x in ids_a], dtype=np.int64)
        self.counts_b = np.array([len(x) for x in ids_b], dtype=np.int64)
        self.a = np.concatenate([np.array(x, dtype=np.int64) for x in ids_a])
        self.b = np.concatenate([np.array(x, dtype=np.int64) for x in ids_b])
        ends_a, ends_b = np.cumsum(a.lengths[self.a]), np.cumsum(b.lengths[self.b])
        at = np.searchsorted(ends_b, ends_a)
        self.last_a = ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a
        self.last_b = np.zeros(len(ends_b), dtype=bool)
        self.last_b[at[self.last_a]] = True
        # Number of the group of each token; the first token of each group, and one behind.
        self.group_a = np.cumsum(self.last_a) - self.last_a
        self.first_a = np.append(0, np.flatnonzero(self.last_a) + 1)
        self.first_b = np.append(0, np.flatnonzero(self.last_b) + 1)
        self.sizes_a, self.sizes_b = np.diff(self.first_a), np.diff(self.first_b)
        tokens = np.append(0, np.cumsum(self.counts_a))
        #: First group of each document, and one behind.
        self.groups = np.append(0, np.cumsum(self.last_a))[tokens]
        links = np.append(0, np.cumsum(self.sizes_a * self.sizes_b))
        self.links = np.diff(links[self.groups])

    def digests(self, size_a: int, size_b: int) -> list[bytes]:
        """SHA-256 of the groups of each document, as they are written."""
        written = _written(size_a, size_b)
        group_b = np.cumsum(self.last_b) - self.last_b
        codes = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        codes[np.arange(len(self.a)) + self.first_b[self.group_a]] = self.a + size_a * self.last_a
        codes[np.arange(len(self.b)) + self.first_a[group_b + 1]] = (
            self.b + 2 * size_a + size_b * self.last_b
        )
        ends = np.cumsum(self.counts_a + self.counts_b).tolist()
        found, at = [], 0
        for end in ends:
            parts = [written[c] for c in codes[at:end].tolist()]
            found.append(hashlib.sha256(b"".join(parts)[:-1]).digest())
            at = end
        return found

    def records(self, first: int, last: int, size_b: int) -> tuple[np.ndarray, np.ndarray]:
        """(pair and document as one number, links) of the documents [first, last), sorted.

        The number is (class of A, A, B, document), so that classes are ranges of it.
        """
        low, high = self.groups[first], self.groups[last]
        sizes_a, sizes_b = self.sizes_a[low:high], self.sizes_b[low:high]
        document = np.repeat(np.arange(first, last), np.diff(self.groups[first : last + 1]))
        # Groups with many tokens on both sides are crossed by their distinct ids.
        large = np.minimum(sizes_a, sizes_b) > 16
        small = np.flatnonzero(~large)
        pairs = (sizes_a * sizes_b)[small]
        group = np.repeat(small, pairs)
        within = np.arange(len(group)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        a = self.a[self.first_a[low + group] + within // sizes_b[group]]
        b = self.b[self.first_b[low + group] + within % sizes_b[group]]
        keys, weights = [self._key(a, b, document[group], size_b)], [np.ones(len(group), dtype=np.int64)]
        for g in np.flatnonzero(large).tolist():
            a, times_a = np.unique(self.a[self.first_a[low + g] : self.first_a[low + g + 1]], return_counts=True)
            b, times_b = np.unique(self.b[self.first_b[low + g] : self.first_b[low + g + 1]], return_counts=True)
            d = np.full(len(a) * len(b), document[g])
            keys.append(self._key(np.repeat(a, len(b)), np.tile(b, len(a)), d, size_b))
            weights.append(np.outer(times_a, times_b).reshape(-1))
        if len(keys) == 1:
            return np.unique(keys[0], return_counts=True)
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        every, weight = every[order], np.concatenate(weights)[order]
        begins = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        return every[begins], np.add.reduceat(weight, begins)

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray, document: np.ndarray, size_b: int) -> np.ndarray:
        # A = quotient * CLASSES + class, so the class goes in front of the quotient.
        return ((((a % CLASSES) << 16 | a // CLASSES) * size_b + b) << 16) + document


def _runs(key: np.ndarray, links: np.ndarray, size_b: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(class, packed pairs with their numbers of documents, packed documents and links)."""
    pair = key >> 16
    classes = pair // (size_b << 16)
    cuts = np.searchsorted(classes, np.arange(CLASSES + 1))
    for c in range(CLASSES):
        some = slice(cuts[c], cuts[c + 1])
        if cuts[c] == cuts[c + 1]:
            continue
        own = pair[some]
        begins = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        keys = own[begins]
        steps = np.diff(keys, prepend=0)
        head = _frame(steps, np.diff(np.append(begins, len(own))))
        yield c, head, _frame(key[some] & 0xFFFF, links[some])


def _describe(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of documents (class null) and rows of runs, for each batch of documents."""
    schema = pa.schema(
        [
            ("batch", pa.int64()), ("slot", pa.int32()), ("doc_id", pa.int64()),
            ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
            ("digest", pa.binary()), ("class", pa.int32()), ("head", pa.binary()), ("tail", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        a, b = byte_side(path_a), piece_side(path_b)
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(1).to_pylist()
            metrics = [[0] * len(texts) for _ in range(4)]
            digests: list[bytes | None] = [None] * len(texts)
            runs: list[tuple] = []
            some = [k for k, t in enumerate(texts) if t]
            both = zip(some, *(s.encode([texts[k] for k in some]) for s in (a, b)), strict=True)
            whole = []
            for k, x, y in both:
                data = b" " + texts[k].encode()
                if a.covers(x, data) and b.covers(y, data):
                    whole.append((k, x, y))
            if whole:
                slots, ids_a, ids_b = (list(c) for c in zip(*whole, strict=True))
                aligned = Alignment(ids_a, ids_b, a, b)
                found = (aligned.counts_a, aligned.counts_b, np.diff(aligned.groups), aligned.links)
                for into, values in zip(metrics, found, strict=True):
                    for k, value in zip(slots, values.tolist(), strict=True):
                        into[k] = value
                for k, digest in zip(slots, aligned.digests(len(a.pieces), len(b.pieces)), strict=True):
                    digests[k] = digest
                before, first = np.append(0, np.cumsum(aligned.links)), 0
                part = number
                while first < len(slots):
                    last = max(first + 1, int(np.searchsorted(before, before[first] + LINKS_AT_ONCE, "right")) - 1)
                    key, links = aligned.records(first, last, len(b.pieces))
                    # Documents are known by their slot in the batch.
                    key = (key & ~0xFFFF) + np.array(slots, dtype=np.int64)[key & 0xFFFF]
                    runs += [(part, *r) for r in _runs(key, links, len(b.pieces))]
                    first = last
            n, m = len(texts), len(runs)
            none = [None] * m
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number] * (n + m), pa.int64()),
                    pa.array([*range(n), *none], pa.int32()),
                    pa.array([*batch.column(0).to_pylist(), *none], pa.int64()),
                    *(pa.array([*x, *none], pa.int64()) for x in metrics),
                    pa.array([*digests, *none], pa.binary()),
                    pa.array([*[None] * n, *(r[1] for r in runs)], pa.int32()),
                    pa.array([*[None] * n, *(r[2] for r in runs)], pa.binary()),
                    pa.array([*[None] * n, *(r[3] for r in runs)], pa.binary()),
                ],
                schema=schema,
            )
            number += 1

    frame = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return frame.mapInArrow(
        run,
        "batch long, slot int, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
        "digest binary, class int, head binary, tail binary",
    )


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted runs of (key, count) as one, counts of equal keys added up.

    The heap holds the next key of each run. The run with the smallest one gives the bound
    of a step, and every run whose next key is within it gives its part.
    """
    at = [0] * len(runs)
    heap = [(int(keys[0]), k) for k, (keys, _) in enumerate(runs) if len(keys)]
    heapq.heapify(heap)
    while heap:
        keys = runs[heap[0][1]][0]
        bound = int(keys[min(at[heap[0][1]] + STEP, len(keys)) - 1])
        parts = []
        while heap and heap[0][0] <= bound:
            k = heapq.heappop(heap)[1]
            keys, counts = runs[k]
            end = at[k] + int(np.searchsorted(keys[at[k] :], bound, "right"))
            parts.append((keys[at[k] : end], counts[at[k] : end]))
            at[k] = end
            if end < len(keys):
                heapq.heappush(heap, (int(keys[end]), k))
        every = np.concatenate([p[0] for p in parts])
        order = np.argsort(every, kind="stable")
        every = every[order]
        begins = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        yield every[begins], np.add.reduceat(np.concatenate([p[1] for p in parts])[order], begins)


def _by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Rows of a sorted partition by their first column, a class, as they come."""
    rows = (
        row
        for batch in batches
        for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True)
    )
    return groupby(rows, key=lambda row: row[0])


def _dealt(runs: DataFrame, salts: int, *columns: str) -> DataFrame:
    """Runs by class and salt, those of a class one after the other."""
    salt = F.pmod(F.xxhash64("batch"), F.lit(salts))
    return runs.repartition("class", salt).select("class", *columns).sortWithinPartitions("class")


def _count(runs: DataFrame, salts: int) -> DataFrame:
    """(class, key, docs): documents of each pair."""
    schema = pa.schema([("class", pa.int32()), ("key", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(c: int, waiting: list) -> Iterator[pa.RecordBatch]:
            for keys, docs in merged(waiting):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), c, dtype=np.int32)), pa.array(keys), pa.array(docs)],
                    schema=schema,
                )

        for c, rows in _by_class(batches):
            waiting, held = [], 0
            for _, head in rows:
                steps, docs = _arrays(head)
                waiting.append((np.cumsum(steps), docs))
                held += len(docs)
                if held >= KEYS_AT_ONCE:
                    # Counts of the same pair are added up later on.
                    yield from counted(c, waiting)
                    waiting, held = [], 0
            yield from counted(c, waiting)

    partial = _dealt(runs, salts, "head").mapInArrow(run, "class int, key long, docs long")
    return partial.groupBy("class", "key").agg(F.sum("docs").alias("docs"))


def _count_files(counts: DataFrame, folder: str, size_b: int) -> dict[int, str]:
    """One file for each class: pairs, documents, and whether no pair of the A id has more."""
    schema = pa.schema([("class", pa.int32()), ("uri", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def written(c: int, parts: list) -> pa.RecordBatch:
            keys, docs = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            own = keys // size_b
            begins = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            highest = np.maximum.reduceat(docs, begins)
            best = docs == np.repeat(highest, np.diff(np.append(begins, len(keys))))
            with new_file(folder, f"counts-{c}.zst") as (uri, stream):
                stream.write(_frame(np.diff(keys, prepend=0), docs, best))
            return pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([uri])], schema=schema)

        now, parts = None, []
        for batch in batches:
            classes, keys, docs = (batch.column(k).to_numpy() for k in range(3))
            for c in np.unique(classes).tolist():
                if c != now and parts:
                    yield written(now, parts)
                    parts = []
                now = c
                parts.append((keys[classes == c], docs[classes == c]))
        if parts:
            yield written(now, parts)

    files = (
        counts.repartition("class")
        .sortWithinPartitions("class", "key")
        .select("class", "key", "docs")
        .mapInArrow(run, "class int, uri string")
    )
    # A row for each class, so CLASSES at most.
    return {row["class"]: row["uri"] for row in files.collect()}


def _give_back(runs: DataFrame, files: dict[int, str], salts: int) -> DataFrame:
    """(batch, slot, n_best, count_sum) of the documents with links."""
    packed = pa.schema([("batch", pa.int64()), ("sums", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, rows in _by_class(batches):
            with existing_file(files[c]) as stream:
                steps, counts, best = _arrays(stream.read())
            every = np.cumsum(steps)
            for _, batch, head, tail in rows:
                (steps, docs), (slots, links) = _arrays(head), _arrays(tail)
                at = np.repeat(np.searchsorted(every, np.cumsum(steps)), docs)
                order = np.argsort(slots, kind="stable")
                begins = np.flatnonzero(np.append(True, np.diff(slots[order]) != 0))
                total = np.add.reduceat((links * counts[at])[order], begins)
                highest = np.add.reduceat((links * best[at])[order], begins)
                sums = _frame(slots[order][begins], highest, total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch], pa.int64()), pa.array([sums], pa.binary())], schema=packed
                )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _by_class(batches):
            parts = [_arrays(sums) for _, sums in rows]
            slots = np.concatenate([p[0] for p in parts])
            sums = np.zeros((2, int(slots.max()) + 1), dtype=np.int64)
            for k in (0, 1):
                np.add.at(sums[k], slots, np.concatenate([p[1 + k] for p in parts]))
            there = np.unique(slots)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(there), batch)), pa.array(there.astype(np.int32)),
                 pa.array(sums[0][there]), pa.array(sums[1][there])],
                names=["batch", "slot", "n_best", "count_sum"],
            )

    sums = _dealt(runs, salts, "batch", "head", "tail").mapInArrow(run, "batch long, sums binary")
    return (
        sums.repartition("batch")
        .sortWithinPartitions("batch")
        .mapInArrow(add_up, "batch long, slot int, n_best long, count_sum long")
    )


def align_tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document how its tokens of two tokenizers align, and how common its links are.

    `docs` has `doc_id` and `text`; other columns are not looked at. `path_a` is the file of a
    byte-level tokenizer, which gets a space and the text; `path_b` is a model of pieces,
    which adds the space. Special tokens inside texts are plain text. Groups of tokens end
    where both sides end a token; every token of A is linked with every one of B in its group.

    Texts that are null or empty, or whose tokens don't give back their bytes on both sides, have
    no tokens: all numbers are 0 and the digest is ''. Each row is a document of its own
    for the counts, also if it repeats an id or a text, or has no id. An empty
    table gives an empty result. A document of any length is aligned whole; groups with
    many tokens on both sides are crossed by their distinct ids.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links of pairs that no other pair of
    their A id exceeds in number of documents), count_sum (documents of the pair, over all
    links) and groups_sha256.
    """
    spark = docs.sparkSession
    with rows_per_batch(spark, TEXTS_PER_BATCH):
        described = settle(_describe(docs, path_a, path_b), "tokens-runs")
    runs = described.where("class is not null")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    salts = max(1, -(-2 * partitions // CLASSES))
    with rows_per_batch(spark, RUNS_PER_BATCH):
        # Written before the batches are set back.
        counts = settle(_count(runs, salts), "tokens-counts")
    files = _count_files(counts, shared_folder(spark, "tokens-classes"), len(piece_side(path_b).pieces))
    with rows_per_batch(spark, RUNS_PER_BATCH):
        sums = settle(_give_back(runs, files, salts), "tokens-sums")
    zero = F.lit(0).cast("long")
    return (
        described.where("class is null")
        .join(sums, ["batch", "slot"], "left")
        .select(
            "doc_id",
            "n_a",
            "n_b",
            "n_groups",
            "n_links",
            F.coalesce("n_best", zero).alias("n_best"),
            F.coalesce("count_sum", zero).alias("count_sum"),
            F.coalesce(F.lower(F.hex("digest")), F.lit("")).alias("groups_sha256"),
        )
    )
