"""Token ids in files of shuffled planes.

A file holds ids as blocks of fixed size. A block's ids, unsigned 32-bit integers, are
transposed: plane p holds byte p (or bit p) of all of them, and every plane is compressed by
itself with Zstandard, so that the high bytes, which are alike, cost next to nothing.
The chunk index at the end gives for each block its place, number of ids and the length
of each plane (0: all zero), so that any block can be read alone; a second table gives
the documents and their numbers of ids.

    "PLN1" | planes of block 0 | planes of block 1 | ... | footer | footer length (8) | "PLN1"

Documents are dealt out by ranges of their id, and each task encodes and writes the documents of
its range as one file while they pass, block by block: nothing is gathered.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.llm.common import rows_per_batch, settle, shared_folder
from spanveil.llm.files import existing_file, new_file

MAGIC = b"PLN1"
#: Ids of a block.
BLOCK = 1 << 16
#: Compression of a plane.
LEVEL = 3
#: Texts that a Python worker holds at a time.
TEXTS_PER_BATCH = 500


def planes_of(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block, the lowest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, p].tobytes() for p in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, p]).tobytes() for p in range(32)]


def ids_of(planes: list[bytes], count: int, kind: str) -> np.ndarray:
    """The block that has these planes; an empty plane is all zero."""
    if kind == "byte":
        raw = np.zeros((count, 4), dtype=np.uint8)
        for p, plane in enumerate(planes):
            if plane:
                raw[:, p] = np.frombuffer(plane, dtype=np.uint8)
    else:
        bits = np.zeros((count, 32), dtype=np.uint8)
        for p, plane in enumerate(planes):
            if plane:
                bits[:, p] = np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=count)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file; close() must follow the last document."""

    def __init__(self, stream, kind: str = "byte", block: int = BLOCK) -> None:
        self.stream, self.kind, self.block = stream, kind, block
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.index: list[tuple[int, list[int]]] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        self.waiting: list[bytes] = []
        self.waits = 0
        self.stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """A document's ids, little-endian unsigned 32-bit integers."""
        self.docs.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.waiting.append(ids)
        self.waits += len(ids) // 4
        if self.waits >= self.block:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), dtype="<u4")
        whole = len(ids) if last else len(ids) // self.block * self.block
        for start in range(0, whole, self.block):
            part = ids[start : min(start + self.block, whole)]
            lengths = []
            for plane in planes_of(part, self.kind):
                data = self.pack.compress(plane) if any(plane) else b""
                self.stream.write(data)
                lengths.append(len(data))
            self.index.append((len(part), lengths))
        self.waiting = [ids[whole:].tobytes()]
        self.waits = len(ids) - whole

    def close(self) -> None:
        self._flush(last=True)
        footer = {"kind": self.kind, "blocks": self.index, "docs": self.docs, "counts": self.counts}
        data = self.pack.compress(json.dumps(footer).encode())
        self.stream.write(data)
        self.stream.write(len(data).to_bytes(8, "little") + MAGIC)


def read_documents(stream) -> Iterator[tuple[int | None, int, int]]:
    """(doc_id, number of ids, CRC-32 of the ids) of each document, read block by block."""
    for doc_id, count, parts in document_parts(stream):
        crc = 0
        for part in parts:
            crc = zlib.crc32(part.tobytes(), crc)
        yield doc_id, count, crc


def document_parts(stream) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
    """The documents of a file with their ids; take each one's ids before the next."""
    size = stream.size()
    stream.seek(size - 12)
    tail = stream.read(12)
    if tail[8:] != MAGIC:
        raise ValueError("not a file of token planes")
    length = int.from_bytes(tail[:8], "little")
    stream.seek(size - 12 - length)
    unpack = zstandard.ZstdDecompressor()
    footer = json.loads(unpack.decompress(stream.read(length)))
    stream.seek(len(MAGIC))

    def blocks() -> Iterator[np.ndarray]:
        for count, lengths in footer["blocks"]:
            planes = [unpack.decompress(stream.read(n)) if n else b"" for n in lengths]
            yield ids_of(planes, count, footer["kind"])

    source = blocks()
    rest = np.zeros(0, dtype="<u4")

    def take(count: int) -> Iterator[np.ndarray]:
        nonlocal rest
        while count:
            if not len(rest):
                rest = next(source)
            part, rest = rest[:count], rest[count:]
            count -= len(part)
            yield part

    for doc_id, count in zip(footer["docs"], footer["counts"], strict=True):
        yield doc_id, count, take(count)


def write_token_files(
    docs: DataFrame,
    folder: str,
    make_encoder: Callable[[], Callable[[list[str | None]], list[bytes]]],
    end_id: int,
    kind: str = "byte",
) -> DataFrame:
    """Encode the documents and write one file for each range of ids; returns the list of files.

    `make_encoder` is called in each task. Columns: part (files in ascending order of ids), path,
    documents, tokens.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        part = TaskContext.get().partitionId()
        filled = (b for b in batches if b.num_rows)
        first = next(filled, None)
        if first is None:
            return
        with new_file(folder, f"tokens-{part:06d}.pln") as (path, stream):
            writer = PlaneWriter(stream, kind)
            tokens = 0
            while first is not None:
                texts = first.column(1).to_pylist()
                for doc_id, ids in zip(first.column(0).to_pylist(), encode(texts), strict=True):
                    writer.add(doc_id, ids + end)
                    tokens += len(ids) // 4 + 1
                first = next(filled, None)
            writer.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([path]), pa.array([len(writer.docs)]), pa.array([tokens])],
            names=["part", "path", "documents", "tokens"],
        )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # Equal ids are told apart, so that an id repeated very often is no hot range.
    keys = ["doc_id", F.xxhash64("text")]
    with rows_per_batch(docs.sparkSession, TEXTS_PER_BATCH):
        written = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(
            run, "part long, path string, documents long, tokens long"
        )
        return settle(written, "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                with existing_file(path) as stream:
                    found = list(read_documents(stream))
                docs, counts, crcs = (list(x) for x in zip(*found, strict=True))
                starts = start + np.cumsum([0, *counts[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    return placed.repartition(max(1, files.count())).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_table(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, kind: str = "byte"
) -> DataFrame:
    """Encode the documents into files of planes in a shared folder, and report what they hold.

    `docs` has `doc_id` (integer) and `text`; other columns are not looked at. A null or
    empty text has the end id only. Rows that repeat an id follow each other, in the order of a
    hash of their texts; null ids come first. An empty table gives no files and no rows.

    Returns doc_id, start, n_tokens, ids_crc32, read back from the files.
    """

    def make_encoder() -> Callable[[list[str | None]], list[bytes]]:
        from spanveil.llm.tokens import tokenizer

        return tokenizer(tokenizer_path).encode

    folder = shared_folder(docs.sparkSession, "token-planes")
    return read_token_files(write_token_files(docs, folder, make_encoder, end_id, kind))
