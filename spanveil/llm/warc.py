"""Web archives whose records are compressed one by one with a dictionary of their own.

A file begins with a skippable frame that holds a Zstandard dictionary, built from records of
that file; each record is then a frame of its own, so that records stay readable
one at a time and yet share what pages have in common. Pages with equal payloads
are archived once; the others are revisits that refer to it.

Equal payloads are found by digest, with partial results per task; each task then writes the
records of its partition as they pass, and rolls over to a new file at a given size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import rows_per_batch, settle, shared_folder
from spanveil.llm.files import existing_file, new_file

#: Payloads of fewer bytes are archived as they are, however often they occur.
LEAST_BYTES = 100
#: Records and bytes from which a file's dictionary is built, and its size.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 4 << 20, 64 << 10
#: Fewest records for a trained dictionary; below that, their bytes are the dictionary.
TRAINED_FROM = 16
LEVEL = 6
#: Bytes of a file from which the next is begun.
FILE_BYTES = 256 << 20
#: Pages that a Python worker holds at a time, and bytes read at a time.
PAGES_PER_BATCH, READ_BYTES = 500, 1 << 20
#: When the pages were fetched, if nothing else is known.
DATE = "1970-01-01T00:00:00Z"

_SKIPPABLE, _DICTIONARY = 0x184D2A5D, b"\x37\xa4\x30\xec"
_ID = "<urn:page:{}>"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROLS = re.compile(r"[\x00-\x20\x7f]")


def record_of(
    page_id: int | None,
    url: str | None,
    payload: bytes,
    digest: str,
    refers_to: int | None,
    revisit: bool,
    date: str = DATE,
) -> bytes:
    """One record of a page; a revisit has the headers of the answer, but not its payload."""
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _ID.format("" if page_id is None else page_id)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if url is not None:
        # A header is one line: blanks and control characters are escaped.
        fields.append(("WARC-Target-URI", _CONTROLS.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Refers-To", _ID.format(refers_to)), ("WARC-Profile", _PROFILE)]
    fields += [
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (small names) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    fields = {name.lower(): value for name, value in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    if len(samples) >= TRAINED_FROM and sum(map(len, samples)) > 8 * DICTIONARY_BYTES:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    raw = b"".join(samples)[-DICTIONARY_BYTES:].rjust(8, b" ")
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Writes one file; close() must follow the last record."""

    def __init__(self, stream) -> None:
        self.stream = stream
        self.waiting: list[bytes] = []
        self.waits = 0
        self.size = 0
        self.records = 0
        self.pack: zstandard.ZstdCompressor | None = None

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.pack is not None:
            self._write(self.pack.compress(record))
            return
        self.waiting.append(record)
        self.waits += len(record)
        if len(self.waiting) >= SAMPLE_RECORDS or self.waits >= SAMPLE_BYTES:
            self._begin()

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def _begin(self) -> None:
        words = _dictionary(self.waiting)
        # Stored compressed, as any reader of such files has to expect.
        stored = zstandard.ZstdCompressor(level=LEVEL).compress(words.as_bytes())
        self._write(_SKIPPABLE.to_bytes(4, "little") + len(stored).to_bytes(4, "little") + stored)
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=words)
        for record in self.waiting:
            self._write(self.pack.compress(record))
        self.waiting = []

    def close(self) -> None:
        if self.pack is None:
            self._begin()


def read_records(stream) -> Iterator[bytes]:
    """The records of a file, one after the other."""
    head = stream.read(8)
    if int.from_bytes(head[:4], "little") != _SKIPPABLE:
        raise ValueError("no dictionary at the beginning")
    stored = stream.read(int.from_bytes(head[4:], "little"))
    raw = zstandard.ZstdDecompressor().decompress(stored)
    kind = (
        zstandard.DICT_TYPE_FULLDICT if raw[:4] == _DICTIONARY else zstandard.DICT_TYPE_RAWCONTENT
    )
    unpack = zstandard.ZstdDecompressor(
        dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind)
    )
    data = stream.read(READ_BYTES)
    while data:
        frame, parts = unpack.decompressobj(), []
        while not frame.eof:
            if not data:
                raise ValueError("the file ends within a record")
            parts.append(frame.decompress(data))
            data = frame.unused_data if frame.eof else stream.read(READ_BYTES)
        yield b"".join(parts)
        data = data or stream.read(READ_BYTES)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Archive all pages into files of a folder; returns the list of files: path, records, bytes."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    # One row for each payload that may be referred to.
    firsts = (
        rows.where(F.octet_length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("pages"))
        .where("pages > 1")
        .select("digest", "first")
    )
    rows = rows.join(firsts, "digest", "left").withColumn(
        "revisit",
        F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        todo = (
            row
            for batch in batches
            for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)
        )
        number, row = 0, next(todo, None)
        while row is not None:
            with new_file(folder, f"pages-{part:06d}-{number:04d}.warc.zst") as (path, stream):
                writer = ArchiveWriter(stream)
                while row is not None and writer.size < FILE_BYTES:
                    page_id, url, data, digest, first, revisit = row
                    writer.add(record_of(page_id, url, data, digest, first, revisit))
                    row = next(todo, None)
                writer.close()
            number += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([writer.records]), pa.array([writer.size])],
                names=["path", "records", "bytes"],
            )

    with rows_per_batch(pages.sparkSession, PAGES_PER_BATCH):
        written = rows.select("page_id", "url", "payload", "digest", "first", "revisit").mapInArrow(
            run, "path string, records long, bytes long"
        )
        return settle(written, "warc-files")


def read_archives(files: DataFrame) -> DataFrame:
    """A row for each record of the files, from its headers and payload.

    The digest of a response is taken of the payload again, and must be the one it is headed by.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def page_of(urn: str | None) -> int | None:
        number = (urn or "").rpartition(":")[2].rstrip(">")
        return int(number) if number else None

    def row_of(record: bytes) -> tuple:
        fields, block = parse_record(record)
        head, _, payload = block.partition(b"\r\n\r\n")
        size = int(head.decode().split("Content-Length: ")[1].split("\r\n")[0])
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        kind = fields["warc-type"]
        if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
            raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
        return (
            page_of(fields["warc-record-id"]),
            fields.get("warc-target-uri"),
            size,
            digest,
            kind,
            page_of(fields.get("warc-refers-to")),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with existing_file(path) as stream:
                    rows = []
                    for record in read_records(stream):
                        rows.append(row_of(record))
                        if len(rows) == 5000:
                            yield _batch(rows, names, kinds)
                            rows = []
                    if rows:
                        yield _batch(rows, names, kinds)

    return files.select("path").repartition(max(1, files.count())).mapInArrow(
        run,
        "page_id long, url string, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long",
    )


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def archive_table(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Archive the pages in a shared folder, and report what the archives hold.

    `pages` has `page_id` (integer), `url` and `html`; other columns are not looked at. A null
    html has an empty payload. Of equal payloads of at least `least_bytes` bytes, the one with the
    smallest page_id is a response and the others revisit it; rows that repeat that id are
    responses too. Pages with a null id are archived without one, and
    revisit what has one. An empty table gives no files and no rows.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, read back.
    """
    folder = shared_folder(pages.sparkSession, "warc")
    found = read_archives(write_archives(pages, folder, least_bytes))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
