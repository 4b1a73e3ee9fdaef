"""Bytes that a string of fixed length covers which also starts earlier in the corpus.

Suffixes decide, but no suffix array of the corpus is ever built. Each string of the length
holds one *anchor*, the gram with the smallest hash in it, so that equal strings have equal
anchors and meet:

- The strings of a document that share an anchor's place are one *segment*. Segments
  that are equal in a batch travel as their first; all strings of the others are repeated.
- Anchors that only one segment has are done. The others' segments, with their bytes, are dealt
  out by anchor. What the neighbours of a segment, sorted by what follows and by what
  precedes the anchor, have in common with it bounds the strings it can share.
- What is left is one text of pieces, whose suffix array is built by *linear grouping*
  (suffix_groups); equal strings are neighbours in it, and the earliest stays.
- An anchor with very many segments isn't one group: its strings are dealt out one by
  one, by 128 bits of hash, and the earliest of each stays.

Documents are ordered by id, those without an id last, and rows of one id by a hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.llm.common import rows_per_batch, settle
from spanveil.llm.shingles import mix
from spanveil.llm.suffix_groups import suffix_array

#: Segments of an anchor, counted by batch, from which its strings are dealt out one by one.
HOT = 2048
#: Texts that a Python worker gets at a time, and bytes whose anchors are searched at once.
TEXTS_PER_BATCH, BYTES_AT_ONCE = 500, 1 << 20
#: Segments that come to a worker at a time, and the bytes of a suffix array.
SEGMENTS_PER_BATCH, ARRAY_BYTES = 4000, 1 << 21

#: Kinds of rows: repeated strings; an anchor's only segment in a batch; one of several; a
#: mark that the batch has several, with their number; a string of a hot anchor.
REPEATED, ONLY, ONE_OF, MARK, STRING = range(5)
_LAST = np.iinfo(np.int64).max
#: Where strings are, as one number: place, strings, and the anchor's place in the first of them.
_PLACE, _COUNT, _LONGEST = 20, 10, 1000

_GENERATOR = np.random.default_rng(20240307)
_BYTE = _GENERATOR.integers(0, 2**64, (2, 256), dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNSTEP = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


class _Powers:
    """Powers of the step and of its inverse, as far as the longest block needs them."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def reach(cls, count: int) -> None:
        if count > len(cls.up):
            for name, base in (("up", _STEP), ("down", _UNSTEP)):
                powers = np.full(2 * count, base, dtype=np.uint64)
                powers[0] = 1
                setattr(cls, name, np.multiply.accumulate(powers))


class Hashes:
    """Hashes of any stretches of some bytes, from sums of powers."""

    def __init__(self, data: np.ndarray, which: int = 0) -> None:
        _Powers.reach(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[which][data] * _Powers.up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * _Powers.down[starts])


def gram_of(length: int) -> int:
    """Bytes of an anchor."""
    return max(1, length // 4)


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the gram at each place, place of the anchor of the string at each place).

    The anchor is the gram of the smallest hash, of equal ones the first. `data` has less than
    2**24 bytes and at least `length`.
    """
    gram = gram_of(length)
    hashes = Hashes(data)
    places = np.arange(len(data) - gram + 1)
    grams = hashes.of(places, places + gram)
    mask = np.uint64((1 << 24) - 1)
    least = (grams & ~mask) | places.astype(np.uint64)
    width, done = length - gram + 1, 1
    while 2 * done <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if width > done:
        least = np.minimum(least[: len(least) - (width - done)], least[width - done :])
    return grams, (least & mask).astype(np.int64)


def _pieces(sizes: list[int], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Parts (document, from, to) to be searched together; long documents overlap by a string."""
    some, held = [], 0
    for k, size in enumerate(sizes):
        at = 0
        while size - at >= length:
            end = min(size, at + BYTES_AT_ONCE + length - 1)
            some.append((k, at, end))
            held += end - at
            if held >= BYTES_AT_ONCE:
                yield some
                some, held = [], 0
            at += BYTES_AT_ONCE
    if some:
        yield some


def segments(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Segments (anchor, digest, document, first string's place, strings, anchor's place in it)."""
    found: list[list[np.ndarray]] = [[] for _ in range(6)]
    for parts in _pieces([len(t) for t in texts], length):
        data = np.frombuffer(b"".join([texts[k][s:e] for k, s, e in parts]), dtype=np.uint8)
        sizes = np.array([e - s for _, s, e in parts])
        ends = np.cumsum(sizes)
        grams, anchor = anchors(data, length)
        # Strings don't reach over the ends of documents.
        place = np.arange(len(anchor))
        whole = place + length <= np.repeat(ends, sizes)[: len(anchor)]
        place, anchor = place[whole], anchor[whole]
        first = np.append(True, (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1))
        at = np.flatnonzero(first)
        low, anchor = place[at], anchor[at]
        count = np.diff(np.append(at, len(place)))
        digest = Hashes(data, 1).of(low, low + count + length - 1)
        part = np.searchsorted(ends, low, "right")
        offset = np.array([s for _, s, _ in parts]) - (ends - sizes)
        document = np.array([k for k, _, _ in parts])[part]
        shape = (count << 10 | (anchor - low)).astype(np.uint64)
        for into, values in zip(
            found,
            (grams[anchor].view(np.int64), mix(digest ^ mix(shape)).view(np.int64), document,
             low + offset[part], count, anchor - low),
            strict=True,
        ):
            into.append(values)
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in found)


def _earliest(same: tuple[np.ndarray, ...], order: tuple[np.ndarray, ...]):
    """(order of the rows, where a group of equal rows begins in it, which come after its first).

    Rows that are at the same place as the first of their group are it once more.
    """
    ranked = np.lexsort((*order[::-1], *same[::-1]))
    new = np.zeros(len(ranked), dtype=bool)
    new[:1] = True
    for column in same:
        column = column[ranked]
        new[1:] |= column[1:] != column[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = np.zeros(len(ranked), dtype=bool)
    for column in order:
        column = column[ranked]
        later |= column != column[first]
    return ranked, new, later


_ROW = pa.schema(
    [
        ("kind", pa.int32()), ("k", pa.int64()), ("k2", pa.int64()), ("doc", pa.int64()), ("sub", pa.int32()),
        ("at", pa.int64()), ("text", pa.binary()),
    ]
)
_ROW_DDL = "kind int, k long, k2 long, doc long, sub int, at long, text binary"


def _at(place: np.ndarray, count: np.ndarray | int, off: np.ndarray | int = 0) -> np.ndarray:
    return place << _PLACE | count << _COUNT | off


def _place_count_off(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = (1 << _COUNT) - 1
    return at >> _PLACE, (at >> _COUNT) & mask, at & mask


def _rows(kind: int, **columns) -> pa.RecordBatch:
    """Rows of a kind; columns that are not named are null."""
    length = len(next(iter(columns.values())))
    arrays = [
        pa.array(np.full(length, kind, dtype=np.int32))
        if field.name == "kind"
        else pa.array(columns[field.name]).cast(field.type)
        if field.name in columns
        else pa.nulls(length, field.type)
        for field in _ROW
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=_ROW)


def _texts(column: pa.Array) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column]


def _find_segments(docs: DataFrame, length: int) -> DataFrame:
    """Rows of the segments of all documents, batch by batch, without their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, subs = (batch.column(k).to_numpy() for k in (0, 1))
            anchor, digest, document, place, count, off = segments(_texts(batch.column(2)), length)
            if not len(anchor):
                continue
            doc, sub = ids[document], subs[document]
            ranked, new, later = _earliest((anchor, digest), (doc, sub, place))
            # In the order of documents rows pack best.
            gone = np.sort(ranked[later])
            yield _rows(REPEATED, k2=doc[gone], doc=doc[gone], sub=sub[gone], at=_at(place[gone], count[gone]))
            kept = ranked[new]
            own, several = np.unique(anchor[kept], return_counts=True)
            yield _rows(MARK, k=own[several > 1], k2=own[several > 1], at=several[several > 1])
            several = np.repeat(several, several)
            for kind, some in ((ONLY, np.sort(kept[several == 1])), (ONE_OF, np.sort(kept[several > 1]))):
                # Those that needn't meet others go by document.
                yield _rows(kind, k=anchor[some], k2=anchor[some] if kind == ONLY else doc[some], doc=doc[some],
                            sub=sub[some], at=_at(place[some], count[some], off[some]))

    return docs.select("doc", "sub", "text").mapInArrow(run, _ROW_DDL).drop("text")


def _with_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted segments with their bytes but the anchor's; the strings of hot ones by themselves."""
    packed = wanted.groupBy("doc", "sub").agg(
        F.collect_list(F.struct("k", "at", "hot")).alias("found")
    )

    gram = gram_of(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(2))
            lists = batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            inner = lists.flatten()
            anchor, at, hot = (f.to_numpy(zero_copy_only=False) for f in inner.flatten())
            place, count, off = _place_count_off(at)
            row = np.repeat(np.arange(len(texts)), sizes)
            doc, sub = (batch.column(k).to_numpy()[row] for k in (0, 1))
            some = np.flatnonzero(~hot)
            if len(some):
                data = [
                    texts[r][p : p + o] + texts[r][p + o + gram : p + n + length - 1]
                    for r, p, n, o in zip(*(x.tolist() for x in (row[some], place[some], count[some], off[some])), strict=True)
                ]
                number: dict[tuple, int] = {}
                same = np.array([number.setdefault(x, len(number)) for x in zip(anchor[some].tolist(), off[some].tolist(), data, strict=True)])
                ranked, new, later = _earliest((same,), (doc[some], sub[some], place[some]))
                gone = some[ranked[later]]
                yield _rows(REPEATED, k=doc[gone], doc=doc[gone], sub=sub[gone], at=at[gone])
                kept = some[ranked[new]]
                yield _rows(ONE_OF, k=anchor[kept], doc=doc[kept], sub=sub[kept], at=at[kept],
                            text=pa.array([data[r] for r in ranked[new].tolist()], pa.binary()))
            some = np.flatnonzero(hot)
            if len(some):
                own = np.unique(row[some])
                bounds = np.zeros(len(texts), dtype=np.int64)
                bounds[own[1:]] = np.cumsum([len(texts[r]) for r in own[:-1]])
                bytes_ = np.frombuffer(b"".join([texts[r] for r in own]), dtype=np.uint8)
                each = np.repeat(some, count[some])
                within = np.arange(len(each)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
                start = place[each] + within
                low = start + bounds[row[each]]
                one, two = (Hashes(bytes_, k).of(low, low + length).view(np.int64) for k in (0, 1))
                ranked, new, later = _earliest((one, two), (doc[each], sub[each], start))
                start = _at(start, 1)
                gone = ranked[later]
                yield _rows(REPEATED, k=doc[each[gone]], doc=doc[each[gone]], sub=sub[each[gone]], at=start[gone])
                kept = ranked[new]
                yield _rows(STRING, k=one[kept], k2=two[kept], doc=doc[each[kept]], sub=sub[each[kept]], at=start[kept])

    # All columns, so that the same shuffle serves what is left of the documents, too.
    return docs.join(packed, ["doc", "sub"]).select("doc", "sub", "text", "found", "doc_id").mapInArrow(run, _ROW_DDL)


def _common(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of each row of bytes, how many first ones it has in common with another of its group."""
    tagged = np.concatenate([group.astype(">u4").view(np.uint8).reshape(-1, 4), rows], axis=1)
    order = np.argsort(np.ascontiguousarray(tagged).view(f"S{tagged.shape[1]}").reshape(-1), kind="stable")
    ordered = tagged[order]
    differ = ordered[1:] != ordered[:-1]
    agree = np.where(differ.any(axis=1), differ.argmax(axis=1), tagged.shape[1]) - 4
    agree = np.maximum(agree, 0)
    most = np.zeros(len(rows), dtype=np.int64)
    most[order[1:]] = agree
    most[order[:-1]] = np.maximum(most[order[:-1]], agree)
    return most


def _repeated_strings(
    group: np.ndarray, off: np.ndarray, count: np.ndarray, texts: list[bytes],
    keys: tuple[np.ndarray, np.ndarray, np.ndarray], length: int,
) -> tuple[np.ndarray, np.ndarray]:
    """(segment, string in it) of the strings that another segment of the group has earlier.

    Groups are numbers; the segments of a group are different, and come without their anchors.
    `keys` are the places of
    their first strings (document, row of it, byte), by which they are ordered.
    """
    gram = gram_of(length)
    before, behind = np.zeros((2, len(texts), length), dtype=np.uint8)
    for k, (text, at) in enumerate(zip(texts, off.tolist(), strict=True)):
        left, right = text[:at][::-1], text[at:]
        before[k, : len(left)] = np.frombuffer(left, dtype=np.uint8)
        behind[k, : len(right)] = np.frombuffer(right, dtype=np.uint8)
    reach_left = np.minimum(_common(before, group), off)
    reach_right = np.minimum(_common(behind, group), count + length - 1 - gram - off)
    # Strings that start further left or end further right than anything shared are alone.
    low = off - reach_left
    high = np.minimum(count, off + gram + reach_right - length + 1)
    some = np.flatnonzero(low < high)
    if not len(some):
        return some, some
    # One piece for each segment: the bytes before the anchor, a letter for it, and those behind.
    parts, anchor_letter = [], 257 + np.unique(group, return_inverse=True)[1]
    for k in some.tolist():
        data = np.frombuffer(texts[k], dtype=np.uint8)
        at = int(off[k])
        piece = np.empty(int(high[k] - low[k]) + length - gram + 1, dtype=np.int64)
        middle = at - int(low[k])
        piece[:middle] = data[low[k] : at]
        piece[middle] = anchor_letter[k] - 1
        piece[middle + 1 : -1] = data[at : high[k] + length - gram - 1]
        piece[:-1] += 1
        piece[-1] = 0
        parts.append(piece)
    text = np.concatenate(parts)
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    order = suffix_array(text)
    piece = np.repeat(np.arange(len(parts)), sizes)
    # Of all suffixes only those with a whole string are compared.
    order = order[order - starts[piece[order]] < (high - low)[some][piece[order]]].astype(np.int64)
    symbols = length - gram + 1
    same = np.ones(len(order) - 1, dtype=bool)
    for k in range(symbols):
        still = np.flatnonzero(same)
        same[still] = text[order[still] + k] == text[order[still + 1] + k]
    run = np.cumsum(np.append(0, ~same))
    segment = some[piece[order]]
    string = order - starts[piece[order]] + low[segment]
    ranked, _, later = _earliest((run,), (keys[0][segment], keys[1][segment], keys[2][segment] + string))
    gone = ranked[later]
    return segment[gone], string[gone]


def _decide(rows: DataFrame, length: int) -> DataFrame:
    """(doc, sub, at): strings that are repeated, of segments and strings dealt out by key."""
    schema = pa.schema([("doc", pa.int64()), ("sub", pa.int32()), ("at", pa.int64())])

    def out(doc, sub, at) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(x).cast(f.type) for x, f in zip((doc, sub, at), schema, strict=True)], schema=schema
        )

    def settled(held: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor, doc, sub, at = (held.column(c).to_numpy() for c in ("k", "doc", "sub", "at"))
        place, count, off = _place_count_off(at)
        texts = held.column("text").to_pylist()
        number: dict[tuple, int] = {}
        same = np.array([number.setdefault(x, len(number)) for x in zip(anchor.tolist(), off.tolist(), texts, strict=True)])
        ranked, new, later = _earliest((same,), (doc, sub, place))
        gone = ranked[later]
        yield out(doc[gone], sub[gone], at[gone])
        kept = ranked[new]
        _, group, size = np.unique(anchor[kept], return_inverse=True, return_counts=True)
        kept, group = kept[size[group] > 1], group[size[group] > 1]
        if len(kept):
            segment, string = _repeated_strings(
                group, off[kept], count[kept], [texts[k] for k in kept.tolist()], (doc[kept], sub[kept], place[kept]), length
            )
            order = np.lexsort((string, segment))
            segment, string = segment[order], string[order]
            first = np.append(True, (segment[1:] != segment[:-1]) | (string[1:] != string[:-1] + 1))[: len(segment)]
            begins = np.flatnonzero(first)
            row = kept[segment[begins]]
            count = np.diff(np.append(begins, len(segment)))
            yield out(doc[row], sub[row], _at(place[row] + string[begins], count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        last: tuple | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kind = table.column("kind").to_numpy()
            some = table.filter(kind == REPEATED)
            if some.num_rows:
                yield out(*(some.column(c).to_numpy() for c in ("doc", "sub", "at")))
            some = table.filter(kind == STRING)
            if some.num_rows:
                columns = [some.column(c).to_numpy() for c in ("k", "k2", "doc", "sub", "at")]
                if last is not None:
                    # The first of the group that was open goes on in front.
                    columns = [np.append(x, column) for x, column in zip(last, columns, strict=True)]
                new = np.append(True, (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]))
                first = np.flatnonzero(new)[np.cumsum(new) - 1]
                later = np.any([c != c[first] for c in columns[2:]], axis=0)
                yield out(*(c[later] for c in columns[2:]))
                last = tuple(c[first[-1]] for c in columns)
            some = table.filter(kind == ONE_OF)
            if some.num_rows:
                held = some if held is None else pa.concat_tables([held, some])
                if held.nbytes >= ARRAY_BYTES:
                    keys = held.column("k").to_numpy()
                    cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
                    if cut:
                        yield from settled(held.slice(0, cut))
                        held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from settled(held)

    return (
        rows.repartition("k")
        .sortWithinPartitions("k", "k2", "doc", "sub", "at")
        .mapInArrow(run, "doc long, sub int, at long")
    )


def _kept(docs: DataFrame, length: int) -> DataFrame:
    """What is left of each document, from the list of its repeated strings."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
         ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), batch.column(2), strict=True):
                size, spans, kept = len(text), [], text
                if found.is_valid and len(found):
                    low, count, _ = _place_count_off(found.values.to_numpy())
                    high = low + count + length - 1
                    order = np.argsort(low)
                    low, high = low[order], np.maximum.accumulate(high[order])
                    # Spans that touch are one.
                    first = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
                    begins, ends = low[first].tolist(), high[np.append(first[1:], len(low)) - 1].tolist()
                    spans = list(zip(begins, ends, strict=True))
                    kept = b"".join([text[a:b] for a, b in zip([0, *ends], [*begins, size], strict=True)])
                rows.append((doc_id, size, size - len(kept), len(spans), hashlib.sha256(kept).hexdigest(),
                             [{"start": a, "end": b} for a, b in spans]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
            )

    return docs.mapInArrow(
        run,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<start:long,end:long>>",
    )


def remove_repeats(docs: DataFrame, length: int = 100, hot: int = HOT) -> DataFrame:
    """Per document what is left without the bytes of strings that start earlier, too.

    `docs` has `doc_id` and `text`; other columns are not looked at. Each byte goes that a
    string of `length` bytes (UTF-8) covers which also starts in a document with a smaller id, or
    earlier in the same one. Strings overlap, never reach over documents, and are judged
    on the texts as they come.

    Null and empty texts have no bytes. Rows that repeat an id are documents in the order of a hash
    of their texts; rows that repeat id and text are one document and get the same result.
    Rows without an id come after all others. An empty table gives an empty result. Documents may
    have any length.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (start, end).
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    own = docs.select(
        doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(int(_LAST))).alias("doc"), F.hash(text).alias("sub"), text.alias("text")
    )
    if not 0 < length <= _LONGEST:
        raise ValueError(f"strings have 1 to {_LONGEST} bytes")
    # By anchor there is at most one row from each batch; the others have a key of their own.
    total: Column = F.sum(F.when(F.col("kind") == MARK, F.col("at")).otherwise(1)).over(Window.partitionBy("k2"))
    with rows_per_batch(spark, TEXTS_PER_BATCH):
        found = settle(
            _find_segments(own, length)
            .withColumn("total", total)
            .where(F.col("kind").isin(REPEATED, ONE_OF) | (F.col("total") > 1))
            .select("kind", "k", "doc", "sub", "at", (F.col("total") > hot).alias("hot")),
            "suffix-found",
        )
    columns = ["k", "doc", "sub", "at"]
    crowded = found.where((F.col("kind") == MARK) & F.col("hot")).select("k", "hot").distinct()
    wanted = (
        found.where(F.col("kind") == ONLY)
        .select(*columns, "hot")
        .union(
            found.where(F.col("kind") == ONE_OF)
            .select(*columns)
            .join(crowded, "k", "left")
            .select(*columns, F.coalesce("hot", F.lit(False)).alias("hot"))
        )
    )
    # The texts are dealt out by document once, for their segments and for what is left of them.
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = own.repartition(partitions, "doc", "sub")
    repeated = _decide(_with_bytes(dealt, wanted, length), length).union(
        found.where(F.col("kind") == REPEATED).select("doc", "sub", "at")
    )
    lists = repeated.groupBy("doc", "sub").agg(F.collect_list("at").alias("found"))
    left = dealt.join(lists, ["doc", "sub"], "left").select("doc_id", "text", "found")
    with rows_per_batch(spark, TEXTS_PER_BATCH):
        return settle(_kept(left, length), "suffix-kept")
