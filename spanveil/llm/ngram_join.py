"""Similarity join of documents on word n-gram sets, and the classes it makes.

Two sets link when their Jaccard similarity reaches a threshold, given as a
fraction of whole numbers so that no rounding decides. The join is exact:

- Sets are put into *tiles* by size band and by the part of the set that falls
  into one of k slices of the hash space. Two linking sets differ in at most d
  members, so that of d + 1 slices one holds the same members of both; sets meet
  in a tile only if a whole slice agrees, so a passage that many documents share
  brings nothing together. A set emits its slices for its own band and, as the
  smaller of a pair, for the next one. Sets that leave many slices empty, which is
  very rare, also emit the empty ones.
- Within a tile sets are compared with a *leader* first: rows grow with the
  members, not with their square. Classes follow from the links; a tile whose
  members are all of one class is done. The others take another leader, and what
  is still open after that is compared by pairs of different classes, in
  blocks of bounded size. Linking sets agree in many slices, so that a set's largest tiles,
  one less than it must share, are left out there.
- Each pair is tested on *bitmap signatures* first: members of one set whose bit
  is not set in the other cannot be shared, so bit counts bound the overlap from
  above. What passes is settled by intersecting the sorted sets.

Links are counted after that: linking sets are of one class, so all pairs of a class are compared
by their members, in blocks of bounded size, and only sums leave a block.

Equal sets are one row from the start. Every shuffle is by tile, pair or id, with
partial results per task, and no list of a tile is ever gathered whole.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.llm.classes import connected_classes
from spanveil.llm.common import rows_per_batch, settle
from spanveil.llm.shingles import mix, shingle_set

#: Bits of a signature for each member of the set; the next power of two is taken.
BITS_PER_MEMBER = 4
#: Members of a tile that are compared with each other as one block.
BLOCK = 512
#: Members of sets, in all, that a block of a class holds when links are counted.
BLOCK_MEMBERS = 1 << 19
#: Texts, and pairs of sets, that a Python worker holds at a time.
TEXTS_PER_BATCH, SETS_PER_BATCH = 2000, 500
#: Groups that the settled rows of a tile are dealt to.
SALTS = 1024
#: Leaders a tile takes before its open pairs are compared in blocks.
LEADERS = 2
#: Open members from which a tile leaves pairs to an earlier tile that they share.
CROWDED = 64
#: Of its crowded tiles, those that a set shows to leave pairs to one of them.
SHOWN = 16
#: Rows of blocks that a worker gets at a time.
ROWS_PER_BATCH = 2000
#: Most ids that are sent to the executors to choose texts, of 8 bytes each; more are joined.
SENT_IDS = 500_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@lru_cache
def band_edges(upto: int, num: int, den: int) -> tuple[int, ...]:
    """First sizes of the bands, from 1 to the second one behind `upto`.

    The last size of a band is at least den / num times its first, so that
    linking sets are in the same band or in neighbouring ones.
    """
    edges = [1]
    while len(edges) < 3 or edges[-2] <= upto:
        low = edges[-1]
        edges.append(max(low + 1, 3 * low // 2, den * low // num + 1))
    return tuple(edges)


def slices_of(last: int, num: int, den: int) -> tuple[int, int]:
    """Slices for pairs of at most `last` members each, and how many of them may differ."""
    # |x & y| * den >= num * |x | y|  <=>  |x & y| * (den + num) >= num * (|x| + |y|),
    # so that |x| + |y| - 2 * |x & y| <= (|x| + |y|) * (den - num) / (den + num).
    most = 2 * last * (den - num) // (den + num)
    return most + 1 + max(2, most // 8), most


def tiles_of(hashes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, list[int]]:
    """The tiles of one set of sorted distinct hashes, and how many of them a linking set shares.

    The lowest bit of a tile tells even bands from odd ones. What is shared at least is given
    for both, 0 if the set has no tiles there.
    """
    size = len(hashes)
    edges = band_edges(1 << (size - 1).bit_length(), num, den)
    band = bisect_right(edges, size) - 1
    keys, least = [], [0, 0]
    # In the next band, only if a partner can be so large.
    reach = [band] + [band + 1] * (size * den >= num * edges[band + 1])
    scattered = mix(hashes)
    for one in reach:
        count, most = slices_of(edges[one + 1] - 1, num, den)
        if most == 0:
            continue  # only equal sets link, and they are one row already
        slot = ((scattered >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        sums = np.zeros(count, dtype=np.uint64)
        np.add.at(sums, slot.astype(np.int64), mix(hashes ^ _GOLDEN))
        members = np.bincount(slot.astype(np.int64), minlength=count)
        empty = int((members == 0).sum())
        tag = mix(
            np.arange(count, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(one + 1)
        )
        own = (mix(sums + tag) & ~np.uint64(1)) | np.uint64(one & 1)
        # Of `count` slices at least count - most agree. If that many are empty, they could
        # be the ones that agree, so such a set shows its empty slices too.
        keys.append(own if empty >= count - most else own[members > 0])
        # As for `most`, with the size of this set and the largest one that links with it. A
        # slice that agrees and isn't empty is shown by both.
        other = min(edges[one + 1] - 1, size * den // num)
        differ = (size + other) * (den - num) // (den + num)
        least[one & 1] = max(1, count - differ - empty)
    return np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64), least


def tile_keys(hashes: np.ndarray, num: int, den: int) -> np.ndarray:
    """The tiles of one set of sorted distinct hashes."""
    return tiles_of(hashes, num, den)[0]


def signature(hashes: np.ndarray) -> bytes:
    """One bit for each member, at a place that its hash gives, in 2**k bits for the size."""
    count = 1 << max(6, (BITS_PER_MEMBER * len(hashes) - 1).bit_length())
    bits = np.zeros(count, dtype=np.uint8)
    bits[((hashes >> np.uint64(7)) & np.uint64(count - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def stacked(signatures: list[bytes]) -> np.ndarray:
    """Signatures as rows of 64-bit words, the longer ones folded to the length of the shortest."""
    shortest = min(map(len, signatures))
    rows = b"".join(
        s
        if len(s) == shortest
        else np.bitwise_or.reduce(np.frombuffer(s, np.uint64).reshape(-1, shortest // 8)).tobytes()
        for s in signatures
    )
    return np.frombuffer(rows, dtype=np.uint64).reshape(len(signatures), -1)


def overlap_bound(
    one: np.ndarray, size_one: np.ndarray, two: np.ndarray, size_two: np.ndarray
) -> np.ndarray:
    """Upper bound of the overlap of sets, from their stacked signatures."""
    only_one = np.bitwise_count(one & ~two).sum(axis=-1, dtype=np.int64)
    only_two = np.bitwise_count(two & ~one).sum(axis=-1, dtype=np.int64)
    return np.minimum(size_one - only_one, size_two - only_two)


def _batches(make, schema: pa.Schema):
    """A function of batches of Arrow, from one of tables of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for columns in make(batch):
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def digest(found: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    one = int(np.add.reduce(mix(found ^ _GOLDEN), dtype=np.uint64))
    return one, int(np.bitwise_xor.reduce(mix(found + _GOLDEN), initial=np.uint64(0)))


def _describe(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Per document its set's size, a 128-bit digest of the set, signature and tiles.

    `even` and `odd` are what `tiles_of` says to be shared; 0 for a copy without tiles.
    """
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n", pa.int64()),
            ("d1", pa.int64()),
            ("d2", pa.int64()),
            ("bits", pa.binary()),
            ("tiles", pa.binary()),
            ("even", pa.int64()),
            ("odd", pa.int64()),
        ]
    )

    def make(batch: pa.RecordBatch):
        ids, texts = batch.column(0), batch.column(1)
        n, d1, d2, bits, tiles, shared = [], [], [], [], [], []
        seen: set[tuple[int, int, int]] = set()
        for doc_id, text in zip(ids, texts, strict=True):
            found = shingle_set(text.as_py(), width)
            one, two = digest(found)
            # Rows without an id go no further, so they stand for none of their copies.
            known = not doc_id.is_valid or (len(found), one, two) in seen
            if doc_id.is_valid:
                seen.add((len(found), one, two))
            n.append(len(found))
            d1.append(one)
            d2.append(two)
            bits.append(signature(found))
            # A copy in the same batch has nothing to add.
            keys, least = (b"", [0, 0]) if known or not len(found) else tiles_of(found, num, den)
            tiles.append(bytes(keys))
            shared.append(least)
        yield [
            ids,
            pa.array(n, pa.int64()),
            _signed(np.array(d1, dtype=np.uint64)),
            _signed(np.array(d2, dtype=np.uint64)),
            pa.array(bits, pa.binary()),
            pa.array(tiles, pa.binary()),
            *[pa.array([least[k] for least in shared], pa.int64()) for k in (0, 1)],
        ]

    frame = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return frame.mapInArrow(
        _batches(make, schema),
        "doc_id long, n long, d1 long, d2 long, bits binary, tiles binary, even long, odd long",
    )


def _tile_rows(described: DataFrame) -> DataFrame:
    """(tile, one, two): a set (two is null), or a set `two` beside its leader in a batch.

    Of the sets of one batch that share a tile only the leader goes on, so
    that a tile of very many sets has few rows for each task.
    """
    schema = pa.schema([("tile", pa.int64()), ("one", pa.int64()), ("two", pa.int64())])

    def make(batch: pa.RecordBatch):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        blobs = [blob.as_buffer() for blob in batch.column(1)]
        counts = np.array([len(blob) // 8 for blob in blobs], dtype=np.int64)
        keys = np.concatenate([np.frombuffer(blob, dtype=np.int64) for blob in blobs])
        sets = np.repeat(ids, counts)
        order = np.lexsort((sets, keys))
        keys, sets = keys[order], sets[order]
        first = np.ones(len(keys), dtype=bool)
        first[1:] = keys[1:] != keys[:-1]
        leader = sets[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(keys) else sets
        again = ~first & (leader != sets)
        tiles = np.concatenate([keys[first], keys[again]])
        ones = np.concatenate([sets[first], leader[again]])
        twos = np.concatenate([np.zeros(int(first.sum()), np.int64), sets[again]])
        none = np.concatenate([np.ones(int(first.sum()), bool), np.zeros(int(again.sum()), bool)])
        yield [pa.array(tiles), pa.array(ones), pa.array(twos, mask=none)]

    return described.select("doc_id", "tiles").mapInArrow(
        _batches(make, schema), "tile long, one long, two long"
    )


def _passing(pairs: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b), those whose sizes and signatures allow a link."""
    one = sizes.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    two = sizes.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def make(batch: pa.RecordBatch):
        a, b, na, nb = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        bits = [batch.column(k).to_pylist() for k in (4, 5)]
        lengths = np.minimum(*[np.array([len(x) for x in some]) for some in bits])
        most = np.zeros(len(a), dtype=np.int64)
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            # Pairs of one length at a time; a pair's longer signature is folded.
            words = stacked([some[r] for some in bits for r in rows])
            most[rows] = overlap_bound(words[: len(rows)], na[rows], words[len(rows) :], nb[rows])
        keep = most * (den + num) >= num * (na + nb)
        yield [pa.array(a[keep]), pa.array(b[keep])]

    return (
        pairs.join(one, "a")
        .join(two, "b")
        .select("a", "b", "na", "nb", "ba", "bb")
        .mapInArrow(_batches(make, schema), "a long, b long")
    )


def _links(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Of the pairs, those that link: the sorted sets are intersected.

    The sets are made from the texts of the documents that occur in a pair. Each
    set travels once for each of its pairs, in rows of their own, and a pair
    is a group of two.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    if ids.limit(SENT_IDS + 1).count() <= SENT_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    packed = texts.join(ids, "doc_id", "left_semi").mapInArrow(
        _batches(
            lambda batch: [
                [
                    batch.column(0),
                    pa.array(
                        [shingle_set(x.as_py(), width).tobytes() for x in batch.column(1)],
                        pa.binary(),
                    ),
                ]
            ],
            pa.schema([("doc_id", pa.int64()), ("members", pa.binary())]),
        ),
        "doc_id long, members binary",
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def make(batch: pa.RecordBatch):
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
            shared = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(den * shared >= num * (len(x) + len(y) - shared))
        keep = np.array(keep, dtype=bool)
        yield [pa.array(batch.column(k).to_numpy(zero_copy_only=False)[keep]) for k in (0, 1)]

    one = packed.select(F.col("doc_id").alias("a"), F.col("members").alias("x"))
    two = packed.select(F.col("doc_id").alias("b"), F.col("members").alias("y"))
    return (
        pairs.join(one, "a")
        .join(two, "b")
        .select("a", "b", "x", "y")
        .mapInArrow(_batches(make, schema), "a long, b long")
    )


def _ordered(one: str, two: str) -> list:
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def _open_tiles(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of tiles that hold several classes, with their class.

    Two sets that are alone in a tile have been compared there.
    """
    placed = members.join(
        classes.select(F.col("id").alias("set_id"), "class_id"), "set_id", "left"
    ).withColumn("class_id", F.coalesce("class_id", "set_id"))
    spread = (
        placed.groupBy("tile")
        .agg(
            F.min("class_id").alias("low"),
            F.max("class_id").alias("high"),
            F.count("*").alias("sets"),
        )
        .where("low < high and sets > 2")
        .select("tile")
    )
    return placed.join(spread, "tile")


def _rarest_tiles(open_members: DataFrame, shared: DataFrame) -> DataFrame:
    """Open tiles without those that a set can do without.

    Sets that link and are of different classes have so many open tiles in common that, of those
    of either in order of size, the first one in common comes before its last `least - 1`.
    """
    sized = open_members.join(
        open_members.groupBy("tile").agg(F.count("*").alias("size")), "tile"
    ).withColumn("is_odd", F.col("tile").bitwiseAND(F.lit(1)))
    least = F.greatest(F.when(F.col("is_odd") == 1, F.col("odd")).otherwise(F.col("even")), F.lit(1))
    # At most the tiles of one set.
    own = Window.partitionBy("set_id", "is_odd")
    kept = (
        sized.join(shared, "set_id")
        .withColumn("place", F.row_number().over(own.orderBy("size", "tile")))
        .withColumn("held", F.count("*").over(own))
        .where(F.col("place") <= F.col("held") - least + 1)
        .select("tile", "set_id", "class_id")
    )
    spread = (
        kept.groupBy("tile")
        .agg(F.min("class_id").alias("low"), F.max("class_id").alias("high"))
        .where("low < high")
        .select("tile")
    )
    return kept.join(spread, "tile")


def _blocks(open_members: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of sets of different classes in one tile that signatures allow, block by block.

    Near copies meet in many tiles. Of its crowded tiles a set shows the largest ones, and a pair
    doesn't leave a crowded tile if both sets show one that comes before it; that tile, too,
    holds both, and is open, as the classes differ.
    """
    counts = open_members.groupBy("tile").agg(F.count("*").alias("size")).select(
        "tile",
        F.col("size"),
        F.ceil(F.col("size") / F.lit(BLOCK)).cast("int").alias("blocks"),
        (F.col("size") >= CROWDED).alias("crowded"),
    )
    placed = open_members.join(counts, "tile")
    # At most the tiles of one set, which are fewer than its members.
    largest = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("order"), "tile")))
    lists = (
        placed.where("crowded").groupBy("set_id").agg(F.slice(largest, 1, SHOWN)["tile"].alias("tiles"))
    )
    rows = (
        placed.join(lists, "set_id", "left")
        .join(sizes.select("set_id", "n", "bits"), "set_id")
        .withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "tile",
            F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"),
            F.col("block").alias("own"),
            "set_id",
            "class_id",
            "n",
            "bits",
            F.when(F.col("crowded"), F.col("tiles")).alias("tiles"),
        )
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs_of(tile, own, ids, classes, n, bits, tiles, i, j):
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if not len(left) or not len(right):
            return None
        words = stacked(bits)
        a, b = [], []
        for x in left:
            most = overlap_bound(words[x], n[x], words[right], n[right])
            fits = most * (den + num) >= num * (n[x] + n[right])
            fits &= classes[right] != classes[x]
            if i == j:
                fits &= ids[right] > ids[x]
            if tiles is not None:
                for y in np.flatnonzero(fits).tolist():
                    # Of the tiles that either shows; those that it doesn't show come later.
                    both = np.flatnonzero(np.isin(tiles[x], tiles[right[y]]))
                    here = np.flatnonzero(tiles[x] == tile)
                    fits[y] = not len(both) or (len(here) > 0 and here[0] <= both[0])
            a.append(np.full(int(fits.sum()), ids[x]))
            b.append(ids[right[fits]])
        a, b = np.concatenate(a), np.concatenate(b)
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def cut(table: pa.Table, last: bool):
            """Whole blocks of the table, and what may go on in the next batch."""
            keys = [table.column(k).to_numpy() for k in range(3)]
            change = np.ones(table.num_rows, dtype=bool)
            change[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            starts = np.flatnonzero(change)
            ends = np.append(starts[1:], table.num_rows)
            if not last:
                starts, ends = starts[:-1], ends[:-1]
            own, ids, classes, n = (table.column(k).to_numpy() for k in range(3, 7))
            bits = table.column(7).to_pylist()
            lists = table.column(8).combine_chunks()
            a, b = [], []
            for s, e in zip(starts, ends, strict=True):
                if e - s < 2:
                    continue
                tiles = [x.values.to_numpy() for x in lists.slice(s, e - s)] if lists[int(s)].is_valid else None
                pair = pairs_of(
                    keys[0][s], own[s:e], ids[s:e], classes[s:e], n[s:e], bits[s:e], tiles, keys[1][s], keys[2][s]
                )
                if pair is not None:
                    a.append(pair[0])
                    b.append(pair[1])
            tail = table.slice(int(ends[-1]) if len(ends) else 0)
            found = None
            if a:
                both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
                found = pa.RecordBatch.from_arrays(
                    [pa.array(both[0]), pa.array(both[1])], schema=schema
                )
            return found, tail

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            found, rest = cut(table, last=False)
            if found is not None:
                yield found
        if rest is not None and rest.num_rows:
            found, _ = cut(rest, last=True)
            if found is not None:
                yield found

    return (
        rows.repartition("tile", "i", "j")
        .sortWithinPartitions("tile", "i", "j")
        .mapInArrow(run, "a long, b long")
        .where("a < b")
        .distinct()
    )


def linked_rows(
    sets: list[np.ndarray], own: np.ndarray, copies: np.ndarray, i: int, j: int, num: int, den: int
) -> np.ndarray:
    """For each set of a block pair, the copies of the sets of the other block that link with it."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = count > 1
    # Members of one set only are shared with none.
    keep = shared[column]
    row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
    words = np.zeros((len(sets), int(shared.sum()) // 64 + 1), dtype=np.uint64)
    bit = np.uint64(1) << (column & 63).astype(np.uint64)
    np.bitwise_or.at(words, (row, column >> 6), bit)
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    linked = np.zeros(len(sets), dtype=np.int64)
    theirs = words[right]
    for x in left:
        both = np.bitwise_count(words[x] & theirs).sum(axis=1, dtype=np.int64)
        links = (both * (den + num) >= num * (sizes[x] + sizes[right])) & (right != x)
        linked[x] += copies[right[links]].sum()
        if i != j:
            linked[right[links]] += copies[x]
    return linked


def _link_counts(
    classes: DataFrame, equal: DataFrame, docs: DataFrame, width: int, num: int, den: int
) -> DataFrame:
    """(n, d1, d2, linked): how many documents of other sets each set links with.

    All pairs of a class are compared; a large class is cut into blocks, and a set travels
    once for each block of its class.
    """
    placed = equal.select("set_id", "n", "d1", "d2", "copies").join(
        classes.select(F.col("id").alias("set_id"), "class_id"), "set_id"
    )
    # At least BLOCK sets or BLOCK_MEMBERS members each, so they are few.
    large = (
        placed.groupBy("class_id")
        .agg(
            F.greatest(
                F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_MEMBERS))
            ).cast("int").alias("blocks")
        )
        .where("blocks > 1")
    )
    ids = placed.select(F.col("set_id").alias("doc_id")).distinct()
    if ids.limit(SENT_IDS + 1).count() <= SENT_IDS:
        ids = F.broadcast(ids)
    schema = pa.schema(
        [("set_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("members", pa.binary())]
    )

    def pack(batch: pa.RecordBatch):
        sets = [shingle_set(x.as_py(), width) for x in batch.column(1)]
        digests = np.array([digest(x) for x in sets], dtype=np.uint64).reshape(-1, 2)
        yield [
            batch.column(0),
            pa.array([len(x) for x in sets], pa.int64()),
            _signed(digests[:, 0]),
            _signed(digests[:, 1]),
            pa.array([x.tobytes() for x in sets], pa.binary()),
        ]

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    packed = texts.join(ids, "doc_id", "left_semi").mapInArrow(
        _batches(pack, schema), "set_id long, n long, d1 long, d2 long, members binary"
    )
    rows = (
        placed.join(packed, ["set_id", "n", "d1", "d2"])
        .join(F.broadcast(large), "class_id", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("n", "d1", "d2"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "class_id",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            "n",
            "d1",
            "d2",
            "own",
            "copies",
            "members",
        )
    )
    out = pa.schema([("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("linked", pa.int64())])

    def counted(group: pa.Table, i: int, j: int) -> pa.RecordBatch:
        n, d1, d2, own, copies = (group.column(k).to_numpy() for k in range(3, 8))
        # Rows that repeat an id and its text are one set.
        first = np.unique(np.stack([n, d1, d2]), axis=1, return_index=True)[1]
        blobs = group.column(8).to_pylist()
        sets = [np.frombuffer(blobs[k], dtype=np.uint64) for k in first]
        linked = linked_rows(sets, own[first], copies[first], i, j, num, den)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (n[first], d1[first], d2[first], linked)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups(table: pa.Table, last: bool):
            keys = np.stack([table.column(k).to_numpy() for k in range(3)])
            starts = np.flatnonzero(np.append(True, np.any(keys[:, 1:] != keys[:, :-1], axis=0)))
            ends = np.append(starts[1:], table.num_rows)
            whole = len(starts) if last else len(starts) - 1
            for s, e in zip(starts[:whole], ends[:whole], strict=True):
                if e - s > 1:
                    yield counted(table.slice(s, e - s), keys[1, s], keys[2, s])

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                table = table if rest is None else pa.concat_tables([rest, table])
                yield from groups(table, last=False)
                keys = np.stack([table.column(k).to_numpy() for k in range(3)])
                change = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0))
                rest = table.slice(int(change[-1]) + 1 if len(change) else 0)
        if rest is not None:
            yield from groups(rest, last=True)

    return (
        rows.repartition("class_id", "i", "j")
        .sortWithinPartitions("class_id", "i", "j")
        .mapInArrow(run, "n long, d1 long, d2 long, linked long")
        .groupBy("n", "d1", "d2")
        .agg(F.sum("linked").alias("linked"))
    )


def ngram_classes(
    docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, *, count_links: bool = True
) -> DataFrame:
    """Per document the size of its n-gram set and the smallest id reachable by links.

    `docs` has `doc_id` (integer) and `text`; other columns are not looked at.
    Sets hold the distinct runs of `width` words, A to Z lower-cased; a text with
    fewer words is one run. Two sets link when den * |x & y| >= num * |x | y|.

    Null, empty or blank texts have no set and link with nothing. Rows that repeat
    a doc_id give one row each, with the size of their own text; they link
    through any of their texts. Rows whose doc_id is null are returned with
    class null. An empty table gives an empty result.

    Returns doc_id, n_shingles, component_id, copies (documents with an equal set)
    and, unless `count_links` is false, links: how many other documents it links with, all of
    them, copies among them. Pairs are not written out.
    """
    spark = docs.sparkSession
    with rows_per_batch(spark, TEXTS_PER_BATCH):
        described = settle(_describe(docs, width, num, den), "ngram-sets")
    known = described.where("doc_id is not null and n > 0")
    # Equal sets are one: the smallest document stands for all.
    equal = settle(
        known.groupBy("n", "d1", "d2").agg(
            F.min("doc_id").alias("set_id"),
            F.count("*").alias("copies"),
            F.min("bits").alias("bits"),
            F.max("even").alias("even"),
            F.max("odd").alias("odd"),
        ),
        "ngram-equal",
    )
    sizes = equal.select("set_id", "n", "bits")
    stands = (
        known.select("doc_id", "n", "d1", "d2")
        .join(equal.select("n", "d1", "d2", "set_id"), ["n", "d1", "d2"])
        .select("doc_id", "set_id")
        .distinct()
    )
    stands = settle(stands, "ngram-stands")
    # An id that is repeated with other texts holds their sets together.
    lowest = stands.groupBy("doc_id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b"))
    held = (
        stands.join(lowest.where("a < b").select("doc_id", "a"), "doc_id")
        .where("a < set_id")
        .select("a", F.col("set_id").alias("b"))
        .distinct()
    )
    # In a batch rows have both ends, and are only dealt out. Between batches: the leader of
    # each beside the smallest, at most one row of a tile from each batch.
    rows = _tile_rows(known.where(F.length("tiles") > 0))
    whole = F.when(F.col("two").isNull(), -1).otherwise(F.pmod("two", F.lit(SALTS)))
    rows = (
        rows.withColumn("salt", whole)
        .withColumn("low", F.min("one").over(Window.partitionBy("tile", "salt")))
        .select("tile", "one", F.coalesce("two", "low").alias("two"))
        .where("one != two")
    )
    met = settle(
        rows.join(stands.toDF("one", "set_one"), "one")
        .join(stands.toDF("two", "set_two"), "two")
        .where("set_one != set_two")
        .select("tile", F.col("set_one").alias("one"), F.col("set_two").alias("two"))
        .distinct(),
        "ngram-met",
    )
    members = settle(
        met.select("tile", F.explode(F.array("one", "two")).alias("set_id")).distinct(),
        "ngram-members",
    )

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = settle(_passing(pairs, sizes, num, den).distinct(), f"ngram-pairs-{name}")
        return exact(pairs, name)

    def exact(pairs: DataFrame, name: str) -> DataFrame:
        with rows_per_batch(spark, SETS_PER_BATCH):
            links = _links(pairs, docs, width, num, den).distinct()
            return settle(links, f"ngram-links-{name}")

    tried = settle(met.select(*_ordered("one", "two")).distinct(), "ngram-tried")
    links = settle(verified(tried, "first").union(held).distinct(), "ngram-links")
    classes = connected_classes(links)
    remaining = settle(_open_tiles(members, classes), "ngram-open")
    for turn in range(LEADERS):
        if remaining.isEmpty():
            break
        # Another leader for each tile: the next by an order of this turn.
        order = F.xxhash64("set_id", F.lit(turn))
        leaders = remaining.groupBy("tile").agg(
            F.min_by(F.struct("set_id", "class_id"), F.struct(order, F.col("set_id"))).alias("top")
        )
        pairs = (
            remaining.join(leaders, "tile")
            .where("class_id != top.class_id")
            .select(*_ordered("set_id", "top.set_id"))
            .distinct()
            .join(tried, ["a", "b"], "left_anti")
        )
        pairs = settle(pairs, "ngram-turn")
        links = settle(links.union(verified(pairs, f"turn{turn}")), "ngram-links")
        tried = tried.union(pairs)
        classes = connected_classes(links)
        remaining = settle(_open_tiles(members, classes), "ngram-open")
    if not remaining.isEmpty():
        rarest = settle(_rarest_tiles(remaining, equal.select("set_id", "even", "odd")), "ngram-rare")
        pairs = _blocks(rarest, sizes, num, den).join(tried, ["a", "b"], "left_anti")
        with rows_per_batch(spark, ROWS_PER_BATCH):
            pairs = settle(pairs, "ngram-blocks")
        links = settle(links.union(exact(pairs, "last")), "ngram-links")
        classes = connected_classes(links)

    labelled = equal.join(
        classes.select(F.col("id").alias("set_id"), "class_id"), "set_id", "left"
    ).withColumn("class_id", F.coalesce("class_id", "set_id"))
    result = [
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("class_id", "doc_id").alias("component_id"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
    ]
    if count_links:
        with rows_per_batch(spark, SETS_PER_BATCH):
            counts = settle(_link_counts(classes, equal, docs, width, num, den), "ngram-counts")
        labelled = labelled.join(counts, ["n", "d1", "d2"], "left")
        others = F.col("copies") - 1 + F.coalesce("linked", F.lit(0))
        result.append(F.when(F.col("doc_id").isNotNull(), F.coalesce(others, F.lit(0))).otherwise(0).alias("links"))
    labelled = labelled.drop("set_id", "bits", "even", "odd")
    return described.select("doc_id", "n", "d1", "d2").join(labelled, ["n", "d1", "d2"], "left").select(result)


def first_of_each_class(
    docs: DataFrame, width: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """The documents, of each class of near copies only the one with the smallest id.

    All columns and rows of what is kept stay as they are; documents without
    words, and rows without an id, are all kept.
    """
    classes = ngram_classes(docs, width, num, den, count_links=False)
    repeated = (
        classes.where("component_id < doc_id").select(F.col("doc_id").alias("_copy")).distinct()
    )
    # Sorted and merged at any size, so that small tables tell what large ones take.
    return docs.join(repeated.hint("merge"), docs["doc_id"] == repeated["_copy"], "left_anti")
