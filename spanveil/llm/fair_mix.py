"""Mixing of sources to target weights by weighted fair queueing.

Each source has a target, a share of the words of the mix. Its documents stand in a
shuffled queue, all of them once and then all of them again. A document's virtual
finish time is the words of its source up to its end, divided by the target of the
source; the documents of all sources are sorted by it and taken until the budget
is spent, so that at every moment each source has had its share.

Only DataFrame functions are used. No running sum goes over a whole source, over all sources or
over the whole mix in one task: documents are put into ranges of the sort key, sums of the
ranges give the offsets, and only within a range rows are in order. Windows without a key
are over such sums, a row for each range. Of the final sort only the place where the
budget ends is needed: it is found range by range, and every document is compared with it where
it lies. There may be as many sources as documents.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.llm.common import settle, word_count

#: Ranges of the shuffled order of a source, and of one unit of virtual time.
RANGES = 4096
#: Groups that rows of a source without an id, and of one size, are dealt to.
SALTS = 16
#: Where rows without an id stand in the queue of their source.
_NO_ID = int(hashlib.md5(b"").hexdigest()[:15], 16)


def _source_key(source: Column) -> Column:
    """Sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _in_order(frame: DataFrame, columns: Sequence[str], purpose: str) -> DataFrame:
    """The frame, settled in ranges of its columns; `part` numbers the ranges in their order."""
    ranged = frame.repartitionByRange(*columns).withColumn("part", F.spark_partition_id())
    return settle(ranged, purpose)


def _before(sums: DataFrame, amount: str, *order: str) -> DataFrame:
    """`before`: what earlier ranges sum to; a row for each range."""
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("before", F.coalesce(F.sum(amount).over(earlier), F.lit(0)))


def source_targets(
    sizes: DataFrame, weights: Sequence[int], percent: int, most: int
) -> tuple[DataFrame, int]:
    """Target of each source (`key`, `source_size`): shares by weight of `percent` of all words.

    Weights repeat over the sources in the order of their keys. No target is above
    `most` times the size of its source; what is cut off is shared again by weight. Sources are
    ranked by ranges of their keys. The level that all others share is found from sums
    over the sources: a source that is full at a level is full at any higher one, so
    the level rises until no further source is full.

    Returns the targets and the number of all words.
    """
    ranged = _in_order(sizes, ["key"], "mix-sources")
    counts = ranged.groupBy("part").agg(F.count("*").alias("sources"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = settle(
        ranged.join(_before(counts, "sources", "part"), "part").select(
            "key",
            "source_size",
            F.element_at(cycle, (rank % len(weights) + 1).cast("int")).alias("weight"),
            (F.col("source_size") * most).cast("double").alias("cap"),
        ),
        "mix-weights",
    )
    total = weighted.agg(F.sum("source_size").alias("total")).first()["total"] or 0
    full, found, level = F.lit(False), 0, float("inf")
    while True:
        row = weighted.agg(
            F.count_if(full).alias("full"),
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("cap"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
        ).first()
        if row["weight"] is None:
            level = float("inf")
            break
        if row["full"] == found and level < float("inf"):
            break
        found, level = row["full"], (total * percent / 100.0 - row["cap"]) / row["weight"]
        full = F.col("cap") <= F.col("weight") * F.lit(level)
    target = F.least(F.col("weight") * F.lit(level), F.col("cap"))
    return weighted.select("key", "source_size", target.alias("target")), total


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    percent: int = 150,
    most: int = 2,
) -> DataFrame:
    """Words that a mix of all sources takes of each document.

    `docs` has `doc_id`, `text` and `source`; other columns are not looked at. The
    size of a document is its number of words, 0 for null. The mix holds `percent` of all
    words; no document is taken more than `most` times.

    Null sources are one source, the last. Documents without words are returned with
    taken 0. Rows with the same doc_id, or null, are documents of their own. The queue is
    shuffled by a digest of the id, so that reruns agree. Only the last document taken may be
    taken in part. An empty table gives an empty result.

    Returns doc_id, size, source_size, target (of the source), taken.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    sized = settle(
        docs.select(
            "doc_id",
            _source_key(F.col("source").cast("string")).alias("key"),
            word_count(F.col("text").cast("string")).alias("size"),
            F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long").alias("place"),
            # Rows without an id and of one size may stand in any order.
            F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"),
        ),
        "mix-sizes",
    )
    sums = settle(sized.groupBy("key").agg(F.sum("size").alias("source_size")), "mix-sums")
    targets, total = source_targets(sums, weights, percent, most)

    # Rows without an id share one place: before and behind it are ranges of their own, and they
    # are in ranges by size.
    nameless = F.col("doc_id").isNull()
    ranges = ["range", "side", "sub", "salt"]
    ranged = sized.select(
        "doc_id",
        "key",
        "size",
        "place",
        F.shiftright("place", 48).alias("range"),
        F.when(nameless, 1).when(F.col("place") < F.lit(_NO_ID), 0).otherwise(2).alias("side"),
        F.when(nameless, F.col("size")).otherwise(0).alias("sub"),
        F.when(nameless, F.col("salt")).otherwise(0).alias("salt"),
    )
    earlier = Window.partitionBy("key").orderBy(*ranges).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("key", *ranges)
        .agg(F.sum("size").alias("words"))
        .select("key", *ranges, F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    )
    within = (
        Window.partitionBy("key", *ranges)
        .orderBy("place", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    queued = settle(
        ranged.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(offsets, ["key", *ranges])
        .join(targets, "key")
        .select(
            "doc_id",
            "key",
            "size",
            "source_size",
            "target",
            (F.col("offset") + F.col("ahead")).alias("start"),
        ),
        "mix-queued",
    )
    cut = _end_of_budget(queued, min(total * percent // 100, total * most), most)

    def taken(turn: int) -> Column:
        if cut is None:
            return F.lit(0).cast("long")
        start = F.col("start") + turn * F.col("source_size")
        here = F.struct(_finish(start).alias("f"), F.col("key").alias("k"), start.alias("s"))
        last = F.struct(
            F.lit(cut["finish"]).alias("f"), F.lit(cut["key"]).alias("k"), F.lit(cut["start"]).alias("s")
        )
        return (
            F.when((F.col("size") == 0) | (F.col("target") == 0), 0)
            .when(here < last, F.col("size"))
            .when(here == last, F.lit(cut["left"]))
            .otherwise(0)
            .cast("long")
        )

    parts = taken(0)
    for turn in range(1, most):
        parts = parts + taken(turn)
    return queued.select("doc_id", "size", "source_size", "target", parts.alias("taken"))


def _finish(start: Column) -> Column:
    return (start + F.col("size")) / F.col("target")


def _reached(sums: DataFrame, name: str, left: int) -> tuple:
    """The range in which so many words are reached, and how many of them lie in it."""
    row = (
        _before(sums, "words", name)
        .where(F.col("before") + F.col("words") >= left)
        .orderBy(name)
        .first()
    )
    return row[name], left - row["before"]


def _end_of_budget(queued: DataFrame, left: int, most: int):
    """Where the sorted mix ends: the last document's sort key, and the words taken of it.

    None if there is nothing to take. Ranges of virtual time are summed, then ranges of the
    whole sort key within the one in which the budget ends, and a range of these is put in
    order. All sources that are full end at one time, so that the second ranges are of
    what is there, not of time.
    """
    if not left:
        return None
    turns = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("turn")
    entries = (
        queued.where("size > 0 and target > 0")
        .select("*", turns)
        .withColumn("start", F.col("start") + F.col("turn") * F.col("source_size"))
        .withColumn("finish", _finish(F.col("start")))
    )
    # The budget ends near 1; all that is far behind is one range.
    time = F.least(F.floor(F.col("finish") * F.lit(float(RANGES))), F.lit(2 * RANGES))
    at, left = _reached(entries.groupBy(time.alias("range")).agg(F.sum("size").alias("words")), "range", left)
    order = ["finish", "key", "start"]
    entries = _in_order(entries.where(time == at), order, "mix-end")
    at, left = _reached(entries.groupBy("part").agg(F.sum("size").alias("words")), "part", left)
    upto = F.sum("size").over(Window.partitionBy("part").orderBy(*order))
    last = (
        entries.where(F.col("part") == at)
        .withColumn("upto", upto)
        .where(F.col("upto") >= left)
        .orderBy(*order)
        .first()
    )
    return {
        "finish": last["finish"],
        "key": last["key"],
        "start": last["start"],
        "left": left - (last["upto"] - last["size"]),
    }


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    percent: int = 150,
    most: int = 2,
) -> DataFrame:
    """The documents of the mix, each as many times as the mix takes it.

    Columns stay as they are. Of the one document taken in part the whole text is
    kept. Documents without words, which have no size to be queued by, stay once.
    """
    plan = mix(docs, weights, percent, most).select(
        F.col("doc_id").alias("_doc_id"),
        F.when(F.col("size") == 0, 1)
        .otherwise(F.ceil(F.col("taken") / F.greatest("size", F.lit(1))))
        .cast("int")
        .alias("_times"),
    )
    # Rows of one id share what their id is taken; ids are keys in all but faulty tables.
    plan = plan.groupBy("_doc_id").agg(F.max("_times").alias("_times")).where("_times > 0")
    turn = f"_turn_{uuid.uuid4().hex}"
    return (
        docs.join(plan.hint("merge"), docs["doc_id"].eqNullSafe(plan["_doc_id"]))
        .select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), plan["_times"])).alias(turn))
        .drop(turn)
    )
