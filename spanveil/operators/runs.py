"""Documents in segments that are too long for one row.

Their text, the segments joined by line ends, is never one string. It is cut into *runs* of
so many characters, and each is searched with the end of the text before it and the beginning of
that behind it. A span belongs to the run in which it starts, so none is found twice. What is
found is as in the whole text if no chain of overlapping matches is longer than that
margin (``REACH``); margins are the only characters that are read more than once.

Where a segment stands in its document is a running sum, which no task makes for a whole document:
segments are put in order by ranges, the sums of the ranges give the offsets, and only within a
range rows are in order. The values found are rows too. A segment meets those of which it holds
the *rarest* short string, so that its work grows with what it holds and not with what its
document holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.functions.arrays import cut, let, pages_of
from spanveil.functions.regex import words_of
from spanveil.functions.rules import Rule
from spanveil.operators.detect import detect
from spanveil.sources.storage import settle

#: Characters of a run, and of the margin on either side.
RUN, REACH = 100_000, 10_000
#: Longest strings that values and segments are compared by.
GRAM = 8
#: Characters of a value whose strings are looked at for a rare one; any of them will do.
HEAD = 64
#: Characters of a segment from which strings are taken at a time.
SLICE = 512


def _partitions(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _same(one: DataFrame, two: DataFrame, *pairs: tuple[str, str]) -> Column:
    """Equal columns, also where both are null."""
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & one[a].eqNullSafe(two[b])
    return condition


def in_order(segments: DataFrame) -> DataFrame:
    """(doc, kind, position, text), settled, with a range ``part`` and an ``id`` for each row.

    A document of very many segments takes many ranges.
    """
    ranged = segments.repartitionByRange(_partitions(segments), "doc", "kind", "position")
    numbered = ranged.withColumns(
        {"part": F.spark_partition_id(), "id": F.monotonically_increasing_id()}
    )
    return settle(numbered, "segments")


def placed(ordered: DataFrame) -> DataFrame:
    """(doc, at, piece): segments with the line end before them, and where that stands in the text."""
    sized = ordered.withColumn("size", F.length("text").cast("long") + 1)
    earlier = Window.partitionBy("doc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each range that a document is in.
    bases = (
        sized.groupBy("doc", "part")
        .agg(F.sum("size").alias("sum"))
        .select(
            F.col("doc").alias("base_doc"),
            F.col("part").alias("base_part"),
            F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"),
        )
    )
    within = (
        Window.partitionBy("doc", "part")
        .orderBy("kind", "position", "text", "id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ahead = sized.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    start = F.col("base") + F.col("ahead")
    return ahead.join(
        bases, _same(ahead, bases, ("doc", "base_doc"), ("part", "base_part"))
    ).select(
        "doc",
        F.greatest(start - 1, F.lit(0)).alias("at"),
        F.when(start > 0, F.concat(F.lit("\n"), F.col("text"))).otherwise(F.col("text")).alias("piece"),
    )


def runs_of(pieces: DataFrame, run: int = RUN, reach: int = REACH) -> DataFrame:
    """(doc, run, base, text): runs with their margins, and where the text begins in the document.

    A row has at most ``run + 2 * reach`` characters, of however many or long segments.
    """
    at, end = F.col("at"), F.col("at") + F.length("piece")

    def slices(pages: Column) -> Column:
        first = F.floor(F.greatest(at - reach, F.lit(0)) / run)
        last = F.floor((end - 1 + reach) / run)

        def one(r: Column) -> Column:
            begin = F.greatest(at, r * run - reach)
            upto = F.least(end, (r + 1) * run + reach)
            return F.struct(
                r.alias("run"),
                begin.alias("at"),
                cut(pages, (begin - at).cast("int"), (upto - at).cast("int")).alias("text"),
            )

        return F.transform(F.sequence(first, last), one)

    cut_up = pieces.where(F.length("piece") > 0).select(
        "doc", F.explode(let(pages_of(F.col("piece")), slices)).alias("slice")
    )
    return (
        cut_up.select("doc", "slice.run", F.struct("slice.at", "slice.text").alias("slice"))
        .repartition(_partitions(pieces), "doc", "run")
        .groupBy("doc", "run")
        .agg(
            F.sort_array(F.collect_list("slice")).alias("slices"),
            F.max(F.col("slice.at") + F.length("slice.text")).alias("upto"),
        )
        # Margins alone, behind the end of a document, have no run.
        .where(F.col("upto") > F.col("run") * run)
        .select(
            "doc",
            "run",
            F.element_at("slices", 1)["at"].alias("base"),
            F.array_join(F.transform("slices", lambda s: s["text"]), "").alias("text"),
        )
    )


def spans_in_runs(runs: DataFrame, rules: Sequence[Rule], run: int = RUN) -> DataFrame:
    """(doc, start, span): what is found, each once; ``start`` counts in the document."""
    found = detect(runs, rules=rules)
    spans = found.select("doc", "run", "base", F.explode("detections").alias("span"))
    start = F.col("base") + F.col("span.start")
    return spans.where(F.floor(start / run) == F.col("run")).select("doc", start.alias("start"), "span")


def swaps_of(spans: DataFrame, replace: Callable[[Column, Column], Column]) -> DataFrame:
    """(doc, value, word, new, at): what to replace in a document, and where it was last found."""
    span = F.col("span")
    return (
        spans.select(
            "doc",
            span["text"].alias("value"),
            F.coalesce(F.get(words_of(span["text"]), 0), F.lit("")).alias("word"),
            replace(span["text"], span).alias("new"),
            "start",
        )
        .groupBy("doc", "value", "word", "new")
        .agg(F.max("start").alias("at"))
    )


def _strings(text: Column, width: Column) -> Column:
    """Distinct strings of a width in a short text."""
    long_enough = F.length(text) >= width
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - width + 1, F.lit(1)))
    strings = F.transform(places, lambda i: F.substring(text, i, width))
    return F.when(long_enough, F.array_distinct(strings)).otherwise(F.array().cast("array<string>"))


def _strings_of_segments(ordered: DataFrame, widths: Sequence[int]) -> DataFrame:
    """(id, doc, gram): strings of these widths that segments hold."""

    def slices(pages: Column) -> Column:
        length = F.length("text")
        return F.transform(
            F.sequence(F.lit(0), F.floor((length - 1) / SLICE).cast("int")),
            lambda k: cut(pages, k * SLICE, F.least(length, (k + 1) * SLICE + GRAM - 1)),
        )

    cut_up = ordered.where(F.length("text") > 0).select(
        "id", "doc", F.explode(let(pages_of(F.col("text")), slices)).alias("slice")
    )
    every = F.concat(*[_strings(F.col("slice"), F.lit(w)) for w in widths])
    return cut_up.select("id", "doc", F.explode(every).alias("gram"))


def swaps_in_segments(ordered: DataFrame, swaps: DataFrame, needle: Column) -> DataFrame | None:
    """(id, swaps): for segments that may hold a ``needle`` of their document, the swaps, last found first.

    Each swap is met by its rarest string of at most ``GRAM`` characters; none is missed. None if
    there is nothing to replace.
    """
    width = F.least(F.length("needle"), F.lit(GRAM))
    sought = settle(swaps.withColumn("needle", needle).where(F.length("needle") > 0), "swaps")
    # At most GRAM numbers.
    widths = sorted(row[0] for row in sought.select(width).distinct().collect())
    if not widths:
        return None
    strings = sought.select(
        "*", F.explode(_strings(F.substring("needle", 1, HEAD), width)).alias("gram")
    )
    wanted = strings.select(F.col("doc").alias("w_doc"), F.col("gram").alias("w_gram")).distinct()
    given = _strings_of_segments(ordered, widths)
    held = settle(
        given.join(wanted, _same(given, wanted, ("doc", "w_doc"), ("gram", "w_gram")))
        .select("id", "doc", "gram")
        .distinct(),
        "strings",
    )
    counts = held.groupBy("doc", "gram").agg(F.count(F.lit(1)).alias("n")).toDF("c_doc", "c_gram", "n")
    rarest = (
        strings.join(counts, _same(strings, counts, ("doc", "c_doc"), ("gram", "c_gram")), "left")
        .groupBy("doc", "value", "word", "new")
        .agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"),
            F.max("at").alias("at"),
        )
        # No segment holds one of its strings, so none holds the needle.
        .where("rarest.n > 0")
        .select(F.col("doc").alias("s_doc"), F.col("rarest.gram").alias("s_gram"), "value", "word", "new", "at")
    )
    swap = F.struct((-F.col("at")).alias("order"), "value", "word", "new")
    return (
        held.join(rarest, _same(held, rarest, ("doc", "s_doc"), ("gram", "s_gram")))
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(swap)).alias("swaps"))
    )
