"""Documents that come in segments: paragraphs, cells, pages, turns.

What is looked for is looked for in the whole document, so a document is one row
while it is searched; what is rewritten are the segments, and they stay rows of
their own: what to replace in a document is joined to them.  Documents of any size
are worked on: long ones are searched in runs, by many tasks (see ``runs``).  To refuse large ones,
as a file of that size is, is a step of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.arrays import let
from spanveil.functions.fixed_values import MAX_FILE_SIZE
from spanveil.functions.regex import words_of
from spanveil.functions.rules import STRUCTURED_RULES, Rule
from spanveil.operators import runs
from spanveil.operators.detect import detect
from spanveil.operators.sanitize import replacer

PARAGRAPH, CELL, HEADER = 0, 1, 2

#: From a value and its span to what is put in its place.
Replace = Callable[[Column, Column], Column]


def admit_documents(
    segments: DataFrame, doc: str, text: str = "text", limit: int = MAX_FILE_SIZE
) -> tuple[DataFrame, DataFrame]:
    """(segments of admitted documents, refused documents with size and ``reject_reason``).

    The size is that of the segments joined by line ends; it is summed in parts.
    """
    size = F.sum(F.octet_length(F.coalesce(text, F.lit("")))) + F.count(F.lit(1)) - 1
    refused = segments.groupBy(doc).agg(size.alias("size")).filter(F.col("size") > limit)
    return (
        segments.join(refused.select(doc), doc, "left_anti"),
        refused.withColumn("reject_reason", F.lit("File too large")),
    )


def assemble(
    segments: DataFrame, doc: str, position: str, text: str = "text", *, kind: str | None = None
) -> DataFrame:
    """One row per document with its ``text``, the segments in order.

    Paragraphs come before cells; headers and footers (kind 2) are segments but
    not part of the text.  Documents are dealt to as many partitions as the session's
    shuffles have: adaptive packing goes by bytes, and would put small texts, which are heavy to
    search, into one task.
    """
    partitions = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segment = F.struct(
        (F.col(kind) if kind else F.lit(PARAGRAPH)).cast("int").alias("kind"),
        F.col(position).alias("position"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    joined = F.array_join(
        F.transform(
            F.filter(F.sort_array(F.collect_list(segment)), lambda s: s["kind"] < HEADER),
            lambda s: s["text"],
        ),
        "\n",
    )
    return segments.repartition(partitions, doc).groupBy(doc).agg(joined.alias("text"))


def _pieces(text: Column, swaps: Column, needle: str) -> Column:
    """Pieces (text, fixed) of a segment: what a swap puts in is fixed, and not looked into again."""

    def cut_out(piece: Column, s: Column) -> Column:
        quoted = F.concat(
            F.lit("\\Q"), F.replace(s[needle], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")
        )
        put = F.struct(s["new"].alias("text"), F.lit(True).alias("fixed"))
        parts = F.transform(
            F.split(piece["text"], quoted, -1),
            lambda t, i: let(
                F.struct(t.alias("text"), F.lit(False).alias("fixed")),
                lambda rest: F.when(i == 0, F.array(rest)).otherwise(F.array(put, rest)),
            ),
        )
        holds = ~piece["fixed"] & (s[needle] != "") & F.contains(piece["text"], s[needle])
        return F.when(holds, F.flatten(parts)).otherwise(F.array(piece))

    return F.aggregate(
        swaps, text, lambda acc, s: F.flatten(F.transform(acc, lambda p: cut_out(p, s)))
    )


def _rewritten(given: Column, swaps: Column, partial_fallback: bool) -> Column:
    """A segment with its values replaced, swaps in the order given."""

    def swap(acc: Column, s: Column) -> Column:
        return F.when(F.contains(acc, s["value"]), F.replace(acc, s["value"], s["new"])).otherwise(acc)

    if not partial_fallback:
        return F.aggregate(swaps, given, swap)
    start = F.array(F.struct(given.alias("text"), F.lit(False).alias("fixed")))
    exact = F.filter(swaps, lambda s: F.contains(given, s["value"]))
    partial = F.filter(swaps, lambda s: ~F.contains(given, s["value"]))
    pieces = let(_pieces(start, exact, "value"), lambda p: _pieces(p, partial, "word"))
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "")


def sanitize_segments(
    segments: DataFrame,
    doc: str,
    position: str,
    text: str = "text",
    *,
    kind: str | None = None,
    mode: str = "mask",
    key: str | None = None,
    partial_fallback: bool = False,
    rules: Sequence[Rule] = STRUCTURED_RULES,
    run: int = runs.RUN,
    reach: int = runs.REACH,
) -> DataFrame:
    """Replace the values found in a document wherever its segments hold them.

    All occurrences of a value in a segment are replaced, later finds first.
    With ``partial_fallback`` what a segment holds is decided on the segment as it
    came: first the whole values, then, of values that it does not hold, the first word,
    where nothing was replaced before.  Segments whose document is null are one document.

    Documents of more than ``run`` characters are searched in runs with margins of ``reach``, and
    their segments meet only values that they may hold: one that first comes about where
    a replacement meets its neighbours is not looked for there.  To see whether there are any, sizes
    are summed when this is called; tables are then written to the shared folder.
    """
    replace = replacer(mode, key, rules)
    rows = segments.select(
        F.col(doc).alias("doc"),
        (F.col(kind) if kind else F.lit(PARAGRAPH)).cast("int").alias("kind"),
        F.col(position).alias("position"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    size = F.sum(F.length("text").cast("long") + 1)
    sizes = rows.where(F.col("kind") < HEADER).groupBy("doc").agg(size.alias("size"))
    long = sizes.where(F.col("size") > run).select(F.col("doc").alias("long_doc"))
    if long.isEmpty():
        clean = _sanitize_rows(rows, replace, partial_fallback, rules)
    else:
        is_long = F.col("doc").eqNullSafe(F.col("long_doc"))
        clean = _sanitize_rows(
            rows.join(long, is_long, "left_anti"), replace, partial_fallback, rules
        ).unionByName(
            _sanitize_runs(
                rows.join(long, is_long, "left_semi"), replace, partial_fallback, rules, run, reach
            )
        )
    return clean.select(
        F.col("doc").alias(doc), "kind", F.col("position").alias(position), "sanitized_text"
    )


def _sanitize_rows(
    rows: DataFrame, replace: Replace, partial_fallback: bool, rules: Sequence[Rule]
) -> DataFrame:
    """Segments of documents that are searched as one row each."""
    whole = detect(assemble(rows, "doc", "position", kind="kind"), rules=rules)
    # What to look for and what to put there, worked out once per document.
    swaps = F.array_distinct(
        F.transform(
            F.reverse("detections"),
            lambda d: F.struct(
                d["text"].alias("value"),
                F.coalesce(F.get(words_of(d["text"]), 0), F.lit("")).alias("word"),
                replace(d["text"], d).alias("new"),
            ),
        )
    )
    found = whole.filter(F.size("detections") > 0).select(
        F.col("doc").alias("found_doc"), swaps.alias("swaps")
    )
    # Segments stay rows: a document of very many is split by the join.
    return rows.join(found, F.col("doc").eqNullSafe(F.col("found_doc")), "left").select(
        "doc", "kind", "position", _clean(partial_fallback).alias("sanitized_text")
    )


def _sanitize_runs(
    rows: DataFrame,
    replace: Replace,
    partial_fallback: bool,
    rules: Sequence[Rule],
    run: int,
    reach: int,
) -> DataFrame:
    """Segments of documents that are searched in runs."""
    ordered = runs.in_order(rows)
    pieces = runs.placed(ordered.where(F.col("kind") < HEADER))
    spans = runs.spans_in_runs(runs.runs_of(pieces, run, reach), rules, run)
    needle = F.col("value")
    if partial_fallback:
        # What holds the value holds its first word.
        needle = F.when(F.col("word") != "", F.col("word")).otherwise(needle)
    met = runs.swaps_in_segments(ordered, runs.swaps_of(spans, replace), needle)
    if met is None:
        return ordered.select("doc", "kind", "position", F.col("text").alias("sanitized_text"))
    return ordered.join(met, "id", "left").select(
        "doc", "kind", "position", _clean(partial_fallback).alias("sanitized_text")
    )


def _clean(partial_fallback: bool) -> Column:
    rewritten = _rewritten(F.col("text"), F.col("swaps"), partial_fallback)
    return F.when(F.col("swaps").isNull(), F.col("text")).otherwise(rewritten)
