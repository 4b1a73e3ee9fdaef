"""Spans over a text: find them, settle overlaps, splice replacements in.

Offsets count characters (code points) from zero, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions.arrays import cut, indexes, let, pages_of, running_max, running_sum

MATCH = "struct<start:int,end:int,text:string>"
DETECTION = (
    "struct<entity_type:string,start:int,end:int,text:string,"
    "confidence:double,detection_method:string>"
)
# Key first, so that the natural order of the struct is the order to resolve in.
RANKED = (
    "struct<start:int,neg_end:int,rank:int,end:int,entity_type:string,text:string,"
    "confidence:double,detection_method:string>"
)


def empty_of(element_type: str) -> Column:
    return F.array().cast(f"array<{element_type}>")


def _with_offsets(
    text: Column, regex: Column, hits: Column, dress: Callable[[Column, Column, Column], Column]
) -> Column:
    """All leftmost, non-overlapping matches; ``dress(start, end, value)`` makes an element.

    ``hits`` are the matches. A single one whose string the text holds once stands there.
    Else the text between the matches comes from another pass, and running lengths
    give the offsets.
    """

    def placed(gaps: Column, hits: Column) -> Column:
        lengths = F.transform(hits, lambda hit, i: F.get(gaps, i) + F.length(hit))

        def at(befores: Column) -> Column:
            def element(hit: Column, i: Column) -> Column:
                start = F.get(befores, i) + F.get(gaps, i)
                return dress(start, start + F.length(hit), hit)

            return F.transform(hits, element)

        return let(running_sum(lengths), at)

    def alone(found: Column) -> Column:
        """Where a single match begins, if its string is in the text once; else null."""
        hit = F.get(found, F.lit(0))

        def locate(after: Column) -> Column:
            return F.call_function("locate", hit, text, after + 1)

        # In bytes that aren't UTF-8, places are not those in the text that a regex sees.
        begin = let(
            locate(F.lit(0)),
            lambda at: F.when((at > 0) & (locate(at) == 0) & F.is_valid_utf8(text), at - 1),
        )
        return F.when(F.size(found) == 1, begin)

    def all_of(found: Column, begin: Column) -> Column:
        gaps = F.transform(F.split(text, regex, -1), F.length)
        hit = F.get(found, F.lit(0))
        return F.when(
            begin.isNotNull(), F.array(dress(begin, begin + F.length(hit), hit))
        ).otherwise(let(gaps, lambda g: placed(g, found)))

    return let(hits, lambda found: let(alone(found), lambda begin: all_of(found, begin)))


def match(start: Column, end: Column, text: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), text.alias("text"))


def find_matches(text: Column, regex: str) -> Column:
    """``array<MATCH>`` of one regex."""
    hits = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    return _with_offsets(text, F.lit(regex), hits, match)


def ranked(
    start: Column,
    end: Column,
    text: Column,
    *,
    rank: Column,
    entity_type: Column,
    confidence: Column,
    method: Column,
) -> Column:
    """One span with its ordering keys."""
    return F.struct(
        start.alias("start"),
        (-end).alias("neg_end"),
        rank.alias("rank"),
        end.alias("end"),
        entity_type.alias("entity_type"),
        text.alias("text"),
        confidence.alias("confidence"),
        method.alias("detection_method"),
    )


def find_ranked(
    text: Column, searches: Sequence[tuple[Column | None, str, int, str, float]]
) -> Column:
    """``array<RANKED>`` of many regexes, in their order.

    Each search is (gate, regex, rank, entity type, confidence), where ``gate``, if there is one,
    tells whether there may be anything to find.  Each regex has a search of its own, as one that
    changes from call to call is compiled anew each time.  What places the matches is
    in the plan once: the regexes with matches are rows of a small array.
    """

    def hits(gate: Column | None, regex: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
        return found if gate is None else F.when(gate, found)

    rows = F.array(
        *[
            F.struct(
                hits(gate, regex).alias("hits"),
                F.lit(regex).alias("regex"),
                F.lit(rank).alias("rank"),
                F.lit(entity_type).alias("entity_type"),
                F.lit(confidence).alias("confidence"),
            )
            for gate, regex, rank, entity_type, confidence in searches
        ]
    )

    def search(row: Column) -> Column:
        def dress(start: Column, end: Column, value: Column) -> Column:
            return ranked(
                start,
                end,
                value,
                rank=row["rank"],
                entity_type=row["entity_type"],
                confidence=row["confidence"],
                method=F.lit("regex"),
            )

        return _with_offsets(text, row["regex"], row["hits"], dress)

    return F.flatten(F.transform(F.filter(rows, lambda row: F.size(row["hits"]) > 0), search))


def drop_repeats(spans: Column) -> Column:
    """Of spans with the same rank and offsets keep one; by rank, else in the order given."""
    keyed = F.transform(
        spans,
        lambda s, i: F.struct(
            s["rank"].alias("rank"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            i.alias("at"),
            s.alias("span"),
        ),
    )

    def once(ordered: Column) -> Column:
        def is_new(key: Column, i: Column) -> Column:
            old = F.get(ordered, i - 1)
            same = F.lit(True)
            for name in ("rank", "start", "end"):
                same = same & old[name].eqNullSafe(key[name])
            return ~same

        return F.filter(ordered, is_new)

    in_order = F.sort_array(
        F.transform(
            let(F.sort_array(keyed), once),
            lambda k: F.struct(*[k[c].alias(c) for c in ("rank", "at", "span")]),
        )
    )
    return F.transform(in_order, lambda k: k["span"])


def plain(spans: Column) -> Column:
    """Drop the ordering keys: ``array<RANKED>`` to ``array<DETECTION>``."""
    names = ("entity_type", "start", "end", "text", "confidence", "detection_method")
    return F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in names]))


def islands(spans: Column) -> Column:
    """Cut spans, sorted by start, where a span begins after all earlier ones ended.

    Spans of different islands do not overlap, so what is to be settled is
    settled island by island, on a few spans at a time.
    """

    def cut_at(found: Column, begins: Column) -> Column:
        return F.transform(
            begins,
            lambda at, k: F.slice(
                found, at + 1, F.coalesce(F.get(begins, k + 1), F.size(found)) - at
            ),
        )

    def cut_up(found: Column) -> Column:
        reach = running_max(F.transform(found, lambda s: s["end"]))
        begins = let(
            reach,
            lambda ends: F.filter(
                indexes(found), lambda i: F.get(found, i)["start"] >= F.get(ends, i)
            ),
        )
        return let(begins, lambda at: cut_at(found, at))

    return let(spans, cut_up)


def settle_islands(groups: Column) -> Column:
    """Keep disjoint spans, in order of position, from ``islands`` of ``array<RANKED>``.

    Of two that overlap the longer one stays; then the more confident one; then
    a pattern match over a model's guess; then the earlier one.  Kept spans are
    disjoint and sorted and each new span starts at or after the last kept one,
    so that one is the only candidate for an overlap.
    """

    def step(kept: Column, new: Column) -> Column:
        old = F.try_element_at(kept, F.lit(-1))
        new_length = new["end"] - new["start"]
        old_length = old["end"] - old["start"]
        wins = (new_length > old_length) | (
            (new_length == old_length)
            & (
                (new["confidence"] > old["confidence"])
                | (
                    (new["confidence"] == old["confidence"])
                    & (new["detection_method"] == "regex")
                    & (old["detection_method"] == "ner")
                )
            )
        )
        return (
            F.when(old.isNull() | (new["start"] >= old["end"]), F.concat(kept, F.array(new)))
            .when(wins, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(new)))
            .otherwise(kept)
        )

    def settle(island: Column) -> Column:
        settled = F.aggregate(island, empty_of(RANKED), step)
        return F.when(F.size(island) == 1, island).otherwise(settled)

    return F.flatten(F.transform(groups, settle))


def uncovered(groups: Column) -> Column:
    """``array<struct<start,end>>``: what dropped spans cover and kept ones don't.

    From ``islands`` of ``array<RANKED>``. The spans of an island have no gap between them, so
    what lies between its kept spans, before the first and after the last belongs to
    dropped ones. Parts that touch, also of two islands, are one.
    """

    def gaps(island: Column) -> Column:
        low = F.get(island, F.lit(0))["start"]
        high = F.array_max(F.transform(island, lambda s: s["end"]))

        def between(kept: Column, last: Column) -> Column:
            parts = F.transform(
                F.sequence(F.lit(0), F.size(kept)),
                lambda i: F.struct(
                    F.coalesce(F.get(kept, i - 1)["end"], low).alias("start"),
                    F.coalesce(F.get(kept, i)["start"], last).alias("end"),
                ),
            )
            return F.filter(parts, lambda p: p["start"] < p["end"])

        found = let(
            settle_islands(F.array(island)), lambda kept: let(high, lambda last: between(kept, last))
        )
        return F.when(F.size(island) > 1, found).otherwise(empty_of("struct<start:int,end:int>"))

    def join(parts: Column) -> Column:
        begins = F.filter(
            indexes(parts),
            lambda i: (i == 0) | (F.get(parts, i)["start"] > F.get(parts, i - 1)["end"]),
        )
        return let(
            begins,
            lambda at: F.transform(
                at,
                lambda first, k: F.struct(
                    F.get(parts, first)["start"].alias("start"),
                    F.get(parts, F.coalesce(F.get(at, k + 1), F.size(parts)) - 1)["end"].alias("end"),
                ),
            ),
        )

    return let(F.flatten(F.transform(groups, gaps)), join)


def splice(
    text: Column, spans: Column, replacement: Callable[[Column, Column], Column]
) -> Column:
    """Replace disjoint, ordered spans; ``replacement(value, span)`` gives the new text.

    ``value`` is what the text holds between the offsets of the span.
    """

    def rebuild(pages: Column, found: Column) -> Column:
        def before(span: Column, i: Column) -> Column:
            previous = F.coalesce(F.try_element_at(found, i)["end"], F.lit(0))
            gap = cut(pages, F.when(i == 0, F.lit(0)).otherwise(previous), span["start"])
            value = cut(pages, span["start"], span["end"])
            return F.concat(gap, let(value, lambda v: replacement(v, span)))

        tail = cut(pages, F.try_element_at(found, F.lit(-1))["end"], F.length(text))
        return F.concat(F.array_join(F.transform(found, before), ""), tail)

    spliced = let(pages_of(text), lambda pages: let(spans, lambda found: rebuild(pages, found)))
    return F.when(F.size(spans) == 0, text).otherwise(spliced)


def count_by_type(spans: Column) -> Column:
    """``map<string,bigint>`` in order of first appearance."""

    def counted(found: Column) -> Column:
        types = F.transform(found, lambda s: s["entity_type"])
        return F.map_from_entries(
            F.transform(
                F.array_distinct(types),
                lambda t: F.struct(
                    t.alias("key"),
                    F.size(F.filter(found, lambda s: s["entity_type"] == t))
                    .cast("long")
                    .alias("value"),
                ),
            )
        )

    return let(spans, counted)
