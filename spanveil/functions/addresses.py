"""Postal addresses: four patterns, tried in order, later finds yielding to earlier ones."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions import fixed_values as V
from spanveil.functions.arrays import cut, indexes, let, pages_of, running_max
from spanveil.functions.regex import alternation, jvm_regex, strip
from spanveil.functions.rules import ADDRESS_CONFIDENCE, ADDRESS_RANK, Pattern, gate, order_number
from spanveil.functions.spans import MATCH, RANKED, empty_of, find_ranked, islands, match, ranked

_PREFIX_HEAD = alternation(V.ADDRESS_PREFIX_WORDS)
PREFIX = _PREFIX_HEAD + jvm_regex(V.ADDRESS_PREFIX_TAIL, ignore_case=True)
_PREFIX_GROUP = r"(?s)\A" + _PREFIX_HEAD + jvm_regex(V.ADDRESS_PREFIX_TAIL.split("(?=")[0]) + r"\z"

# The repeated group of V.STREET_HEAD makes the JVM recurse per word and overflow
# its stack on long texts.  Letters and white space up to the last word start
# match the same strings without recursion.
STREET = (
    r"(?=\p{Nd})"
    + jvm_regex(
        V.STREET_HEAD.replace(r"(?:[A-Za-z]+\s+)*", r"(?:[A-Za-z][A-Za-z\s]*\s)?"),
        ignore_case=True,
        edges="(",
    )
    + alternation(V.STREET_WORDS)
)
UNIT = alternation(V.UNIT_WORDS) + jvm_regex(V.UNIT_TAIL, ignore_case=True)
CITY = alternation(V.CITIES) + jvm_regex(V.CITY_TAIL, ignore_case=True)


PARTS = (Pattern(PREFIX, "addr"), Pattern(STREET, "digit"), Pattern(UNIT), Pattern(CITY, "digits"))


def _has_good_length(span: Column) -> Column:
    return F.length(span["text"]).between(V.ADDRESS_MIN_LENGTH, V.ADDRESS_MAX_LENGTH)


def _after_prefix(found: Column) -> Column:
    """What follows "address:", up to punctuation; offsets include outer blanks."""

    def inner(m: Column) -> Column:
        group = F.regexp_extract(m["text"], _PREFIX_GROUP, 1)
        return match(m["end"] - F.length(group), m["end"], strip(group))

    return F.filter(F.transform(found, inner), _has_good_length)


def _streets(text: Column, found: Column) -> Column:
    """A number, words and a street word, with some context around it."""

    def shorten(words: Column, delimiter: Column) -> Column:
        at = F.instr(F.lower(words), delimiter) - 1
        return F.when(at > V.STREET_CUT_AFTER, strip(words.substr(F.lit(1), at))).otherwise(words)

    def in_context(pages: Column, length: Column, m: Column) -> Column:
        start = F.greatest(F.lit(0), m["start"] - V.STREET_CONTEXT_BEFORE)
        end = F.least(length, m["end"] + V.STREET_CONTEXT_AFTER)
        delimiters = F.array(*[F.lit(d) for d in V.STREET_DELIMITERS])
        words = F.aggregate(delimiters, strip(cut(pages, start, end)), shorten)
        return let(words, lambda w: match(start, start + F.length(w), w))

    placed = let(
        F.struct(pages_of(text).alias("pages"), F.length(text).alias("length")),
        lambda doc: F.transform(found, lambda m: in_context(doc["pages"], doc["length"], m)),
    )
    return F.filter(placed, _has_good_length)


def _stripped(found: Column) -> Column:
    return F.transform(found, lambda m: match(m["start"], m["end"], strip(m["text"])))


def address_parts(text: Column, gates: Mapping[str, Column] | None = None) -> Column:
    """``array<RANKED>`` of the four patterns, numbered by rank from 1."""
    searches = [
        (gate(text, part.needs, gates), part.regex, number, "ADDRESS", ADDRESS_CONFIDENCE)
        for number, part in enumerate(PARTS, 1)
    ]
    return find_ranked(text, searches)


def address_candidates(kind: str, text: Column, parts: Column) -> Column:
    """``array<MATCH>`` of one kind (prefix, street, unit, city), from ``address_parts``."""

    def only(number: int) -> Column:
        return F.filter(parts, lambda p: p["rank"] == number)

    if kind == "prefix":
        return _after_prefix(only(1))
    if kind == "street":
        has_street = F.exists(parts, lambda p: p["rank"] == 2)
        return F.when(has_street, _streets(text, only(2))).otherwise(empty_of(MATCH))
    if kind == "unit":
        return F.filter(_stripped(only(3)), _has_good_length)
    if kind == "city":
        return _stripped(only(4))
    raise ValueError(f"unknown kind of address {kind!r}")


def clear_of(candidates: Column, accepted: Column) -> Column:
    """Candidates none of whose ends lies in an accepted address.

    One sweep over all ends in order of position: an end is inside if, of the
    addresses that began before it, the one that reaches furthest reaches it.
    """

    def event(at: Column, order: int, end: Column, number: Column) -> Column:
        return F.struct(
            at.alias("at"),
            F.lit(order).alias("order"),
            end.alias("end"),
            number.alias("number"),
        )

    # At equal positions: last characters, then beginnings, then first characters.
    begin, last, first = 1, 0, 2
    nothing = F.lit(-1)

    def inside(events: Column) -> Column:
        """Numbers of candidates with an end inside, sorted."""

        def judge(reach: Column) -> Column:
            def is_inside(e: Column, i: Column) -> Column:
                furthest = F.get(reach, i)
                return ((e["order"] == first) & (furthest > e["at"])) | (
                    (e["order"] == last) & (furthest >= e["at"])
                )

            return F.filter(events, is_inside)

        reach = running_max(F.transform(events, lambda e: e["end"]))
        return F.sort_array(
            F.array_distinct(F.transform(let(reach, judge), lambda e: e["number"]))
        )

    def sweep(found: Column, taken: Column) -> Column:
        return F.sort_array(
            F.concat(
                F.transform(taken, lambda a: event(a["start"], begin, a["end"], nothing)),
                F.transform(found, lambda c, i: event(c["start"], first, nothing, i)),
                F.transform(found, lambda c, i: event(c["end"], last, nothing, i)),
            )
        )

    def keep(found: Column, taken: Column) -> Column:
        clear = F.array_except(indexes(found), let(sweep(found, taken), inside))
        kept = F.transform(clear, lambda i: F.get(found, i))
        return F.when((F.size(found) == 0) | (F.size(taken) == 0), found).otherwise(kept)

    return let(candidates, lambda found: let(accepted, lambda taken: keep(found, taken)))


def one_after_another(candidates: Column) -> Column:
    """Of candidates in order of start, those that begin after the last one kept ended."""

    def step(kept: Column, new: Column) -> Column:
        old = F.try_element_at(kept, F.lit(-1))
        return F.when(
            old.isNull() | (new["start"] >= old["end"]), F.concat(kept, F.array(new))
        ).otherwise(kept)

    return F.flatten(
        F.transform(
            islands(candidates), lambda island: F.aggregate(island, empty_of(MATCH), step)
        )
    )


def as_spans(settled: Column) -> Column:
    """``array<MATCH>`` of addresses as ``array<RANKED>``."""
    return F.transform(
        settled,
        lambda m: ranked(
            m["start"],
            m["end"],
            m["text"],
            rank=F.lit(order_number(ADDRESS_RANK)),
            entity_type=F.lit("ADDRESS"),
            confidence=F.lit(ADDRESS_CONFIDENCE),
            method=F.lit("regex"),
        ),
    )
