"""Detection as a list of stages, each an expression over earlier ones.

One expression for all of it would nest too deep for the analyzer and would
repeat what is used twice.  The stages are added one after another, either as
columns of a table or as fields of the structs in an array (many short texts in
one row).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions import addresses as A
from spanveil.functions.rules import GATES, Rule, rule_spans
from spanveil.functions.spans import islands, settle_islands

Get = Callable[[str], Column]
Stage = tuple[str, Callable[[Get], Column]]


def _gate_stages(rules: Sequence[Rule], addresses: bool) -> list[Stage]:
    needed = {p.needs for r in rules for p in r.patterns if p.needs}
    if addresses:
        needed |= {p.needs for p in A.PARTS if p.needs}
    return [
        (f"gate_{name}", lambda get, name=name: GATES[name](get("text")))
        for name in GATES
        if name in needed
    ]


def _gates(get: Get, gate_stages: Sequence[Stage]) -> dict[str, Column]:
    return {name.removeprefix("gate_"): get(name) for name, _ in gate_stages}


def address_stages(gate_stages: Sequence[Stage] = ()) -> list[Stage]:
    """Add kind after kind, leaving out what has an end in an address accepted before.

    Units do not overlap each other, nor do cities; of streets, which come in
    order of start, only the last one kept can be in the way.
    """

    def kind(name: str) -> Callable[[Get], Column]:
        return lambda get: A.address_candidates(name, get("text"), get("parts"))

    return [
        ("parts", lambda get: A.address_parts(get("text"), _gates(get, gate_stages))),
        ("prefixes", kind("prefix")),
        ("clear_streets", lambda get: A.clear_of(kind("street")(get), get("prefixes"))),
        (
            "with_streets",
            lambda get: F.concat(get("prefixes"), A.one_after_another(get("clear_streets"))),
        ),
        (
            "with_units",
            lambda get: F.concat(
                get("with_streets"), A.clear_of(kind("unit")(get), get("with_streets"))
            ),
        ),
        (
            "addresses",
            lambda get: A.as_spans(
                F.concat(get("with_units"), A.clear_of(kind("city")(get), get("with_units")))
            ),
        ),
    ]


def span_stages(rules: Sequence[Rule], addresses: bool) -> list[Stage]:
    """Up to ``rules`` and ``addresses``."""
    gate_stages = _gate_stages(rules, addresses)
    stages = [
        *gate_stages,
        ("rules", lambda get: rule_spans(get("text"), rules, _gates(get, gate_stages))),
    ]
    return stages + (address_stages(gate_stages) if addresses else [])


def raw_stage(addresses: bool, more: Column | None = None) -> Stage:
    """All ranked spans, rule by rule."""

    def raw(get: Get) -> Column:
        parts = [get("rules")]
        if addresses:
            parts.append(get("addresses"))
        if more is not None:
            parts.append(more)
        return F.concat(*parts)

    return "raw", raw


RESOLVE: list[Stage] = [
    ("islands", lambda get: islands(F.sort_array(get("raw")))),
    ("resolved", lambda get: settle_islands(get("islands"))),
]


def _get_column(text: str) -> Get:
    return lambda name: F.col(text if name == "text" else stage_column(name))


def stage_columns(df: DataFrame, text: str, stages: Sequence[Stage]) -> DataFrame:
    """Add the stages as columns, named by ``stage_column``."""
    for name, expression in stages:
        df = df.withColumn(stage_column(name), expression(_get_column(text)))
    return df


@lru_cache(maxsize=64)
def _span_columns(text: str, rules: tuple[Rule, ...], addresses: bool) -> list[tuple[str, Column]]:
    """The span stages as columns; they are unresolved, so they serve any table."""
    return [(name, e(_get_column(text))) for name, e in span_stages(rules, addresses)]


@lru_cache(maxsize=64)
def _resolve_columns() -> list[tuple[str, Column]]:
    return [(name, e(_get_column(""))) for name, e in RESOLVE]


def raw_columns(
    df: DataFrame, text: str, rules: Sequence[Rule], addresses: bool, more: Column | None = None
) -> DataFrame:
    """Add all stages up to ``raw``."""
    for name, column in _span_columns(text, tuple(rules), addresses):
        df = df.withColumn(stage_column(name), column)
    return stage_columns(df, text, [raw_stage(addresses, more)])


def resolved_columns(df: DataFrame) -> DataFrame:
    """Add the stages from ``raw`` to ``resolved``."""
    for name, column in _resolve_columns():
        df = df.withColumn(stage_column(name), column)
    return df


def sealed(df: DataFrame, keep: Sequence[str], result: Column, out: str) -> DataFrame:
    """The columns to keep and a result that no filter is pushed through.

    The optimizer puts a filter on a column below the projection that makes it, and
    writes the whole expression into it: the texts would be searched again for each use.  A
    generator of one row stops that; nothing is shuffled.
    """
    return df.select(*keep, F.inline_outer(F.array(F.struct(result.alias(out)))))


def stage_column(name: str) -> str:
    return f"__{name}"


def stage_fields(df: DataFrame, array: str, stages: Sequence[Stage]) -> DataFrame:
    """Add the stages as fields to the structs of an array; they have a field ``text``."""
    for name, expression in stages:
        df = df.withColumn(array, F.transform(array, _field_adder(name, expression)))
    return df


def _field_adder(name: str, expression: Callable[[Get], Column]) -> Callable[[Column], Column]:
    return lambda p: p.withField(name, expression(lambda n: p[n]))
