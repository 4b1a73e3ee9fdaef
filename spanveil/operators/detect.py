"""Find entities in a text column.

Every step is a column expression over one row: nothing is shuffled, and a row
without a hit costs one failing regex search per rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.functions.addresses import address_candidates
from spanveil.functions.arrays import cut, let, pages_of
from spanveil.functions.rules import BASIC_RULES, STRUCTURED_RULES, Rule
from spanveil.functions.spans import count_by_type, drop_repeats, match, plain, uncovered
from spanveil.functions.stages import (
    RESOLVE,
    address_stages,
    raw_columns,
    resolved_columns,
    sealed,
    stage_column,
    stage_columns,
)


def _with_raw(
    df: DataFrame, text: str, rules: Sequence[Rule], addresses: bool, model_spans: str | None
) -> DataFrame:
    more = None
    if model_spans:
        none = F.array().cast(df.schema[model_spans].dataType)
        more = F.coalesce(F.col(model_spans), none)
    return raw_columns(df, text, rules, addresses, more)


def find_rule(df: DataFrame, rule: Rule, text: str = "text", *, out: str = "detections") -> DataFrame:
    """All matches of a single rule."""
    return detect_raw(df, text, rules=(rule,), addresses=False, out=out)


def find_address_kind(
    df: DataFrame, kind: str, text: str = "text", *, out: str = "detections"
) -> DataFrame:
    """Address candidates of one kind: prefix, street, unit or city."""
    parts = stage_columns(df, text, address_stages()[:1])
    found = address_candidates(kind, F.col(text), F.col(stage_column("parts")))
    return sealed(parts, df.columns, found, out)


def find_addresses(df: DataFrame, text: str = "text", *, out: str = "detections") -> DataFrame:
    """All addresses, before other entities come in."""
    staged = stage_columns(df, text, address_stages())
    return sealed(staged, df.columns, plain(F.col(stage_column("addresses"))), out)


def detect_raw(
    df: DataFrame,
    text: str = "text",
    *,
    rules: Sequence[Rule] = STRUCTURED_RULES,
    addresses: bool = True,
    model_spans: str | None = None,
    out: str = "detections",
) -> DataFrame:
    """All matches in rule order, overlaps included."""
    staged = _with_raw(df, text, rules, addresses, model_spans)
    raw = drop_repeats(F.col(stage_column("raw")))
    return sealed(staged, df.columns, plain(raw), out)


def detect(
    df: DataFrame,
    text: str = "text",
    *,
    rules: Sequence[Rule] = STRUCTURED_RULES,
    addresses: bool = True,
    model_spans: str | None = None,
    out: str = "detections",
) -> DataFrame:
    """Add ``array<DETECTION>``: disjoint spans in order of position.

    ``rules`` may hold own rules besides the built-in ones; ``model_spans``
    names a column with spans of a named-entity model (see ``entities``).
    """
    staged = resolved_columns(_with_raw(df, text, rules, addresses, model_spans))
    return sealed(staged, df.columns, plain(F.col(stage_column("resolved"))), out)


def find_uncovered(
    df: DataFrame,
    text: str = "text",
    *,
    rules: Sequence[Rule] = STRUCTURED_RULES,
    addresses: bool = True,
    model_spans: str | None = None,
    out: str = "uncovered",
) -> DataFrame:
    """Add the parts of dropped spans that no kept span covers, as ``array<MATCH>``.

    Of spans that overlap one stays, so a text that is sanitized by ``detect`` may still hold a
    part of another. The parts are as long as they can be, disjoint and in order of position; null
    texts have none.
    """
    staged = _with_raw(df, text, rules, addresses, model_spans)
    loose = stage_columns(
        staged, text, [RESOLVE[0], ("loose", lambda get: uncovered(get("islands")))]
    )
    parts = let(
        pages_of(F.col(text)),
        lambda pages: F.transform(
            F.col(stage_column("loose")),
            lambda p: match(p["start"], p["end"], cut(pages, p["start"], p["end"])),
        ),
    )
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    return sealed(loose, df.columns, F.coalesce(parts, none), out)


def detect_basic(df: DataFrame, text: str = "text", *, out: str = "detections") -> DataFrame:
    """The basic profile: six rules, sorted by start, overlaps left as they are."""
    staged = raw_columns(df, text, BASIC_RULES, addresses=False)
    keyed = F.transform(
        F.col(stage_column("raw")),
        lambda s: F.struct(
            s["start"].alias("start"),
            s["rank"].alias("rank"),
            s["end"].alias("end"),
            *[s[c].alias(c) for c in ("entity_type", "text", "confidence", "detection_method")],
        ),
    )
    return sealed(staged, df.columns, plain(F.sort_array(keyed)), out)


def with_counts(
    df: DataFrame,
    detections: str = "detections",
    *,
    counts: str = "entity_counts",
    total: str = "total_entities",
) -> DataFrame:
    """Add the number of spans per entity type (a map) and in all."""
    found = F.col(detections)
    return df.withColumns({counts: count_by_type(found), total: F.size(found)})


def detect_with_counts(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """Detections and their counts in one call."""
    found = options.get("out", "detections")
    return with_counts(detect(df, text, **options), found)


def detections_to_json(df: DataFrame, detections: str = "detections", out: str = "pii_detected"):
    """Add the detections as JSON text."""
    return df.withColumn(out, F.to_json(F.col(detections)))


def explode_detections(
    df: DataFrame, keys: Sequence[str], detections: str = "detections"
) -> DataFrame:
    """One row per detection: keys, position in the list, fields of the span."""
    found = df.select(*keys, F.posexplode(detections).alias("pos", "span"))
    return found.select(*keys, "pos", "span.*")


def count_entities(
    df: DataFrame, by: Sequence[str] = (), detections: str = "detections"
) -> DataFrame:
    """Spans per entity type and group; partial sums before the shuffle."""
    return (
        explode_detections(df, by, detections)
        .groupBy(*by, "entity_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )
