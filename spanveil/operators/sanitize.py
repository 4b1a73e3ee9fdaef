"""Rewrite texts so that detected values are masked, redacted or tokenized."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions import fixed_values as V
from spanveil.functions.arrays import cut, let, pages_of
from spanveil.functions.masks import check_mode, redact, replacement
from spanveil.functions.rules import STRUCTURED_RULES, Rule
from spanveil.functions.spans import islands, splice
from spanveil.functions.stages import RESOLVE, raw_stage, span_stages, stage_fields

Replace = Callable[[Column, Column], Column]


def own_masks(rules: Sequence[Rule]) -> dict:
    return {r.entity_type: r.mask for r in rules if r.mask is not None}


def replacer(mode: str, key: str | None = None, rules: Sequence[Rule] = ()) -> Replace:
    """``(value, span) -> text`` for one mode."""
    check_mode(mode, key)
    extra = own_masks(rules)
    return lambda value, span: replacement(value, span["entity_type"], mode, key, extra)


def sanitize(
    df: DataFrame,
    text: str = "text",
    *,
    mode: str = "mask",
    key: str | None = None,
    rules: Sequence[Rule] = (),
    detections: str = "detections",
    out: str = "sanitized_text",
) -> DataFrame:
    """Replace every detected span of a text; also right for whole SQL dumps."""
    return df.withColumn(
        out, splice(F.col(text), F.col(detections), replacer(mode, key, rules))
    )


def compare_modes(
    df: DataFrame, text: str = "text", *, key: str, detections: str = "detections"
) -> DataFrame:
    """All three versions of a text from one set of detections."""
    versions = {
        f"{mode}_version": splice(F.col(text), F.col(detections), replacer(mode, key))
        for mode in V.MODES
    }
    return df.withColumns(versions)


def mask_basic(
    df: DataFrame,
    text: str = "text",
    *,
    mask_char: str = "*",
    detections: str = "detections",
    out: str = "masked_text",
) -> DataFrame:
    """Star every character of a basic-profile span; overlaps do not matter."""
    if len(mask_char) != 1:
        raise ValueError("mask_char must be a single character")
    covered = F.transform(
        islands(F.col(detections)),
        lambda island: F.struct(
            F.element_at(island, 1)["start"].alias("start"),
            F.array_max(F.transform(island, lambda s: s["end"])).alias("end"),
        ),
    )
    starred = let(
        covered,
        lambda spans: splice(
            F.col(text), spans, lambda value, _: F.repeat(F.lit(mask_char), F.length(value))
        ),
    )
    return df.withColumn(out, starred)


def _rewrite_backwards(pages: Column, spans: Column, upto: Column) -> Column:
    """Put labels in place of spans, last first, in the text up to a position.

    Offsets count in the original text, so a label is cut where the next span
    to its left reaches over it.  The state is where the rewritten part begins
    (``at``), its leading label (``head``), what follows it (``rest``), and
    whether a cut ever went beyond the leading label.
    """

    def step(acc: Column, span: Column) -> Column:
        over = span["end"] - acc["at"]
        head, rest = acc["head"], acc["rest"]
        whole = F.concat(head, rest)
        following = F.when(
            over <= 0, F.concat(cut(pages, span["end"], acc["at"]), whole)
        ).otherwise(F.coalesce(whole.substr(over + 1, F.length(whole)), F.lit("")))
        return F.struct(
            span["start"].alias("at"),
            redact(F.upper(span["entity_type"])).alias("head"),
            following.alias("rest"),
            (acc["beyond"] | (over > F.length(head))).alias("beyond"),
        )

    zero = F.struct(
        upto.alias("at"),
        F.lit("").alias("head"),
        F.lit("").alias("rest"),
        F.lit(False).alias("beyond"),
    )
    return F.aggregate(F.reverse(spans), zero, step)


def redact_basic(
    df: DataFrame, text: str = "text", *, detections: str = "detections", out: str = "redacted_text"
) -> DataFrame:
    """Put labels in place of basic-profile spans, from the last to the first.

    Spans that overlap are rewritten island by island.  If a cut goes beyond a
    label, which takes a label shorter than the value it stands for, the text
    after the island is cut too; such a text is rewritten in one go.
    """

    def in_islands(pages: Column, found: Column) -> Column:
        def rewrite(island: Column) -> Column:
            end = F.array_max(F.transform(island, lambda s: s["end"]))
            return let(
                _rewrite_backwards(pages, island, end),
                lambda r: F.struct(
                    F.element_at(island, 1)["start"].alias("start"),
                    end.alias("end"),
                    F.concat(r["head"], r["rest"]).alias("new"),
                    r["beyond"].alias("beyond"),
                ),
            )

        def assemble(parts: Column) -> Column:
            in_one_go = let(
                _rewrite_backwards(pages, found, F.length(F.col(text))),
                lambda r: F.concat(cut(pages, F.lit(0), r["at"]), r["head"], r["rest"]),
            )
            spliced = splice(F.col(text), parts, lambda _, part: part["new"])
            return F.when(F.exists(parts, lambda p: p["beyond"]), in_one_go).otherwise(spliced)

        return let(F.transform(islands(found), rewrite), assemble)

    rewritten = let(
        pages_of(F.col(text)), lambda pages: let(F.col(detections), lambda d: in_islands(pages, d))
    )
    return df.withColumn(out, F.when(F.size(detections) == 0, F.col(text)).otherwise(rewritten))


# V.SQL_LITERAL repeats a group, on which the JVM recurses.  Nothing the loop
# takes could be given back to reach a quote, so taking it for good is equal.
_SQL_LITERAL = r"'(?:[^'\\]++|\\[^\n])*+'"


def sanitize_sql_literals(
    df: DataFrame,
    text: str = "text",
    *,
    mode: str = "mask",
    key: str | None = None,
    rules: Sequence[Rule] = STRUCTURED_RULES,
    out: str = "sanitized_text",
) -> DataFrame:
    """Detect and replace inside single-quoted literals only, each on its own.

    The literals of a text stay in its row, so nothing is shuffled.
    """
    replace = replacer(mode, key, rules)
    pieces = F.zip_with(
        F.split(F.col(text), _SQL_LITERAL, -1),
        F.regexp_extract_all(F.col(text), F.lit(_SQL_LITERAL), F.lit(0)),
        lambda gap, literal: F.struct(
            gap.alias("gap"), literal.substr(F.lit(2), F.length(literal) - 2).alias("text")
        ),
    )
    stages = [*span_stages(rules, addresses=True), raw_stage(addresses=True), *RESOLVE]
    staged = stage_fields(df.withColumn("__pieces", pieces), "__pieces", stages)
    # The last piece is the text after the last literal.
    rebuilt = F.transform(
        F.col("__pieces"),
        lambda p: F.when(p["text"].isNull(), p["gap"]).otherwise(
            F.concat(
                p["gap"], F.lit("'"), splice(p["text"], p["resolved"], replace), F.lit("'")
            )
        ),
    )
    kept = [c for c in df.columns if c != out]
    return staged.select(*kept, F.array_join(rebuilt, "").alias(out))
