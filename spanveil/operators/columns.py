"""Structured tables: which columns hold entities, and sanitizing those."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanveil.functions.rules import STRUCTURED_RULES, Rule
from spanveil.functions.spans import splice
from spanveil.functions.stages import RESOLVE, raw_stage, sealed, span_stages, stage_fields
from spanveil.operators.detect import detect_with_counts
from spanveil.operators.sanitize import replacer


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]


def hit_rates(cells: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per column and entity type of cells (column, text): cells with hits, hits and their share."""
    counted = (
        detect_with_counts(cells.filter(F.col("text").isNotNull()), rules=rules)
        .select("column", F.posexplode_outer("entity_counts").alias("pos", "entity_type", "n"))
        .groupBy("column", "entity_type")
        .agg(
            F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0).alias("scanned"),
            F.count("n").alias("rows_with_hits"),
            F.sum("n").alias("hits"),
        )
    )
    rows = F.sum("scanned").over(Window.partitionBy("column"))
    return (
        counted.withColumn("rows_scanned", rows)
        .filter(F.col("entity_type").isNotNull())
        .select(
            "column",
            "entity_type",
            "rows_scanned",
            "rows_with_hits",
            "hits",
            (F.col("rows_with_hits") / F.col("rows_scanned")).alias("hit_rate"),
        )
    )


def scan_columns(
    df: DataFrame, columns: Sequence[str] | None = None, *, rules: Sequence[Rule] = STRUCTURED_RULES
) -> DataFrame:
    """Per column and entity type: rows with hits, hits and the share of rows.

    Only column name and counts are shuffled; a cell counts as scanned on the
    first of its exploded counts, so there is one pass.
    """
    names = list(columns or string_columns(df))
    cells = df.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in names]
            )
        ).alias("cell")
    ).select("cell.*")
    return hit_rates(cells, rules)


def sanitize_columns(
    df: DataFrame,
    columns: Sequence[str],
    *,
    mode: str = "mask",
    key: str | None = None,
    rules: Sequence[Rule] = STRUCTURED_RULES,
) -> DataFrame:
    """The table with the given columns sanitized in place.

    The cells of a row are searched as one array, so the plan doesn't grow with the columns.
    """
    replace = replacer(mode, key, rules)
    cells = F.array(*[F.struct(F.col(name).alias("text")) for name in columns])
    stages = [*span_stages(rules, addresses=True), raw_stage(addresses=True), *RESOLVE]
    staged = stage_fields(df.withColumn("__cells", cells), "__cells", stages)
    rebuilt = F.transform(
        F.col("__cells"),
        lambda p: F.when(p["text"].isNotNull(), splice(p["text"], p["resolved"], replace)),
    )
    done = sealed(staged, df.columns, rebuilt, "__done")
    at = {name: F.get("__done", i) for i, name in enumerate(columns)}
    return done.select(*[at[c].alias(c) if c in at else F.col(c) for c in df.columns])
