"""Reports on texts: analysis, highlighting, comparison, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.functions import fixed_values as V
from spanveil.functions.spans import splice
from spanveil.functions.texts import nonblank_lines, shorten
from spanveil.operators.detect import detect_with_counts
from spanveil.operators.sanitize import sanitize


def analyze(
    df: DataFrame, text: str = "text", *, mode: str = "mask", key: str | None = None, **options
) -> DataFrame:
    """Detections, counts, total and the sanitized text, row by row."""
    rules = options.get("rules", ())
    found = detect_with_counts(df, text, **options)
    return sanitize(found, text, mode=mode, key=key, rules=rules)


def summarize(analyzed: DataFrame) -> DataFrame:
    """Texts, entities and entities per text (0 without texts), in one row."""
    return analyzed.agg(
        F.count(F.lit(1)).alias("total_texts"),
        F.coalesce(F.sum("total_entities"), F.lit(0)).alias("total_entities_detected"),
        F.coalesce(F.avg("total_entities"), F.lit(0.0)).alias("average_entities_per_text"),
    )


def breakdown(analyzed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Entities per type from the counts of each text."""
    return (
        analyzed.select(*by, F.explode_outer("entity_counts").alias("entity_type", "n"))
        .filter(F.col("entity_type").isNotNull())
        .groupBy(*by, "entity_type")
        .agg(F.sum("n").alias("n"))
    )


def split_lines(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per line that is not blank, stripped, with its position."""
    lines = F.posexplode_outer(nonblank_lines(F.col(text))).alias("pos", "line")
    return df.select(*keys, lines).filter(F.col("pos").isNotNull())


def for_display(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long texts cut for a list view."""
    return df.withColumns({c: shorten(F.col(c)) for c in columns})


def colour_of(entity_type: Column) -> Column:
    colours = F.create_map(
        *[F.lit(x) for name, colour, _ in V.ENTITY_TYPES for x in (name, colour)]
    )
    return F.coalesce(F.try_element_at(colours, entity_type), F.lit(V.UNKNOWN_COLOUR))


def highlight(
    df: DataFrame,
    text: str = "text",
    *,
    detections: str = "detections",
    boxed: bool = True,
    out: str = "html",
) -> DataFrame:
    """The text as HTML with every detection coloured; the text is not escaped."""

    def mark(value: Column, span: Column) -> Column:
        kind = span["entity_type"]
        return F.format_string(V.HIGHLIGHT_SPAN, colour_of(kind), kind, span["confidence"], value)

    html = splice(F.col(text), F.col(detections), mark)
    if boxed:
        html = F.concat(F.lit(V.HIGHLIGHT_BOX_OPEN), html, F.lit(V.HIGHLIGHT_BOX_CLOSE))
    return df.withColumn(out, html)


def entity_types(spark: SparkSession) -> DataFrame:
    """All entity types with colour and description."""
    return spark.createDataFrame(
        V.ENTITY_TYPES, "entity_type string, colour string, description string"
    )


def with_entity_info(df: DataFrame) -> DataFrame:
    """Add colour and description; unknown types get the defaults."""
    # The dimension is a constant of the package, so it always fits.
    known = F.broadcast(entity_types(df.sparkSession))
    return df.join(known, "entity_type", "left").withColumns(
        {
            "colour": F.coalesce("colour", F.lit(V.UNKNOWN_COLOUR)),
            "description": F.coalesce("description", F.lit(V.UNKNOWN_DESCRIPTION)),
        }
    )
