"""Classes of documents that links connect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import settle

#: A safeguard: each turn at least halves the longest chain, so this is never met.
MOST_TURNS = 64


def connected_classes(links: DataFrame) -> DataFrame:
    """(id, class_id) for each id of the links (a, b): the smallest id reachable from it.

    Each turn hangs every vertex and its larger neighbours on the smallest neighbour, then
    those smaller ones likewise, until each class is one star around its
    smallest id; turns grow as the logarithm of the size. Minima are combined in the
    map tasks, so that a vertex with very many links is no hot group, and a link
    stays one row. Ids without links are not in the result; no links give an empty result.
    """
    edges = links.select(
        F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")
    )
    edges = settle(edges.where("u != v").distinct(), "class-edges")
    before = None
    for _ in range(MOST_TURNS):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # All rows have u > v now.
        hung = hung.distinct()
        lower = hung.groupBy("u").agg(F.min("v").alias("m"))
        joined = hung.join(lower, "u")
        edges = settle(
            joined.select("u", F.col("m").alias("v"))
            .union(joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct(),
            "class-turn",
        )
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            centres = edges.select(F.col("v").alias("id")).distinct()
            return edges.select(F.col("u").alias("id"), F.col("v").alias("class_id")).union(
                centres.select("id", F.col("id").alias("class_id"))
            )
        before = state
    raise RuntimeError("classes did not settle")
