"""File names by any part of them, through an index of their trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.arrays import let, running_sum
from spanveil.operators.catalog import search_files

#: Ids of a posting list lie in a block of so many (a power of two), so no list grows with the catalog.
BLOCK_BITS = 16


def _trigrams(name: Column) -> Column:
    """The different runs of three characters, in small letters; none of shorter names."""
    small = F.lower(name)
    starts = F.when(F.length(small) >= 3, F.sequence(F.lit(1), F.length(small) - 2))
    grams = F.array_distinct(F.transform(starts, lambda i: small.substr(i, F.lit(3))))
    return F.coalesce(grams, F.array().cast("array<string>"))


def name_index(files: DataFrame, filename: str = "filename", file_id: str = "file_id") -> DataFrame:
    """Posting lists (gram, block, deltas) of an integer id: each the difference to the one before.

    Rows without id or name are in no list. In order of gram, so that a search in the written
    table reads what it needs.
    """
    named = files.filter(F.col(file_id).isNotNull()).select(
        F.col(file_id).cast("long").alias("id"), F.explode(_trigrams(F.col(filename))).alias("gram")
    )
    lists = named.groupBy("gram", F.shiftright("id", BLOCK_BITS).alias("block")).agg(
        F.sort_array(F.collect_set("id")).alias("ids")
    )
    begin = F.call_function("shiftleft", F.col("block"), F.lit(BLOCK_BITS))
    deltas = F.transform(
        "ids", lambda x, i: (x - F.coalesce(F.get("ids", i - 1), begin)).cast("int")
    )
    return (
        lists.select("gram", "block", deltas.alias("deltas"))
        .repartitionByRange("gram", "block")
        .sortWithinPartitions("gram", "block")
    )


def _ids(deltas: Column, block: Column) -> Column:
    begin = F.call_function("shiftleft", block, F.lit(BLOCK_BITS))
    return let(
        running_sum(deltas),
        lambda before: F.transform(deltas, lambda d, i: begin + F.get(before, i) + d),
    )


def search_by_index(
    index: DataFrame, files: DataFrame, query: str, filename: str = "filename", file_id: str = "file_id"
) -> DataFrame:
    """The rows of ``search_files``: names that contain the query, in any case.

    Ids that are in the lists of all trigrams of the query are candidates; only their rows are
    looked at. A query of fewer than three characters has no trigram, and all names are.
    """
    spark = files.sparkSession
    grams = spark.range(1).select(_trigrams(F.lit(query))).first()[0]
    if not grams:
        return search_files(files, query, filename)
    # A row for each trigram of the query and block: as many short lists as the query has trigrams.
    common = (
        index.filter(F.col("gram").isin(grams))
        .withColumn("ids", _ids(F.col("deltas"), F.col("block")))
        .groupBy("block")
        .agg(F.collect_list("ids").alias("lists"))
        .filter(F.size("lists") == len(grams))
        .select(
            F.explode(
                F.aggregate(
                    F.slice("lists", 2, len(grams)), F.element_at("lists", 1), F.array_intersect
                )
            ).alias("__id")
        )
    )
    candidates = files.join(common, files[file_id].cast("long") == common["__id"], "left_semi")
    return search_files(candidates, query, filename)
