"""Names of people, places and organizations: from a model or from a list."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.arrays import cut, let, pages_of
from spanveil.functions.fixed_values import MODEL_CONFIDENCE, MODEL_LABELS
from spanveil.functions.regex import WORD
from spanveil.functions.rules import MODEL_RANK, order_number
from spanveil.functions.spans import RANKED, empty_of, find_matches, ranked

#: Bits of the set of prefixes for each prefix, and the most that are sent to the executors: 2**20
#: rows of a slot and its bits.
BITS_PER_PREFIX, FILTER_BITS = 16, 1 << 26

Model = Callable[[list[str]], Iterable[Iterable[tuple[str, int, int]]]]


def with_model_entities(
    df: DataFrame, load_model: Callable[[], Model], text: str = "text", out: str = "model_spans"
) -> DataFrame:
    """Add spans that a named-entity model finds.

    ``load_model`` returns a function from a list of texts to (label, start, end)
    of each.  It is called once on the driver: if the model or its library is
    missing there are no spans in the whole job, and the patterns still work.  Then it runs
    once per Python worker, and a worker that lacks the model fails: a job never mixes
    rows that were searched with rows that were not.
    """
    try:
        load_model()
    except (ImportError, OSError):
        return df.withColumn(out, empty_of(RANKED))

    @F.pandas_udf(f"array<{RANKED}>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()

        def spans(value: str, entities: Iterable[tuple[str, int, int]]) -> list[dict]:
            return [
                {
                    "start": start,
                    "neg_end": -end,
                    "rank": order_number(MODEL_RANK),
                    "end": end,
                    "entity_type": MODEL_LABELS[label],
                    "text": value[start:end],
                    "confidence": MODEL_CONFIDENCE,
                    "detection_method": "ner",
                }
                for label, start, end in entities
                if label in MODEL_LABELS
            ]

        for batch in batches:
            texts = [value for value in batch if value]
            found = iter(model(texts)) if texts else iter(())
            yield pd.Series([spans(value, next(found)) if value else [] for value in batch])

    return df.withColumn(out, find(F.col(text)))


def _phrase(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def _prefix_filter(listed: DataFrame) -> tuple[DataFrame, int] | None:
    """(slot, bits) of a set of hashed prefixes of the names, and its number of bits.

    Every first word, first two words and so on of a name sets one bit; bits are put together
    slot by slot, with partial results per task. None if there would be more than
    FILTER_BITS: then the set is not sent to the executors.
    """
    prefixes = listed.select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("words")), lambda n: _phrase(F.slice("words", F.lit(1), n))
            )
        ).alias("phrase")
    ).distinct()
    bits = 1 << max(10, (BITS_PER_PREFIX * prefixes.count() - 1).bit_length())
    if bits > FILTER_BITS:
        return None
    slots = prefixes.select(_bit("phrase", bits).alias("bit")).groupBy(
        F.shiftright("bit", 6).alias("slot")
    )
    return slots.agg(F.bit_or(_one_at("bit")).alias("bits")), bits


def _bit(phrase: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(phrase), F.lit(bits)).cast("int")


def _one_at(bit: str) -> Column:
    """The bit within its slot of 64."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))


def _perhaps_listed(rows: DataFrame, phrase: str, known: tuple[DataFrame, int] | None) -> DataFrame:
    """The rows whose phrase may begin a name, without moving them."""
    if known is None:
        return rows
    slots, bits = known
    bit = _bit(phrase, bits)
    # At most FILTER_BITS / 64 rows.
    there = rows.withColumn("__bit", bit).join(
        F.broadcast(slots.select(F.col("slot").alias("__slot"), F.col("bits").alias("__bits"))),
        F.shiftright("__bit", 6) == F.col("__slot"),
    )
    return there.filter(F.col("__bits").bitwiseAND(_one_at("__bit")) != 0).drop("__bit", "__slot", "__bits")


def with_listed_entities(
    df: DataFrame,
    names: DataFrame,
    key: str,
    text: str = "text",
    *,
    out: str = "model_spans",
) -> DataFrame:
    """Add spans of the names in a table (name, entity_type).

    The names are a trie of words, kept as a set of hashed prefixes that is sent to the
    executors if its size allows. A word that begins no name ends in its task; where one does, the
    runs from it on whose prefixes are known are joined with the names by equality, so that
    what moves grows with the hits and neither with the texts nor with the list. ``key``
    identifies a row of ``df``; null texts have no spans.
    """
    every_word = f"{WORD}+"
    listed = (
        names.select(find_matches(F.col("name"), every_word).alias("words"), "entity_type")
        .filter(F.size("words") > 0)
        .withColumn("phrase", _phrase(F.col("words")))
        .dropDuplicates(["phrase", "entity_type"])
    )
    # Names are short: a handful of different lengths, read from the list.
    lengths = sorted(row["n"] for row in listed.select(F.size("words").alias("n")).distinct().collect())
    if not lengths:
        return df.withColumn(out, empty_of(RANKED))
    known = _prefix_filter(listed)

    words = F.col("__words")
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words)))
    windows = F.transform(starts, lambda i: F.slice(words, i, lengths[-1]))
    begun = (
        df.select(key, find_matches(F.col(text), every_word).alias("__words"))
        .select(key, F.explode(windows).alias("__window"))
        .withColumn("phrase", F.col("__window")[0]["text"])
    )
    begun = _perhaps_listed(begun, "phrase", known)
    runs = F.filter(
        F.array(
            *[
                F.when(
                    F.size("__window") >= n,
                    F.struct(
                        F.col("__window")[0]["start"].alias("start"),
                        F.col("__window")[n - 1]["end"].alias("end"),
                        _phrase(F.slice("__window", 1, n)).alias("phrase"),
                    ),
                )
                for n in lengths
            ]
        ),
        lambda run: run.isNotNull(),
    )
    whole = begun.select(key, F.explode(runs).alias("run")).select(key, "run.*")
    hits = _perhaps_listed(whole, "phrase", known).join(listed.select("phrase", "entity_type"), "phrase")
    found = hits.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "entity_type"))).alias("__found")
    )

    def span(pages: Column, hit: Column) -> Column:
        return ranked(
            hit["start"],
            hit["end"],
            cut(pages, hit["start"], hit["end"]),
            rank=F.lit(order_number(MODEL_RANK)),
            entity_type=hit["entity_type"],
            confidence=F.lit(MODEL_CONFIDENCE),
            method=F.lit("ner"),
        )

    # The texts are not carried along with the word runs; values are cut out at the end.
    spans = let(
        pages_of(F.col(text)),
        lambda pages: F.transform(F.col("__found"), lambda hit: span(pages, hit)),
    )
    return df.join(found, key, "left").select(
        *df.columns, F.coalesce(spans, empty_of(RANKED)).alias(out)
    )
