"""Quality of texts by positive-unlabelled learning.

A linear model of text statistics is fitted by minimising the non-negative unbiased
risk: with trusted positives P, unlabelled texts U and the share pi of good texts among U, the
risk of taking bad for good is estimated as risk of U minus pi times that of P, and
where that falls below zero, which only overfitting can do, the step goes back.
No negative label is used. The share pi is estimated: among texts that score
above a mark, unlabelled ones are at least pi times as frequent as positives, so that the
least ratio over all marks bounds it; the model is fitted again with it.

The loss is the squared one, of which the unbiased risk needs only the means of the inputs and
of their products two by two. So the risk of U is that of all documents, none left out, from one
aggregate; the descent runs on two small matrices. Only the trusted positives are a bounded
number of rows, chosen by a hash of the id. Texts are read once: what the model knows of each is
a row of a settled table, and means, products, the counts above the marks and the scores come from
that table. Inputs and weights are whole numbers on a grid, so that sums are exact, in any order,
and reruns agree.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import rows_per_batch, settle
from spanveil.llm.training import LABELLED_ROWS, held_out, labelled_ids

#: Share of good texts before any is estimated, and bounds of the estimate.
PRIOR, PRIOR_BOUNDS = 0.8, (0.05, 0.99)
#: Share of the positives that must lie above a mark for the estimate of the prior.
MARKS = np.linspace(0.3, 0.95, 14)
#: Steps and first step length of the descent, weight of the squared coefficients: squared loss on
#: few positives fits them too closely without it, which lowers the prior.
STEPS, STEP, DECAY = 600, 0.05, 3e-2
#: Parts of one that statistics and inputs, and weights, are rounded to.
GRID, WEIGHT_GRID = 1 << 10, 1 << 20
#: Statistics beyond it count as it; logarithms and shares do not get there.
LARGEST = 64.0
#: Score from which a document is good.
GOOD = 0.5
#: Texts that a Python worker holds at a time.
TEXTS_PER_BATCH = 500

_MARKS = re.compile(r"[^\w\s.,;:?'’\"()-]")
_UPPER = re.compile(r"[^\W\d_a-zà-öø-ÿß]")
_LETTER = re.compile(r"[^\W\d_]")
_DIGIT = re.compile(r"\d")
_NAMES = (
    "words length mean_word long_word upper letters digits marks bang bar marked_words "
    "distinct top_word doubled repeated_triples lines line_words repeated_lines short_lines "
    "short_words capital_words stops compressed entropy"
).split()


def statistics(text: str | None) -> list[float]:
    """What the model knows of a text; zeros for null and blank ones."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(_NAMES)
    chars, count = len(text), len(words)
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    shares = np.fromiter(counts.values(), dtype=float) / count
    lengths = np.fromiter(map(len, words), dtype=float, count=count)
    letters = len(_LETTER.findall(text))
    return [
        np.log1p(count),
        np.log1p(chars),
        float(np.log1p(lengths.mean())),
        float(np.log1p(lengths.max())),
        len(_UPPER.findall(text)) / max(1, letters),
        letters / chars,
        len(_DIGIT.findall(text)) / chars,
        len(_MARKS.findall(text)) / chars,
        float(np.log1p(text.count("!") / count)),
        float(np.log1p(text.count("|") / count)),
        sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:?\"')") / count,
        len(counts) / count**0.9,
        float(shares.max()),
        sum(1 for a, b in zip(words, words[1:], strict=False) if a == b) / count,
        1 - len(set(triples)) / max(1, len(triples)),
        np.log1p(len(lines)),
        np.log1p(count / len(lines)),
        1 - len(set(lines)) / len(lines),
        sum(1 for line in lines if len(line) < 40) / len(lines),
        float((lengths <= 3).mean()),
        sum(1 for w in words if w[0].isupper()) / count,
        sum(1 for w in words if w[-1] in ".?!") / count,
        len(zlib.compress(text.encode("utf-8", "surrogatepass"), 1)) / chars,
        float(-(shares * np.log(shares)).sum()) / max(1.0, np.log(count)),
    ]


#: From rows of statistics to whole numbers that are summed over all rows.
Sums = Callable[[Callable[[np.ndarray], np.ndarray]], list[int]]


@dataclass
class QualityModel:
    """Standardised statistics and their squares, weighted."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float

    def inputs(self, values: np.ndarray) -> np.ndarray:
        """Whole numbers, `GRID` to one; the first is the constant."""
        z = np.clip((values - self.mean) / self.spread, -6, 6)
        rows = np.hstack([np.ones((len(z), 1)), z, z * z / 6])
        return np.rint(rows * GRID).astype(np.int64)

    def score(self, values: np.ndarray) -> np.ndarray:
        weights = np.rint(self.weights * WEIGHT_GRID).astype(np.int64)
        return _sigmoid(2 * (self.inputs(values) @ weights) / (GRID * WEIGHT_GRID))


@dataclass(frozen=True)
class Moments:
    """Mean of rows of inputs, and mean of their products two by two."""

    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        return cls(rows.mean(axis=0), rows.T @ rows / len(rows))

    @classmethod
    def over(cls, sums: Sums, model: QualityModel) -> Moments:
        """Those of the inputs of all rows."""

        def make(values: np.ndarray) -> np.ndarray:
            rows = model.inputs(values)
            upper = np.triu_indices(rows.shape[1])
            return np.concatenate([[len(rows)], rows.sum(axis=0), (rows.T @ rows)[upper]])

        count, *rest = sums(make)
        width = len(model.weights)
        products = np.zeros((width, width))
        products[np.triu_indices(width)] = [x / (count * GRID * GRID) for x in rest[width:]]
        mean = np.array([x / (count * GRID) for x in rest[:width]])
        return cls(mean, products + np.triu(products, 1).T)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def non_negative_risk(
    weights: np.ndarray,
    positive: Moments | np.ndarray,
    unlabelled: Moments | np.ndarray,
    prior: float,
) -> tuple[float, float, np.ndarray]:
    """Risk of good taken for bad, corrected risk of bad for good, and the way to go.

    The loss of a decision value g is (1 - g)**2 / 4 where good is right, else (1 + g)**2 / 4.
    Where the corrected risk is negative, the step undoes it. Rows of inputs stand for
    their moments.
    """
    p, u = (m if isinstance(m, Moments) else Moments.of(m) for m in (positive, unlabelled))
    bent_p, bent_u = p.products @ weights, u.products @ weights
    miss = prior * (1 - 2 * p.mean @ weights + weights @ bent_p) / 4
    false = (1 + 2 * u.mean @ weights + weights @ bent_u) / 4
    false -= prior * (1 + 2 * p.mean @ weights + weights @ bent_p) / 4
    slope_false = (u.mean + bent_u - prior * (p.mean + bent_p)) / 2
    if false < 0:
        return float(miss), float(false), -slope_false
    return float(miss), float(false), prior * (bent_p - p.mean) / 2 + slope_false


def _descend(positive: Moments, unlabelled: Moments, prior: float) -> np.ndarray:
    weights = np.zeros(len(positive.mean))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        _, _, slope = non_negative_risk(weights, positive, unlabelled, prior)
        slope = slope + DECAY * weights
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        way = (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights = weights - STEP * (1 - (step - 1) / STEPS) * way
    return weights


def _marks(positive: np.ndarray) -> np.ndarray:
    return np.quantile(positive, 1 - MARKS)


def _least_ratio(marks: np.ndarray, positive: np.ndarray, above: np.ndarray) -> float:
    """The prior, from scores of positives and the share of unlabelled texts above each mark."""
    ratios = [share / max(1e-9, (positive >= mark).mean()) for mark, share in zip(marks, above, strict=True)]
    return float(np.clip(min(ratios), *PRIOR_BOUNDS))


def _counts_above(scores: np.ndarray, marks: np.ndarray) -> np.ndarray:
    return np.array([len(scores), *((scores >= mark).sum() for mark in marks)], dtype=np.int64)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores of both."""
    marks = _marks(positive)
    count, *above = _counts_above(unlabelled, marks)
    return _least_ratio(marks, positive, np.array(above) / count)


def _scale(sums: Sums) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of each statistic over all rows; zeros and ones without any."""

    def make(values: np.ndarray) -> np.ndarray:
        whole = np.rint(np.clip(values, -LARGEST, LARGEST) * GRID).astype(np.int64)
        return np.concatenate([[len(whole)], whole.sum(axis=0), (whole * whole).sum(axis=0)])

    count, *rest = sums(make) or [0]
    width = len(rest) // 2
    if not count:
        return np.zeros(len(_NAMES)), np.ones(len(_NAMES))
    mean = np.array([x / (count * GRID) for x in rest[:width]])
    # In whole numbers, as the difference of large ones.
    squares = [count * q - x * x for x, q in zip(rest[:width], rest[width:], strict=True)]
    spread = np.array([x**0.5 / (count * GRID) for x in squares])
    return mean, np.where(spread > 1e-9, spread, 1.0)


def fit(positive: np.ndarray, unlabelled: np.ndarray | Sums) -> QualityModel:
    """A model from statistics of trusted positives (rows x statistics) and of unlabelled texts.

    The latter may be rows too, or a function that sums whole numbers over all of them.
    """
    sums: Sums = unlabelled if callable(unlabelled) else _sums_of(unlabelled)
    mean, spread = _scale(sums)
    model = QualityModel(mean, spread, np.zeros(2 * len(mean) + 1), PRIOR)
    if not len(positive) or not sums(lambda values: np.array([len(values)])):
        return model
    p = Moments.over(_sums_of(positive), model)
    u = Moments.over(sums, model)
    for _ in range(2):
        model.weights = _descend(p, u, model.prior)
        scores = model.score(positive)
        marks = _marks(scores)
        count, *above = sums(lambda values: _counts_above(model.score(values), marks))
        model.prior = _least_ratio(marks, scores, np.array(above) / count)
    model.weights = _descend(p, u, model.prior)
    return model


def _sums_of(rows: np.ndarray) -> Sums:
    return lambda make: [int(x) for x in make(rows)] if len(rows) else []


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(_NAMES))


def _sums_over(known: DataFrame) -> Sums:
    """Sums over a table of statistics; each task sends its own, one row for each number."""

    def sums(make: Callable[[np.ndarray], np.ndarray]) -> list[int]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = make(_rows(batch.column(0)))
                    total = part if total is None else total + part
            if total is not None:
                places = pa.array(np.arange(len(total), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([places, pa.array(total)], names=["place", "total"])

        parts = known.select("statistics").mapInArrow(run, "place int, total long")
        total = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
        # As many rows as numbers, whatever the table.
        found = parts.groupBy("place").agg(total).collect()
        return [int(row["total"]) for row in sorted(found, key=lambda row: row["place"])]

    return sums


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics) of all documents, settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [statistics(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.list_(pa.float64()))],
                names=["doc_id", "statistics"],
            )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with rows_per_batch(docs.sparkSession, TEXTS_PER_BATCH):
        return settle(
            texts.mapInArrow(run, "doc_id long, statistics array<double>"), "quality-statistics"
        )


def learn_quality(
    docs: DataFrame,
    labels: DataFrame,
    rows: int = LABELLED_ROWS,
    known: DataFrame | None = None,
) -> QualityModel:
    """A model from at most `rows` labelled documents outside the held-out third, of which only
    the good ones are used, and all documents without their labels.

    `known` is what `describe` makes of `docs`, if it is there already. Without
    documents or good ones it scores everything one half.
    """
    known = describe(docs) if known is None else known
    good = labelled_ids(labels, "quality", rows).where("label = 1").select("doc_id")
    # At most `rows` ids, so safe to send to every executor; of an id with several texts all count.
    trusted = known.join(F.broadcast(good), "doc_id").orderBy("doc_id", "statistics")
    values = [row["statistics"] for row in trusted.select("statistics").collect()]
    return fit(np.array(values, dtype=float).reshape(-1, len(_NAMES)), _sums_over(known))


def quality(docs: DataFrame, model: QualityModel, known: DataFrame | None = None) -> DataFrame:
    """Per document held_out, score (0 to 1) and predicted (1 from a score of 0.5).

    `docs` has `doc_id` (integer) and `text`; other columns are not looked at; `known` is what
    `describe` makes of it, if it is there already. Null, empty and blank
    texts have the score of a text whose statistics are all zero. Repeated and null ids
    give rows of their own; null ids count as held out. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(_rows(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores)], names=["doc_id", "score"]
            )

    known = describe(docs) if known is None else known
    scored = known.select("doc_id", "statistics").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )
