"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are turned by one random rotation and each keeps only the signs of its
components, packed into bits, with two correction scalars. The inner product of a query
with the signs, divided by the first scalar, estimates the cosine without bias; the second
bounds the error of the estimate: for a random rotation the error is below
`bound` / sqrt(dimension - 1) * sqrt(1 / s**2 - 1) but for a share of pairs that falls
off like a Gaussian tail in `bound`. Only vectors whose upper bound reaches the k-th
best exact cosine found so far are compared in full, on the original vectors in double
precision. Every row is coded and no bucket is left out.

Queries go over the codes in blocks of bounded size: one pass over the table for each
block, in which the codes stay where they lie. What leaves a task is at most k rows for each
query of the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.llm.common import rows_per_batch, settle

#: Vectors coded as one chunk, and chunks that a Python worker holds at a time.
CHUNK, CHUNKS_PER_BATCH = 4096, 4
#: Queries of one pass, on the average: with 64 components 8 MB are sent to each executor.
QUERY_BLOCK = 16384
#: Queries compared with a chunk at once.
QUERY_STEP = 512
#: Pairs compared exactly at once.
PAIR_STEP = 1 << 16


def rotation(dimension: int, seed: int = 20240521) -> np.ndarray:
    """A random rotation, the same in every task."""
    gauss = np.random.default_rng([seed, dimension]).standard_normal((dimension, dimension))
    q, r = np.linalg.qr(gauss)
    return (q * np.sign(np.diag(r))).astype(np.float64)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component near 1.

    Cosines stay the same to the last bit, and no square overflows or vanishes.
    """
    _, exponents = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    # In two steps, as the power itself may be out of range.
    half = -exponents // 2
    return np.ldexp(np.ldexp(vectors, half), -exponents - half)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated unit vectors, and their products with their own signs."""
    turned = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ turn
    own = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    return np.packbits(turned >= 0, axis=1), own


def estimates(
    codes: np.ndarray, own: np.ndarray, queries: np.ndarray, bound: float
) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (vectors x queries) from packed signs, and a bound of the error."""
    dimension = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dimension).astype(np.float32)
    signs = (2 * signs - 1) / np.float32(np.sqrt(dimension))
    found = (signs @ queries.T.astype(np.float32)) / own[:, None].astype(np.float32)
    spread = np.sqrt(np.maximum(0.0, 1.0 / own**2 - 1.0))
    return found, bound * spread / np.sqrt(max(1, dimension - 1))


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    infinite = float("inf")
    fine = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(infinite)),
    )
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _code_chunks(vectors: DataFrame) -> DataFrame:
    schema = pa.schema(
        [
            ("dimension", pa.int32()),
            ("ids", pa.binary()),
            ("vectors", pa.binary()),
            ("codes", pa.binary()),
            ("own", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            for dimension in np.unique(lengths):
                rows = np.flatnonzero(lengths == dimension)
                block = scaled(values[starts[rows][:, None] + np.arange(dimension)])
                codes, own = encode(block, rotation(int(dimension)))
                parts = [ids[rows].astype(np.int64), block, codes, own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(dimension)], pa.int32())]
                    + [pa.array([x.tobytes()], pa.binary()) for x in parts],
                    schema=schema,
                )

    return vectors.select("vec_id", "vector").mapInArrow(
        run, "dimension int, ids binary, vectors binary, codes binary, own binary"
    )


class _Best:
    """The k best of each query of a block, so far; ties to the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        touched = np.unique(at)
        query = np.concatenate([np.repeat(touched, self.k), at])
        score = np.concatenate([self.score[touched].ravel(), score])
        ident = np.concatenate([self.id[touched].ravel(), ident])
        order = np.lexsort((ident, -score, query))
        query, score, ident = query[order], score[order], ident[order]
        first = np.searchsorted(query, touched)
        rows = first[:, None] + np.arange(self.k)
        self.score[touched], self.id[touched] = score[rows], ident[rows]


def _scan(batches, block: dict[int, tuple[np.ndarray, np.ndarray]], k: int, bound: float):
    """The k best of each query among the chunks of a task."""
    best = {d: _Best(len(ids), k) for d, (ids, _) in block.items()}
    unit = {d: q / np.linalg.norm(q, axis=1, keepdims=True) for d, (_, q) in block.items()}
    turned = {d: unit[d] @ rotation(d) for d in block}
    for batch in batches:
        for row in batch.to_pylist():
            d = row["dimension"]
            if d not in block:
                continue
            ids = np.frombuffer(row["ids"], dtype=np.int64)
            vectors = np.frombuffer(row["vectors"], dtype=np.float64).reshape(-1, d)
            codes = np.frombuffer(row["codes"], dtype=np.uint8).reshape(len(ids), -1)
            own = np.frombuffer(row["own"], dtype=np.float64)
            norms = np.sqrt((vectors * vectors).sum(axis=1))
            query_ids, queries = block[d]
            query_norms = np.sqrt((queries * queries).sum(axis=1))

            def settle_pairs(c, q, best=best[d], v=vectors, w=queries, n=norms, m=query_norms, i=ids):
                for s in range(0, len(c), PAIR_STEP):
                    a, b = c[s : s + PAIR_STEP], q[s : s + PAIR_STEP]
                    best.add(b, (v[a] * w[b]).sum(axis=1) / (n[a] * m[b]), i[a])

            for s in range(0, len(query_ids), QUERY_STEP):
                part = slice(s, s + QUERY_STEP)
                guess, error = estimates(codes, own, turned[d][part], bound)
                foreign = ids[:, None] != query_ids[part][None, :]
                # The most promising first, so that the others meet a high mark.
                lead = np.argpartition(-np.where(foreign, guess, -9), min(k, len(ids)) - 1, axis=0)
                lead = lead[: min(k, len(ids))]
                c, q = lead.ravel(), np.tile(np.arange(lead.shape[1]), len(lead))
                keep = foreign[c, q]
                ahead = np.zeros(guess.shape, dtype=bool)
                ahead[c, q] = True
                settle_pairs(c[keep], q[keep] + s)
                mark = best[d].score[part, k - 1]
                open_pairs = (guess + error[:, None] >= mark[None, :]) & foreign & ~ahead
                c, q = np.nonzero(open_pairs)
                settle_pairs(c, q + s)
    for d, (query_ids, _) in block.items():
        found = best[d].score > -np.inf
        at, place = np.nonzero(found)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(query_ids[at]),
                pa.array(best[d].id[at, place]),
                pa.array(best[d].score[at, place]),
            ],
            names=["query_id", "vec_id", "score"],
        )


def nearest(
    embeddings: DataFrame,
    every: int = 50,
    k: int = 5,
    bound: float = 3.0,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """The k rows of largest cosine for each row whose id is divisible by `every`.

    Candidates are all rows but those with the query's own id. Vectors that are null or
    zero, or hold null or non-finite components, and rows without an id, take no part; vectors
    of different dimensions are not compared. If a query's id is repeated, its smallest vector,
    component by component, asks. Equal cosines are ordered by id; a row that
    repeats another's id counts by itself. With fewer candidates than k all are returned; an
    empty table gives an empty result.

    Returns query_id, rank (from 1), vec_id, score.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.col(vector_column).cast("array<double>").alias("vector"),
    ).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    with rows_per_batch(spark, CHUNK):
        chunks = settle(_code_chunks(rows), "codes")
    asked = rows.where(F.col("vec_id") % every == 0)
    asked = settle(asked.groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    passes = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("pass", F.pmod(F.xxhash64("vec_id"), F.lit(passes)))
    found = []
    for number in range(passes):
        block: dict[int, tuple[list, list]] = {}
        # Bounded by QUERY_BLOCK, whatever the size of the table.
        for row in asked.where(F.col("pass") == number).collect():
            ids, vectors = block.setdefault(len(row["vector"]), ([], []))
            ids.append(row["vec_id"])
            vectors.append(row["vector"])
        sent = spark.sparkContext.broadcast(
            {d: (np.array(i, dtype=np.int64), scaled(np.array(v))) for d, (i, v) in block.items()}
        )

        def run(batches, sent=sent) -> Iterator[pa.RecordBatch]:
            yield from _scan(batches, sent.value, k, bound)

        with rows_per_batch(spark, CHUNKS_PER_BATCH):
            part = chunks.mapInArrow(run, "query_id long, vec_id long, score double")
            found.append(settle(part, "nearest"))
        sent.destroy()
    every_found = found[0]
    for part in found[1:]:
        every_found = every_found.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        every_found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
