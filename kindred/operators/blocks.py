"""Measures of all pairs of a query set and a table of vectors, by matrix blocks.

Vectors become blocks of rows, one matrix each; every block of queries meets every block of items once, and a NumPy kernel measures the
whole block. Nothing is collected or hinted for broadcast, and what is of one vector alone (norms, means, logarithms) is computed once a block, not
once a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From [queries, d] and [items, d] to [queries, items]; NaN where undefined.
Measure = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _by_query(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Measure:
    """A measure that needs all differences of two vectors: a query at a time against the block."""
    return lambda q, x: np.stack([f(row, x) for row in q]) if len(q) else np.zeros((0, len(x)))


euclidean = _by_query(lambda a, x: np.sqrt(((x - a) ** 2).sum(1)))
manhattan = _by_query(lambda a, x: np.abs(x - a).sum(1))


def minkowski(p: float) -> Measure:
    """Differences keep their sign, so an odd p may leave a negative sum, which has no root."""

    def measure(a: np.ndarray, x: np.ndarray) -> np.ndarray:
        s = ((a - x) ** p).sum(1)
        return np.where(s >= 0, np.abs(s) ** (1 / p), np.nan)

    return _by_query(measure)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(a.shape, np.nan), where=b != 0)


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _ratio(q @ x.T, np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)))


def cosine_distance(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (1 - cosine(q, x)) / 2


def cosine_floored(eps: float = 1e-8) -> Measure:
    return lambda q, x: q @ x.T / np.maximum(np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)), eps)


def pearson(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return cosine(q - q.mean(1, keepdims=True), x - x.mean(1, keepdims=True))


def hamming(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Dimensions in which being at least one's own mean differs."""
    a, b = ((m >= m.mean(1, keepdims=True)).astype(float) for m in (q, x))
    return a @ (1 - b).T + (1 - a) @ b.T


def jaccard(above: float) -> Measure:
    """Of the dimensions in which either is above the bound, the share in which not both are."""

    def measure(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        a, b = (q > above).astype(float), (x > above).astype(float)
        both = a @ b.T
        either = a.sum(1)[:, None] + b.sum(1)[None, :] - both
        return _ratio(either - both, either)

    return measure


def kl_of_softmax(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The divergence of the softmax of the query from that of the item."""
    a, b = (m - np.log(np.exp(m).sum(1, keepdims=True)) for m in (q - q.max(1, keepdims=True), x - x.max(1, keepdims=True)))
    p = np.exp(a)
    return (p * a).sum(1)[:, None] - p @ b.T


def max_sim(tokens: int, metric: str = "cosine") -> Measure:
    """Late interaction: vectors are `tokens` token vectors one after the other; each of the query's with its best of the item's, summed."""

    def measure(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        a, b = (m.reshape(len(m), tokens, -1) for m in (q, x))
        if metric == "cosine":
            a, b = (m / np.maximum(np.linalg.norm(m, axis=2, keepdims=True), 1e-12) for m in (a, b))
        flat, out = b.reshape(-1, b.shape[2]), np.zeros((len(q), len(x)))
        square = (flat**2).sum(1)
        for k, own in enumerate(a):
            sim = own @ flat.T
            if metric == "l2":
                sim = 2 * sim - square[None, :] - (own**2).sum(1)[:, None]
            out[k] = sim.reshape(tokens, len(x), tokens).max(2).sum(0)
        return out

    return measure


def vector_blocks(vectors: DataFrame, size: int) -> DataFrame:
    """(ids, flat, parts, n) of (id, vec) or (id, vec, part): up to `size` vectors a row; null ids and vectors are left out. All vectors are of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, size):
                ids, vec, part = (c.slice(low, size) for c in batch.columns)
                flat = vec.flatten()
                if len(flat) % len(ids):
                    raise ValueError("vectors of different lengths")
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids.cast(pa.int64()), flat.cast(pa.float64()), part.cast(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([len(ids)], pa.int32())], ["ids", "flat", "parts", "n"])

    rows = vectors if len(vectors.columns) == 3 else vectors.withColumn("part", F.lit(0).cast("bigint"))
    rows = rows.toDF("id", "vec", "part").where("id IS NOT NULL AND vec IS NOT NULL AND part IS NOT NULL")
    return rows.mapInArrow(run, "ids array<bigint>, flat array<double>, parts array<bigint>, n int")


def measured(items: DataFrame, queries: DataFrame, measures: dict[str, Measure], *, size: int = 512) -> DataFrame:
    """(query_id, item_id, *measures) of (item_id, vec) and (query_id, vec): every query with every item but the one of its own id. What is undefined is null; an empty side gives an empty result."""
    met = vector_blocks(items, size).crossJoin(vector_blocks(queries, size).toDF("q_ids", "q_flat", "q_parts", "q_n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, flat, asked, q_flat = (batch.column(k)[row].values.to_numpy(zero_copy_only=False) for k in ("ids", "flat", "q_ids", "q_flat"))
                x, q = flat.reshape(len(ids), -1), q_flat.reshape(len(asked), -1)
                apart = asked[:, None] != ids[None, :]
                a, b = np.nonzero(apart)
                values = [pa.array(f(q, x)[apart], from_pandas=True) for f in measures.values()]
                yield pa.RecordBatch.from_arrays([pa.array(asked[a]), pa.array(ids[b]), *values], ["query_id", "item_id", *measures])

    return met.mapInArrow(run, "query_id bigint, item_id bigint, " + ", ".join(f"{name} double" for name in measures))
