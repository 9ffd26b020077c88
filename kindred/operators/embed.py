"""Sentence embeddings from word vectors: SIF and uSIF, principal components, nearest vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.blocks import vector_blocks


def word_probabilities(words: DataFrame) -> DataFrame:
    """(token, p) from rows with a token column."""
    counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
    total = counts.agg(F.sum("cnt").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("token", (F.col("cnt") / F.col("total")).alias("p"))


def sif_weights(probabilities: DataFrame, a: float = 1e-3) -> DataFrame:
    return probabilities.select("token", (a / (a + F.col("p"))).alias("weight"))


def usif_weights(probabilities: DataFrame, n: int) -> DataFrame:
    """Weights a / (a / 2 + p) with a from the share of words likely to occur among n. No likely word: null weights."""
    if n < 1:
        raise ValueError("n is a positive number of words")
    size = probabilities.agg(F.count(F.lit(1)).alias("v"))
    limit = size.select("v", (1 - F.pow(1 - 1 / F.col("v"), F.lit(n))).alias("threshold"))
    alpha = probabilities.crossJoin(F.broadcast(limit)).agg((F.sum((F.col("p") > F.col("threshold")).cast("int")) / F.max("v")).alias("alpha"), F.max("v").alias("v"))
    a = alpha.select(F.try_divide(1 - F.col("alpha"), F.col("alpha") * F.col("v") / 2).alias("a"))
    return probabilities.crossJoin(F.broadcast(a)).select("token", F.try_divide(F.col("a"), F.col("a") / 2 + F.col("p")).alias("weight"))


def pooled(tokens: DataFrame, vectors: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, vec): the weighted sum of the vectors of a document's tokens over its number of tokens.

    Tokens without a vector add nothing, without a weight they weigh 1. Sums are per dimension with partial sums, so a long document is no single row's work.
    """
    size = F.size("tokens")
    counted = tokens.where(size > 0).select("doc_id", size.alias("n"), F.explode("tokens").alias("token")).groupBy("doc_id", "n", "token").agg(F.count(F.lit(1)).alias("cnt"))
    joined = counted.join(vectors, "token").join(weights, "token", "left")
    scale = F.coalesce("weight", F.lit(1.0)) * F.col("cnt") / F.col("n")
    parts = joined.select("doc_id", scale.alias("scale"), F.posexplode("vec").alias("dim", "x"))
    summed = parts.groupBy("doc_id", "dim").agg(F.sum(F.col("scale") * F.col("x")).alias("x"))
    return summed.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vec"))


def components(vectors: DataFrame, k: int, centred: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(k principal directions as rows, their singular values) of (…, vec): tasks send up their d x d sums of products, the driver decomposes one such matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, total, n = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            gram, total, n = (m.T @ m if gram is None else gram + m.T @ m), (m.sum(0) if total is None else total + m.sum(0)), n + len(m)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()]), pa.array([gram.ravel().tolist()])], ["n", "total", "gram"])

    rows = vectors.where("vec IS NOT NULL").select("vec").mapInArrow(run, "n bigint, total array<double>, gram array<double>").toLocalIterator()
    gram = total = None
    n = 0
    for r in rows:
        g, t = np.array(r["gram"]), np.array(r["total"])
        gram, total, n = (g if gram is None else gram + g), (t if total is None else total + t), n + r["n"]
    if not n:
        return np.zeros((0, 0)), np.zeros(0)
    d = len(total)
    gram = gram.reshape(d, d) - (np.outer(total, total) / n if centred else 0)
    values, directions = np.linalg.eigh(gram)
    order = np.argsort(-values)[:k]
    return directions[:, order].T, np.sqrt(np.maximum(values[order], 0))


def without_components(vectors: DataFrame, directions: np.ndarray, shares: np.ndarray | None = None) -> DataFrame:
    """(doc_id, vec) with the projections on the directions taken away: all at once, or one after another by their shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            if shares is None:
                m = m - m @ directions.T @ directions
            else:
                for u, share in zip(directions, shares):
                    m = m - share * np.outer(m @ u, u)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vec], ["doc_id", "vec"])

    kind = vectors.schema["doc_id"].dataType.simpleString()
    return vectors.select("doc_id", "vec").mapInArrow(run, f"doc_id {kind}, vec array<double>")


def sif(tokens: DataFrame, vectors: DataFrame, n_components: int = 1, a: float = 1e-3, decompose: Callable[[DataFrame, int], np.ndarray] | None = None) -> DataFrame:
    """SIF embeddings; the directions are those of the pooled vectors, not centred, unless `decompose`, a function of the vectors and the number of components, gives others."""
    weights = sif_weights(word_probabilities(tokens.select(F.explode("tokens").alias("token"))), a)
    s = pooled(tokens, vectors, weights)
    return without_components(s, decompose(s, n_components) if decompose else components(s, n_components, centred=False)[0])


def usif(tokens: DataFrame, vectors: DataFrame, n: int, n_components: int = 5) -> DataFrame:
    """uSIF embeddings: vectors scaled per dimension over a document's tokens, weighted, averaged; each direction goes by its share of variance."""
    weights = usif_weights(word_probabilities(tokens.select(F.explode("tokens").alias("token"))), n)
    words = tokens.where(F.size("tokens") > 0).select("doc_id", F.size("tokens").alias("n"), F.posexplode("tokens").alias("pos", "token"))
    parts = words.join(vectors, "token").join(weights, "token", "left").select("doc_id", "n", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.posexplode("vec").alias("dim", "x"))
    summed = parts.groupBy("doc_id", "n", "dim").agg(F.sum(F.col("weight") * F.col("x")).alias("wx"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    x = F.coalesce(F.try_divide(F.col("wx"), F.col("norm") * F.col("n")), F.lit(0.0))
    s = summed.select("doc_id", "dim", x.alias("x")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda v: v["x"]).alias("vec"))
    directions, sigma = components(s, n_components, centred=False)
    power = sigma**2
    return without_components(s, directions, power / power.sum() if power.sum() > 0 else np.zeros_like(power))


def word_vectors(segments: DataFrame, *, size: int = 128, window: int = 5, min_count: int = 1, epochs: int = 10, rate: float = 0.025, seed: int = 1, partitions: int = 1) -> DataFrame:
    """(token, vec): word2vec over the token lists of (…, tokens), such as random segmentations; trained in `partitions` parts whose models are averaged after each epoch."""
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, stepSize=rate, seed=seed, numPartitions=partitions, inputCol="tokens", outputCol="vec")
    return model.fit(segments.select("tokens")).getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("vec"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, *, block: int = 1024, digits: int = 6, group: str | None = None, above: float = -2.0) -> DataFrame:
    """(query_id, item_id, cosine, rank) of (item_id, vec) and (query_id, vec): exact neighbours of each query, itself left out.

    With `group`, a whole number that both tables have, only items of the query's group are neighbours; `above` bounds the cosine from below. Both hold before the k best are taken.
    Blocks of at most `block` queries meet blocks of items, each pair once (`blocks.vector_blocks`): one matrix product, of which the k best a query
    are kept, and one group-by joins those; nothing goes through the driver. Zero vectors have no neighbours; ties go to the smaller id.
    """
    kept = F.lit(0) if group is None else F.col(group)
    sides = [vector_blocks(x.select(key, "vec", kept.cast("bigint").alias("part")), block) for x, key in ((vectors, "item_id"), (queries, "query_id"))]
    met = sides[0].crossJoin(sides[1].toDF("q_ids", "q_flat", "q_parts", "q_n"))

    def unit(ids: np.ndarray, flat: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = flat.reshape(len(ids), -1)
        size = np.linalg.norm(m, axis=1)
        return ids[size > 0], m[size > 0] / size[size > 0, None], parts[size > 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                held = {c: batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("ids", "flat", "parts", "q_ids", "q_flat", "q_parts")}
                every, m, own = unit(held["ids"], held["flat"], held["parts"])
                ids, q, parts = unit(held["q_ids"], held["q_flat"], held["q_parts"])
                for p in np.intersect1d(own, parts):
                    item, asks = every[own == p], ids[parts == p]
                    c = np.round(m[own == p] @ q[parts == p].T, digits)
                    c[(item[:, None] == asks[None, :]) | (c <= above)] = -2
                    order = np.lexsort((np.broadcast_to(item[:, None], c.shape), -c), axis=0)[:k]
                    value = np.take_along_axis(c, order, 0)
                    keep = value > -2
                    yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(asks, order.shape)[keep]), pa.array(item[order][keep]), pa.array(value[keep])], ["query_id", "item_id", "cosine"])

    found = met.mapInArrow(run, "query_id bigint, item_id bigint, cosine double")
    window = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "item_id")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
