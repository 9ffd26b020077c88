"""Distances and similarities of arrays of doubles as columns. What is undefined (zero norms, zero variance) is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.binding import let


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def minkowski(a: Column, b: Column, p: float, absolute: bool = False) -> Column:
    """Without `absolute` the differences keep their sign, so an odd p may leave a negative sum: null."""
    s = total(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y) if absolute else x - y, F.lit(float(p)))))
    return F.when(s >= 0, F.pow(s, F.lit(1.0 / p)))


def cosine(a: Column, b: Column, distance: bool = False) -> Column:
    c = F.try_divide(dot(a, b), norm(a) * norm(b))
    return (1 - c) / 2 if distance else c


def cosine_floored(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def at_least_mean(a: Column) -> Column:
    return let(mean(a), lambda m: F.transform(a, lambda x: x >= m))


def hamming(a: Column, b: Column) -> Column:
    """Dimensions in which being at least one's own mean differs."""
    differ = F.zip_with(at_least_mean(a), at_least_mean(b), lambda x, y: (x != y).cast("int"))
    return F.aggregate(differ, F.lit(0), lambda acc, x: acc + x)


def jaccard_distance(a: Column, b: Column) -> Column:
    """Of the dimensions in which either is not zero, the share in which they differ."""
    either = F.zip_with(a, b, lambda x, y: ((x != 0) | (y != 0)).cast("double"))
    differ = F.zip_with(a, b, lambda x, y: ((x != y) & ((x != 0) | (y != 0))).cast("double"))
    return F.try_divide(total(differ), total(either))


def centred(a: Column) -> Column:
    return let(mean(a), lambda m: F.transform(a, lambda x: x - m))


def pearson(a: Column, b: Column) -> Column:
    return let(centred(a), lambda x: let(centred(b), lambda y: cosine(x, y)))


def kl_divergence(p: Column, q: Column) -> Column:
    """Null where a probability is not positive: no smoothing."""

    def divergence(p: Column, q: Column) -> Column:
        return F.when(F.least(F.array_min(p), F.array_min(q)) > 0, total(F.zip_with(p, q, lambda x, y: x * F.log(x / y))))

    return let(p, lambda x: let(q, lambda y: divergence(x, y)))


def softmax(a: Column) -> Column:
    powers = let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))
    return let(powers, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def l2_normalised(a: Column, eps: float | None = None) -> Column:
    size = norm(a) if eps is None else F.greatest(norm(a), F.lit(eps))
    return let(size, lambda n: F.transform(a, lambda x: F.try_divide(x, n)))


def mahalanobis_pairs(a: Column, b: Column) -> Column:
    """array<struct<i, j, distance>>: the two vectors are two variables observed in n dimensions; the distance of each two dimensions
    i < j under the inverse of their 2 x 2 sample covariance. Null where it is singular."""
    n = F.size(a)

    def of(x: Column, y: Column, k: Column) -> Column:
        """k: variances of a and b, covariance, determinant."""
        var_a, var_b, cov, det = (F.get(k, F.lit(i)) for i in range(4))

        def distance(i: Column, j: Column) -> Column:
            u, v = F.get(x, i) - F.get(x, j), F.get(y, i) - F.get(y, j)
            return F.sqrt(F.greatest((u * u * var_b - 2 * u * v * cov + v * v * var_a) / det, F.lit(0.0)))

        def row(i: Column) -> Column:
            return F.transform(F.sequence(i + 1, n - 1), lambda j: F.struct(i.alias("i"), j.alias("j"), distance(i, j).alias("distance")))

        return F.when(det > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 2), row)))

    def moments(x: Column, y: Column) -> Column:
        var_a, var_b, cov = dot(x, x) / (n - 1), dot(y, y) / (n - 1), dot(x, y) / (n - 1)
        return F.array(var_a, var_b, cov, var_a * var_b - cov * cov)

    return let(centred(a), lambda x: let(centred(b), lambda y: let(moments(x, y), lambda k: of(x, y, k))))


def max_sim(query: Column, document: Column, metric: str = "cosine") -> Column:
    """Late interaction: each query vector with its best document vector, summed. Arrays of arrays."""
    if metric == "l2":
        best = lambda q: F.array_max(F.transform(document, lambda d: -total(F.zip_with(q, d, lambda x, y: (x - y) * (x - y)))))
        return total(F.transform(query, best))
    unit = lambda m: F.transform(m, lambda v: l2_normalised(v, 1e-12))
    best = lambda q, d: total(F.transform(q, lambda x: F.array_max(F.transform(d, lambda y: dot(x, y)))))
    return let(unit(document), lambda d: let(unit(query), lambda q: best(q, d)))


def attention_pool(query: Column, keys: Column, values: Column, mask: Column | None = None) -> Column:
    """softmax(q . k / sqrt(d)) over the keys, applied to the values; masked-out keys get -1e9."""
    size = F.sqrt(F.size(query).cast("double"))
    scores = F.transform(keys, lambda k: dot(query, k) / size)
    if mask is not None:
        scores = F.zip_with(scores, mask, lambda s, m: s + (1 - m) * F.lit(-1e9))
    weighted = F.zip_with(softmax(scores), values, lambda w, v: F.transform(v, lambda x: w * x))
    zero = F.transform(F.element_at(values, 1), lambda x: F.lit(0.0))
    return F.aggregate(weighted, zero, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
