"""Losses and metrics as columns and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.vectors import cosine, softmax
from kindred.operators.corpus import running_sums


def contrastive_loss(label: Column, energy: Column, margin: float) -> Column:
    """Sum over pairs: similar ones (1) pay (1 - E)^2 / 4, others E^2 from the margin on."""
    return F.sum(label * 0.25 * (1 - energy) * (1 - energy) + (1 - label) * F.when(energy >= margin, energy * energy).otherwise(0.0))


def cross_entropy(label: Column, probabilities: Column) -> Column:
    return F.avg(-F.log(F.get(probabilities, label)))


def logits_cross_entropy(label: Column, logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.log(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))
    return F.avg(total + top - F.get(logits, label))


def accuracy(label: Column, probabilities: Column) -> Column:
    best = F.array_position(probabilities, F.array_max(probabilities)) - 1
    return F.avg((best == label).cast("double"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def binary_cross_entropy(label: Column, p: Column, eps: float = 1e-7) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.avg(-(label * F.log(q) + (1 - label) * F.log(1 - q)))


def siamese_loss(label: Column, similarity: Column) -> Column:
    """Cross-entropy of the sigmoid of the cosine."""
    return binary_cross_entropy(label, sigmoid(similarity))


def share_above(similarity: Column, least: float = 0.6) -> Column:
    """How many cosines reach `least`, whatever the labels."""
    return F.avg((similarity >= least).cast("double"))


def simcse_loss(rows: DataFrame, batch_col: str, item_col: str, group_col: str, vec_col: str, temperature: float = 0.05) -> DataFrame:
    """(batch, loss): in-batch contrastive loss. Of each vector, the cross-entropy of finding the other one of its group among all others of its batch.

    Vectors meet within their batch, whose size is the pipeline's own.
    """
    a = rows.select(F.col(batch_col).alias("batch"), F.col(item_col).alias("i"), F.col(group_col).alias("gi"), F.col(vec_col).alias("vi"))
    b = rows.select(F.col(batch_col).alias("batch"), F.col(item_col).alias("j"), F.col(group_col).alias("gj"), F.col(vec_col).alias("vj"))
    pairs = a.join(b, "batch").where("i <> j").select("batch", "i", (F.col("gi") == F.col("gj")).alias("same"), (cosine(F.col("vi"), F.col("vj")) / temperature).alias("s"))
    per = pairs.groupBy("batch", "i").agg(F.log(F.sum(F.exp("s"))).alias("all"), F.max(F.when(F.col("same"), F.col("s"))).alias("own"))
    return per.groupBy("batch").agg(F.avg(F.col("all") - F.col("own")).alias("loss"))


def double_softmax_cross_entropy(label: Column, logits: Column) -> Column:
    """Softmax, and cross-entropy on top that takes the probabilities for logits."""
    return logits_cross_entropy(label, softmax(logits))


def roc_auc(rows: DataFrame, label_col: str, score_col: str) -> DataFrame:
    """(auc): the chance that a positive row scores above a negative one, ties by half; null without both kinds.

    Rows are counted by score before anything is ordered, and the running counts are summed in parallel over ranges of scores.
    """
    counted = rows.groupBy(F.col(score_col).alias("score")).agg(
        F.sum((F.col(label_col) == 1).cast("long")).alias("pos"), F.sum((F.col(label_col) == 0).cast("long")).alias("neg")
    )
    summed = running_sums(counted, [F.asc("score")], {"below": "neg"})
    won = F.sum(F.col("pos") * (F.col("below") - F.col("neg") * 0.5))
    return summed.agg(F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def running_average(rows: DataFrame, order: list, value_col: str) -> DataFrame:
    """`rows` with `average`, the mean of all values so far."""
    summed = running_sums(rows.withColumn("__one", F.lit(1).cast("long")), order, {"__sum": value_col, "__n": "__one"})
    return summed.withColumn("average", F.col("__sum").cast("double") / F.col("__n")).drop("__one", "__sum", "__n")


def piecewise_linear(step: Column, points: list[tuple[int, float]]) -> Column:
    """A learning rate that runs linearly from point to point, from 0 at step 0, and stays at the last value."""
    points = ([(0, 0.0)] if points[0][0] != 0 else []) + list(points)
    out = F.lit(float(points[-1][1]))
    for (s0, v0), (s1, v1) in reversed(list(zip(points, points[1:]))):
        out = F.when(step < s1, v0 + (step - s0) / (s1 - s0) * (v1 - v0)).otherwise(out)
    return out
