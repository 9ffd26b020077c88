"""A token corpus and its counts: term and document frequencies, sizes, vocabulary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.session import cut


def corpus(df: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(doc_id, tokens): one row per id (of several the greatest array), null tokens gone, null arrays empty; rows without an id are left out."""
    docs = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(tokens_col).alias("tokens"))
    tokens = F.coalesce(F.filter("tokens", lambda t: t.isNotNull()), F.array().cast("array<string>"))
    return docs.select("doc_id", tokens.alias("tokens"))


@dataclass(frozen=True)
class CorpusIndex:
    """tf(doc_id, token, cnt, doc_len), df(token, df), docs(doc_id, doc_len) and stats(n_docs, avg_len), a single row.

    All are lazy; `cut()` writes tf, df and docs to the checkpoint folder, so that many queries tokenise and count once.
    """

    tf: DataFrame
    df: DataFrame
    docs: DataFrame
    stats: DataFrame
    written: bool = False

    @staticmethod
    def of(tokens: DataFrame) -> CorpusIndex:
        """From (doc_id, tokens) with one row per id, as corpus() gives: the counts then need no shuffle of their own."""
        docs = tokens.select("doc_id", F.size("tokens").cast("long").alias("doc_len"))
        words = tokens.select("doc_id", F.size("tokens").cast("long").alias("doc_len"), F.explode("tokens").alias("token"))
        tf = words.groupBy("doc_id", "token", "doc_len").agg(F.count(F.lit(1)).alias("cnt"))
        return CorpusIndex._with(tf, docs)

    @staticmethod
    def _with(tf: DataFrame, docs: DataFrame) -> CorpusIndex:
        df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        stats = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"))
        return CorpusIndex(tf, df, docs, stats)

    def cut(self) -> CorpusIndex:
        tf = cut(self.tf)
        return CorpusIndex(tf, cut(tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))), cut(self.docs), cut(self.stats), True)


def vocabulary(tokens: DataFrame, *, min_count: int = 1, offset: int = 1, oov: str | None = None) -> DataFrame:
    """(token, idx, cnt, df): ranked by count, ties by first appearance (doc_id, position), indices from `offset`, an
    out-of-vocabulary token before all others.

    Ranks are global, so ranges of (count, first appearance) are numbered in parallel: a range partitioning, a row number
    within each range and the sizes of the ranges before it; no task holds the whole vocabulary.
    """
    words = tokens.select("doc_id", F.posexplode("tokens").alias("pos", "token"))
    counted = words.groupBy("token").agg(
        F.count(F.lit(1)).alias("cnt"), F.count_distinct("doc_id").alias("df"), F.min(F.struct("doc_id", "pos")).alias("first")
    )
    ranked = ranked_rows(counted.where(F.col("cnt") >= min_count), [F.desc("cnt"), F.asc("first")], "rank")
    start = offset + (oov is not None)
    out = ranked.select("token", (F.col("rank") + start - 1).cast("int").alias("idx"), "cnt", "df")
    if oov is not None:
        row = tokens.sparkSession.range(1).select(F.lit(oov).alias("token"), F.lit(offset).alias("idx"), F.lit(0).cast("long").alias("cnt"), F.lit(0).cast("long").alias("df"))
        out = row.unionAll(out.where(F.col("token") != oov))
    return out


def ranked_rows(df: DataFrame, order: list, name: str) -> DataFrame:
    """`df` with the 1-based rank of each row in a total order, numbered in parallel over range partitions."""
    ranged = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__rn", within).join(F.broadcast(before), "__part").withColumn(name, F.col("__rn") + F.col("__before")).drop("__part", "__rn", "__before")


def running_sums(df: DataFrame, order: list, values: dict[str, str]) -> DataFrame:
    """`df` with running sums `values[new] = old` in a total order, summed in parallel over range partitions."""
    ranged = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part").agg(*(F.sum(old).alias(f"__s_{new}") for new, old in values.items()))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("__part", *(F.coalesce(F.sum(f"__s_{new}").over(earlier), F.lit(0)).alias(f"__b_{new}") for new in values))
    window = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(before), "__part")
    for new, old in values.items():
        out = out.withColumn(new, F.sum(old).over(window) + F.col(f"__b_{new}"))
    return out.drop("__part", *(f"__b_{new}" for new in values))
