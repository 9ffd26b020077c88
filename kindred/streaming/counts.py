"""Corpus counts kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term_totals(stream: DataFrame, tokens_col: str = "tokens", time_col: str | None = None, delay: str = "1 day", window: str | None = None) -> DataFrame:
    """(token, cnt, df) of a stream of token arrays, or (window, token, cnt, df) per event-time window.

    A record's repeated tokens are folded within its row, so the state holds one row a token (and window); with a
    time column windows close once the watermark has passed them and late records are dropped by Spark's rules. Mean lengths are
    sums and counts, so adding batches never divides a mean again. Null arrays and tokens add nothing.
    """
    tokens = F.filter(F.coalesce(F.col(tokens_col), F.array().cast("array<string>")), lambda t: t.isNotNull())
    once = F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("token"), F.size(F.filter(tokens, lambda u: u == t)).alias("n")))
    keys = ["token"]
    if time_col is not None:
        stream = stream.withWatermark(time_col, delay)
        keys = ["window", "token"]
        rows = stream.select(F.window(time_col, window or "1 hour").alias("window"), F.explode(once).alias("t"))
    else:
        rows = stream.select(F.explode(once).alias("t"))
    rows = rows.select(*[k for k in keys if k != "token"], F.col("t.token").alias("token"), F.col("t.n").alias("n"))
    return rows.groupBy(*keys).agg(F.sum("n").alias("cnt"), F.count(F.lit(1)).alias("df"))


def length_totals(stream: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """(n_docs, sum_len) of a stream; the mean length is their quotient at any time."""
    size = F.when(F.col(tokens_col).isNull(), 0).otherwise(F.size(tokens_col))
    return stream.groupBy().agg(F.count(F.lit(1)).alias("n_docs"), F.sum(size).alias("sum_len"))
