"""Records that differ only in blanks, letter case, punctuation or the order of their fields (problem 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.codepoints import bare_hashes, mix
from kindred.session import cut


def formatting_keys(fields: list[pa.Array], ordered: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit halves of a key that is equal for records equal up to formatting, and where there is one: every field holds a letter or digit."""
    hashed = [bare_hashes(x, (101, 202)) for x in fields]
    solid = np.logical_and.reduce([s for _, s in hashed])
    first, second = (np.stack([h[k] for h, _ in hashed]) for k in (0, 1))
    with np.errstate(over="ignore"):
        if ordered:
            second = mix(second + np.arange(len(fields), dtype=np.uint64)[:, None], 3)
        else:
            first = np.sort(first, axis=0)
        low = np.zeros(first.shape[1], np.uint64)
        for part in first:
            low = mix(low + part, 1)
        high = mix(second.sum(axis=0, dtype=np.uint64), 2)
    return low.view(np.int64), high.view(np.int64), solid


def keyed_rows(df: DataFrame, id_col: str, fields: list[str], ordered: bool = False) -> DataFrame:
    """(id, k1, k2): the formatting key of each row, null where a field is null or has no letter or digit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high, solid = formatting_keys(batch.columns[1:], ordered)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low, mask=~solid), pa.array(high, mask=~solid)], ["id", "k1", "k2"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, *fields).mapInArrow(run, f"id {kind}, k1 bigint, k2 bigint")


def group_copies(
    df: DataFrame,
    id_col: str = "pair_id",
    fields: tuple[str, ...] = ("text_a", "text_b"),
    *,
    ordered: bool = False,
    hot_share: float = 1e-6,
    hot_rows: int = 8,
    max_hot: int = 4096,
    salts: int = 64,
) -> DataFrame:
    """(id, keep_id, n_copies): each row's group of equal records, its smallest id and its size.

    Keys are 128 bits of the fields' code points without blanks, letter case and punctuation; ids and keys are written to the
    checkpoint folder, so texts are read once. Keys that hold a share `hot_share` of all rows, and at least
    `hot_rows`, are found exactly from partial counts (a map task shuffles one row per key) and the `max_hot`
    largest are kept, which bounds what is broadcast and leaves every other group below max(hot_rows, hot_share * rows, rows / max_hot).
    Rows of hot keys are aggregated in two levels, by (key, salt) and then by key; all others in one shuffle by key.
    Representatives are the smallest ids.

    Null, empty and mark-only fields: the row takes part in no group and comes out alone with n_copies = 1. Rows with
    the same id and key count as copies of each other. Rows with a null id are kept, and never represent a group with
    known ids. An empty table gives an empty result; other columns are not read.
    """
    rows = cut(keyed_rows(df, id_col, list(fields), ordered))
    keyed, alone = rows.where("k1 IS NOT NULL"), rows.where("k1 IS NULL")
    counts = keyed.groupBy("k1", "k2").count().where(F.col("count") >= max(hot_rows, hot_share * rows.count()))
    hot_keys = [(r["k1"], r["k2"]) for r in counts.orderBy(F.desc("count"), "k1", "k2").limit(max_hot).collect()]
    alone = alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n_copies"))
    cold, key = keyed, ["k1", "k2"]
    if hot_keys:
        hot = F.broadcast(df.sparkSession.createDataFrame(hot_keys, "k1 bigint, k2 bigint"))
        cold, heavy = keyed.join(hot, key, "left_anti"), keyed.join(hot, key, "left_semi")
        salted = heavy.groupBy(*key, F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(
            F.min("id").alias("low"), F.count(F.lit(1)).alias("n")
        )
        groups = salted.groupBy(*key).agg(F.min("low").alias("keep_id"), F.sum("n").alias("n_copies"))
        heavy = heavy.join(F.broadcast(groups), key).select("id", "keep_id", "n_copies")
    group = Window.partitionBy(*key)
    cold = cold.select("id", F.min("id").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("n_copies"))
    out = cold.unionAll(heavy) if hot_keys else cold
    return out.unionAll(alone)


def collapse_copies(df: DataFrame, id_col: str = "pair_id", fields: tuple[str, ...] = ("text_a", "text_b"), **how) -> DataFrame:
    """One record per group, the one with the smallest id, and `n_copies`; all columns of `df` are kept.

    Rows that share an id and a group come out once; a column `n_copies` of `df` is replaced. Rows without a key and
    rows whose ids are null come out as they are, with n_copies = 1 unless their group has no other id.
    """
    kept = group_copies(df, id_col, fields, **how).where(F.col("id") == F.col("keep_id"))
    kept = kept.groupBy(F.col("id").alias("__id")).agg(F.max("n_copies").alias("n_copies"))
    rest = df.drop("n_copies")
    named = rest.where(F.col(id_col).isNotNull()).join(kept, F.col(id_col) == F.col("__id")).drop("__id").dropDuplicates([id_col])
    nameless = rest.where(F.col(id_col).isNull()).withColumn("n_copies", F.lit(1).cast("long"))
    return named.unionByName(nameless)


def copies_found(df: DataFrame, **how) -> DataFrame:
    """(keep_id, copy_id): each further copy under the smallest id of its group."""
    groups = group_copies(df, **how)
    return groups.where((F.col("n_copies") > 1) & (F.col("id") != F.col("keep_id"))).select(
        "keep_id", F.col("id").alias("copy_id")
    )
