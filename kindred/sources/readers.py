"""Readers and writers with explicit schemas: token files, pair files, stop words, tokenizer state."""

from __future__ import annotations

import json
import os
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.text import split_literal
from kindred.operators.corpus import ranked_rows

JSON_PAIRS = "rid string, labels int, text_a string, text_b string"


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, block, value): lines that are not blank, without blanks around them."""
    if isinstance(paths, str):
        paths = [paths]
    for p in paths:
        if not re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", p) and not os.path.exists(p):
            raise FileNotFoundError(p)
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("value"))
    return rows.where("value <> ''")


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(position, value): lines that are not blank, numbered from 0 in the order of `paths`, of the names within a folder, and of each file.

    A block of a file is read by one task, in order, so the blocks' places and the order within each give every line its place, however files are split.
    """
    listed = [paths] if isinstance(paths, str) else paths
    parts = [lines(spark, p).withColumn("path", F.lit(k)) for k, p in enumerate(listed)]
    rows = reduce(DataFrame.unionAll, parts).withColumn("n", F.monotonically_increasing_id())
    ranked = ranked_rows(rows, [F.asc("path"), F.asc("file"), F.asc("block"), F.asc("n")], "rank")
    return ranked.select((F.col("rank") - 1).alias("position"), "value")


def token_lines(spark: SparkSession, paths: str | list[str], sep: str) -> DataFrame:
    """(doc_id, tokens): one document a line; the id is the line's position."""
    return numbered_lines(spark, paths).select(F.col("position").alias("doc_id"), split_literal(F.col("value"), sep).alias("tokens"))


def pair_lines(rows: DataFrame, sep: str = "\t", strict: bool = False) -> DataFrame:
    """(text_a, text_b, labels) of a `value` column: the label counts only of exactly three fields, else it is 0, and null where it is no number; `strict` keeps no others."""
    parts = split_literal(F.col("value"), sep)
    rows = rows.where(F.size(parts) == 3 if strict else F.size(parts) >= 2)
    third = F.trim(F.get(parts, F.lit(2)))
    number = F.when(third.rlike(r"^[0-9]{1,9}\z"), third.try_cast("int"))
    label = F.when(F.size(parts) == 3, number).otherwise(0)
    return rows.select(F.get(parts, F.lit(0)).alias("text_a"), F.get(parts, F.lit(1)).alias("text_b"), label.alias("labels"))


def tsv_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Header-less files of three columns; missing values are the string 0."""
    return spark.read.csv(path, sep="\t", schema="text_a string, text_b string, label string", quote="").na.fill("0")


def to_json_pairs(pairs: DataFrame, label_col: str | None = "labels") -> DataFrame:
    """The JSON form: an id from the texts, 2 for a missing label."""
    label = F.coalesce(F.col(label_col), F.lit(2)) if label_col else F.lit(2)
    rid = F.substring(F.sha2(F.concat_ws("\t", F.coalesce("text_a", F.lit("")), F.coalesce("text_b", F.lit(""))), 256), 1, 32)
    return pairs.select(rid.alias("rid"), label.cast("int").alias("labels"), "text_a", "text_b")


def read_json_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=JSON_PAIRS)


def stop_words(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return lines(spark, paths).select(F.col("value").alias("word")).distinct()


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """(label, label_desc): JSON lines, under either name of the description."""
    rows = spark.read.json(path, schema="label string, label_des string, label_desc string")
    return rows.select("label", F.coalesce("label_desc", "label_des").alias("label_desc"))


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    """One token a line in the order of ids; a vocabulary file is one file by its format."""
    vocab.orderBy("idx").select("token").coalesce(1).write.mode("overwrite").text(path)


def save_tokenizer(vocab: DataFrame, config: dict, path: str) -> None:
    """The vocabulary as Parquet, the scalars (lengths as doubles) as JSON beside it."""
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    vocab.sparkSession.createDataFrame([(json.dumps(config, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load_tokenizer(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/vocab"), json.loads(spark.read.text(f"{path}/config").first()[0])


def save_run_config(spark: SparkSession, path: str, key: str, config: dict) -> None:
    """The settings of a run under a key of the store at `path`; a later entry of a key replaces the earlier one."""
    at = spark.sql("SELECT current_timestamp() AS at").withColumn("key", F.lit(key)).withColumn("config", F.lit(json.dumps(config, ensure_ascii=False)))
    at.select("key", "at", "config").coalesce(1).write.mode("append").json(path)


def run_config(spark: SparkSession, path: str, key: str) -> dict:
    """The last settings under a key; an empty dictionary where there are none."""
    found = spark.read.json(path, schema="key string, at timestamp, config string").where(F.col("key") == key)
    last = found.agg(F.max_by("config", "at").alias("config")).first()["config"]
    return json.loads(last) if last else {}


def write_lines(rows: DataFrame, path: str) -> None:
    """A single string column as text files."""
    rows.write.mode("overwrite").text(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=False)
