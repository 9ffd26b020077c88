"""Lexical pair classifiers: weighted character n-grams and cross-validated logistic regression."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from kindred.functions.text import char_ngrams, split_literal, word_ngrams, word_tokens
from kindred.operators.pairs import stratified_folds
from kindred.operators.rank import bm25_document
from kindred.session import cut
from kindred.sources import readers


def joint_text(a: str = "text_a", b: str = "text_b") -> Column:
    return F.concat(F.coalesce(F.col(a), F.lit("")), F.lit(" "), F.coalesce(F.col(b), F.lit("")))


#: N-gram occurrences of a chunk of records, whose distinct n-grams are counted together.
CHUNK = 1 << 22
#: Rows of an Arrow batch that a task hands on.
BATCH = 1 << 16


def _coded_ngrams(texts: pa.Array, owner: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For each n-gram of low to high - 1 characters the owner of its text and its place among the distinct ones, and these.

    An n-gram is the place of the one before it, which is a character shorter, and a character of 21 bits: exact at any length."""
    texts = texts.cast(pa.large_string())
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    whose = np.repeat(owner, size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(points))
    at, code, owners, codes, terms = np.arange(len(points)), np.zeros(len(points), np.int64), [], [], []
    for n in range(1, high):
        fits = left[at] >= n
        at, code = at[fits], code[fits]
        known = pa.array((code << 21) | points[at + n - 1]).dictionary_encode()
        code = known.indices.to_numpy().astype(np.int64)
        if n >= low:
            anywhere = np.zeros(len(known.dictionary), np.int64)
            anywhere[code] = at
            joined = points[anywhere[:, None] + np.arange(n)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            owners.append(whose[at])
            codes.append(code + len(terms))
            terms += [joined[i : i + n] for i in range(0, len(joined), n)]
    none = [np.zeros(0, np.int64)]
    return np.concatenate(owners or none), np.concatenate(codes or none), terms


def _counted_ngrams(chunk: pa.Table, low: int, high: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of the records of a chunk: the distinct ids, and for each id and n-gram of it their places and its count; the n-grams of each id, the distinct ones."""
    ids = chunk.column("id").combine_chunks().dictionary_encode(null_encoding="encode")
    owner, code, terms = _coded_ngrams(chunk.column("text").combine_chunks(), ids.indices.to_numpy().astype(np.int64), low, high)
    held, cnt = np.unique(owner * max(1, len(terms)) + code, return_counts=True)
    return ids.dictionary, held // max(1, len(terms)), held % max(1, len(terms)), cnt, np.bincount(owner, minlength=len(ids.dictionary)), terms


def lexical_features(pairs: DataFrame, id_col: str, *, low: int = 1, high: int = 4, rarer_than: int = 2, method: str = "tfidf", digits: int | None = None) -> DataFrame:
    """(id, term, weight): character n-grams of both texts without blanks; those of at most `rarer_than` occurrences in all weigh nothing and are left out.

    `digits` rounds the weights, halves up. Records are dealt to chunks by a hash of their id. Each chunk counts its n-grams in arrays and hands on its distinct ones, not one row a record and n-gram; their
    frequencies over all chunks come back to it, and it weighs the n-grams of its records, which are made again from the texts.
    """
    text = F.replace(joint_text(), F.lit(" "), F.lit(""))
    grams = sum((F.greatest(F.length("text") - (n - 1), F.lit(0)).cast("long") for n in range(low, high)), F.lit(0).cast("long"))
    rows = pairs.select(F.col(id_col).alias("id"), text.alias("text"))
    lengths = rows.select("id", grams.alias("n")).groupBy("id").agg(F.sum("n").alias("doc_len")).where("doc_len > 0")
    n_docs, n_grams = lengths.agg(F.count(F.lit(1)), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
    avg_len, chunks = n_grams / max(1, n_docs), n_grams // CHUNK + 1
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).repartition(chunks, "chunk")

    def count(table: pa.Table) -> pa.Table:
        _, _, code, cnt, _, terms = _counted_ngrams(table, low, high)
        df, total = np.bincount(code, minlength=len(terms)), np.bincount(code, cnt, len(terms)).astype(np.int64)
        chunk = pa.array(np.full(len(terms), table.column("chunk")[0].as_py(), np.int32))
        return pa.table({"chunk": chunk, "term": pa.array(terms, pa.string()), "df": pa.array(df.astype(np.int64)), "total": pa.array(total)})

    counted = dealt.groupBy("chunk").applyInArrow(count, "chunk int, term string, df bigint, total bigint")
    over = Window.partitionBy("term")
    summed = counted.select("chunk", "term", F.sum("df").over(over).alias("df"), F.sum("total").over(over).alias("total"))
    known = summed.where(F.col("total") > rarer_than).select("chunk", "term", "df")
    kind = pairs.schema[id_col].dataType

    def weigh(table: pa.Table, frequencies: pa.Table) -> pa.Table:
        ids, owner, code, cnt, doc_len, terms = _counted_ngrams(table, low, high) if table.num_rows else (pa.array([], to_arrow_type(kind)), *[np.zeros(0, np.int64)] * 4, [])
        words = pa.array(terms, pa.string())
        place = pc.index_in(words, value_set=frequencies.column("term").combine_chunks()).fill_null(-1).to_numpy(zero_copy_only=False)
        some = (place[code] >= 0) & ids.is_valid().to_numpy(zero_copy_only=False)[owner]
        owner, code, cnt = owner[some], code[some], cnt[some]
        df, doc_len = frequencies.column("df").to_numpy()[place[code]], doc_len[owner]
        share = cnt / doc_len
        weight = np.log((n_docs + 0.5) / (df + 0.5)) * (share if method == "tfidf" else bm25_document(share, doc_len, avg_len))
        if digits is not None:
            weight = np.floor(weight * 10.0**digits + 0.5) / 10.0**digits
        parts = [slice(i, i + BATCH) for i in range(0, max(1, len(code)), BATCH)]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([ids.take(pa.array(owner[p])), words.take(pa.array(code[p])), pa.array(weight[p])], [id_col, "term", "weight"]) for p in parts])

    schema = StructType([StructField(id_col, kind), StructField("term", StringType()), StructField("weight", DoubleType())])
    return dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(weigh, schema)


def hashed_features(pairs: DataFrame, id_col: str, *, low: int = 1, high: int = 4, width: int = 1 << 16) -> DataFrame:
    """(id, features vector): the same n-grams hashed to a fixed width, tf-idf weighted; no term table is joined, so width bounds the model."""
    grams = pairs.select(F.col(id_col), char_ngrams(joint_text(), low, high, strip_blanks=True).alias("grams"))
    tf = HashingTF(inputCol="grams", outputCol="tf", numFeatures=width).transform(grams)
    return IDF(inputCol="tf", outputCol="features", minDocFreq=2).fit(tf).transform(tf).select(id_col, "features")


def inferred(train: DataFrame, asked: DataFrame, id_col: str, label_col: str = "labels", *, features: Callable[[DataFrame, str], DataFrame] = hashed_features, k: int = 5, seed: int = 1, c: float = 1.0, iterations: int = 20) -> DataFrame:
    """(id, probability) of `asked`, the mean of what k models say, each fitted to the labelled pairs of `train` outside one of k stratified folds.

    Features are weighted over the pairs of both tables. Ids of the two may be equal. Without both labels in a fold's pairs its model is left out; null if none is left.
    """
    labelled = train.where(F.col(label_col).isin(0, 1))
    columns = ["text_a", "text_b"]
    both = labelled.select(F.struct(F.lit(0).alias("part"), F.col(id_col).alias("id")).alias("key"), *columns)
    both = both.unionAll(asked.select(F.struct(F.lit(1).alias("part"), F.col(id_col).alias("id")).alias("key"), *columns))
    made = cut(features(both, "key"))
    folds = stratified_folds(labelled, id_col, label_col, k, seed)
    known = cut(made.where("key.part = 0").select(F.col("key.id").alias("id"), "features").join(folds, "id").withColumn("label", F.col("label").cast("double")))
    wanted, n, parts = made.where("key.part = 1").select(F.col("key.id").alias("id"), "features"), known.count(), []
    for fold in range(k):
        own = known.where(F.col("fold") != fold)
        if n and own.select("label").distinct().count() == 2:
            model = LogisticRegression(regParam=1 / (c * n), standardization=False, maxIter=iterations).fit(own)
            parts.append(model.transform(wanted).select("id", vector_to_array("probability")[1].alias("p")))
    if not parts:
        return wanted.select("id", F.lit(None).cast("double").alias("probability"))
    return reduce(DataFrame.unionAll, parts).groupBy("id").agg(F.avg("p").alias("probability"))


def infer_file(spark: SparkSession, train_path: str, path: str, out_path: str, **how) -> None:
    """The probabilities of the pairs of a file (two columns), in its order, as CSV without a header, from a labelled file (three columns)."""
    train = readers.tsv_pairs(spark, train_path).withColumn("id", F.monotonically_increasing_id()).withColumn("labels", F.col("label").cast("int"))
    lines = readers.numbered_lines(spark, path).select(F.col("position").alias("id"), split_literal(F.col("value"), "\t").alias("f"))
    asked = lines.select("id", F.coalesce(F.get("f", F.lit(0)), F.lit("0")).alias("text_a"), F.coalesce(F.get("f", F.lit(1)), F.lit("0")).alias("text_b"))
    readers.write_predictions(inferred(train, asked, "id", **how).orderBy("id").select("probability"), out_path)


def infer_pair(spark: SparkSession, text_a: str, text_b: str, train_path: str, **how) -> float | None:
    """The probability of one pair from a labelled file; lines of other than three fields are passed over."""
    train = readers.pair_lines(readers.lines(spark, train_path), strict=True).withColumn("id", F.monotonically_increasing_id())
    asked = spark.createDataFrame([(0, text_a, text_b)], "id bigint, text_a string, text_b string")
    return inferred(train, asked, "id", **how).first()["probability"]


def infer(spark: SparkSession, train_path: str, *, pair: tuple[str, str] | None = None, path: str | None = None, out_path: str | None = None, **how) -> float | None:
    """One pair if there is one, else the file at `path`, whose probabilities go to `out_path`."""
    if pair:
        return infer_pair(spark, *pair, train_path, **how)
    if path:
        infer_file(spark, train_path, path, out_path, **how)
    return None


def word_features(pairs: DataFrame, id_col: str, *, low: int = 1, high: int = 2, width: int = 1 << 16) -> DataFrame:
    """(id, features vector): word n-grams of both texts hashed to a fixed width, tf-idf weighted with smoothed frequencies and scaled to length 1."""
    grams = pairs.select(F.col(id_col), word_ngrams(word_tokens(joint_text()), low, high).alias("grams"))
    tf = HashingTF(inputCol="grams", outputCol="tf", numFeatures=width).transform(grams)
    weighted = IDF(inputCol="tf", outputCol="raw").fit(tf).transform(tf)
    return Normalizer(inputCol="raw", outputCol="features").transform(weighted).select(id_col, "features")


def cross_validated(pairs: DataFrame, id_col: str, label_col: str = "labels", *, k: int = 5, seed: int = 1, c: float = 1.0, iterations: int = 20) -> DataFrame:
    """(fold, auc) of a logistic regression of the pairs labelled 0 or 1, each fold predicted by a model of the others."""
    labelled = pairs.where(F.col(label_col).isin(0, 1))
    folds = stratified_folds(labelled, id_col, label_col, k, seed).withColumnRenamed("id", id_col)
    rows = cut(hashed_features(labelled, id_col).join(folds, id_col).withColumn("label", F.col("label").cast("double")))
    n, out = rows.count(), []
    for fold in range(k):
        train, held = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        if n and train.select("label").distinct().count() == 2 and held.select("label").distinct().count() == 2:
            model = LogisticRegression(regParam=1 / (c * n), standardization=False, maxIter=iterations).fit(train)
            out.append((fold, float(BinaryClassificationEvaluator().evaluate(model.transform(held)))))
    return pairs.sparkSession.createDataFrame(out, "fold int, auc double")
