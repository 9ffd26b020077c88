"""TF-IDF and BM25: scores, top k, weights per position, normalised n-gram features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from kindred.functions.arrays import pad
from kindred.functions.text import word_ngrams
from kindred.operators.corpus import CorpusIndex, ranked_rows
from kindred.session import broadcast_upto, cut, salted_join

#: Documents and queries of a block.
DOCUMENTS, QUERIES = 1 << 17, 1 << 13


def idf(n_docs: Column, df: Column, e: float = 0.5, kind: str = "smooth") -> Column:
    """smooth: ln((N + e) / (df + e)); probabilistic: ln((N - df + e) / (df + e)), negative for terms of most documents."""
    top = n_docs - df if kind == "probabilistic" else n_docs
    return F.log((top + e) / (df + e))


def bm25_document(tf: Column, doc_len: Column, avg_len: Column, b: float = 0.75, k1: float = 2.0) -> Column:
    """Saturation of the length-normalised term frequency."""
    return (k1 + 1) * tf / (k1 * (1 - b + b * doc_len / avg_len) + tf)


def bm25_query(qf: Column, k2: float = 1.2) -> Column:
    return (k2 + 1) * qf / (k2 + qf)


def query_terms(queries: DataFrame, id_col: str = "query_id", tokens_col: str = "tokens") -> DataFrame:
    """(query_id, token, q_cnt, q_len) of a table of token arrays; null tokens are left out."""
    tokens = F.filter(tokens_col, lambda t: t.isNotNull())
    words = queries.select(F.col(id_col).alias("query_id"), F.size(tokens).alias("q_len"), F.explode(tokens).alias("token"))
    return words.groupBy("query_id", "token", "q_len").agg(F.count(F.lit(1)).alias("q_cnt"))


def scores(index: CorpusIndex, terms: DataFrame, method: str = "bm25", *, e: float = 0.5, b: float = 0.75, k1: float = 2.0, k2: float = 1.2, query_tf: bool = True, idf_kind: str = "smooth") -> DataFrame:
    """(query_id, doc_id, score) of the documents that hold a term of the query; a repeated query token counts each time.

    An equi-join on token with the query's terms takes the place of a loop over documents; documents without a shared term score 0
    and are not listed. Only postings of the queries' tokens leave the corpus: they are written once, and document frequencies are counted
    from them unless the index has them. Frequent tokens are spread by salts where the terms are too many to be broadcast.
    """
    terms = cut(terms)
    asked, _ = broadcast_upto(terms.select("token").distinct(), 1_000_000)
    few, small = broadcast_upto(terms, 1_000_000)
    held = index.tf.join(asked, "token", "left_semi")
    held = held if index.written else cut(held)
    df = index.df.join(asked, "token", "left_semi") if index.written else held.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    few = few.join(df, "token") if small else terms.join(df, "token")
    postings = held.join(F.broadcast(few), "token") if small else salted_join(held, few, "token", cut(df.select("token", F.col("df").alias("n"))))
    postings = postings.crossJoin(F.broadcast(index.stats))
    weight = idf(F.col("n_docs"), F.col("df"), e, idf_kind)
    tf = F.col("cnt") / F.col("doc_len")
    if method == "tfidf":
        one = tf * weight
    else:
        one = weight * bm25_document(tf, F.col("doc_len"), F.col("avg_len"), b, k1)
        if query_tf:
            one = one * bm25_query(F.col("q_cnt") / F.col("q_len"), k2)
    return postings.groupBy("query_id", "doc_id").agg(F.sum(one * F.col("q_cnt")).alias("score"))


def one_query(spark, tokens: list[str]) -> DataFrame:
    """The terms of a single query."""
    rows = [(0, tokens)]
    return query_terms(spark.createDataFrame(rows, "query_id bigint, tokens array<string>"))


def top_documents(index: CorpusIndex, tokens: list[str], k: int = 0, method: str = "bm25", *, digits: int = 6, **how) -> DataFrame:
    """(doc_id, score): all documents by score, those without a shared term at 0, ties by doc_id; k = 0: all of them."""
    spark = index.tf.sparkSession
    found = scores(index, one_query(spark, tokens), method, **how).select("doc_id", "score")
    filled = index.docs.join(found, "doc_id", "left").select("doc_id", F.round(F.coalesce("score", F.lit(0.0)), digits).alias("score"))
    return filled.orderBy(F.desc("score"), "doc_id").limit(k) if k else filled


def _document_blocks(index: CorpusIndex, words: DataFrame, size: int) -> DataFrame:
    """Up to `size` documents a row, by id: ids and lengths of those that hold one of `words` (token, word), and their postings by word; n and total are of all of them."""
    kind = index.docs.schema["doc_id"].dataType

    def packed(table: pa.Table) -> pa.RecordBatch:
        length, sizes = (pc.fill_null(c, 0).to_numpy().astype(np.int64) for c in (table.column("doc_len"), pc.list_value_length(table.column("word"))))
        some = np.flatnonzero(sizes)
        word, cnt = (pc.list_flatten(table.column(c)).to_numpy() for c in ("word", "cnt"))
        order = np.argsort(word, kind="stable")
        words, counts = np.unique(word, return_counts=True)
        ints = length[some], words, counts, np.repeat(np.arange(len(some)), sizes[some])[order], cnt[order]
        lists = table.column("doc_id").combine_chunks().take(pa.array(some)), *(pa.array(x.astype(np.int32)) for x in ints)
        row = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
        return pa.RecordBatch.from_arrays([*row, pa.array([len(length)]), pa.array([int(length.sum())])], ["docs", "lens", "words", "counts", "at", "cnt", "n", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, size):
                kept.append(batch.slice(low, size))
                n += kept[-1].num_rows
                if n >= size:
                    yield packed(pa.Table.from_batches(kept))
                    kept, n = [], 0
        if n:
            yield packed(pa.Table.from_batches(kept))

    held = index.tf.join(words, "token").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("word").cast("int").alias("word"), F.col("cnt").cast("int").alias("cnt"))).alias("held"))
    rows = index.docs.join(held, "doc_id", "left").select("doc_id", "doc_len", F.col("held.word").alias("word"), F.col("held.cnt").alias("cnt"))
    lists = [StructField(c, ArrayType(IntegerType())) for c in ("lens", "words", "counts", "at", "cnt")]
    schema = StructType([StructField("docs", ArrayType(kind)), *lists, StructField("n", LongType()), StructField("total", LongType())])
    return rows.sortWithinPartitions("doc_id").mapInArrow(run, schema)


def _query_blocks(weighted: DataFrame, size: int) -> DataFrame:
    """Up to `size` queries a row, of (query_id, word, weight): ids, numbers of words, words and weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, size):
                ids, word, weight = (c.slice(low, size) for c in batch.columns)
                lists = ids, pc.list_value_length(word), word.flatten(), weight.flatten()
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], ["queries", "sizes", "q_words", "weights"])

    held = weighted.groupBy("query_id").agg(F.collect_list(F.struct(F.col("word").cast("int").alias("word"), "weight")).alias("held"))
    kinds = weighted.schema["query_id"].dataType, IntegerType(), IntegerType(), DoubleType()
    schema = StructType([StructField(name, ArrayType(kind)) for name, kind in zip(("queries", "sizes", "q_words", "weights"), kinds)])
    return held.select("query_id", F.col("held.word").alias("word"), F.col("held.weight").alias("weight")).mapInArrow(run, schema)


def _best(scores: np.ndarray, k: int, margin: float) -> np.ndarray:
    """Places of all scores that may be among the k best once rounded, equal ones by place: those less than `margin` below the k-th, of equal ones the first k."""
    if len(scores) <= k:
        return np.arange(len(scores))
    near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - margin)
    near = near[np.argsort(-scores[near], kind="stable")]
    new = np.append(True, np.diff(scores[near]) != 0)
    return near[np.arange(len(near)) - np.flatnonzero(new)[np.cumsum(new) - 1] < k]


def top_per_query(
    index: CorpusIndex, queries: DataFrame, k: int, method: str = "bm25", *, digits: int = 6, e: float = 0.5, b: float = 0.75, k1: float = 2.0, k2: float = 1.2, query_tf: bool = True, idf_kind: str = "smooth"
) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents with a shared term for each query, ties by doc_id.

    Documents become blocks of postings, read from the corpus once and written; every block of queries meets every block of documents, and a query's scores of
    a block are summed in one array. Only what may be among the k best of a block leaves it, so pairs of a query and a document are not shuffled.
    """
    terms = cut(query_terms(queries))
    words = cut(ranked_rows(terms.select("token").distinct(), [F.asc("token")], "word"))
    blocks = cut(_document_blocks(index, broadcast_upto(words, 1_000_000)[0], DOCUMENTS))
    n_docs, total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    avg_len, margin = total / max(1, n_docs), 1.01 * 10.0**-digits
    df = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy(F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("df"))
    weight = idf(F.lit(n_docs), F.col("df"), e, idf_kind) * F.col("q_cnt")
    if method != "tfidf" and query_tf:
        weight = weight * bm25_query(F.col("q_cnt") / F.col("q_len"), k2)
    weighted = terms.join(words.join(df, "word"), "token").select("query_id", "word", weight.alias("weight"))
    met = blocks.drop("n", "total").crossJoin(cut(_query_blocks(weighted, QUERIES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                docs, lens, words, counts, at, cnt, asked, sizes, q_words, weights = (c[row].values for c in batch.columns)
                lens, words, counts, at, cnt, sizes, q_words, weights = (x.to_numpy() for x in (lens, words, counts, at, cnt, sizes, q_words, weights))
                share = cnt / lens[at]
                value = share if method == "tfidf" else bm25_document(share, lens[at], avg_len, b, k1)
                ends = np.cumsum(counts)
                lows, highs = (ends - counts).tolist(), ends.tolist()
                place = np.searchsorted(words, q_words)
                place[np.append(words, -1)[place] != q_words] = -1
                place, weights, last = place.tolist(), weights.tolist(), np.cumsum(sizes).tolist()
                positive, scores, least = bool((value > 0).all()), np.zeros(len(docs)), {}
                whose, found, said = [], [], []
                for q, end in enumerate(last):
                    own = [(p, w) for p, w in zip(place[end - int(sizes[q]) : end], weights[end - int(sizes[q]) : end]) if p >= 0]
                    if not own:
                        continue
                    scores.fill(0)
                    bound = 0.0
                    for p, w in own:
                        low, high = lows[p], highs[p]
                        scores[at[low:high]] += w * value[low:high]
                        if high - low >= k > 0:
                            if p not in least:
                                least[p] = np.partition(value[low:high], high - low - k)[high - low - k]
                            bound = max(bound, w * least[p])
                    if positive and min(w for _, w in own) > 0:
                        # the k-th best of one word is no more than the k-th best sum
                        held = np.flatnonzero(scores >= bound - margin if bound > margin else scores > 0)
                    else:
                        held = np.unique(np.concatenate([at[lows[p] : highs[p]] for p, _ in own]))
                    best = held[_best(scores[held], k, margin)]
                    whose.append(np.full(len(best), q))
                    found.append(best)
                    said.append(scores[best])
                if whose:
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(np.concatenate(whose))), docs.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(said))], ["query_id", "doc_id", "score"])

    schema = StructType([StructField("query_id", terms.schema["query_id"].dataType), StructField("doc_id", index.docs.schema["doc_id"].dataType), StructField("score", DoubleType())])
    found = met.mapInArrow(run, schema).withColumn("score", F.round("score", digits))
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def position_weights(tokens: DataFrame, method: str = "tfidf", *, e: float = 0.5, b: float = 0.75, k1: float = 2.0, k2: float = 1.2, query_tf: bool = False) -> DataFrame:
    """(doc_id, pos, token, weight): the weight of the token at each position of each document."""
    index = CorpusIndex.of(tokens)
    words = tokens.select("doc_id", F.size("tokens").cast("long").alias("doc_len"), F.posexplode("tokens").alias("pos", "token"))
    # a document's rows are together already, so its own counts need no shuffle
    counted = words.withColumn("cnt", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "token")))
    df = cut(index.df)
    joined = salted_join(counted, df, "token", df.select("token", F.col("df").alias("n"))).crossJoin(F.broadcast(index.stats))
    tf = F.col("cnt") / F.col("doc_len")
    weight = idf(F.col("n_docs"), F.col("df"), e)
    if method == "tfidf":
        weight = tf * weight
    else:
        weight = weight * bm25_document(tf, F.col("doc_len"), F.col("avg_len"), b, k1)
        if query_tf:
            weight = weight * bm25_query(tf, k2)
    return joined.select("doc_id", "pos", "token", weight.alias("weight"))


def padded_weights(tokens: DataFrame, size: int, method: str = "tfidf", *, padding: str = "post", truncating: str = "post", value: float = 0.0, **how) -> DataFrame:
    """(doc_id, weights array<float>) of one length; counts are those of whole documents, an empty one is all `value`."""
    ragged = position_weights(tokens, method, **how).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "weight"))).alias("w"))
    values = F.transform("w", lambda x: x["weight"])
    joined = tokens.select("doc_id").join(ragged, "doc_id", "left")
    return joined.select("doc_id", pad(values, size, padding, truncating, value, "double").cast("array<float>").alias("weights"))


def ngram_features(tokens: DataFrame, low: int = 1, high: int = 2) -> DataFrame:
    """(doc_id, term, weight): word n-grams with idf ln((1 + n) / (1 + df)) + 1, scaled to length 1 per document."""
    grams = tokens.select("doc_id", F.explode(word_ngrams(F.col("tokens"), low, high)).alias("term"))
    tf = grams.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("cnt"))
    df = cut(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    n = tokens.agg(F.count(F.lit(1)).alias("n"))
    raw = salted_join(tf, df, "term", df.select("term", F.col("df").alias("n"))).crossJoin(F.broadcast(n)).withColumn("raw", F.col("cnt") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "term", (F.col("raw") / length).alias("weight"))


def keywords(tokens: DataFrame, k: int = 5, method: str = "tfidf", digits: int = 9) -> DataFrame:
    """(doc_id, token, weight, rank): the k heaviest distinct tokens of each document, ties by token."""
    best = position_weights(tokens, method).groupBy("doc_id", "token").agg(F.round(F.max("weight"), digits).alias("weight"))
    window = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "token")
    return best.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
