"""The registered queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import arrays as A
from kindred.functions import external
from kindred.functions import text as T
from kindred.functions import vectors as V
from kindred.operators import blocks, classify, corpus, embed, lsh, metrics, pairs, rank, vocab
from kindred.plans.sql import SQL
from kindred.session import parallel, table
from kindred.sources import readers
from kindred.sources.rejects import parse_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: A query of several tokens, one of them twice and one unknown.
ASKED = ["how", "the", "the", "garage", "的", "zzz"]
#: Of hashed word vectors, p-stable hashes and padded weights.
DIMENSIONS, SIZE = 8, 12


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.corpus(table(spark, folder, "corpus"))


def lowered(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).select("doc_id", T.lower_tokens(F.col("tokens")).alias("tokens"))


def rounded(column: str | F.Column, digits: int = 6):
    return F.round(column, digits)


# --- corpus


@query
def corpus_stats(spark, folder):
    return corpus.CorpusIndex.of(docs(spark, folder)).stats.select("n_docs", rounded("avg_len").alias("avg_len"))


@query
def term_freq(spark, folder):
    return corpus.CorpusIndex.of(docs(spark, folder)).tf


@query
def doc_freq(spark, folder):
    return corpus.CorpusIndex.of(docs(spark, folder)).df


@query
def vocab_index(spark, folder):
    return corpus.vocabulary(lowered(spark, folder), offset=1, oov="[UNK]")


@query
def texts_to_sequences(spark, folder):
    tokens = lowered(spark, folder)
    return vocab.texts_to_sequences(tokens, corpus.vocabulary(tokens, oov="[UNK]"), num_words=500, oov_index=1)


@query
def sequences_to_texts(spark, folder):
    tokens = lowered(spark, folder)
    known = corpus.vocabulary(tokens)
    return vocab.sequences_to_texts(vocab.texts_to_sequences(tokens, known, num_words=500), known)


@query
def distinct_tokens(spark, folder):
    return docs(spark, folder).select("doc_id", F.array_sort(F.array_distinct("tokens")).alias("tokens"))


# --- ranking


def _top(spark, folder, k, method="bm25", **how):
    return rank.top_documents(corpus.CorpusIndex.of(docs(spark, folder)), ASKED, k, method, **how)


@query
def bm25_topk(spark, folder):
    return _top(spark, folder, 50)


@query
def bm25_topk_probidf(spark, folder):
    return _top(spark, folder, 50, idf_kind="probabilistic")


@query
def bm25_no_tq(spark, folder):
    return _top(spark, folder, 50, query_tf=False)


@query
def tfidf_topk(spark, folder):
    return _top(spark, folder, 50, "tfidf")


@query
def tfidf_all_scores(spark, folder):
    return _top(spark, folder, 0, "tfidf")


@query
def bm25_queries_topk(spark, folder):
    asked = table(spark, folder, "queries").select("query_id", T.word_tokens(F.col("query_text")).alias("tokens"))
    return rank.top_per_query(corpus.CorpusIndex.of(lowered(spark, folder)), asked, 10)


@query
def tfidf_weights(spark, folder):
    return rank.position_weights(docs(spark, folder)).withColumn("weight", rounded("weight"))


@query
def bm25_weights(spark, folder):
    return rank.position_weights(docs(spark, folder), "bm25").withColumn("weight", rounded("weight"))


@query
def bm25_weights_tq(spark, folder):
    return rank.position_weights(docs(spark, folder), "bm25", query_tf=True).withColumn("weight", rounded("weight"))


def _padded(spark, folder, method):
    padded = rank.padded_weights(docs(spark, folder), SIZE, method)
    return padded.select("doc_id", F.posexplode("weights").alias("pos", "w")).select("doc_id", "pos", F.round(F.col("w").cast("double"), 5).alias("weight"))


@query
def tfidf_weights_padded(spark, folder):
    return _padded(spark, folder, "tfidf")


@query
def bm25_weights_padded(spark, folder):
    return _padded(spark, folder, "bm25")


@query
def sk_tfidf_ngrams(spark, folder):
    return rank.ngram_features(lowered(spark, folder)).withColumn("weight", rounded("weight"))


@query
def keywords_per_doc(spark, folder):
    return rank.keywords(docs(spark, folder)).withColumn("weight", rounded("weight"))


# --- texts


@query
def word_tokens(spark, folder):
    return table(spark, folder, "pairs").select("pair_id", F.posexplode(T.word_tokens(F.col("text_a"))).alias("pos", "token"))


@query
def char_tokens(spark, folder):
    return table(spark, folder, "queries").select("query_id", F.posexplode(T.characters(F.col("query_text"))).alias("pos", "token"))


@query
def clean_str(spark, folder):
    return table(spark, folder, "pairs").select("pair_id", T.clean_english(F.col("text_a")).alias("cleaned"))


@query
def char_ngrams(spark, folder):
    grams = F.explode(T.char_ngrams(F.col("query_text"), 1, 4, strip_blanks=True)).alias("gram")
    return table(spark, folder, "queries").select("query_id", grams).groupBy("query_id", "gram").agg(F.count(F.lit(1)).alias("cnt"))


@query
def bert_basic_tokens(spark, folder):
    return table(spark, folder, "pairs").select("pair_id", F.posexplode(T.basic_tokens(F.col("text_a"))).alias("pos", "token"))


@query
def char_classes(spark, folder):
    chars = table(spark, folder, "queries").select(F.explode(T.characters(F.col("query_text"))).alias("c")).distinct()
    c = F.col("c")
    return chars.select("c", T.is_space(c).alias("space"), T.is_punctuation(c).alias("punctuation"), T.is_cjk(c).alias("cjk"), T.is_control(c).alias("control"))


@query
def lower_no_accents(spark, folder):
    return table(spark, folder, "pairs").select("pair_id", T.lower_without_accents(F.col("text_a")).alias("plain"))


@query
def levenshtein_pairs(spark, folder):
    part = table(spark, folder, "part").select("p_brand", "p_type").distinct()
    return part.select("p_brand", "p_type", T.levenshtein(F.col("p_brand"), F.col("p_type")).alias("distance"))


@query
def word_piece_tokens(spark, folder):
    """Every word by the vocabulary of the words that three documents hold, their beginnings of three letters and all single characters."""
    words = lowered(spark, folder).select(F.explode("tokens").alias("word")).where("word <> ''")
    known = corpus.CorpusIndex.of(lowered(spark, folder)).df.where("df >= 3 AND token <> ''")
    chars = words.select(F.explode(T.characters(F.col("word"))).alias("c")).distinct().select(F.explode(F.array("c", F.concat(F.lit("##"), "c"))).alias("piece"))
    starts = known.select(F.explode(F.array("token", F.concat(F.lit("##"), F.substring("token", 1, 3)))).alias("piece"))
    return vocab.word_pieces(words, starts.unionAll(chars)).select("word", F.array_join("pieces", " ").alias("pieces"))


@query
def random_ngram_segments(spark, folder):
    lines = table(spark, folder, "queries")
    cuts = vocab.random_segments(lines, "query_id", "query_text", vocab.ngram_counts(lines, "query_text", 3, 4))
    return cuts.select(F.col("id").alias("query_id"), F.array_join("tokens", "|").alias("tokens"))


@query
def sentence_piece_ids(spark, folder):
    return external.sentence_pieces(table(spark, folder, "pairs").select("pair_id", "text_a"), "text_a").drop("text_a")


@query
def segmented_texts(spark, folder):
    return external.segmented(table(spark, folder, "pairs").select("pair_id", "text_a"), "text_a").drop("text_a")


@query
def decoded_pieces(spark, folder):
    tokens = F.transform(T.basic_tokens(F.col("text_a")), lambda t: F.when(F.length(t) > 6, F.concat(F.substring(t, F.lit(1), F.lit(4)), F.lit(" ##"), F.substring(t, F.lit(5), F.length(t)))).otherwise(t))
    return table(spark, folder, "pairs").select("pair_id", T.decode_pieces(F.split(F.array_join(tokens, " "), " ")).alias("decoded"))


# --- arrays


def _coded(spark, folder):
    tokens = lowered(spark, folder)
    return vocab.texts_to_sequences(tokens, corpus.vocabulary(tokens, oov="[UNK]"))


@query
def pad_truncate(spark, folder):
    seqs = _coded(spark, folder)
    out = None
    for padding in ("pre", "post"):
        for truncating in ("pre", "post"):
            part = seqs.select("doc_id", F.lit(f"{padding}-{truncating}").alias("mode"), F.array_join(A.pad(F.col("seq"), SIZE, padding, truncating).cast("array<string>"), " ").alias("ids"))
            out = part if out is None else out.unionAll(part)
    return out


def _split_pairs(spark, folder):
    """(pair_id, a, b): the words of both texts, as columns of their own, so that they are split once."""
    rows = table(spark, folder, "pairs").where("text_a IS NOT NULL AND text_b IS NOT NULL")
    return rows.select("pair_id", T.word_tokens(F.col("text_a")).alias("a"), T.word_tokens(F.col("text_b")).alias("b"))


@query
def encode_text_pairs(spark, folder):
    rows = _split_pairs(spark, folder)
    tokens, segs = pairs.encode_pairs(F.col("a"), F.col("b"), 20)
    return rows.select("pair_id", F.array_join(tokens, " ").alias("tokens"), pairs.ids_text(segs).alias("segments"))


@query
def bert_pair_ids(spark, folder):
    """Jointly encoded pairs as ids of a frequency vocabulary whose first entries are the markers."""
    rows = _split_pairs(spark, folder)
    known = vocab.frequency_map(rows.select(F.array_join("a", " ").alias("a"), F.array_join("b", " ").alias("b")), ["a", "b"], min_freq=2)
    known = known.select("token", (F.col("idx").cast("int") + 4).alias("idx"))
    known = known.unionAll(spark.createDataFrame([("[UNK]", 1), ("[CLS]", 2), ("[SEP]", 3)], "token string, idx int"))
    tokens, segs = pairs.encode_pairs(F.col("a"), F.col("b"), 20)
    coded = rows.select(F.col("pair_id").alias("doc_id"), tokens.alias("tokens"))
    ids = vocab.tokens_to_ids(coded, known, 1).select("doc_id", pairs.ids_text(pairs.padded_ids(F.col("seq"), 20)).alias("ids"))
    other = rows.select(F.col("pair_id").alias("doc_id"), pairs.ids_text(pairs.padded_ids(segs, 20)).alias("segments"))
    return ids.join(other, "doc_id").withColumnRenamed("doc_id", "pair_id")


@query
def id_lines_read_back(spark, folder):
    rows = table(spark, folder, "pairs").where("source = 'anon_ids' AND text_a RLIKE '^[0-9]{1,9}( [0-9]{1,9})*$'")
    return rows.select("pair_id", F.posexplode(pairs.ids_from_text(F.col("text_a"))).alias("pos", "id"))


@query
def cipher_decode(spark, folder):
    """Ids as characters: each distinct id, by first appearance, is one code point of a block."""
    rows = table(spark, folder, "pairs").where("source = 'anon_ids' AND text_a RLIKE '^[0-9]{1,9}( [0-9]{1,9})*$'")
    tokens = rows.select(F.col("pair_id").alias("doc_id"), F.split("text_a", " ").alias("tokens"))
    return vocab.decode_cipher(tokens, vocab.cipher_vocabulary(tokens))


@query
def vocab_load(spark, folder):
    lines = table(spark, folder, "tokenizer_state").select(F.col("token").alias("value"), (F.col("shard_id").cast("bigint") * 1_000_000 + F.col("idx")).alias("line_no"))
    return vocab.load_vocabulary(lines.where("value IS NOT NULL AND line_no IS NOT NULL"))


@query
def ngram_char_ids(spark, folder):
    grams = vocab.ngram_counts(table(spark, folder, "pairs"), "text_a")
    chars = grams.select("ngram", F.posexplode(T.characters(F.col("ngram"))).alias("pos", "token"))
    known = corpus.ranked_rows(chars.select("token").distinct(), [F.asc("token")], "idx")
    return chars.join(known, "token").select("ngram", "pos", "idx")


@query
def unknown_query_tokens(spark, folder):
    asked = table(spark, folder, "queries").select("query_id", F.explode(T.word_tokens(F.col("query_text"))).alias("token")).distinct()
    return asked.join(corpus.CorpusIndex.of(lowered(spark, folder)).df, "token", "left_anti").select("query_id", "token")


@query
def log_buckets(spark, folder):
    offset = F.col("query_id") - 50
    return table(spark, folder, "queries").select("query_id", A.log_bucket(offset, 16, 64).alias("bucket"))


@query
def truncate_pairs(spark, folder):
    a, b = A.truncate_together(12, -1, F.col("a"), F.col("b"))
    return _split_pairs(spark, folder).select("pair_id", F.size(a).alias("n_a"), F.size(b).alias("n_b"))


@query
def sliding_batches(spark, folder):
    rows = table(spark, folder, "queries").select("query_id")
    return pairs.batches(rows, [F.asc("query_id")], 8, stride=1).groupBy("batch_id").agg(F.min("query_id").alias("first"), F.max("query_id").alias("last"), F.count(F.lit(1)).alias("n"))


@query
def even_batches(spark, folder):
    rows = table(spark, folder, "pairs").select("pair_id")
    return pairs.batches(rows, [F.asc("pair_id")], 64).groupBy("batch_id").agg(F.min("pair_id").alias("first"), F.count(F.lit(1)).alias("n"))


@query
def k_max_pool(spark, folder):
    values = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, folder, "embeddings").select("vec_id", F.posexplode(A.top_k(values, 4)).alias("pos", "x")).withColumn("x", rounded("x"))


@query
def text_pair_to_ids(spark, folder):
    rows = table(spark, folder, "pairs").where("text_a IS NOT NULL AND text_b IS NOT NULL")
    words = rows.select("pair_id", "labels", T.word_tokens(F.col("text_a")).alias("a"), T.word_tokens(F.col("text_b")).alias("b"))
    both = words.select((F.col("pair_id") * 2).alias("doc_id"), F.col("a").alias("tokens")).unionAll(words.select(F.col("pair_id") * 2 + 1, "b"))
    seqs = vocab.texts_to_sequences(both, corpus.vocabulary(both, oov="[UNK]"))
    ids = seqs.select("doc_id", pairs.ids_text(pairs.padded_ids(F.col("seq"), 16)).alias("ids"))
    a = ids.where("doc_id % 2 = 0").select((F.col("doc_id") / 2).cast("bigint").alias("pair_id"), F.col("ids").alias("a_ids"))
    b = ids.where("doc_id % 2 = 1").select(((F.col("doc_id") - 1) / 2).cast("bigint").alias("pair_id"), F.col("ids").alias("b_ids"))
    line = pairs.id_line(F.col("a_ids"), F.col("b_ids"), F.coalesce(F.col("labels"), F.lit(0)).cast("string"))
    return a.join(b, "pair_id").join(words.select("pair_id", "labels"), "pair_id").select("pair_id", line.alias("line"))


# --- vectors


def vectors(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")


def asked_vectors(spark, folder):
    """Every vector whose id is divisible by 20, against all."""
    return vectors(spark, folder).where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "vec")


def _distances(spark, folder, **columns):
    met = blocks.measured(vectors(spark, folder).select("item_id", "vec"), asked_vectors(spark, folder), columns)
    return met.select("query_id", "item_id", *(rounded(name).alias(name) for name in columns))


@query
def euclidean_pairs(spark, folder):
    return _distances(spark, folder, euclidean=blocks.euclidean)


@query
def cosine_pairs(spark, folder):
    return _distances(spark, folder, cosine=blocks.cosine, distance=blocks.cosine_distance)


@query
def manhattan_pairs(spark, folder):
    return _distances(spark, folder, manhattan=blocks.manhattan)


@query
def minkowski_pairs(spark, folder):
    return _distances(spark, folder, minkowski=blocks.minkowski(4))


@query
def hamming_pairs(spark, folder):
    return _distances(spark, folder, hamming=blocks.hamming).withColumn("hamming", F.col("hamming").cast("int"))


@query
def jaccard_pairs(spark, folder):
    return _distances(spark, folder, jaccard=blocks.jaccard(0.1))


@query
def pearson_pairs(spark, folder):
    return _distances(spark, folder, pearson=blocks.pearson)


@query
def kl_pairs(spark, folder):
    return _distances(spark, folder, kl=blocks.kl_of_softmax)


@query
def cosine_floored_pairs(spark, folder):
    return _distances(spark, folder, cosine=blocks.cosine_floored())


@query
def mahalanobis_dims(spark, folder):
    """Of each vector and the next, all distances of two dimensions, as their number and sum."""
    v = vectors(spark, folder)
    a, b = v.select(F.col("item_id"), F.col("vec").alias("a")), v.select((F.col("item_id") - 1).alias("item_id"), F.col("vec").alias("b"))
    joined = a.join(b, "item_id").select("item_id", V.mahalanobis_pairs(F.col("a"), F.col("b")).alias("d"))
    return joined.select("item_id", F.size("d").cast("bigint").alias("n"), F.round(V.total(F.transform("d", lambda x: x["distance"])), 4).alias("total"))


@query
def knn_cosine(spark, folder):
    return embed.nearest(vectors(spark, folder), asked_vectors(spark, folder), 10)


@query
def l2_normalised(spark, folder):
    return vectors(spark, folder).select("item_id", F.posexplode(V.l2_normalised(F.col("vec"))).alias("dim", "x")).withColumn("x", rounded("x"))


def _token_matrices(spark, folder):
    """Each embedding as 8 token vectors of 8 dimensions."""
    return vectors(spark, folder).select("item_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("vec", k * 8 + 1, F.lit(8))).alias("m"))


def _late(spark, folder, metric):
    """Each embedding as 8 token vectors of 8 dimensions."""
    return _distances(spark, folder, score=blocks.max_sim(8, metric))


@query
def maxsim_cosine(spark, folder):
    return _late(spark, folder, "cosine")


@query
def maxsim_l2(spark, folder):
    return _late(spark, folder, "l2")


@query
def attention_pool(spark, folder):
    m = _token_matrices(spark, folder)
    pooled = V.attention_pool(F.element_at("m", 1), F.col("m"), F.col("m"))
    return m.select("item_id", F.posexplode(pooled).alias("dim", "x")).withColumn("x", rounded("x"))


@query
def mean_pool_by_label(spark, folder):
    rows = vectors(spark, folder).select("label", F.posexplode("vec").alias("dim", "x"))
    return rows.groupBy("label", "dim").agg(F.round(F.avg("x"), 6).alias("x"))


# --- hashing


def shingled(spark, folder):
    """(item_id, features): runs of five words of each whole document."""
    words = T.word_tokens(F.col("text"))
    grams = F.array_distinct(T.word_ngrams(words, 5, 5))
    return parallel(table(spark, folder, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("item_id"), F.transform(F.coalesce(grams, F.array().cast("array<string>")), lambda g: lsh.feature_number(g)).alias("features"))


@query
def minhash_signatures(spark, folder):
    return lsh.signatures(shingled(spark, folder), 10).select("item_id", F.posexplode("sig").alias("p", "h"))


@query
def minhash_bands(spark, folder):
    return lsh.bands(lsh.signatures(shingled(spark, folder), 20), 4, 5)


@query
def minhash_search(spark, folder):
    return lsh.minhash_matches(shingled(spark, folder), "item_id % 20 = 0", 20, 5)


@query
def near_duplicate_docs(spark, folder):
    """Over runs of five tokens, a Chinese character being one, so that texts without blanks and short ones have features too."""
    rows = parallel(table(spark, folder, "documents").where("doc_id IS NOT NULL").select("doc_id", "text"))
    return lsh.near_duplicates(lsh.token_shingles(rows, "doc_id", "text")).links()


@query
def e2lsh_hashes(spark, folder):
    return lsh.stable_fingerprints(vectors(spark, folder), lsh.stable_family(3, 4, 64), lsh.fingerprint_factors(4))


@query
def e2lsh_search(spark, folder):
    index = e2lsh_hashes(spark, folder)
    return lsh.stable_matches(index, index.where("item_id % 20 = 0"))


@query
def e2lsh_search_per_round(spark, folder):
    index = e2lsh_hashes(spark, folder)
    return lsh.stable_matches(index, index.where("item_id % 20 = 0"), per_round=True)


@query
def e2lsh_nearest(spark, folder):
    """The ten nearest by an index whose recall against `knn_cosine` is at least 0.9."""
    return lsh.stable_nearest(vectors(spark, folder), asked_vectors(spark, folder), 10)


# --- embeddings of documents


def word_vectors(tokens: DataFrame) -> DataFrame:
    """(token, vec): a vector for every word, from its md5."""
    digest = F.md5("token")
    values = F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda d: (F.conv(F.substring(digest, d * 4 + 1, F.lit(4)), 16, 10).cast("double") - 32768) / 32768)
    return tokens.select(F.explode("tokens").alias("token")).distinct().select("token", values.alias("vec"))


@query
def sif_weights(spark, folder):
    words = docs(spark, folder).select(F.explode("tokens").alias("token"))
    return embed.sif_weights(embed.word_probabilities(words)).withColumn("weight", rounded("weight"))


@query
def usif_weights(spark, folder):
    words = docs(spark, folder).select(F.explode("tokens").alias("token"))
    return embed.usif_weights(embed.word_probabilities(words), 12).withColumn("weight", rounded("weight"))


def _sif_pooled(spark, folder):
    tokens = docs(spark, folder)
    weights = embed.sif_weights(embed.word_probabilities(tokens.select(F.explode("tokens").alias("token"))))
    return embed.pooled(tokens, word_vectors(tokens), weights)


@query
def sif_pooled(spark, folder):
    return _sif_pooled(spark, folder).select("doc_id", F.posexplode("vec").alias("dim", "x")).withColumn("x", rounded("x"))


@query
def sif_projected(spark, folder):
    """With one given direction: all dimensions alike."""
    import numpy as np

    out = embed.without_components(_sif_pooled(spark, folder), np.full((1, DIMENSIONS), DIMENSIONS**-0.5))
    return out.select("doc_id", F.posexplode("vec").alias("dim", "x")).withColumn("x", rounded("x"))


@query
def sif_embeddings(spark, folder):
    tokens = docs(spark, folder)
    return embed.sif(tokens, word_vectors(tokens), 2)


@query
def usif_embeddings(spark, folder):
    tokens = docs(spark, folder)
    return embed.usif(tokens, word_vectors(tokens), 12, 3)


# --- vocabulary mining


@query
def ngram_counts(spark, folder):
    return vocab.ngram_counts(table(spark, folder, "pairs"), "text_a")


@query
def ngram_pruned(spark, folder):
    return vocab.pruned_ngrams(vocab.ngram_counts(table(spark, folder, "pairs"), "text_a"))


@query
def idmap(spark, folder):
    return vocab.frequency_map(table(spark, folder, "pairs"), ["text_a", "text_b"])


@query
def oov_map(spark, folder):
    rows = table(spark, folder, "pairs")
    return vocab.map_rare_words(rows, vocab.frequency_map(rows, ["text_a", "text_b"]), "pair_id", ("text_a", "text_b"))


@query
def similar_words(spark, folder):
    """For each word of the queries the most similar other ones of its length, by hashed vectors."""
    return vocab.similar_words(_like_words(spark, folder))


def _like_words(spark, folder):
    words = table(spark, folder, "queries").select("query_id", T.word_tokens(F.col("query_text")).alias("tokens"))
    known = corpus.ranked_rows(word_vectors(words), [F.asc("token")], "item_id").withColumn("len", F.length("token"))
    met = embed.nearest(known, known.select(F.col("item_id").alias("query_id"), "vec", "len"), 15, group="len", above=0.68)
    a, b = known.select(F.col("item_id").alias("query_id"), F.col("token").alias("word")), known.select("item_id", F.col("token").alias("other"))
    return met.join(a, "query_id").join(b, "item_id").select("word", "other", F.col("cosine").alias("similarity"))


@query
def stopword_filter(spark, folder):
    words = spark.createDataFrame([(w,) for w in ("the", "a", "to", "how", "的", "我")], "word string")
    tokens = docs(spark, folder).select("doc_id", F.posexplode("tokens").alias("pos", "token"))
    return tokens.join(F.broadcast(words), F.lower("token") == F.col("word"), "left_anti")


# --- pairs and their graph


@query
def pair_lines(spark, folder):
    stripped = F.regexp_replace("line_text", r"^\s+|\s+$", "").alias("value")
    return readers.pair_lines(table(spark, folder, "raw_records").select(stripped).where("value <> ''"))


@query
def json_pairs(spark, folder):
    return readers.to_json_pairs(table(spark, folder, "pairs"))


@query
def sentence_ids(spark, folder):
    return pairs.sentences(table(spark, folder, "pairs"))


@query
def sentence_edges(spark, folder):
    return pairs.edges(table(spark, folder, "pairs"))


@query
def sentence_components(spark, folder):
    return pairs.sentence_components(table(spark, folder, "pairs"))


@query
def component_violations(spark, folder):
    rows = table(spark, folder, "pairs")
    met = pairs.pair_components(rows, pairs.sentence_components(rows))
    return met.where("comp_a <> comp_b").groupBy("labels").agg(F.count(F.lit(1)).alias("n"))


@query
def kfold_by_component(spark, folder):
    return pairs.component_folds(table(spark, folder, "pairs"))


@query
def kfold_stratified(spark, folder):
    return pairs.stratified_folds(table(spark, folder, "pairs"), "pair_id", "labels")


@query
def symmetric_pairs(spark, folder):
    return pairs.symmetric(table(spark, folder, "pairs").select("pair_id", "text_a", "text_b"))


@query
def repeated_pairs(spark, folder):
    return pairs.repeated(table(spark, folder, "pairs").select("pair_id"))


@query
def unlabelled_filter(spark, folder):
    return table(spark, folder, "pairs").where(F.col("labels") != pairs.UNLABELLED).groupBy("labels").agg(F.count(F.lit(1)).alias("n"))


@query
def shuffled_order(spark, folder):
    rows = table(spark, folder, "queries").select("query_id")
    return corpus.ranked_rows(rows.withColumn("h", F.md5(F.concat(F.lit("1:"), F.col("query_id").cast("string")))), [F.asc("h"), F.asc("query_id")], "rank").select("query_id", "rank")


@query
def tokenizer_lines(spark, folder):
    return table(spark, folder, "pairs").select("pair_id", F.posexplode(F.array("text_a", "text_b")).alias("pos", "line"))


# --- losses and metrics


def _scored(spark, folder):
    """Cosines of the query vectors with all others, and whether the labels agree."""
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), "label")
    met = _distances(spark, folder, score=blocks.cosine).join(labels, "item_id")
    met = met.join(labels.toDF("query_id", "asked"), "query_id")
    return met.select("query_id", "item_id", (F.col("asked") == F.col("label")).cast("int").alias("same"), "score")


@query
def contrastive_loss(spark, folder):
    return _scored(spark, folder).agg(F.round(metrics.contrastive_loss(F.col("same"), F.col("score"), 0.2), 4).alias("loss"))


@query
def siamese_bce(spark, folder):
    s = F.col("score")
    return _scored(spark, folder).agg(F.round(metrics.siamese_loss(F.col("same"), s), 6).alias("loss"), F.round(metrics.share_above(s, 0.1), 6).alias("share"))


@query
def cross_entropy_accuracy(spark, folder):
    s = F.col("score")
    logits, p = F.array(F.lit(0.0), s * 4), V.softmax(F.array(F.lit(0.0), s * 4))
    return _scored(spark, folder).agg(
        F.round(metrics.cross_entropy(F.col("same"), p), 6).alias("loss"),
        F.round(metrics.logits_cross_entropy(F.col("same"), logits), 6).alias("logits_loss"),
        F.round(metrics.double_softmax_cross_entropy(F.col("same"), logits), 6).alias("double_loss"),
        F.round(metrics.accuracy(F.col("same"), p), 6).alias("accuracy"),
    )


@query
def simcse_loss(spark, folder):
    v = vectors(spark, folder).withColumn("batch", F.floor(F.col("item_id") / 16)).withColumn("pair", F.floor(F.col("item_id") / 2))
    return metrics.simcse_loss(v, "batch", "item_id", "pair", "vec").select("batch", F.round("loss", 6).alias("loss"))


@query
def auc(spark, folder):
    return metrics.roc_auc(_scored(spark, folder), "same", "score").select(F.round("auc", 6).alias("auc"))


@query
def lr_schedule(spark, folder):
    rows = table(spark, folder, "queries").select(F.col("query_id").alias("step"))
    return rows.select("step", F.round(metrics.piecewise_linear(F.col("step"), [(40, 1.0), (80, 0.1)]), 6).alias("rate"))


@query
def running_avg(spark, folder):
    # decimal sums are exact in any order
    rows = table(spark, folder, "events").select("event_id", F.col("value").cast("decimal(18,4)").alias("value"))
    return metrics.running_average(rows, [F.asc("event_id")], "value").select("event_id", "average")


# --- lexical classifiers


@query
def lexical_classifier_features(spark, folder):
    return classify.lexical_features(table(spark, folder, "pairs").where("labels IN (0, 1)"), "pair_id", digits=6)


@query
def lexical_bm25_features(spark, folder):
    return classify.lexical_features(table(spark, folder, "pairs").where("labels IN (0, 1)"), "pair_id", method="bm25", digits=6)


@query
def lexical_classifier_auc(spark, folder):
    return classify.cross_validated(table(spark, folder, "pairs"), "pair_id")


@query
def neural_pair_scores(spark, folder):
    from kindred.operators.neural import siamese_scores

    return siamese_scores(table(spark, folder, "pairs"), "pair_id")


# --- lines that fail to parse


@query
def p5_found(spark, folder):
    parsed = parse_lines(table(spark, folder, "raw_records"), table(spark, folder, "raw_files"))
    return parsed.where(F.col("reason").isNotNull()).select("line_id", "reason")


@query
def p5_rows(spark, folder):
    parsed = parse_lines(table(spark, folder, "raw_records"), table(spark, folder, "raw_files"))
    return parsed.where(F.col("reason").isNull()).drop("reason")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: SQL[name] for name in QUERIES if name in SQL}
