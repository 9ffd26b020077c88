"""Queries of files written and read again, of tokenizer hooks, of encoding jobs and of the layers of encoders, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import arrays as A
from kindred.functions import text as T
from kindred.operators import classify, corpus, embed, encode, metrics, neural, vocab
from kindred.plans.sql import ENCODED, LOWER_BASE, MATRICES, SCORED, SQL, VECTORS, VOCAB, basic_sql, filters_sql
from kindred.session import scratch, table
from kindred.sources import readers

QUERIES: dict = {}
MORE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            MORE[f.__name__] = sql
        return f

    return register


def _docs(spark, folder):
    return corpus.corpus(table(spark, folder, "corpus"))


def _lowered(spark, folder):
    return _docs(spark, folder).select("doc_id", T.lower_tokens(F.col("tokens")).alias("tokens"))


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


# --- files


def _token_files(spark, folder) -> list[str]:
    """The corpus in two folders of files, one document a line, in the order of ids."""
    lines = _docs(spark, folder).select("doc_id", F.array_join("tokens", " ").alias("value"))
    paths = [scratch(spark), scratch(spark)]
    for k, path in enumerate(paths):
        readers.write_lines(lines.where(F.col("doc_id") % 2 == k).orderBy("doc_id").select("value"), path)
    return paths


LINES = f"""{LOWER_BASE.replace("lower(t)", "t")}, lines AS (SELECT doc_id, doc_id % 2 AS half, regexp_replace(array_to_string(tokens, ' '), '^\\s+|\\s+$', '', 'g') AS line FROM docs),
placed AS (SELECT line, row_number() OVER (ORDER BY half, doc_id) - 1 AS doc_id FROM lines WHERE line <> '')"""


@query(f"{LINES} SELECT doc_id, line FROM placed")
def token_files_read(spark, folder):
    read = readers.token_lines(spark, _token_files(spark, folder), " ")
    return read.select("doc_id", F.array_join("tokens", " ").alias("line"))


@query(f"{LINES} SELECT count(*) AS n_docs, round(avg(len(string_split(line, ' '))), 6) AS avg_len FROM placed")
def token_files_stats(spark, folder):
    index = corpus.CorpusIndex.of(readers.token_lines(spark, _token_files(spark, folder), " "))
    return index.stats.select("n_docs", F.round("avg_len", 6).alias("avg_len"))


@query("SELECT query_id AS doc_id, token, count(*) AS cnt FROM (SELECT query_id, unnest(string_split(query_text, ' ')) AS token FROM queries) GROUP BY ALL")
def text_corpus_freq(spark, folder):
    """A corpus of texts, split at blanks; empty tokens count."""
    texts = table(spark, folder, "queries").where("query_text IS NOT NULL").select(F.col("query_id").alias("doc_id"), T.split_literal(F.col("query_text"), " ").alias("tokens"))
    return corpus.CorpusIndex.of(texts).tf.select("doc_id", "token", "cnt")


CLEAN = "(text_a IS NULL OR NOT regexp_matches(text_a, '[\\t\\n\\r]')) AND (text_b IS NULL OR NOT regexp_matches(text_b, '[\\t\\n\\r]'))"


@query(f"SELECT coalesce(nullif(text_a, ''), '0') AS text_a, coalesce(nullif(text_b, ''), '0') AS text_b, coalesce(labels::VARCHAR, '0') AS label FROM pairs WHERE {CLEAN}")
def tsv_pairs_read(spark, folder):
    rows = table(spark, folder, "pairs").where("(text_a IS NULL OR NOT text_a RLIKE '[\\t\\n\\r]') AND (text_b IS NULL OR NOT text_b RLIKE '[\\t\\n\\r]')")
    line = F.concat(F.coalesce("text_a", F.lit("")), F.lit("\t"), F.coalesce("text_b", F.lit("")), F.lit("\t"), F.coalesce(F.col("labels").cast("string"), F.lit("")))
    path = scratch(spark)
    readers.write_lines(rows.select(line.alias("value")), path)
    return readers.tsv_pairs(spark, path)


@query(SQL["pair_lines"].replace("len(f) >= 2", "len(f) = 3"))
def pair_lines_strict(spark, folder):
    stripped = F.regexp_replace("line_text", r"^\s+|\s+$", "").alias("value")
    return readers.pair_lines(table(spark, folder, "raw_records").select(stripped).where("value <> ''"), strict=True)


@query(SQL["json_pairs"])
def json_pairs_read(spark, folder):
    path = scratch(spark)
    readers.to_json_pairs(table(spark, folder, "pairs")).write.json(path)
    return readers.read_json_pairs(spark, path)


@query(f"SELECT DISTINCT unnest({filters_sql('query_text')}) AS word FROM queries")
def stop_words_read(spark, folder):
    words = table(spark, folder, "queries").select(F.explode(T.word_tokens(F.col("query_text"))).alias("word"))
    paths = [scratch(spark), scratch(spark)]
    for path, own in zip(paths, (words.select(F.concat(F.lit("  "), "word")), words.select(F.concat("word", F.lit(" "))))):
        readers.write_lines(own, path)
    return readers.stop_words(spark, paths)


@query(f"{LOWER_BASE}, {VOCAB.format(0)} SELECT token, (row_number() OVER (ORDER BY idx) - 1)::INTEGER AS idx FROM vocab WHERE trim(token) <> ''")
def vocab_file_read(spark, folder):
    path = scratch(spark)
    readers.save_vocabulary(corpus.vocabulary(_lowered(spark, folder), offset=0), path)
    lines = readers.numbered_lines(spark, path)
    return vocab.load_vocabulary(lines.select("value", F.col("position").alias("line_no")))


@query(f"{LOWER_BASE}, {VOCAB.format(1)} SELECT token, idx, cnt, df, (SELECT count(*) FROM docs) AS n_docs FROM vocab UNION ALL SELECT '[UNK]', 1, 0, 0, (SELECT count(*) FROM docs)")
def tokenizer_state_read(spark, folder):
    tokens, path = _lowered(spark, folder), scratch(spark)
    readers.save_tokenizer(corpus.vocabulary(tokens, oov="[UNK]"), {"n_docs": tokens.count()}, path)
    known, config = readers.load_tokenizer(spark, path)
    return known.withColumn("n_docs", F.lit(config["n_docs"]).cast("long"))


@query(SQL["lr_schedule"])
def predictions_read(spark, folder):
    rows = table(spark, folder, "queries").select(F.col("query_id").alias("step"), F.round(metrics.piecewise_linear(F.col("query_id"), [(40, 1.0), (80, 0.1)]), 6).alias("rate"))
    path = scratch(spark)
    readers.write_predictions(rows, path)
    return spark.read.csv(path, schema="step bigint, rate double")


@query("SELECT * FROM (VALUES ('length', '40'), ('rate', '0.5')) t(name, value)")
def run_config_read(spark, folder):
    path = scratch(spark)
    for config in ({"length": 20}, {"length": 40, "rate": 0.5}):
        readers.save_run_config(spark, path, "run", config)
    found = readers.run_config(spark, path, "run")
    return spark.createDataFrame([(k, str(v)) for k, v in found.items()], "name string, value string")


# --- tokenizer hooks and predicates

BASIC = basic_sql("text_a")


@query(f"""WITH w AS (SELECT DISTINCT unnest({BASIC}) AS w FROM pairs), t AS (SELECT w AS token FROM w UNION SELECT '##' || w FROM w UNION SELECT '[' || w || ']' FROM w UNION SELECT w || '中' FROM w),
s AS (SELECT token, token LIKE '[%' AND token LIKE '%]' AS special, regexp_replace(token, '^##', '') AS stem FROM t)
SELECT token, special, stem, length(stem) > 1 AND NOT special AND regexp_matches(stem, '[{T.CJK_CLASS}{T.PUNCTUATION_CLASS}]') AS redundant FROM s""")
def token_predicates(spark, folder):
    words = table(spark, folder, "pairs").select(F.explode(T.basic_tokens(F.col("text_a"))).alias("w")).distinct()
    forms = F.explode(F.array("w", F.concat(F.lit("##"), "w"), F.concat(F.lit("["), "w", F.lit("]")), F.concat("w", F.lit("中")))).alias("token")
    t = F.col("token")
    return words.select(forms).distinct().select("token", T.is_special(t).alias("special"), T.stem(t).alias("stem"), T.is_redundant(t).alias("redundant"))


@query(f"SELECT c, count(*) AS n FROM (SELECT unnest(string_split(text_a, '')) AS c FROM pairs) WHERE c <> '' AND contains('{T.CJK_PUNCTUATION}', c) GROUP BY c")
def cjk_marks(spark, folder):
    chars = table(spark, folder, "pairs").select(F.explode(T.characters(F.col("text_a"))).alias("c"))
    return chars.where(F.col("c").isin(*T.CJK_PUNCTUATION)).groupBy("c").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT pair_id, array_to_string(list_transform({BASIC}, lambda t: CASE t WHEN 'the' THEN '[THE]' WHEN '我' THEN '[ME]' WHEN '?' THEN '[Q]' ELSE t END), ' ') AS tokens FROM pairs")
def translated_tokens(spark, folder):
    names = {"the": "[THE]", "我": "[ME]", "?": "[Q]"}
    return table(spark, folder, "pairs").select("pair_id", F.array_join(T.translated(T.basic_tokens(F.col("text_a")), names), " ").alias("tokens"))


@query(f"""WITH p AS (SELECT pair_id, unnest(range(len(w))) AS k, unnest(w) AS w FROM (SELECT pair_id, string_split(text_a, ' ') AS w FROM pairs WHERE text_a IS NOT NULL)),
s AS (SELECT pair_id, k, CASE WHEN w = 'user''s' THEN [w] ELSE {basic_sql('w')} END AS t FROM p) SELECT pair_id, array_to_string(flatten(list(t ORDER BY k)), ' ') AS tokens FROM s GROUP BY pair_id UNION ALL SELECT pair_id, NULL FROM pairs WHERE text_a IS NULL""")
def pretokenized_texts(spark, folder):
    tokens = T.basic_tokens(F.col("text_a"), lambda t: T.split_literal(t, " "), ["user's"])
    return table(spark, folder, "pairs").select("pair_id", F.array_join(tokens, " ").alias("tokens"))


@query(f"""{LOWER_BASE}, {VOCAB.format(1)}, seqs AS (SELECT d.doc_id, coalesce(s.seq, []) AS seq FROM docs d LEFT JOIN (SELECT doc_id, list(idx ORDER BY pos) AS seq FROM words JOIN vocab USING (token) GROUP BY doc_id) s USING (doc_id))
SELECT doc_id, array_to_string(list_concat(seq, list_transform(range(greatest(30 - len(seq), 0)), lambda x: 0)), ' ') AS ids FROM seqs""")
def inference_padding(spark, folder):
    tokens = _lowered(spark, folder)
    seqs = vocab.texts_to_sequences(tokens, corpus.vocabulary(tokens, oov="[UNK]"))
    return seqs.select("doc_id", F.array_join(A.pad_right(F.col("seq"), 30).cast("array<string>"), " ").alias("ids"))


# --- encoding jobs


def _known(spark, folder) -> DataFrame:
    """A vocabulary by frequency behind four markers, of words that two texts hold."""
    rows = table(spark, folder, "pairs").where("text_a IS NOT NULL AND text_b IS NOT NULL")
    words = rows.select(*(F.array_join(T.word_tokens(F.col(c)), " ").alias(c) for c in ("text_a", "text_b")))
    known = vocab.frequency_map(words, ["text_a", "text_b"], min_freq=2).select("token", (F.col("idx").cast("int") + 4).alias("idx"))
    return known.unionAll(spark.createDataFrame([("[UNK]", 1), ("[CLS]", 2), ("[SEP]", 3)], "token string, idx int"))


SIDES = f"""WITH {ENCODED}, words AS (SELECT unnest(list_concat(a, b)) AS token FROM w),
known AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 3 AS idx FROM words GROUP BY token HAVING count(*) >= 2 UNION ALL VALUES ('[CLS]', 2), ('[SEP]', 3)),
sides AS (SELECT pair_id, side, CASE WHEN len(t) + 2 <= 12 THEN list_concat(['[CLS]'], t, ['[SEP]']) ELSE list_concat(['[CLS]'], t[1:10], ['[SEP]']) END AS t FROM (SELECT pair_id, 0 AS side, a AS t FROM w UNION ALL SELECT pair_id, 1, b FROM w)),
u AS (SELECT pair_id, side, unnest(range(len(t))) AS pos, unnest(t) AS token FROM sides),
i AS (SELECT pair_id, side, list(coalesce(idx, 1) ORDER BY pos) AS ids FROM u LEFT JOIN known USING (token) GROUP BY ALL),
told AS (SELECT pair_id, side, array_to_string(list_concat(ids, list_transform(range(12 - len(ids)), lambda x: 0)), ' ') AS ids, array_to_string(list_transform(range(12), lambda x: 0), ' ') AS segments, coalesce(labels, 0)::VARCHAR AS label FROM i JOIN pairs USING (pair_id))"""


@query(f"{SIDES} SELECT pair_id, side::INTEGER AS side, ids || chr(9) || segments || chr(9) || label AS value FROM told")
def single_text_ids(spark, folder):
    """Every text of a pair by itself, two rows a pair."""
    rows = encode.encoded(table(spark, folder, "pairs"), _known(spark, folder), 12, "single")
    return rows.select(F.col("id").alias("pair_id"), "side", F.concat_ws("\t", "ids", "segments", "label").alias("value"))


@query(f"{SIDES} SELECT a.pair_id, a.ids || chr(9) || a.segments || chr(9) || b.ids || chr(9) || b.segments || chr(9) || a.label AS value FROM told a JOIN told b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1")
def tetrad_ids(spark, folder):
    """Four arrays side by side: ids and segments of either text."""
    rows = encode.encoded(table(spark, folder, "pairs"), _known(spark, folder), 12, "tetrad")
    return rows.select(F.col("id").alias("pair_id"), F.concat_ws("\t", "a_ids", "a_segments", "b_ids", "b_segments", "label").alias("value"))


@query(f"{SIDES} SELECT b.batch, count(*) AS n, sum(len(string_split(ids, ' '))) AS width FROM (SELECT *, (dense_rank() OVER (ORDER BY pair_id) - 1) // 32 AS batch FROM told) b GROUP BY b.batch")
def tetrad_batches(spark, folder):
    """Rows of four arrays in even batches, with the width that each batch takes."""
    from kindred.operators import pairs

    rows = encode.encoded(table(spark, folder, "pairs"), _known(spark, folder), 12, "tetrad")
    width = F.size(F.split("a_ids", " ")) + F.size(F.split("b_ids", " "))
    return pairs.batches(rows, [F.asc("id")], 32).groupBy(F.col("batch_id").alias("batch")).agg((F.count(F.lit(1)) * 2).alias("n"), F.sum(width).alias("width"))


RARE = SQL["oov_map"].split("SELECT pair_id AS id")[0]


@query(f"""{RARE}, ids AS (SELECT pair_id, field, pos, idx FROM joined WHERE idx IS NOT NULL UNION ALL SELECT pair_id, field, pos, (dense_rank() OVER (PARTITION BY pair_id ORDER BY f) + 34999)::VARCHAR FROM rare),
texts AS (SELECT pair_id, string_agg(idx, ' ' ORDER BY pos) FILTER (field = 0) AS a, string_agg(idx, ' ' ORDER BY pos) FILTER (field = 1) AS b FROM ids GROUP BY pair_id)
SELECT pair_id AS id, coalesce(a, '') || chr(9) || coalesce(b, '') || chr(9) || coalesce(labels::VARCHAR, '') AS line FROM pairs LEFT JOIN texts USING (pair_id)""")
def oov_lines(spark, folder):
    return vocab.rare_word_lines(table(spark, folder, "pairs"), "pair_id", ("text_a", "text_b"), "labels")


POINTS = "array_to_string(list_transform(string_split({0}, ''), lambda c: unicode(c)), ' ')"


@query(f"""WITH s AS ({SQL["similar_words"]}), g AS (SELECT word, string_agg({POINTS.format('other')}, '|' ORDER BY rank) AS likes FROM s GROUP BY word),
q AS (SELECT DISTINCT unnest({filters_sql('query_text')}) AS word FROM queries) SELECT word, {POINTS.format('word')} AS ids, length(word) AS n, coalesce(likes, '') AS likes FROM q LEFT JOIN g USING (word)""")
def ngram_meta(spark, folder):
    """The words of the queries with the code points of their characters and of the words like them."""
    from kindred.plans.catalogue import _like_words

    words = table(spark, folder, "queries").select(F.explode(T.word_tokens(F.col("query_text"))).alias("word"))
    return vocab.ngram_meta(words, _like_words(spark, folder))


@query()
def lexical_inference(spark, folder):
    """The pairs of unknown label, by models of the labelled ones."""
    rows = table(spark, folder, "pairs")
    return classify.inferred(rows, rows.where("labels = 2"), "pair_id", k=3, iterations=10)


@query()
def word2vec_vectors(spark, folder):
    """Vectors of the words of the queries' random segmentations."""
    lines = table(spark, folder, "queries")
    cuts = vocab.random_segments(lines, "query_id", "query_text", vocab.ngram_counts(lines, "query_text", 3, 4), times=2)
    return embed.word_vectors(cuts, size=16, epochs=2).select("token", F.size("vec").alias("n"))


# --- losses and layers of encoders


@query(f"WITH {SCORED}, p AS (SELECT same, greatest(1e-7, least(1 - 1e-7, 1 / (1 + exp(-score)))) AS p FROM scored) SELECT round(avg(-(same * ln(p) + (1 - same) * ln(1 - p))) / 64, 8) AS loss FROM p")
def colbert_bce(spark, folder):
    """Binary cross-entropy of the sigmoid of late-interaction scores, over the size of a batch."""
    from kindred.plans.catalogue import _scored

    loss = metrics.binary_cross_entropy(F.col("same"), metrics.sigmoid(F.col("score"))) / 64
    return _scored(spark, folder).agg(F.round(loss, 8).alias("loss"))


def _layer(rows: DataFrame, f, width: int, digits: int = 6) -> DataFrame:
    """(item_id, pos, x): what a function makes of the matrix of a batch's vectors, by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                out = f(m)
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), width)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(width, dtype=np.int32), batch.num_rows)), pa.array(np.round(out.reshape(-1), digits))], ["item_id", "pos", "x"])

    return rows.mapInArrow(run, "item_id bigint, pos int, x double")


FORMULAS = {
    "gelu": "0.5 * x * (1 + (exp(2 * g) - 1) / (exp(2 * g) + 1))", "relu": "greatest(x, 0)", "tanh": "(exp(2 * x) - 1) / (exp(2 * x) + 1)", "sigmoid": "1 / (1 + exp(-x))", "linear": "x", "swish": "x / (1 + exp(-x))",
    "mish": "x * ((1 + exp(x)) ** 2 - 1) / ((1 + exp(x)) ** 2 + 1)", "softplus": "ln(1 + exp(x))", "elu": "CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END", "selu": "1.0507009873554805::DOUBLE * CASE WHEN x > 0 THEN x ELSE 1.6732632423543772::DOUBLE * (exp(x) - 1) END",
    "leaky_relu": "CASE WHEN x > 0 THEN x ELSE 0.01 * x END", "softsign": "x / (1 + abs(x))", "exponential": "exp(x)",
}
UNNESTED = f"{VECTORS}, u AS (SELECT item_id, unnest(range(64)) AS d, unnest(vec) AS x FROM v)"


@query(f"WITH {UNNESTED}, g AS (SELECT *, 0.7978845608028654::DOUBLE * (x + 0.044715 * x ** 3) AS g FROM u WHERE d = 0) " + " UNION ALL ".join(f"SELECT item_id, '{name}' AS name, round({f}, 6) AS x FROM g" for name, f in FORMULAS.items()))
def nn_activations(spark, folder):
    names = list(FORMULAS)
    values = _layer(_vectors(spark, folder), lambda m: np.stack([neural.activation(n)(m[:, 0]) for n in names], 1), len(names))
    return values.select("item_id", F.element_at(F.array(*map(F.lit, names)), F.col("pos") + 1).alias("name"), "x")


WEIGHT = "(((i * 7 + j * 3) % 11) - 5) / 10.0::DOUBLE"


def _weights(rows: int, columns: int) -> np.ndarray:
    i, j = np.indices((rows, columns))
    return ((i * 7 + j * 3) % 11 - 5) / 10


@query(f"""WITH {UNNESTED}, h AS (SELECT item_id, j, sum(x * {WEIGHT.replace('i', 'd').replace('dnt', 'int')}) + max(j) / 10.0 AS h FROM u, (SELECT unnest(range(6)) AS j) GROUP BY ALL),
o AS (SELECT item_id, k AS pos, sum(greatest(h, 0) * {WEIGHT.replace('i', '(a.j)').replace('j * 3', 'k * 3')}) - max(k) / 10.0 AS x FROM h a, (SELECT unnest(range(3)) AS k) GROUP BY ALL) SELECT item_id, pos::INTEGER AS pos, round(x, 6) AS x FROM o""")
def nn_feed_forward(spark, folder):
    """Two dense layers with biases and a rectifier between, of given weights."""
    w = {"f.in.w": _weights(64, 6), "f.in.b": np.arange(6) / 10, "f.out.w": _weights(6, 3), "f.out.b": -np.arange(3) / 10}
    return _layer(_vectors(spark, folder), lambda m: neural.feed_forward(m, w, "f", "relu"), 3)


@query(f"WITH {UNNESTED}, n AS (SELECT item_id, d, x, avg(x) OVER (PARTITION BY item_id) AS m, var_pop(x) OVER (PARTITION BY item_id) AS v FROM u) SELECT item_id, d::INTEGER AS pos, round((x - m) / sqrt(v + 1e-12) * 2 + 1, 6) AS x FROM n")
def nn_layer_norm(spark, folder):
    return _layer(_vectors(spark, folder), lambda m: neural.layer_norm(m, np.full(64, 2.0), np.ones(64)), 64)


SINE = "CASE WHEN d % 2 = 0 THEN sin(p / pow(10000, 2 * (d // 2) / 8.0)) ELSE cos(p / pow(10000, 2 * (d // 2) / 8.0)) END"


@query(f"""WITH t AS (SELECT p, d, {SINE} AS x FROM (SELECT unnest(range(10)) AS p), (SELECT unnest(range(8)) AS d)),
b AS (SELECT t.p, t.d, (t.x - 0.4 * z.x) / 0.6 AS x FROM t JOIN t z ON z.p = 0 AND z.d = t.d)
SELECT query_id, b.d::INTEGER AS d, round(CASE WHEN query_id % 100 < 10 THEN t.x ELSE 0.4 * b.x + 0.6 * c.x END, 6) AS x FROM queries JOIN b ON b.p = (query_id % 100) // 10 JOIN b c ON c.p = (query_id % 100) % 10 AND c.d = b.d LEFT JOIN t ON t.p = query_id % 100 AND t.d = b.d""")
def nn_positions(spark, folder):
    """Position embeddings of a table of ten, made hierarchically beyond it."""
    table_ = neural.positions(neural.sinusoid(10, 8), 100)
    rows = [(int(p), int(d), float(np.round(table_[p, d], 6))) for p in range(100) for d in range(8)]
    known = spark.createDataFrame(rows, "p bigint, d int, x double")
    return table(spark, folder, "queries").select("query_id", (F.col("query_id") % 100).alias("p")).join(F.broadcast(known), "p").select("query_id", "d", "x")


@query(f"WITH o AS (SELECT query_id, unnest(range(8)) AS d, greatest(-64, least(64, query_id - 50)) + 64 AS p FROM queries) SELECT query_id, d::INTEGER AS d, round({SINE}, 6) AS x FROM o")
def nn_relative_positions(spark, folder):
    """Embeddings of clipped offsets."""
    rows = table(spark, folder, "queries").select(F.col("query_id").alias("item_id"), F.array((F.col("query_id") - 50).cast("double")).alias("vec"))
    offsets = lambda m: neural.sinusoid(129, 8)[np.clip(m[:, 0], -64, 64).astype(int) + 64]
    return _layer(rows, offsets, 8).select(F.col("item_id").alias("query_id"), F.col("pos").alias("d"), "x")


@query(f"""WITH {MATRICES}, a AS (SELECT item_id, i, m, list_transform(m, lambda t: exp(list_inner_product(m[i + 1], t) / sqrt(8.0))) AS e FROM m, (SELECT unnest(range(8)) AS i)),
o AS (SELECT item_id, i, unnest(range(8)) AS d, m, e FROM a)
SELECT item_id, (i * 8 + d)::INTEGER AS pos, round(list_sum(list_transform(range(1, 9), lambda k: e[k] * m[k][d + 1])) / list_sum(e), 6) AS x FROM o""")
def nn_attention(spark, folder):
    """Self-attention of one head over eight token vectors, without projections."""
    heads = lambda m: m.reshape(len(m), 1, 8, 8)
    return _layer(_vectors(spark, folder), lambda m: neural.attention(heads(m), heads(m), heads(m)).reshape(len(m), 64), 64)


@query(f"""WITH {MATRICES}, u AS (SELECT item_id, unnest(range(8)) AS d, m FROM m)
SELECT item_id, d::INTEGER AS pos, round(list_sum(list_transform(range(1, 7), lambda k: (m[k][d + 1] + 2 * m[k][d + 1]) / 2)) / 6, 6) AS x FROM u""")
def nn_pooling(spark, folder):
    """The mean of the first and last states over the tokens that are none of padding."""

    def pool(m: np.ndarray) -> np.ndarray:
        x = m.reshape(len(m), 8, 8)
        mask = np.tile((np.arange(8) < 6).astype(float), (len(m), 1))
        return neural.pooled([x * 0, x, 2 * x], mask, {}, "first-last-avg")

    return _layer(_vectors(spark, folder), pool, 8)


@query(f"""WITH {MATRICES}, t AS (SELECT item_id, p, m[p + 1] AS a, m[p + 2] AS b FROM m, (SELECT unnest(range(7)) AS p)),
u AS (SELECT item_id, p, f, list_sum(list_transform(range(8), lambda c: a[c + 1] * ((((c * 3 + f * 5) % 7) - 3) / 10.0::DOUBLE) + b[c + 1] * ((((1 + c * 3 + f * 5) % 7) - 3) / 10.0::DOUBLE))) - f / 20.0 AS x FROM t, (SELECT unnest(range(4)) AS f))
SELECT item_id, f::INTEGER AS pos, round(greatest(max(x), 0), 6) AS x FROM u GROUP BY item_id, f""")
def nn_text_cnn(spark, folder):
    """The greatest response of four filters of width two over eight token vectors."""
    k, c, f = np.indices((2, 8, 4))
    w = {"conv2.w": ((k + c * 3 + f * 5) % 7 - 3) / 10, "conv2.b": -np.arange(4) / 20}
    return _layer(_vectors(spark, folder), lambda m: neural.text_cnn(m.reshape(len(m), 8, 8), w, (2,)), 4)


@query(f"""WITH {MATRICES}, u AS (SELECT item_id, d, list_transform(m, lambda t: t[d + 1]) AS x FROM m, (SELECT unnest(range(8)) AS d)),
i AS (SELECT item_id, d AS i, list_max(x) AS x FROM u UNION ALL SELECT item_id, d + 8, list_sum(x) / 8 FROM u),
h AS (SELECT item_id, j, greatest(sum(x * {WEIGHT}) + max(j) / 10.0, 0) AS h FROM i, (SELECT unnest(range(3)) AS j) GROUP BY item_id, j),
o AS (SELECT item_id, k, exp(sum(h * {WEIGHT.replace('i', '(a.j)').replace('j * 3', 'k * 3')}) + max(k) / 10.0) AS e FROM h a, (SELECT unnest(range(2)) AS k) GROUP BY item_id, k)
SELECT item_id, k::INTEGER AS pos, round(e / sum(e) OVER (PARTITION BY item_id), 6) AS x FROM o""")
def nn_fast_text(spark, folder):
    """Class probabilities from the greatest and mean token values through one hidden layer."""
    w = {"hidden.w": _weights(16, 3), "hidden.b": np.arange(3) / 10, "out.w": _weights(3, 2), "out.b": np.arange(2) / 10}
    return _layer(_vectors(spark, folder), lambda m: neural.fast_text(m.reshape(len(m), 8, 8), w), 2)


QW = "((((i * 7 + j * 3) % 11) - 5) / 10.0::DOUBLE)"


def _project(source: str, weight: str) -> str:
    return f"list_transform({source}, lambda t: list_transform(range(8), lambda j: list_sum(list_transform(range(8), lambda i: t[i + 1] * {weight}))))"


@query(f"""WITH {MATRICES}, q AS (SELECT item_id, m, {_project('m', QW)} AS q, {_project('m', QW.replace('* 7', '* 5'))} AS k, {_project('m', QW.replace('* 7', '* 2'))} AS v FROM m),
s AS (SELECT item_id, p, h, m, list_transform(k, lambda t: exp(list_inner_product(q[p + 1][h * 4 + 1 : h * 4 + 4], t[h * 4 + 1 : h * 4 + 4]) / 2.0::DOUBLE)) AS e, v FROM q, (SELECT unnest(range(8)) AS p), (SELECT unnest(range(2)) AS h)),
c AS (SELECT item_id, p, h * 4 + d AS c, m, list_sum(list_transform(range(1, 9), lambda n: e[n] * v[n][h * 4 + d + 1])) / list_sum(e) AS x FROM s, (SELECT unnest(range(4)) AS d)),
a AS (SELECT item_id, p, j, m[1][1] AS any, first(m[p + 1][j + 1]) + sum(x * {QW.replace('i * 7', 'c * 4')}) AS x FROM c, (SELECT unnest(range(8)) AS j) GROUP BY item_id, p, j, m[1][1]),
n AS (SELECT item_id, p, j, (x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-12) AS x FROM a WINDOW w AS (PARTITION BY item_id, p))
SELECT item_id, (p * 8 + j)::INTEGER AS pos, round(x, 5) AS x FROM n""")
def nn_attention_block(spark, folder):
    """The first half of an encoder's block: two-headed self-attention with projections, added to its input and normalised."""
    i, j = np.indices((8, 8))
    w = {f"b.{part}.w": ((i * f + j * 3) % 11 - 5) / 10 for part, f in {"q": 7, "k": 5, "v": 2, "o": 4}.items()} | {f"b.{part}.b": np.zeros(8) for part in "qkvo"}

    def block(m: np.ndarray) -> np.ndarray:
        x = m.reshape(len(m), 8, 8)
        out = x + neural.self_attention(x, w, "b", 2, np.ones((len(m), 8)))
        return neural.layer_norm(out, np.ones(8), np.zeros(8)).reshape(len(m), 64)

    return _layer(_vectors(spark, folder), block, 64, 5)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(MORE)
