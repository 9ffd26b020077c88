import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import external
from kindred.functions import vectors as V
from kindred.operators import blocks, classify, corpus, embed, encode, lsh, metrics, neural, pairs, rank, vocab, weights
from kindred.operators.corpus import CorpusIndex
from kindred.session import salted_join
from kindred.sources import readers
from kindred.streaming.counts import length_totals, term_totals

CORPUS = [(1, ["a", "b", "a"]), (2, ["b", "c"]), (3, ["c", "c", "c", "d"]), (4, []), (4, []), (5, None), (None, ["z"]), (6, [None, "b"])]


@pytest.fixture(scope="module")
def tokens(spark):
    return corpus.corpus(spark.createDataFrame(CORPUS, "doc_id bigint, tokens array<string>"))


def test_ranking_equals_the_formulas(spark, tokens):
    docs = {1: ["a", "b", "a"], 2: ["b", "c"], 3: ["c", "c", "c", "d"], 4: [], 5: [], 6: ["b"]}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))

    def score(query, d, kind, tq):
        out = 0
        for t in query:
            if t in d:
                tf, q = d.count(t) / len(d), query.count(t) / len(query)
                idf = math.log(((n - df[t] if kind else n) + 0.5) / (df[t] + 0.5))
                out += idf * 3 * tf / (2 * (0.25 + 0.75 * len(d) / mean) + tf) * (2.2 * q / (1.2 + q) if tq else 1)
        return round(out, 6)

    index = corpus.CorpusIndex.of(tokens).cut()
    for query in (["a"], ["a", "a", "b"], ["zzz"], []):
        for kind in (False, True):
            for tq in (False, True):
                want = sorted(((i, score(query, d, kind, tq)) for i, d in docs.items()), key=lambda x: (-x[1], x[0]))
                got = rank.top_documents(index, query, 4, query_tf=tq, idf_kind="probabilistic" if kind else "smooth").collect()
                assert [(r["doc_id"], pytest.approx(r["score"] + 0.0, abs=2e-6)) for r in got] == want[:4]
                assert rank.top_documents(index, query, 0, query_tf=tq).count() == 6


def test_padded_weights_of_an_empty_document(tokens):
    got = {r["doc_id"]: r["weights"] for r in rank.padded_weights(tokens, 2, padding="pre", truncating="pre", value=-1.0).collect()}
    assert got[4] == [-1.0, -1.0] and got[6][0] == -1.0 and len(got[3]) == 2


def test_vocabulary_round_trip(spark, tokens):
    known = corpus.vocabulary(tokens, oov="[UNK]")
    assert {r["token"]: r["idx"] for r in known.collect()} == {"[UNK]": 1, "c": 2, "b": 3, "a": 4, "d": 5}
    seqs = vocab.texts_to_sequences(tokens, known, num_words=4, oov_index=1)
    assert {r["doc_id"]: r["seq"] for r in seqs.collect()} == {1: [1, 3, 1], 2: [3, 2], 3: [2, 2, 2, 1], 4: [], 5: [], 6: [3]}
    texts = vocab.sequences_to_texts(seqs, known)
    assert {r["doc_id"]: r["text"] for r in texts.collect()}[1] == "[UNK] b [UNK]"


def test_ranks_and_running_sums_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select("id", F.md5(F.col("id").cast("string")).alias("h"), (F.col("id") % 7).alias("v"))
    rows = sorted(df.collect(), key=lambda r: r["h"])
    total = 0
    want = []
    for k, r in enumerate(rows, 1):
        total += r["v"]
        want.append((r["id"], k, total))
    ranked = corpus.ranked_rows(df, [F.asc("h")], "rank").select("id", "rank")
    summed = corpus.running_sums(df, [F.asc("h")], {"s": "v"}).select("id", "s")
    assert sorted(map(tuple, ranked.join(summed, "id").collect()), key=lambda r: r[1]) == want
    assert corpus.ranked_rows(df.limit(0), [F.asc("h")], "rank").collect() == []


def test_components_equal_union_find(spark):
    draw = random.Random(2)
    nodes = list(range(400))
    links = [(draw.choice(nodes), draw.choice(nodes)) for _ in range(250)] + [(k, k + 1) for k in range(300, 399)]
    root = {k: k for k in nodes}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    df = spark.createDataFrame(links, "src bigint, dst bigint")
    got = pairs.components(spark.createDataFrame([(k,) for k in nodes], "id bigint"), df)
    assert {r["id"]: r["component"] for r in got.collect()} == {k: find(k) for k in nodes}


PAIRS = "pair_id bigint, text_a string, text_b string, labels int"


def test_folds_share_no_sentence(spark):
    rows = [(1, "s1", "s2", 1), (2, "s2", "s3", 0), (3, "s4", "s5", 1), (4, "s6", "s7", 2), (5, None, "s1", 1), (6, "s8", "s8", 0)] + [(10 + k, f"x{k}", f"y{k}", k % 2) for k in range(20)]
    df = spark.createDataFrame(rows, PAIRS)
    comps = pairs.sentence_components(df)
    assert comps.select("component").distinct().count() == 2 + 2 + 1 + 20
    met = pairs.pair_components(df, comps)
    assert [r["id"] for r in met.where("comp_a <> comp_b").collect()] == [4]
    for keep in (False, True):
        folds = {r["id"]: r["fold"] for r in pairs.component_folds(df, 5, use_remainder=keep).collect()}
        assert folds[1] == folds[2] and set(folds) == {r[0] for r in rows if r[3] != 2 and r[1]} and (None in folds.values()) == (not keep)
    dealt = Counter((r["label"], r["fold"]) for r in pairs.stratified_folds(df, "pair_id", "labels").collect())
    assert all(abs(dealt[label, f] - sum(r[3] == label for r in rows) / 5) < 1 for label in (0, 1, 2) for f in range(5))
    assert pairs.sentence_components(df.limit(0)).collect() == []


def test_encoding_of_pairs(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["d"]), (["a"], ["b", "c", "d", "e"]), ([], [])], "x array<string>, y array<string>")
    t, s = pairs.encode_pairs(F.col("x"), F.col("y"), 6)
    assert [(" ".join(r[0]), r[1]) for r in df.select(t, s).collect()] == [("[CLS] a b [SEP] d [SEP]", [0, 0, 0, 0, 1, 1]), ("[CLS] a [SEP] b c [SEP]", [0, 0, 0, 1, 1, 1]), ("[CLS] [SEP] [SEP]", [0, 0, 1])]


def test_hashing(spark):
    rows = [(1, [1, 2, 3, 4]), (2, [1, 2, 3, 4]), (3, [100, 200]), (4, []), (5, None)]
    items = spark.createDataFrame(rows, "item_id bigint, features array<bigint>")
    sigs = {r["item_id"]: r["sig"] for r in lsh.signatures(items, 50).collect()}
    assert sigs[1] == sigs[2] != sigs[3] and set(sigs[4]) == set(sigs[5]) == {-1}
    p, a, b = lsh.permutations(50)[7]
    assert sigs[3][7] == min((x * a + b) % lsh.PRIME for x in (100, 200))
    assert sorted(map(tuple, lsh.minhash_matches(items, items).collect())) == [(1, 2), (2, 1)]
    assert sorted(map(tuple, lsh.minhash_matches(items, "item_id = 1").collect())) == [(1, 2)]
    vectors = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.1, 0.2]), (3, [90.0, -70.0]), (4, None)], "item_id bigint, vec array<double>")
    fps = lsh.stable_fingerprints(vectors, lsh.stable_family(3, 4, 2), lsh.fingerprint_factors(4))
    assert sorted(map(tuple, lsh.stable_matches(fps, fps, per_round=True).collect())) == [(1, 2), (2, 1)]
    with pytest.raises(ValueError):
        lsh.digest(F.lit("x"), "crc")


def test_near_duplicates_of_texts_without_blanks(spark):
    long = "".join(chr(0x4E00 + k) for k in range(60))
    texts = [(1, long), (2, long), (3, "。" + long[:-1] + "！"), (4, long[30:] + long[:10]), (5, "你好"), (6, " 你好!"), (7, "你"), (8, ""), (9, None), (10, "one two three four five six"), (11, "One, two three four five six."), (12, "？！…"), (13, " ？！…"), (14, " ")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    items = lsh.token_shingles(docs, "doc_id", "text")
    assert {r["item_id"]: len(r["features"]) for r in items.collect()} == {1: 56, 2: 56, 3: 55, 4: 36, 5: 1, 6: 1, 7: 1, 8: 0, 9: 0, 10: 2, 11: 2, 12: 1, 13: 1, 14: 0}
    got = {(r["id_1"], r["id_2"]): round(r["jaccard"], 4) for r in lsh.near_duplicates(items).by_row().collect()}
    assert got == {(1, 2): 1, (1, 3): round(55 / 56, 4), (2, 3): round(55 / 56, 4), (5, 6): 1, (10, 11): 1, (12, 13): 1}


def test_nearest_in_blocks_equals_brute_force(spark):
    draw = np.random.default_rng(1)
    m = draw.normal(size=(60, 5))
    m[7] = 0
    items = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)] + [(99, None)], "item_id bigint, vec array<double>")
    asked = items.where("item_id % 5 = 0").toDF("query_id", "vec")
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    for block in (3, 100):
        got = {(r["query_id"], r["rank"]): r["item_id"] for r in embed.nearest(items, asked, 4, block=block).collect()}
        for q in range(0, 60, 5):
            c = [(-round(float(unit[q] @ unit[k]), 6), k) for k in range(60) if k not in (q, 7)]
            assert [got[q, r] for r in range(1, 5)] == [k for _, k in sorted(c)[:4]]
    assert embed.nearest(items, asked.limit(0), 3).collect() == []


def test_similar_words_are_not_cut_by_words_of_other_lengths(spark, tmp_path):
    from kindred.plans import catalogue

    draw = random.Random(5)
    words = sorted({"".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 12))) for _ in range(4000)})
    spark.createDataFrame([(k, w) for k, w in enumerate(words)], "query_id bigint, query_text string").write.parquet(f"{tmp_path}/queries.parquet")
    m = np.array([r["vec"] for r in catalogue.word_vectors(spark.createDataFrame([(words,)], "tokens array<string>")).orderBy("token").collect()])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    c, size = np.round(unit @ unit.T, 6), np.array([len(w) for w in words])
    c[(size[:, None] != size) | np.eye(len(words), dtype=bool)] = -2
    want = {(words[k], words[j], rank) for k in range(len(words)) for rank, j in enumerate(np.argsort(-c[k], kind="stable")[:15], 1) if c[k, j] > 0.68}
    got = {(r["word"], r["other"], r["rank"]) for r in catalogue.queries()["similar_words"](spark, str(tmp_path)).collect()}
    assert got == want


def test_sentence_embeddings_lose_their_first_direction(spark, tokens):
    vectors = spark.createDataFrame([(t, [float(ord(t)), 1.0, float(k)]) for k, t in enumerate("abcd")], "token string, vec array<double>")
    s = embed.pooled(tokens, vectors, embed.sif_weights(embed.word_probabilities(tokens.select(F.explode("tokens").alias("token")))))
    m = np.array([r["vec"] for r in s.orderBy("doc_id").collect()])
    u, sigma = embed.components(s, 1, centred=False)
    _, true_sigma, vt = np.linalg.svd(m)
    assert abs(u[0] @ vt[0]) == pytest.approx(1) and sigma[0] == pytest.approx(true_sigma[0])
    out = np.array([r["vec"] for r in embed.sif(tokens, vectors).orderBy("doc_id").collect()])
    assert np.allclose(out @ u[0], 0, atol=1e-9) and out.shape == m.shape
    assert embed.usif(tokens, vectors, 3, 2).count() == 4


def test_ngrams_and_rare_words(spark):
    lines = spark.createDataFrame([("abcx",)] * 7 + [("ab",)] * 3 + [("bc",)] * 3 + [(None,)], "t string")
    counted = vocab.ngram_counts(lines, "t", 7, 3)
    assert {r["ngram"]: r["cnt"] for r in counted.collect()} == {"ab": 10, "bc": 10, "cx": 7, "abc": 7, "bcx": 7}
    # an ending is never pruned unless asked for: cx stays beside bcx
    assert {r["ngram"] for r in vocab.pruned_ngrams(counted).collect()} == {"ab", "bc", "cx", "abc", "bcx"}
    assert {r["ngram"] for r in vocab.pruned_ngrams(counted, prune_suffix=True).collect()} == {"ab", "bc", "abc", "bcx"}
    rows = spark.createDataFrame([(1, "x y x", "z y")] + [(k, "y", None) for k in range(2, 8)], "pair_id bigint, text_a string, text_b string")
    got = vocab.map_rare_words(rows, vocab.frequency_map(rows, ["text_a", "text_b"]), "pair_id", ("text_a", "text_b"))
    assert sorted((r["field"], r["pos"], r["idx"]) for r in got.where("id = 1").collect()) == [(0, 0, "35000"), (0, 1, "0"), (0, 2, "35000"), (1, 0, "35001"), (1, 1, "0")]


def test_cipher_goes_on_past_the_surrogates(spark):
    tokens = spark.createDataFrame([(1, ["a", "b", "c", "a"]), (2, ["d", "e"])], "doc_id bigint, tokens array<string>")
    for base, want in ((0xD7FE, "\ud7fe\ud7ff\ue000\ue001\ue002"), (0x10FFFB - 0x800, "".join(map(chr, range(0x10FFFB, 0x110000))))):
        got = {r["doc_id"]: r["text"] for r in vocab.decode_cipher(tokens, vocab.cipher_vocabulary(tokens, base)).collect()}
        assert got == {1: want[:3] + want[0], 2: want[3:]}
    with pytest.raises(Exception, match="more distinct tokens"):
        vocab.decode_cipher(tokens, vocab.cipher_vocabulary(tokens, 0x10FFFC - 0x800)).collect()
    many = spark.createDataFrame([(1, [str(k) for k in range(50_000)])], "doc_id bigint, tokens array<string>")
    text = vocab.decode_cipher(many, vocab.cipher_vocabulary(many)).first()["text"]
    assert len(text) == len(set(text)) == 50_000


def test_word_pieces_and_segments(spark):
    words = spark.createDataFrame([("unaffable",), ("unx",), ("un",), (None,), ("u" * 300,)], "word string")
    got = {r["word"]: r["pieces"] for r in vocab.word_pieces(words, spark.createDataFrame([("un",), ("##aff",), ("##able",), ("[UNK]",)], "piece string")).collect()}
    assert got == {"unaffable": ["un", "##aff", "##able"], "unx": ["unx"], "un": ["un"], "u" * 300: ["u" * 300]}
    lines = spark.createDataFrame([(1, "abcd"), (2, None), (3, "")], "id bigint, t string")
    cuts = [r["tokens"] for r in vocab.random_segments(lines, "id", "t", spark.createDataFrame([("ab",), ("bcd",)], "ngram string")).collect()]
    assert cuts and all("".join(c) == "abcd" for c in cuts) and len({tuple(c) for c in cuts}) == len(cuts)


def test_auc_with_ties(spark):
    draw = random.Random(3)
    rows = [(draw.randint(0, 1), draw.randint(0, 9) / 10) for _ in range(300)]
    p, q = ([s for label, s in rows if label == k] for k in (1, 0))
    want = sum((x > y) + 0.5 * (x == y) for x in p for y in q) / len(p) / len(q)
    df = spark.createDataFrame(rows, "label int, score double")
    assert metrics.roc_auc(df, "label", "score").first()[0] == pytest.approx(want)
    assert metrics.roc_auc(df.where("label = 1"), "label", "score").first()[0] is None


def test_classifier_learns(spark):
    rows = [(k, f"good day {k}" if k % 2 else f"bad night {k}", "x", k % 2) for k in range(120)] + [(500, "z", None, 2), (501, "z", "y", None)]
    got = classify.cross_validated(spark.createDataFrame(rows, PAIRS), "pair_id", k=3).collect()
    assert len(got) == 3 and min(r["auc"] for r in got) > 0.95


def test_encoders():
    w = neural.random_transformer(vocab=50, size=8, layers=2, hidden=16, length=6)
    ids = np.array([[3, 4, 5, 0, 0, 0], [3, 4, 5, 0, 0, 0]])
    ids[1, 3:] = 0
    x, states = neural.transformer(ids, np.zeros_like(ids), w, layers=2, heads=2)
    assert x.shape == (2, 6, 8) and len(states) == 3 and np.allclose(x.mean(-1), 0, atol=1e-9)
    # padding does not reach the tokens before it
    short, _ = neural.transformer(ids[:, :3], np.zeros((2, 3), int), w, layers=2, heads=2)
    assert np.allclose(short, x[:, :3])
    for how in ("cls", "pooler", "last-avg", "first-last-avg"):
        assert neural.pooled(states, (ids != 0).astype(float), w, how).shape == (2, 8)
    assert neural.transformer(ids, np.zeros_like(ids), w, layers=2, heads=2, shared=True, relative=True)[0].shape == (2, 6, 8)
    assert neural.positions(w["position"], 20).shape == (20, 8)
    assert neural.k_max(np.array([[[3.0], [1.0], [2.0]]]), 2).ravel().tolist() == [3, 2]
    assert neural.conv1d(np.ones((1, 4, 1)), np.ones((2, 1, 1)), np.zeros(1)).ravel().tolist() == [2, 2, 2]
    assert neural.late_interaction(np.eye(2)[None], np.eye(2)[None], np.ones((1, 2)), np.ones((1, 2))) == pytest.approx([2])
    with pytest.raises(ValueError):
        neural.activation("none")
    draw = np.random.default_rng(0)
    m = lambda *s: draw.normal(0, 0.1, s)
    r = {"forward.w": m(3, 16), "forward.u": m(4, 16), "forward.b": m(16), "backward.w": m(3, 16), "backward.u": m(4, 16), "backward.b": m(16)}
    assert neural.birnn(m(2, 5, 3), r).shape == (2, 8)
    assert neural.gru(m(2, 5, 3), {"g.w": m(3, 12), "g.u": m(4, 12), "g.b": m(12)} , "g").shape == (2, 5, 4)
    assert neural.poly_encoder(m(2, 5, 4), m(2, 4), np.ones((2, 5)), {"codes": m(3, 4)}).shape == (2,)
    d = lambda name, i, o: {f"{name}.w": m(i, o), f"{name}.b": m(o)}
    e = {"re0.c.w": m(3, 4, 5), "re0.c.b": m(5), **d("re0.p", 9, 6), **{k: v for n in range(3) for k, v in d(f"re0.f.f{n}".replace("re0.f.", "re0."), 18, 7).items()}, **d("re0.f", 21, 7), **d("re.h", 28, 6), **d("re.out", 6, 2)}
    assert neural.re2(m(2, 5, 4), m(2, 6, 4), np.ones((2, 5)), np.ones((2, 6)), e, 1).shape == (2, 2)


def test_readers_round_trip(spark, tmp_path, tokens):
    (tmp_path / "t.txt").write_text("a b  c \n\n  \nd\n", encoding="utf-8")
    assert sorted(r["tokens"] for r in readers.token_lines(spark, str(tmp_path / "t.txt"), " ").collect()) == [["a", "b", "", "c"], ["d"]]
    with pytest.raises(FileNotFoundError):
        readers.lines(spark, str(tmp_path / "none"))
    (tmp_path / "p.tsv").write_text("x\ty\t1\nx\ty\nx\ty\t1\tz\n\nq\n", encoding="utf-8")
    rows = readers.lines(spark, str(tmp_path / "p.tsv"))
    assert sorted(map(tuple, readers.pair_lines(rows).collect())) == [("x", "y", 0), ("x", "y", 0), ("x", "y", 1)]
    assert readers.pair_lines(rows, strict=True).count() == 1
    pairs_ = readers.pair_lines(rows)
    readers.to_json_pairs(pairs_).write.json(str(tmp_path / "j"))
    assert readers.read_json_pairs(spark, str(tmp_path / "j")).count() == 3
    known = corpus.vocabulary(tokens)
    readers.save_tokenizer(known, {"length_average": 2.5}, str(tmp_path / "tok"))
    again, config = readers.load_tokenizer(spark, str(tmp_path / "tok"))
    assert again.count() == 4 and config == {"length_average": 2.5}
    readers.save_vocabulary(known, str(tmp_path / "vocab"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "vocab")).collect()] == ["c", "b", "a", "d"]
    lines = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x"), (3, " "), (4, "z")], "line_no bigint, value string")
    assert {r["token"]: r["idx"] for r in vocab.load_vocabulary(lines).collect()} == {"x": 0, "y": 1, "z": 2}


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    df = spark.createDataFrame([(k, t) for k, t in CORPUS], "doc_id bigint, tokens array<string>")
    for part in range(2):
        df.where(F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, out in (("totals", term_totals(stream)), ("lengths", length_totals(stream))):
        run = out.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
        run.awaitTermination()
    assert {r["token"]: (r["cnt"], r["df"]) for r in spark.table("totals").collect()} == {"a": (2, 1), "b": (3, 3), "c": (4, 2), "d": (1, 1), "z": (1, 1)}
    assert spark.table("lengths").first()["n_docs"] == len(CORPUS)


def test_blocks_measure_as_the_columns_do(spark):
    draw = np.random.default_rng(4)
    m = draw.normal(size=(30, 8))
    m[3] = 0
    rows = [(k, v.tolist()) for k, v in enumerate(m)] + [(100, None), (None, m[0].tolist())]
    df = spark.createDataFrame(rows, "item_id bigint, vec array<double>").repartition(3)
    asked = df.where("item_id % 5 = 0").toDF("query_id", "vec")
    kinds = {
        "euclidean": (blocks.euclidean, V.euclidean), "manhattan": (blocks.manhattan, V.manhattan), "minkowski": (blocks.minkowski(3), lambda a, b: V.minkowski(a, b, 3)), "cosine": (blocks.cosine, V.cosine),
        "floored": (blocks.cosine_floored(), V.cosine_floored), "pearson": (blocks.pearson, V.pearson), "hamming": (blocks.hamming, V.hamming), "kl": (blocks.kl_of_softmax, lambda a, b: V.kl_divergence(V.softmax(a), V.softmax(b))),
        "jaccard": (blocks.jaccard(0.5), lambda a, b: V.jaccard_distance(*(F.transform(x, lambda y: (y > 0.5).cast("double")) for x in (a, b)))),
    }
    got = {(r["query_id"], r["item_id"]): r for r in blocks.measured(df, asked, {k: f for k, (f, _) in kinds.items()}, size=7).collect()}
    met = asked.withColumnRenamed("vec", "a").crossJoin(df.withColumnRenamed("vec", "b")).where("query_id <> item_id AND a IS NOT NULL AND b IS NOT NULL")
    want = met.select("query_id", "item_id", *(f(F.col("a"), F.col("b")).cast("double").alias(k) for k, (_, f) in kinds.items())).collect()
    assert len(got) == len(want) == 6 * 29
    for r in want:
        for k in kinds:
            x, y = r[k], got[r["query_id"], r["item_id"]][k]
            assert x is None and y is None or x == pytest.approx(y, abs=1e-9), (k, r)
    two = blocks.measured(df, asked, {"s": blocks.max_sim(2), "l": blocks.max_sim(2, "l2")}).where("query_id = 0 AND item_id = 5").first()
    a, b = (m[k].reshape(2, 4) for k in (0, 5))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    assert two["s"] == pytest.approx((unit(a) @ unit(b).T).max(1).sum()) and two["l"] == pytest.approx(-((a[:, None] - b[None]) ** 2).sum(2).min(1).sum())
    assert blocks.measured(df.limit(0), asked, {"c": blocks.cosine}).collect() == []


def test_salted_join_equals_a_join(spark):
    many = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k}") for k in range(3000)] + [(9000, None)], "id int, key string")
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("none", 4), (None, 5)], "key string, v int")
    counts = many.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, salted_join(many, few, "key", counts, hot_share=0.1, salts=5).collect())) == sorted(map(tuple, many.join(few, "key").collect()))
    assert salted_join(many.limit(0), few, "key", counts.limit(0)).collect() == []


def test_links_of_near_duplicates_count_items(spark):
    rows = [(k, [1, 2, 3, 4, 5]) for k in range(4)] + [(10, [1, 2, 3, 4, 5, 6]), (11, [7, 8]), (12, [])]
    found = lsh.near_duplicates(spark.createDataFrame(rows, "item_id bigint, features array<bigint>"), band=50, row=2)
    assert {r["item_id"]: (r["class_id"], r["n_links"]) for r in found.links().collect()} == {0: (0, 4), 1: (0, 4), 2: (0, 4), 3: (0, 4), 10: (10, 4), 11: (11, 0)}
    assert found.by_row().count() == 10


def test_index_written_once_scores_alike(spark):
    tokens = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "c"]), (3, [])], "doc_id bigint, tokens array<string>")
    index = CorpusIndex.of(tokens)
    for method in ("bm25", "tfidf"):
        plain, written = (rank.top_documents(i, ["a", "b", "zzz"], 0, method).collect() for i in (index, index.cut()))
        assert sorted(plain) == sorted(written)


def test_encoding_forms(spark):
    pairs_ = spark.createDataFrame([(1, "a b c d", "a", 1), (2, "a", None, 0), (3, "b x", "c", None)], "pair_id bigint, text_a string, text_b string, labels int")
    known = spark.createDataFrame([("[CLS]", 2), ("[SEP]", 3), ("a", 4), ("b", 5), ("c", 6)], "token string, idx int")
    rows = {form: sorted(map(tuple, encode.encoded(pairs_, known, 5, form).collect())) for form in encode.FORMS}
    assert rows["plain"] == [(1, "4 5 6 1 0", "4 0 0 0 0", "1"), (3, "5 1 0 0 0", "6 0 0 0 0", "0")]
    assert rows["single"] == [(1, 0, "2 4 5 6 3", "0 0 0 0 0", "1"), (1, 1, "2 4 3 0 0", "0 0 0 0 0", "1"), (3, 0, "2 5 1 3 0", "0 0 0 0 0", "0"), (3, 1, "2 6 3 0 0", "0 0 0 0 0", "0")]
    assert rows["tetrad"][1] == (3, "2 5 1 3 0", "0 0 0 0 0", "2 6 3 0 0", "0 0 0 0 0", "0") and [r[0] for r in rows["joint"]] == [1, 3]
    assert {r[0] for r in encode.encoded_lines(encode.encoded(pairs_, known, 5, "plain")).collect()} == {"4 5 6 1 0\t4 0 0 0 0\t1", "5 1 0 0 0\t6 0 0 0 0\t0"}
    with pytest.raises(ValueError):
        encode.encoded(pairs_, known, 5, "triple")


def test_inference_from_files(spark, tmp_path):
    train, asked = tmp_path / "train.tsv", tmp_path / "asked.tsv"
    train.write_text("".join(f"good day {k}\tx\t1\nbad night {k}\tx\t0\n" for k in range(40)) + "broken line\n")
    asked.write_text("good day again\tx\nbad night again\tx\n")
    classify.infer(spark, str(train), path=str(asked), out_path=str(tmp_path / "out"), k=3)
    p = [float(r[0]) for r in spark.read.csv(str(tmp_path / "out")).collect()]
    assert len(p) == 2 and max(p) > 0.6 and min(p) < 0.4
    assert classify.infer(spark, str(train), pair=("good day", "x"), k=3, features=classify.word_features) > 0.6
    assert classify.infer(spark, str(train)) is None


def test_positions_of_lines_whatever_the_splits(spark, tmp_path):
    (tmp_path / "a").write_text("".join(f"a{k}\n\n" for k in range(500)))
    (tmp_path / "b").write_text("".join(f" b{k} \n" for k in range(500)))
    want = [f"b{k}" for k in range(500)] + [f"a{k}" for k in range(500)]
    for size in ("700", "100000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = readers.numbered_lines(spark, [str(tmp_path / "b"), str(tmp_path / "a")]).orderBy("position").collect()
        assert [r["value"] for r in rows] == want and [r["position"] for r in rows] == list(range(1000))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_run_configs_and_piece_kinds(spark, tmp_path):
    path = str(tmp_path / "runs")
    readers.save_run_config(spark, path, "a", {"x": 1})
    readers.save_run_config(spark, path, "a", {"x": 2})
    assert readers.run_config(spark, path, "a") == {"x": 2} and readers.run_config(spark, path, "b") == {}
    rows = external.piece_kinds(spark.createDataFrame([(0,), (1,), (500,), (10**6,), (None,)], "id int"), "id").collect()
    assert [(r["special"], r["decodable"]) for r in rows] == [(True, False), (True, False), (False, True), (False, False), (False, False)]


def test_word_vectors_and_meta(spark):
    tokens = spark.createDataFrame([(["a", "b"],), (["a", "c"],)] * 20, "tokens array<string>")
    assert {r["token"]: len(r["vec"]) for r in embed.word_vectors(tokens, size=4, epochs=1).collect()} == {"a": 4, "b": 4, "c": 4}
    near = spark.createDataFrame([("ab", "cd", 0.9), ("ab", "ce", 0.95), ("ab", "x", 0.99), ("ab", "zz", 0.1)], "word string, other string, similarity double")
    got = {r["word"]: (r["ids"], r["n"], r["likes"]) for r in vocab.ngram_meta(spark.createDataFrame([("ab",), ("q",), (None,), ("ab",)], "word string"), near).collect()}
    assert got == {"ab": ("97 98", 2, "99 101|99 100"), "q": ("113", 1, "")}


def test_resized_matrices_keep_their_norm():
    a = np.arange(1.0, 9.0).reshape(4, 2)
    b = neural.resized(a, (8, 2))
    assert b.shape == (8, 2) and np.linalg.norm(b) == pytest.approx(np.linalg.norm(a))
    assert np.allclose(b / b[0, 0], np.concatenate([a[:2], a[:2], a[2:], a[2:]]) / a[0, 0])
    assert neural.resized(a, (3, 2)).shape == (3, 2)
    with pytest.raises(ValueError):
        neural.resized(np.ones((3, 2)), (6, 2))


def drawn(draw, **shapes):
    return {k.replace("__", "."): draw.normal(size=v) for k, v in shapes.items()}


def test_convolutions_equal_loops():
    draw = np.random.default_rng(2)
    x, w = draw.normal(size=(2, 6, 3)), drawn(draw, conv2__w=(2, 3, 4), conv2__b=(4,), conv3__w=(3, 3, 4), conv3__b=(4,))
    want = np.zeros((2, 8))
    for b in range(2):
        for n, width in enumerate((2, 3)):
            for f in range(4):
                at = [sum(x[b, t + k, c] * w[f"conv{width}.w"][k, c, f] for k in range(width) for c in range(3)) + w[f"conv{width}.b"][f] for t in range(7 - width)]
                want[b, n * 4 + f] = max(0, max(at))
    assert neural.text_cnn(x, w, (2, 3)) == pytest.approx(want)
    same = neural.conv1d(x, w["conv3.w"], w["conv3.b"], same=True)
    assert same.shape == (2, 6, 4) and same[:, 1:-1] == pytest.approx(neural.conv1d(x, w["conv3.w"], w["conv3.b"]))
    assert neural.halved(np.arange(5.0)[None, :, None])[0, :, 0].tolist() == [1, 3, 4]
    assert neural.k_max(np.array([3.0, 1, 4, 1, 5])[None, :, None], 3)[0, :, 0].tolist() == [3, 4, 5]


def test_fast_text_equals_its_formula():
    draw = np.random.default_rng(3)
    x, w = draw.normal(size=(2, 5, 3)), drawn(draw, hidden__w=(6, 4), hidden__b=(4,), out__w=(4, 2), out__b=(2,))
    for b in range(2):
        h = [max(0, sum(z * w["hidden.w"][i, j] for i, z in enumerate([*x[b].max(0), *x[b].mean(0)])) + w["hidden.b"][j]) for j in range(4)]
        e = [math.exp(sum(h[i] * w["out.w"][i, j] for i in range(4)) + w["out.b"][j]) for j in range(2)]
        assert neural.fast_text(x, w)[b] == pytest.approx([v / sum(e) for v in e])


def test_masked_logits_equal_their_formula():
    draw = np.random.default_rng(4)
    x, w = draw.normal(size=(1, 2, 3)), drawn(draw, mlm__w=(3, 3), mlm__b=(3,), mlm__g=(3,), mlm__beta=(3,), token=(7, 3), mlm__bias=(7,))
    for t in range(2):
        h = [sum(x[0, t, i] * w["mlm.w"][i, j] for i in range(3)) + w["mlm.b"][j] for j in range(3)]
        h = [0.5 * v * (1 + math.tanh(math.sqrt(2 / math.pi) * (v + 0.044715 * v**3))) for v in h]
        m, s = sum(h) / 3, math.sqrt(sum((v - sum(h) / 3) ** 2 for v in h) / 3)
        h = [(v - m) / s * g + b for v, g, b in zip(h, w["mlm.g"], w["mlm.beta"])]
        assert neural.masked_logits(x, w)[0, t] == pytest.approx([sum(v * k for v, k in zip(h, row)) + b for row, b in zip(w["token"], w["mlm.bias"])], rel=1e-6)


def test_recurrent_and_deep_networks():
    draw = np.random.default_rng(5)
    x, w = draw.normal(size=(2, 4, 3)), drawn(draw, a__w=(3, 8), a__u=(2, 8), a__b=(8,))
    h = c = np.zeros((2, 2))
    for t in range(4):
        z = x[:, t] @ w["a.w"] + h @ w["a.u"] + w["a.b"]
        s = lambda v: 1 / (1 + np.exp(-v))
        c = s(z[:, 2:4]) * c + s(z[:, :2]) * np.tanh(z[:, 4:6])
        h = s(z[:, 6:]) * np.tanh(c)
        assert neural.lstm(x, w, "a")[:, t] == pytest.approx(h)
    assert neural.lstm(x[:, ::-1], w, "a")[:, -1] == pytest.approx(neural.lstm(x, w, "a", True)[:, 0])
    w |= drawn(draw, conv2__w=(2, 3, 4), conv2__b=(4,), norm__g=(4,), norm__beta=(4,), norm__mean=(4,), gate0__w=(4, 4), gate0__b=(4,), carry0__w=(4, 4), carry0__b=(4,), forward__w=(4, 8), forward__u=(2, 8), forward__b=(8,), backward__w=(4, 8), backward__u=(2, 8), backward__b=(8,))
    w["norm.var"] = np.ones(4)
    y = neural.batch_norm(neural.text_cnn(x, w, (2,)), w, "norm")
    gate = 1 / (1 + np.exp(-(y @ w["gate0.w"] + w["gate0.b"])))
    y = gate * np.maximum(y @ w["carry0.w"] + w["carry0.b"], 0) + (1 - gate) * y
    assert neural.char_cnn(x, w, (2,), 1)[:, :2] == pytest.approx(neural.lstm(y[:, None], w, "forward")[:, 0])
    deep = drawn(draw, first__w=(3, 3, 2), first__b=(2,))
    for n in range(2):
        for k in (1, 2):
            deep |= {f"cb{n}.c{k}.w": np.zeros((3, 2, 2)), f"cb{n}.c{k}.b": np.zeros(2), f"cb{n}.n{k}.mean": np.zeros(2), f"cb{n}.n{k}.var": np.ones(2), f"cb{n}.n{k}.g": np.ones(2), f"cb{n}.n{k}.beta": np.zeros(2)}
    # blocks of zeros pass their input by
    first = neural.halved(neural.conv1d(x, deep["first.w"], deep["first.b"], same=True))
    assert neural.deep_cnn(x, deep, 2, 2) == pytest.approx(neural.k_max(first, 2).reshape(2, -1))


def test_weights_by_published_names(spark, tmp_path):
    config = weights.EncoderConfig.of('{"vocab_size": 30, "hidden_size": 8, "num_hidden_layers": 2, "num_attention_heads": 2, "intermediate_size": 16, "max_position_embeddings": 6, "hidden_act": "gelu"}')
    own = config.random(3)
    ids = np.array([[3, 4, 5, 0, 0, 0], [7, 8, 9, 1, 2, 3]])
    want = neural.transformer(ids, ids * 0, own, **config.options())[0]
    for scoped in (False, True):
        names = weights.published_names(2, scoped)
        published = {names[k]: v.T if not scoped and k.endswith(".w") else v for k, v in own.items()}
        got, missing = weights.imported(published, config, scoped=scoped)
        assert missing == [] and neural.transformer(ids, ids * 0, got, **config.options())[0] == pytest.approx(want)
    assert names["block1.q.w"] == "bert/encoder/layer_1/attention/self/query/kernel" and names["token"] == "bert/embeddings/word_embeddings"
    published.pop(names["pooler.b"])
    part, missing = weights.imported(published, config, scoped=True, keep=[1, 2, 5], compound=[[0, 1], ([0, 2], [3, 1])])
    t = own["token"]
    assert missing == [names["pooler.b"]] and part["token"] == pytest.approx(np.stack([t[1], t[2], t[5], (t[1] + t[2]) / 2, (3 * t[1] + t[5]) / 4]))
    with pytest.raises(ValueError):
        weights.imported(published | {names["pooler.w"]: np.ones((2, 2))}, config, scoped=True)
    kept = weights.Checkpoints(spark, str(tmp_path / "steps"))
    kept.save(1, {"a": np.ones((2, 3))})
    kept.save(5, own)
    step, back = kept.load()
    assert step == 5 and kept.steps() == [1, 5] and all((back[k] == v).all() for k, v in own.items()) and kept.load(1)[1]["a"].shape == (2, 3)
    with pytest.raises(KeyError):
        kept.load(2)


def test_heads_are_probabilities_by_their_formula():
    config = weights.EncoderConfig(30, 8, 1, 2, 16, 6)
    draw = np.random.default_rng(1)
    w = config.random() | {f"{h}.{k}": draw.normal(size=s) for h in ("nsp", "head") for k, s in (("w", (8, 2)), ("b", (2,)))}
    ids = np.array([[3, 4, 5, 0], [7, 8, 9, 1]])
    _, states = neural.transformer(ids, ids * 0, w, **config.options())
    for name, got in (("head", neural.pair_probabilities(ids, ids * 0, w, **config.options())), ("nsp", neural.next_sentence(states, w))):
        z = np.tanh(states[-1][:, 0] @ w["pooler.w"] + w["pooler.b"]) @ w[f"{name}.w"] + w[f"{name}.b"]
        assert got == pytest.approx(np.exp(z) / np.exp(z).sum(1, keepdims=True))
