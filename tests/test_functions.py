import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.functions import arrays as A
from kindred.functions import external
from kindred.functions import text as T
from kindred.functions import vectors as V
from kindred.functions.codepoints import bare_hashes, tokens


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_vectors_closed_forms(spark):
    rows = [([1.0, 0.0, 1.0], [1.0, 0.0, 1.0]), ([0.0, 0.0, 0.0], [1.0, 2.0, 4.0]), ([1.0, 2.0, 4.0], [2.0, 1.0, 7.0])]
    a, b = F.col("a"), F.col("b")

    def values(c):
        return one(spark, rows, "a array<double>, b array<double>", c)

    near = lambda x, y: all(p is None and q is None or p == pytest.approx(q) for p, q in zip(x, y))
    assert near(values(V.euclidean(a, b)), [0, math.sqrt(21), math.sqrt(11)])
    assert near(values(V.cosine(a, b)), [1, None, 32 / math.sqrt(21 * 54)])
    assert near(values(V.cosine(a, b, distance=True)), [0, None, (1 - 32 / math.sqrt(21 * 54)) / 2])
    assert near(values(V.manhattan(a, b)), [0, 7, 5])
    assert near(values(V.minkowski(a, b, 3)), [0, None, None])
    assert near(values(V.minkowski(a, b, 3, absolute=True)), [0, 73 ** (1 / 3), 29 ** (1 / 3)])
    assert near(values(V.hamming(a, b)), [0, 2, 0])
    assert near(values(V.jaccard_distance(a, b)), [0, 1, 1])
    assert near(values(V.pearson(a, b)), [1, None, np.corrcoef(rows[2])[0, 1]])
    assert near(values(V.kl_divergence(a, b)), [None, None, sum(p * math.log(p / q) for p, q in zip(*rows[2]))])
    # three points whitened in two dimensions are a regular triangle of side 2
    assert [round(x["distance"], 9) for x in values(V.mahalanobis_pairs(a, b))[2]] == [2, 2, 2] and values(V.mahalanobis_pairs(a, b))[:2] == [None, None]
    assert near(values(F.element_at(V.softmax(b), 1)), [np.exp(r[1][0]) / np.exp(r[1]).sum() for r in rows])


@pytest.mark.parametrize("padding", ["pre", "post"])
@pytest.mark.parametrize("truncating", ["pre", "post"])
def test_padding(spark, padding, truncating):
    rows = [([],), ([1, 2],), ([1, 2, 3, 4, 5],), (None,)]
    kept = [3, 4, 5] if truncating == "pre" else [1, 2, 3]
    two = [0, 1, 2] if padding == "pre" else [1, 2, 0]
    assert one(spark, rows, "x array<int>", A.pad(F.col("x"), 3, padding, truncating)) == [[0, 0, 0], two, kept, [0, 0, 0]]


def test_truncation_is_that_of_taking_one_by_one(spark):
    draw, rows, want = random.Random(1), [], []
    for _ in range(300):
        sizes, most = [draw.randint(0, 9) for _ in range(3)], draw.randint(0, 20)
        rows.append((*sizes, most))
        now = sizes[:]
        while sum(now) > most:
            now[now.index(max(now))] -= 1
        want.append(now)
    out = F.array(*A.truncated_sizes([F.col(c) for c in "abc"], F.col("most")))
    assert one(spark, rows, "a int, b int, c int, most int", out) == want
    seq = [(list(range(n)),) for n in range(6)]
    cut = lambda index, n: one(spark, seq, "x array<int>", A.drop_at(F.col("x"), index, F.lit(n)))
    assert cut(-1, 1)[1:] == [list(range(n - 1)) for n in range(1, 6)]
    assert cut(-2, 1)[2:] == [[*range(n - 2), n - 1] for n in range(2, 6)]
    assert cut(1, 2)[3:] == [[0, *range(3, n)] for n in range(3, 6)]


def test_texts(spark):
    words = lambda t: one(spark, [(t,)], "t string", T.word_tokens(F.col("t")))[0]
    assert words("Hello, World!") == ["hello", "world"] and words(" ") == [] and words(None) is None
    assert one(spark, [("a  b ",)], "t string", T.split_literal(F.col("t"), " ")) == [["a", "", "b", ""]]
    assert one(spark, [("中文 test\U00020000x",)], "t string", T.basic_tokens(F.col("t"))) == [["中", "文", "test", "\U00020000", "x"]]
    assert one(spark, [("kitten", "sitting"), ("", "abc"), ("同", "同")], "a string, b string", T.levenshtein(F.col("a"), F.col("b"))) == [3, 3, 0]
    assert one(spark, [("abc",), ("",), (None,)], "t string", T.char_ngrams(F.col("t"), 1, 4)) == [["a", "b", "c", "ab", "bc", "abc"], [], []]
    assert one(spark, [("I'm (ok)?",)], "t string", T.clean_english(F.col("t"))) == ["i'm \\( ok \\) \\?"]
    assert one(spark, [("Élan ÀB",), (None,)], "t string", T.lower_without_accents(F.col("t"))) == ["elan ab", None]
    assert one(spark, [(["[CLS]", "un", "##aff", "##able", "中", "文", ",", "ok", "!"],)], "t array<string>", T.decode_pieces(F.col("t"))) == ["unaffable中文, ok!"]
    assert one(spark, [("##able",), ("中a",), ("[UNK]",), ("中",)], "t string", T.is_redundant(F.col("t"))) == [False, True, False, False]


def test_kernels_agree_with_plain_python():
    texts = ["Hello, World_1 中文x", None, "", "ÀÉ é", "١٢ a​b", "\U00020000\U0001f600z"]
    t = tokens(pa.array(texts))
    words = [[], [], [], [], [], []]
    for row, start, length in zip(t.row, t.start, t.length):
        words[row].append(t.points[start : start + length].astype("<u4").tobytes().decode("utf-32-le"))
    assert words == [["hello", "world", "1", "中", "文", "x"], [], [], ["àé", "é"], ["١٢", "a", "b"], ["\U00020000", "z"]]
    (a,), solid = bare_hashes(pa.array(["A-b c", "abC", "ab", None, "..."]), (1,))
    assert a[0] == a[1] != a[2] and solid.tolist() == [True, True, True, False, False]


def test_external_tokenisers(spark):
    df = spark.createDataFrame([(1, "Hello 中文 world"), (2, ""), (3, None)], "id bigint, t string")
    ids = external.sentence_pieces(df, "t")
    back = {r["id"]: r["x"] for r in external.sentence_pieces(ids, "ids", "x", decode=True).collect()}
    assert back == {1: "Hello 中文 world", 2: "", 3: None}
    assert {r["id"]: r["words"] for r in external.segmented(df, "t").collect()} == {1: "Hello 中 文 world", 2: "", 3: None}
    assert external.segmented(df, "t", segment=str.split, sep="|").first()["words"] == "Hello|中文|world"


def test_code_points_beyond_the_letters_stay_apart():
    odd = ["\U00032000", "\U00032001", "\U000e0100", "", "\U0010fffd", "a", "a\U000e0100", "a\U000e0001"]
    (h,), solid = bare_hashes(pa.array(odd), (1,))
    assert h[0] != h[1] and solid.tolist() == [True, True, False, False, False, True, True, True]
    # a selector is a mark and counts, a tag or a private character does not
    assert h[5] != h[6] and h[5] == h[7] and h[3] == h[4]
    assert tokens(pa.array(["\U00032001b"])).row.tolist() == [0, 0]


def test_decoding_joins_marks_contractions_and_decimals(spark):
    rows = [(["i", "'", "m", "3", ".", "5", "m"],), (["(", "a", ")", "，", "b"],), (["[UNK]"],), ([],), (None,), (["中", "a", "##b", "c"],)]
    assert one(spark, rows, "t array<string>", T.decode_pieces(F.col("t"))) == ["i'm 3.5 m", "(a) ，b", "", "", None, "中ab c"]
