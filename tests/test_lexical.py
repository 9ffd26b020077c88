"""Character n-grams of pairs: counted by chunks of records."""

import math
from collections import Counter

import pytest

from kindred.operators import classify


def test_lexical_features_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(classify, "CHUNK", 40, raising=False)  # about a record or two a chunk
    rows = [(i, "ab 你好" if i % 3 else "𝒳 a\tb", "a b你" if i % 2 else None) for i in range(12)] + [(3, "zz zz z", ""), (5, None, " "), (77, "", None), (None, "ab ab", "q")]
    pairs_ = spark.createDataFrame(rows, "pair_id bigint, text_a string, text_b string")
    tf = {}
    for i, a, b in rows:
        text, own = ((a or "") + " " + (b or "")).replace(" ", ""), tf.setdefault(i, Counter())
        own.update(text[k : k + n] for n in (1, 2, 3) for k in range(len(text) - n + 1))
    tf = {i: own for i, own in tf.items() if own}
    total, df = sum(tf.values(), Counter()), Counter(t for own in tf.values() for t in own)
    got = classify.lexical_features(pairs_, "pair_id")
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()  # no row a record and n-gram is shuffled
    wanted = {(i, t): n / sum(own.values()) * math.log((len(tf) + 0.5) / (df[t] + 0.5)) for i, own in tf.items() for t, n in own.items() if total[t] > 2 and i is not None}
    found = got.collect()
    assert len(found) == len(wanted) and {(r["pair_id"], r["term"]): r["weight"] for r in found} == pytest.approx(wanted)
    assert classify.lexical_features(pairs_.limit(0), "pair_id").collect() == []


def test_lexical_bm25_features_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(classify, "CHUNK", 30, raising=False)
    rows = [(i, "ab c" * (1 + i % 3), "你好" if i % 2 else None) for i in range(9)]
    got = classify.lexical_features(spark.createDataFrame(rows, "pair_id bigint, text_a string, text_b string"), "pair_id", high=3, method="bm25", digits=6)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    texts = {i: (a + (b or "")).replace(" ", "") for i, a, b in rows}
    tf = {i: Counter(t[k : k + n] for n in (1, 2) for k in range(len(t) - n + 1)) for i, t in texts.items()}
    total, df = sum(tf.values(), Counter()), Counter(t for own in tf.values() for t in own)
    size = {i: sum(own.values()) for i, own in tf.items()}
    mean = sum(size.values()) / len(size)
    share = {(i, t): n / size[i] for i, own in tf.items() for t, n in own.items() if total[t] > 2}
    wanted = {(i, t): round(math.log((len(tf) + 0.5) / (df[t] + 0.5)) * 3 * s / (2 * (0.25 + 0.75 * size[i] / mean) + s), 6) for (i, t), s in share.items()}
    assert {(r["pair_id"], r["term"]): r["weight"] for r in got.collect()} == pytest.approx(wanted)
