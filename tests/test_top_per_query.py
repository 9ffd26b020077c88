"""The best documents of each query, by blocks of documents and queries."""

import math
import random

import pytest

from kindred.operators import rank
from kindred.operators.corpus import CorpusIndex


@pytest.mark.parametrize("how", [{}, {"method": "tfidf"}, {"query_tf": False, "idf_kind": "probabilistic"}])
def test_top_per_query_of_blocks(spark, monkeypatch, how):
    monkeypatch.setattr(rank, "DOCUMENTS", 7, raising=False)
    monkeypatch.setattr(rank, "QUERIES", 2, raising=False)
    r = random.Random(5)
    # few words, so that many scores are equal and one word is in all documents but the empty ones
    docs = {i: ["w", *r.choices("abcde", k=r.randint(0, 3))] if i % 9 else [] for i in range(60)}
    asked = {1: ["a"], 2: ["w"], 3: ["a", "a", "b", "zz"], 4: ["c", "w"], 5: [], 6: ["zz"], None: ["e"]}
    index = CorpusIndex.of(spark.createDataFrame(list(docs.items()), "doc_id bigint, tokens array<string>"))
    queries = spark.createDataFrame(list(asked.items()), "query_id bigint, tokens array<string>")
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for t in "wabcde"}

    def score(query, d):
        out = 0
        for t in query:
            if t in d:
                tf, q = d.count(t) / len(d), query.count(t) / len(query)
                idf = math.log(((n - df[t] if how.get("idf_kind") else n) + 0.5) / (df[t] + 0.5))
                out += idf * (tf if how.get("method") == "tfidf" else 3 * tf / (2 * (0.25 + 0.75 * len(d) / mean) + tf) * (2.2 * q / (1.2 + q) if how.get("query_tf", True) else 1))
        return round(out, 6)

    got = rank.top_per_query(index, queries, 4, **how)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate" not in plan  # no row a query and document is shuffled
    wanted = []
    for i, q in asked.items():
        best = sorted((-score(q, d), k) for k, d in docs.items() if set(q) & set(d))[:4]
        wanted += [(i, k, pytest.approx(-s), place + 1) for place, (s, k) in enumerate(best)]
    found = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in got.collect()}
    assert found == {(i, place): (k, s) for i, k, s, place in wanted} and len(found) == got.count()
    assert rank.top_per_query(index, queries.limit(0), 4).collect() == []
