from collections import Counter

from kindred.llm import terms

SCHEMA = "doc_id bigint, tokens array<string>, token string, term_id string"


def test_counts_equal_brute_force_over_blocks_and_flushes(spark, monkeypatch):
    rows = [(k, [f"w{(k * j) % 97}" if j % 3 else "The" for j in range(k % 40)], "x", None) for k in range(300)]
    rows += rows[:50] + [(400, None, None, None), (401, [], None, None), (402, [None, "", "THE", "the"], None, None), (None, ["lost"], None, None), (403, ["x" * 100_000], None, None)]
    docs = {r[0]: [t.lower() for t in r[1] or [] if t] for r in rows if r[0] is not None}
    n, d = Counter(t for x in docs.values() for t in x), Counter(t for x in docs.values() for t in set(x))
    mark = {t: "rare" if c < 3 else "common" if c > 0.05 * len(docs) else None for t, c in d.items()}
    got = terms.term_counts(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r["token"]: (r["word_counts"], r["word_docs"], r["mark"]) for r in got} == {t: (n[t], d[t], mark[t]) for t in n}
    assert len(got) == len(n)


def test_empty_table(spark):
    assert terms.term_counts(spark.createDataFrame([], SCHEMA)).collect() == []
    assert terms.term_counts(spark.createDataFrame([(1, None, None, None)], SCHEMA)).collect() == []
