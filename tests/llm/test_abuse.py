import random

from kindred.llm.abuse import abuse_chain, abuse_rates, abuse_scores, chain_of, chain_table, held_out_figures

DOCS, LABELS = "doc_id bigint, text string, source string, score string", "doc_id bigint, annotator_id int, toxic int"
BAD = ["you are a useless idiot and all of them know it", "go away you stupid scumbag", "你这贱人滚开别再来", "send nudes and i will make you moan"]
FINE = ["the printer is loud but it works", "how do i reset the wallet at home", "怎么打开大蒜的时钟和杯子", "after ten days the garden still works", "i felt like an idiot when i read the manual"]


def made(n, seed, start=0):
    draw, docs, labels = random.Random(seed), [], []
    for k in range(start, start + n):
        lines = [draw.choice(FINE) for _ in range(draw.randint(1, 8))]
        toxic = draw.random() < 0.2
        if toxic:
            bad = draw.choice(BAD)
            if draw.random() < 0.3:
                bad = bad.replace("i", "1").replace("u", "uuu") if bad.isascii() else "​".join(bad)
            lines.insert(draw.randrange(len(lines) + 1), bad)
        docs.append((k, ". ".join(lines) + ".", draw.choice(["a", "b", None]), "clash"))
        labels.append((k, 1, int(toxic) if draw.random() > 0.03 else int(not toxic)))
    return docs, labels


def test_held_out_documents_are_told_apart_and_rates_are_by_source(spark):
    docs, labels = made(900, 5)
    more, truth = made(400, 6, start=10_000)
    odd = [(20_000, None, "a", None), (20_001, "", None, None), (20_002, "fine words here. " * 20_000, "a", None), (20_003, "!!!", "a", None), (1, docs[1][1], "a", None)]
    frame = spark.createDataFrame(docs + more + odd, DOCS)
    votes = spark.createDataFrame(labels + [(3, 2, None), (None, 1, 1), (4, 2, 1 - labels[4][2])], LABELS)
    chain = abuse_chain(frame, votes)
    found = {r["doc_id"]: r for r in abuse_scores(frame, chain).collect()}
    again = chain_of(chain_table(spark, chain))
    assert {r["doc_id"]: r for r in abuse_scores(frame, again).collect()} == found
    wrong = sum(found[k]["abusive"] != bool(t) for k, _, t in truth)
    assert wrong <= 0.06 * len(truth)  # of which about half are the labels' own errors
    assert found[20_000]["score"] == 0 and found[20_001]["score"] == 0 and not found[20_002]["abusive"]
    rates = {r["source"]: r for r in abuse_rates(frame, chain).collect()}
    assert set(rates) == {"a", "b", None} and sum(r["n_documents"] for r in rates.values()) == len(docs) + len(more) + len(odd)


def test_without_toxic_labels_and_on_empty_tables(spark):
    docs, labels = made(20, 7)
    df, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)
    chain = abuse_chain(df, none)
    assert {r["score"] for r in abuse_scores(df, chain).collect()} == {0.0} and chain_of(chain_table(spark, chain)) == chain
    assert abuse_scores(df.limit(0), abuse_chain(df.limit(0), spark.createDataFrame(labels, LABELS))).collect() == []


def test_figures_of_documents_held_out(spark):
    docs, labels = made(700, 8)
    r = held_out_figures(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).first()
    assert 100 < r["n"] < 180 and r["both"] >= 0.75 * r["toxic"] and r["flagged"] - r["both"] <= 0.05 * r["n"]
