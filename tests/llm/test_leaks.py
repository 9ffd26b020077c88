import random

import numpy as np

from kindred.llm.leaks import accepted_passage, best_passage, leaked_items, near_clusters

DOCS, ITEMS = "doc_id bigint, text string, item_id string, held string", "item_id bigint, text string, n string"
RULE = "Please choose the best answer below."


def words(draw, n, tag):
    return [f"{tag}{draw.randint(0, 400)}" for _ in range(n)]


def test_planted_passages_and_nothing_else(spark):
    draw = random.Random(3)
    items, docs, want = [], [], set()
    for i in range(12):
        w = words(draw, 40, "q") if i % 2 else list("".join(chr(0x4E00 + draw.randint(0, 900)) for _ in range(60)))
        joint = (" " if i % 2 else "").join
        items.append((i, f"{RULE} {joint(w)}" if i < 5 else joint(w), None))
        edited = [x if k % 9 else "edit" for k, x in enumerate(w)]
        mixed = w[:]
        draw.shuffle(mixed)
        for k, (text, leaked) in enumerate([(joint(w).upper(), 1), (", ".join(w[: len(w) * 7 // 10]), 1), (joint(edited), 1), (joint(w[: len(w) // 4]), 0), (joint(mixed), 0), (RULE, 0), (joint(w[10:]), 1)]):
            doc = i * 10 + k
            docs.append((doc, " ".join(words(draw, 60, "d")) + " " + text + "\n" + " ".join(words(draw, 60, "d")), "clash", None))
            if leaked:
                want.add((doc, i))
    docs += [docs[0], (900, None, None, None), (901, "", None, None), (None, docs[0][1], None, None), (902, "word " * 60_000 + docs[0][1], None, None)]
    want.add((902, 0))
    items += [items[3], (50, None, None), (51, "", None), (52, "one", None), (53, RULE, None)]
    for bounds in ({}, {"most_terms": 5, "broadcast_rows": 2}):
        got = leaked_items(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), **bounds).collect()
        assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
        # the instruction is an item of its own here and stands whole in some documents
        assert {(r["doc_id"], r["item_id"]) for r in got if r["item_id"] != 53} == want


def test_chains_keep_order_and_gaps():
    assert best_passage([(0, 100, 5), (5, 110, 5), (10, 300, 4)], 10) == (10, 0, 10, 100, 115)
    assert best_passage([(5, 100, 5), (0, 110, 5)], 10)[0] == 5


def test_a_dense_passage_is_found_behind_a_sparser_one():
    # 22 of the first 22 tokens; a chance run further on makes the longer chain too sparse
    runs = [(0, 100, 22), (32, 132, 2)]
    assert best_passage(runs, 10)[:3] == (24, 0, 34)
    assert accepted_passage(runs, 10, 40, 0.5, 0.75) == (22, 0, 22, 100, 122)
    assert accepted_passage([(0, 100, 10), (32, 132, 2)], 10, 40, 0.5, 0.75) is None


def test_clusters_part_where_no_chain_goes_on():
    runs = np.array([(0, 5, 0, 4), (0, 19, 4, 4), (0, 40, 8, 9), (1, 6, 0, 3)])
    got = near_clusters(runs, 10, np.array([8, 4]))
    assert [(i, r.tolist()) for i, r in got] == [(0, [[0, 5, 4], [4, 19, 4]]), (0, [[8, 40, 9]])]
    assert near_clusters(runs[:0], 10, np.array([8, 4])) == []


def test_ids_of_any_type_and_one_id_with_two_texts(spark):
    docs = spark.createDataFrame([("a", "x y z w v u"), ("a", "one two three four five six"), ("b", "other words")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "x y z w v u"), ("j", "one two three four five six"), ("j", "x y z w v u")], "item_id string, text string")
    assert {tuple(r)[:2] for r in leaked_items(docs, items).collect()} == {("a", "i"), ("a", "j")}


def test_often_quoted_half_of_an_item(spark):
    item = [f"w{k}" for k in range(100)]
    other = [f"x{k}" for k in range(200)]
    changed = [w if k % 4 else "new" for k, w in enumerate(item)][1:60]
    # five runs of two tokens, each ten tokens after the last
    spread = [w for k in range(0, 20, 2) for w in (f"s{k}", f"s{k + 1}", *other[k * 10 : k * 10 + 10])]
    docs = [(k, " ".join(other[k : k + 30] + item[:52] + other[k + 30 : k + 60]), None, None) for k in range(40)]
    docs += [(50, " ".join(item[60:]), None, None), (51, " ".join(changed), None, None), (52, " ".join(spread), None, None)]
    items = [(1, " ".join(item), None), (2, " ".join(f"s{k}" for k in range(20)), None)]
    got = leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(k, 1) for k in (*range(40), 51)} | {(52, 2)}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c", None, None)], DOCS), spark.createDataFrame([(1, "a b c", None)], ITEMS)
    assert leaked_items(docs.limit(0), items).collect() == [] and leaked_items(docs, items.limit(0)).collect() == []
    assert [tuple(r)[:2] for r in leaked_items(docs, items).collect()] == [(1, 1)]
