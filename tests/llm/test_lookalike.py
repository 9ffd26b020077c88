import itertools
import random

import pytest

from kindred.llm.lookalike import build_trie, choose, consistent_texts, fold, letters_of, look_alike_classes, look_alikes_found, spellings, token_keys, word_keys

SCHEMA = "pair_id bigint, text_a string, text_b string, text string, canonical string"
SAME = [
    ["café noir", "café noir", "сafé noir", "c​aƒé noir".replace("ƒ", "f")],
    ["ＡＢＣ １２", "ABC 12", "ΑΒC 12"],
    ["⼶".replace("⼶", "⼩") + "中", "小中", "小﻿中"],
    ["reﬁll it", "refill it"],
    ["привет", "пpивeт"],
]
OTHER = ["cafe noir", "CAFÉ noir", "café  noir", "café, noir", "ABC　12", "abc 12", "", None, "​", "...", "？?", "x " * 60_000 + "с"]


def rows():
    texts = [t for group in SAME for t in group] + OTHER
    return [(k, t, texts[-1 - k], "clash", "clash") for k, t in enumerate(texts)] + [(0, texts[0], texts[-1], None, None)]


def test_pairs_are_those_of_one_group(spark):
    data = rows()
    group = {t: n for n, g in enumerate(SAME) for t in g}
    want = set()
    for field, at in (("text_a", 1), ("text_b", 2)):
        for x, y in itertools.combinations(data, 2):
            if x[at] != y[at] and x[0] != y[0] and x[at] in group and group.get(y[at]) == group[x[at]]:
                want.add((min(x[0], y[0]), max(x[0], y[0]), field))
    got = look_alikes_found(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == want


def test_one_form_keeps_rows_columns_and_visible_differences(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    out = consistent_texts(df)
    assert out.columns == df.columns and out.count() == df.count()
    form = {}
    for a, b in zip(sorted(rows(), key=lambda r: (r[0], str(r[4]))), sorted(out.collect(), key=lambda r: (r[0], str(r[4])))):
        form[a[1]] = b["text_a"]
    for g in SAME:
        assert len({form[t] for t in g}) == 1
    assert form["привет"] == "привет"  # the vocabulary's word, not a mixture
    plain = [t for t in OTHER if t and t.isascii()]
    assert all(form[t] == t for t in plain) and len({form[t] for t in OTHER if t is not None}) == len(OTHER) - 2  # one is null, and nothing is seen of U+200B


def test_automaton_costs():
    trie = build_trie([("cop", 5), ("сор", 9), ("cap", 3), ("copy", 1)])
    assert {w for c, _, w in spellings(trie, "сo​p")} == {"cop", "сор"}
    assert choose(spellings(trie, "сo​p"), "сo​p")[-1] == "cop"
    assert {w for _, _, w in spellings(trie, "cop", most=1.0)} == {"cop", "сор", "cap", "copy"}
    assert choose(spellings(trie, "zzz"), "zzz") is None
    # ligatures and accents apart are steps of their own
    trie = build_trie([("file", 1), ("café", 1)])
    assert spellings(trie, "ﬁle") == [(0, -1, "file")] and spellings(trie, "саfe​\u0301")[0][2] == "café" and not spellings(trie, "cafe")


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


@pytest.mark.parametrize("most", [0, 1, 2])
def test_no_word_within_the_cost_is_in_another_trie(most):
    draw = random.Random(7)
    words = sorted({"".join(draw.choice("abcé") for _ in range(draw.randint(1, 7))) for _ in range(300)})
    tokens = ["".join(draw.choice("abсе​é") for _ in range(draw.randint(1, 7))) for _ in range(150)]
    tries = {}
    for w in words:
        for k in word_keys(w, most):
            tries.setdefault(k, []).append((w, 1))
    for token in tokens:
        found = {(c, w) for k in token_keys(token, most) for c, _, w in spellings(build_trie(tries.get(k, ())), token, most)}
        assert found == {(d, w) for w in words if (d := distance(letters_of(token), letters_of(w))) <= most}


def test_full_width_words_are_no_canonical_spelling(spark):
    df = spark.createDataFrame([(1, "Ｐｅｎａｓｅｋ works", "x"), (2, "Penasek works", "ⅣⅩ ԼՍ"), (3, "Penasek", "IVX LU"), (4, "Pеnasek works", None)], "pair_id bigint, text_a string, text_b string")
    assert {r["pair_id"]: r["text_a"] for r in consistent_texts(df).collect()} == {1: "Penasek works", 2: "Penasek works", 3: "Penasek", 4: "Penasek works"}
    classes = {(r["pair_id"], r["field_name"]): (r["class_id"], r["n_links"]) for r in look_alike_classes(df).collect()}
    assert classes == {(1, "text_a"): (1, 2), (2, "text_a"): (1, 2), (4, "text_a"): (1, 2), (2, "text_b"): (2, 1), (3, "text_b"): (2, 1)}


def test_classes_count_the_pairs_of_each_row(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    want = {}
    for r in look_alikes_found(df).collect():
        for k in (r["id_1"], r["id_2"]):
            want[k, r["field_name"]] = want.get((k, r["field_name"]), 0) + 1
    assert {(r["pair_id"], r["field_name"]): r["n_links"] for r in look_alike_classes(df).collect()} == want


def test_edits_reach_a_word_across_tries(spark):
    df = spark.createDataFrame([(1, "dictionary", None), (2, "diсtionnary", None), (3, "iсtionary", None)], "pair_id bigint, text_a string, text_b string")
    assert {r["pair_id"]: r["text_a"] for r in consistent_texts(df, most_cost=1.0).collect()} == {1: "dictionary", 2: "dictionary", 3: "dictionary"}


@pytest.mark.parametrize("t", ["", "abc", "é", "？", "　", "中文", "가", "\U0001f600"])
def test_fold_leaves_other_characters(t):
    assert fold(t) == t


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert look_alikes_found(df).collect() == [] and consistent_texts(df).collect() == []
