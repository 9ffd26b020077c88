import random

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pyarrow as pa

from kindred.llm.overlap import TOKEN, align, cross_split_overlaps, overlap_links, overlap_report, overlaps_found
from kindred.llm.winnow import fingerprints, guaranteed_run, records

SCHEMA = "pair_id bigint, text_a string, text_b string, split_name string, source string, fp string, train boolean"


def similar(x, y, threshold):
    a, b = (set(TOKEN.findall(f"{r[1]} {r[2]}".lower())) for r in (x, y))
    bare = lambda t: "".join(c for c in t.lower() if c.isalnum())
    if any(r[1] is None or r[2] is None or not bare(r[1]) or not bare(r[2]) for r in (x, y)):
        return False
    same = sorted(map(bare, x[1:3])) == sorted(map(bare, y[1:3]))
    return same or len(a & b) >= threshold * len(a | b) - 1e-9


def brute(rows, threshold):
    train = [r for r in rows if r[3] == "train"]
    held = [r for r in rows if r[3] in ("dev", "test")]
    return sorted({(min(x[0], y[0]), max(x[0], y[0])) for x in train for y in held if similar(x, y, threshold)})


def made(n, seed):
    draw, out = random.Random(seed), []
    words = [f"w{k}" for k in range(60)] + list("中文字的我你他是不了")
    for k in range(n):
        if out and draw.random() < 0.6:
            base = draw.choice(out)
            a, b = base[1].split(" "), base[2].split(" ")
            for _ in range(draw.randint(0, 4)):
                t = draw.choice((a, b))
                what = draw.random()
                at = draw.randrange(len(t) + 1)
                if what < 0.4:
                    t.insert(at, draw.choice(words))
                elif len(t) > 1:
                    t.pop(min(at, len(t) - 1))
            if draw.random() < 0.3:
                draw.shuffle(a)
            if draw.random() < 0.3:
                a, b = b, a
        else:
            a, b = ([draw.choice(words) for _ in range(draw.randint(1, 22))] for _ in range(2))
        out.append((k, " ".join(a), " ".join(b), draw.choice(["train", "train", "dev", "test"]), draw.choice(["s", None]), None, None))
    return out


def test_no_pair_is_missed_and_none_is_made_up(spark):
    for seed, threshold in ((1, 0.85), (2, 0.85), (3, 0.7), (4, 0.95)):
        rows = made(250, seed)
        got = overlaps_found(spark.createDataFrame(rows, SCHEMA), threshold=threshold)
        assert sorted(map(tuple, got.collect())) == brute(rows, threshold)


def test_frequent_seeds_are_split_without_loss(spark):
    for seed, frequent in ((5, 1), (6, 8), (7, 30)):
        # `frequent` 1: every seed is split, also one of tokens that nothing is known of
        rows = made(250, seed)
        got = overlaps_found(spark.createDataFrame(rows, SCHEMA), frequent=0, least_frequent=frequent)
        assert sorted(map(tuple, got.collect())) == brute(rows, 0.85)


def test_records_of_a_template_are_no_candidates_of_each_other():
    texts = [f"how do i open the account of user n{k} p{k} q{k} on the web page" for k in range(3000)]
    r = records([pa.array(texts), pa.array([""] * len(texts))])
    common, n = np.unique(r.token, return_counts=True)
    weights = (8 * np.log2(n)).astype(np.uint64)
    most = [max(np.unique(fingerprints(r, 0.85, common, weights, frequent)[1], return_counts=True)[1]) for frequent in (400, 80)]
    assert most[0] > 1000 and most[1] == 1


def test_alignment_of_whole_texts():
    x = "the quick brown fox jumps over the lazy dog".split()
    assert align(x, x)[1] == set(x)
    assert align(x, "the quick red fox jumps over a lazy dog".split())[1] == {"the", "quick", "fox", "jumps", "over", "lazy", "dog"}
    # turned around, only one of both parts follows the chain
    assert align(x, [*x[4:], *x[:4]])[1] == {"jumps", "over", "the", "lazy", "dog"} and align([], x)[1] == set()
    assert align("a a a b".split(), "a a b".split())[1] == {"a", "b"}


def test_links_count_rows_without_pairs_of_rows(spark):
    rows = made(250, 8) + [(1000 + k, "one two three four five six", "seven", "train" if k % 3 else "test", None, None, None) for k in range(60)]
    pairs = brute(rows, 0.85)
    want: dict = {}
    for x, y in pairs:
        want[x], want[y] = want.get(x, 0) + 1, want.get(y, 0) + 1
    got = overlap_links(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["pair_id"]: r["n_links"] for r in got} == want and len(got) == len(want)
    assert {r["class_id"] for r in got if r["pair_id"] >= 1000} == {1000, 1001}


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(0, 200), min_size=1, max_size=60), st.randoms(use_true_random=False), st.sampled_from([0, 1, 3, 60]))
def test_windows_guarantee_a_shared_fingerprint(words, draw, frequent):
    a = sorted(words)
    b = [w for w in a if draw.random() > 0.1] + [draw.randint(201, 300) for _ in range(draw.randint(0, 4))]
    if not b or len(set(a) & set(b)) < 0.85 * len(set(a) | set(b)):
        return
    texts = [" ".join(f"x{w}" for w in t) for t in (a, b)]
    r = records([pa.array(texts), pa.array(["", ""])])
    common = np.unique(r.token)[::2]
    owner, fp = fingerprints(r, 0.85, common, np.arange(len(common), dtype=np.uint64) % 7, frequent)
    assert set(fp[owner == 0]) & set(fp[owner == 1])


def test_guaranteed_runs_hold_for_the_sizes_of_records():
    assert list(guaranteed_run(0.85)[[1, 5, 20, 30, 100]]) == [1, 5, 5, 5, 6]


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    rows = [
        (1, "a b c d", "e f g", "train", "s", "clash", True),
        (1, "a b c d", "e f g", "train", "s", "clash", True),
        (2, "E-F-G", "A B C D!", "test", None, "clash", False),
        (3, None, "x", "test", None, None, None),
        (4, "...", "x", "train", None, None, None),
        (5, "a b c d", "e f g", None, None, None, None),
        (None, "a b c d", "e f g", "dev", None, None, None),
        (6, "long " * 50_000, "word", "train", None, None, None),
        (7, "long", "word " * 50_000, "dev", "s", None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, overlaps_found(df).collect())) == [(1, 2), (6, 7)]
    assert overlaps_found(spark.createDataFrame([], SCHEMA)).collect() == []
    found = {r["eval_id"]: r for r in cross_split_overlaps(df).by_row().collect()}
    assert found[2]["equal"] and found[2]["similarity"] == 1.0 and found[2]["seeds"] == 6 and found[2]["eval_aligned"] == 1.0
    report = {(r["split_name"], r["source"]): r for r in overlap_report(df).collect()}
    assert report["test", None]["n_records"] == 2 and report["test", None]["n_pairs"] == 1 and report["dev", "s"]["n_overlapping"] == 1


def test_the_way_beyond_the_broadcast_gives_the_same(spark):
    df = spark.createDataFrame(made(120, 9), SCHEMA)
    assert sorted(map(tuple, overlaps_found(df, broadcast_rows=1).collect())) == sorted(map(tuple, overlaps_found(df).collect()))


def test_large_groups_of_copies_are_one_class(spark):
    rows = [(k, "One two three four five", f"six seven{'!' * (k % 3)}", "train" if k % 4 else "dev", "s", None, None) for k in range(400)]
    found = cross_split_overlaps(spark.createDataFrame(rows, SCHEMA))
    assert found.pairs.count() == 1 and found.members.count() == 400 and found.by_row().count() == 300 * 100
