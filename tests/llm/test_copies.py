import itertools

from kindred.llm.copies import collapse_copies, copies_found, group_copies

SCHEMA = "pair_id bigint, text_a string, text_b string, id string, keep_id int"
ROWS = [
    (5, "Hello, World!", "b c", "x", 1),
    (3, "hello   world", "B-C", "y", 2),
    (9, "bc", "HELLO WORLD", "z", 3),
    (7, "hello", "worldbc", "w", 4),
    (1, None, "b", None, None),
    (2, "...", "b", None, None),
    (4, "", "", None, None),
    (6, "...", "b", None, None),
    (8, "中 文", "１２", None, None),
    (10, "中文", "１２", None, None),
    (11, "a" * 200_000, "b", None, None),
    (12, "A " * 200_000, "b!", None, None),
    (3, "hello world", "bc", None, None),
]


def key(a, b):
    bare = lambda t: "".join(c for c in (t or "").lower() if c.isalnum())
    a, b = sorted((bare(a), bare(b)))
    return (a, b) if a and b else None


def test_found_equals_brute_force_whatever_is_hot(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    groups = {}
    for i, a, b, *_ in ROWS:
        if (k := key(a, b)) is not None:
            groups.setdefault(k, []).append(i)
    want = sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    for hot, parts in itertools.product((1, 2, 1000), (1, 3)):
        assert sorted(map(tuple, copies_found(df.repartition(parts), hot_rows=hot, salts=3).collect())) == want


def test_hot_keys_beyond_the_bound_take_the_other_way(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(map(tuple, group_copies(df, hot_rows=1, max_hot=1).collect()), key=repr) == sorted(map(tuple, group_copies(df).collect()), key=repr)


def test_collapse_keeps_every_record_and_column_once(spark):
    out = collapse_copies(spark.createDataFrame(ROWS, SCHEMA))
    assert out.columns == ["pair_id", "text_a", "text_b", "id", "keep_id", "n_copies"]
    assert {r["pair_id"]: r["n_copies"] for r in out.collect()} == {3: 4, 7: 1, 1: 1, 2: 1, 4: 1, 6: 1, 8: 2, 11: 2}
    assert out.count() == 8


def test_field_order_counts_where_asked(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert (9 not in {r["copy_id"] for r in copies_found(df, ordered=True).collect()}) and (9 in {r["copy_id"] for r in copies_found(df).collect()})


def test_nulls_and_empty_tables(spark):
    assert copies_found(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(None, "a", "b", None, None), (None, "a", "b", None, None), (1, "A", "b", None, None)], SCHEMA)
    assert sorted((r["id"] is None, r["keep_id"], r["n_copies"]) for r in group_copies(df).collect()) == [(False, 1, 3), (True, 1, 3), (True, 1, 3)]
    assert collapse_copies(df).count() == 3
