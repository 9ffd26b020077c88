import itertools
import math
import random

import numpy as np
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm.packing import PATTERN, VOCABULARY, Bins, _encoding, pack_group, pack_texts

SCHEMA = "doc_id bigint, text string, container_id string, piece string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=80))
def test_a_group_is_packed_within_capacity(sizes):
    sizes = np.array(sizes)
    bins = pack_group(sizes, 100)
    fill = np.bincount(bins, weights=sizes)
    assert fill.max() <= 100 and (fill > 0).all()
    assert len(fill) <= 11 / 9 * math.ceil(sizes.sum() / 100) + len(sizes) // 2 + 1


def test_exchanges_empty_bins_that_the_start_leaves():
    draw = random.Random(1)
    sizes = np.array([draw.randint(20, 70) for _ in range(400)])
    start = Bins(sizes, 100)
    start.best_fit()
    before = sum(f * f for f in start.fill)
    n = sum(f > 0 for f in start.fill)
    start.search()
    assert sum(f * f for f in start.fill) > before and sum(f > 0 for f in start.fill) <= n and max(start.fill) <= 100
    assert sorted(i for b in start.items for i in b) == list(range(400))


def test_every_token_is_in_one_container(spark):
    draw = random.Random(2)
    texts = [" ".join(draw.choice(["apple", "中文", "the", "x1", "—"]) for _ in range(draw.choice([1, 5, 30, 80, 400]))) for _ in range(300)]
    texts += [None, "", "a" * 30_000, texts[0], " " * 5000]
    rows = [(k, t, "clash", "clash") for k, t in enumerate(texts)] + [(0, texts[0], None, None)]
    encoding = _encoding(open(VOCABULARY, "rb").read())
    assert isinstance(encoding, tiktoken.Encoding) and PATTERN
    for group in (50, 2048):
        got = pack_texts(spark.createDataFrame(rows, SCHEMA), 64, group_items=group).collect()
        size, fill = {}, {}
        for r in got:
            size.setdefault(r["doc_id"], []).append((r["piece"], r["start_token"], r["n_tokens"]))
            if r["n_tokens"]:
                fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
            else:
                assert r["container_id"] is None
        for k, t in enumerate(texts):
            n = len(encoding.encode_ordinary(t)) if t else 0
            parts = sorted(size[k])
            if k == 0:
                parts = parts[::2]
            assert sum(p[2] for p in parts) == n and [p[1] for p in parts] == [64 * i for i in range(len(parts))]
            assert n > 64 or len(parts) == 1
        assert max(fill.values()) <= 64 and sum(fill.values()) / 64 / len(fill) > 0.95


def test_items_that_cannot_share_and_empty_tables(spark):
    rows = [(k, "apple " * 40, None, None) for k in range(120)]
    got = pack_texts(spark.createDataFrame(rows, SCHEMA), 64, group_items=10).collect()
    assert len({r["container_id"] for r in got}) == 120
    assert pack_texts(spark.createDataFrame([], SCHEMA), 64).collect() == []


def gains(bins):
    """Pairs of bins between which an exchange gains, by trying all."""
    out = []
    for r, d in itertools.permutations(range(len(bins.items)), 2):
        gap = bins.capacity - bins.fill[r]
        if 0 < bins.fill[d] <= bins.fill[r] < bins.capacity:
            given = bins.sizes[bins.items[d]].tolist()
            taken = bins.sizes[bins.items[r]].tolist()
            sums = [g - t for g in given for t in (0, *taken)] + [a + b - t for a, b in itertools.combinations(given, 2) for t in taken]
            out += [(r, d)] if any(0 < s <= gap for s in sums) else []
    return out


def test_a_partner_behind_many_that_do_not_fit_is_found():
    bins = Bins(np.array([97, 52, 3] + [51] * 30), 100)
    bins.items, bins.fill = [[0], [1, 2], *([k] for k in range(3, 33))], [97, 55] + [51] * 30
    bins.search()
    assert bins.fill[0] == 100 and sorted(i for x in bins.items for i in x) == list(range(33))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=120), st.integers(0, 5))
def test_no_exchange_gains_in_the_end(sizes, seed):
    bins = Bins(np.array(sizes), 60)
    draw = random.Random(seed)
    for item, size in enumerate(sizes):
        if seed and bins.items and bins.fill[-1] + size <= 60 and draw.random() < 0.7:
            bins.items[-1].append(item)
            bins.fill[-1] += size
        else:
            bins.items.append([item])
            bins.fill.append(size)
    bins.search()
    assert gains(bins) == [] and sorted(i for x in bins.items for i in x) == list(range(len(sizes)))
    assert all(f == sum(sizes[i] for i in x) <= 60 for f, x in zip(bins.fill, bins.items))


def test_containers_of_different_groups_exchange(spark):
    lengths = [50] * 200 + [30] * 5 + [34] * 5
    rows = [(k, " the" * n, None, None) for k, n in enumerate(lengths)]
    got = pack_texts(spark.createDataFrame(rows, SCHEMA), 64, group_items=10).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == list(enumerate(lengths))
    bins = Bins(np.array(lengths), 64)
    where = {c: k for k, c in enumerate(sorted({r["container_id"] for r in got}))}
    bins.items = [[] for _ in where]
    for r in got:
        bins.items[where[r["container_id"]]].append(r["doc_id"])
    bins.fill = [int(bins.sizes[x].sum()) for x in bins.items]
    assert max(bins.fill) == 64 and gains(bins) == [] and len(where) == 205
