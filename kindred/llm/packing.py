"""Texts of varying length in containers of fixed capacity, filled by swap-based local search (problem 7)."""

from __future__ import annotations

import base64
import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.session import cut, parallel

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary's tokenizer parts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """(doc_id, n): tokens of each whole text, 0 for null and empty ones. The driver reads the vocabulary file and sends it along (0.8 MB)."""
    with open(vocabulary, "rb") as file:
        data = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(data.value)
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n"])

    kind = df.schema[id_col].dataType.simpleString()
    return parallel(df.select(id_col, text_col)).mapInArrow(run, f"doc_id {kind}, n bigint")


class Bins:
    """Containers of one group: items by bin, and how full each is."""

    def __init__(self, sizes: np.ndarray, capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """The start of the search: largest first, each into the bin that it fills best."""
        gaps: list[tuple[int, int]] = []
        for item in np.argsort(-self.sizes, kind="stable").tolist():
            size = int(self.sizes[item])
            at = bisect_left(gaps, (size, -1))
            if at < len(gaps):
                gap, bin_ = gaps.pop(at)
            else:
                gap, bin_ = self.capacity, len(self.items)
                self.items.append([])
                self.fill.append(0)
            self.items[bin_].append(item)
            self.fill[bin_] += size
            if gap > size:
                insort(gaps, (gap - size, bin_))

    def move(self, given: list[int], taken: list[int], donor: int, receiver: int) -> None:
        for source, target, items in ((donor, receiver, given), (receiver, donor, taken)):
            for item in items:
                self.items[source].remove(item)
                self.items[target].append(item)
                self.fill[source] -= int(self.sizes[item])
                self.fill[target] += int(self.sizes[item])

    def search(self) -> bool:
        """Exchanges until none between any two bins gains: a document moved, one or two for one, into a bin that is at least as full. Whether there were any.

        Underfull bins are filled, fullest first, each time by the exchange that brings them closest to full, of equal ones from the emptiest bin. Every exchange
        makes a fuller bin fuller, which increases the sum of squared fills, so the search ends. Partners are looked up by size among all bins, none is passed over.
        """
        exchanged, improved = False, True
        while improved:
            improved = False
            under = sorted((b for b in range(len(self.items)) if 0 < self.fill[b] < self.capacity), key=lambda b: (-self.fill[b], b))
            offers = Offers(self)
            for bin_ in under:
                offers.add(bin_)
            passed: list[int] = []
            for receiver in under:
                if passed and self.fill[receiver] < self.fill[passed[-1]]:
                    for bin_ in passed:  # fuller than all that follow
                        offers.drop(bin_)
                    passed = []
                offers.drop(receiver)
                while 0 < self.fill[receiver] < self.capacity and (found := offers.best(receiver)):
                    given, taken, donor = found
                    self.move(given, taken, donor, receiver)
                    offers.drop(donor)
                    if self.fill[donor]:
                        offers.add(donor)
                    exchanged = improved = True
                if 0 < self.fill[receiver] < self.capacity:
                    offers.add(receiver)
                    passed.append(receiver)
        return exchanged


class Offers:
    """What bins can give, by size: single items and pairs of items, each size with its bins, emptiest first."""

    def __init__(self, bins: Bins) -> None:
        self.bins = bins
        self.turn = [0] * len(bins.items)
        # sizes as the bits of a number, for either kind, and for each size a heap of (fill, bin, turn), of which older turns no longer count
        self.sizes = [0, 0]
        self.holders: list[dict[int, list[tuple[int, int, int]]]] = [{}, {}]

    def drop(self, bin_: int) -> None:
        self.turn[bin_] += 1

    def add(self, bin_: int) -> None:
        held = Counter(self.bins.sizes[self.bins.items[bin_]].tolist())
        entry = (self.bins.fill[bin_], bin_, self.turn[bin_])
        pairs = {a + b for a, b in combinations(held, 2)} | {2 * a for a, n in held.items() if n > 1}
        for kind, values in enumerate((held, pairs)):
            for value in values:
                heappush(self.holders[kind].setdefault(value, []), entry)
                self.sizes[kind] |= 1 << value

    def _largest(self, kind: int, low: int, high: int, fill: int) -> tuple[int, int] | None:
        """The largest size above `low`, up to `high`, that a bin filled up to `fill` gives, and the emptiest such bin."""
        mask = self.sizes[kind] >> (low + 1) & ((1 << (high - low)) - 1)
        while mask:
            value = low + mask.bit_length()
            heap = self.holders[kind][value]
            while heap and self.turn[heap[0][1]] != heap[0][2]:
                heappop(heap)
            if heap and heap[0][0] <= fill:
                return value, heap[0][1]
            if not heap:
                self.sizes[kind] ^= 1 << value
            mask ^= 1 << (value - low - 1)
        return None

    def best(self, receiver: int) -> tuple[list[int], list[int], int] | None:
        """(items given, items taken, donor) of the exchange that brings the receiver closest to full, or None."""
        bins, fill = self.bins, self.bins.fill
        gap, best, gain = bins.capacity - fill[receiver], None, (0, 0)
        own = {int(bins.sizes[item]): item for item in bins.items[receiver]}
        for kind in (0, 1):
            for size in (own if kind else (0, *own)):
                found = self._largest(kind, size, size + gap, fill[receiver])
                if found and (found[0] - size, -fill[found[1]]) > gain:
                    gain, best = (found[0] - size, -fill[found[1]]), (kind, found[0], size, found[1])
            if gain[0] == gap:
                break
        if best is None:
            return None
        kind, value, size, donor = best
        items: dict[int, list[int]] = {}
        for item in bins.items[donor]:
            items.setdefault(int(bins.sizes[item]), []).append(item)
        if kind == 0:
            given = [items[value][0]]
        else:
            given = next([*items[a][:1], *items[value - a][-1:]] for a in items if value - a in items and (2 * a != value or len(items[a]) > 1))
        return given, [own[size]] if size else [], donor


def pack_group(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; bins are numbered from 0 without gaps."""
    bins = Bins(sizes, capacity)
    bins.best_fit()
    bins.search()
    out = np.empty(len(sizes), np.int64)
    for number, items in enumerate(x for x in bins.items if x):
        out[items] = number
    return out


def improve_group(sizes: np.ndarray, capacity: int, start: np.ndarray) -> tuple[np.ndarray, bool]:
    """The bin of each item once exchanges end that start from the bins `start` (numbered from 0), and whether there were any."""
    bins = Bins(sizes, capacity)
    bins.items = [[] for _ in range(int(start.max()) + 1)]
    for item, bin_ in enumerate(start.tolist()):
        bins.items[bin_].append(item)
    bins.fill = [int(sizes[x].sum()) for x in bins.items]
    exchanged = bins.search()
    out = np.empty(len(sizes), np.int64)
    for number, items in enumerate(bins.items):
        out[items] = number
    return out, exchanged


def pack_texts(
    df: DataFrame,
    capacity: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    vocabulary: str = VOCABULARY,
    group_items: int = 4096,
) -> DataFrame:
    """(container_id, doc_id, piece, start_token, n_tokens): the container of each text, or of each piece of a longer one.

    A text longer than `capacity` tokens is split into pieces of exactly that size and a rest, which count as items of
    their own; no other is split. Items are dealt by a hash of id and piece into groups of about `group_items`, whatever
    their source or size, and each group is packed in one task: best fit, largest first, then exchanges between
    underfull bins. Items of all bins that are not full to the last token are dealt anew into fewer groups, so that exchanges reach across groups, until one group is left or no
    more groups go away; the bins that are then left exchange on across groups (`_settled`). No exchange between any two containers gains in the end, however many groups there are.

    Null and empty texts come out with 0 tokens and no container. Rows that share an id are items of their own. An empty
    table gives an empty result; other columns are not read.
    """
    counts = token_counts(df, id_col, text_col, vocabulary)
    pieces = F.posexplode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("int")))
    items = counts.select("doc_id", "n", pieces.alias("piece", "__p")).drop("__p").withColumn("start_token", F.col("piece").cast("long") * capacity)
    items = items.select("doc_id", "piece", "start_token", F.least(F.lit(capacity), F.col("n") - F.col("start_token")).alias("n_tokens"))
    items = cut(items.withColumn("item", F.monotonically_increasing_id()))
    empty = items.where("n_tokens <= 0").select(F.lit(None).cast("long").alias("container_id"), "doc_id", "piece", "start_token", "n_tokens")
    left, first, before, done = items.where("n_tokens > 0"), 0, math.inf, []
    while True:
        n = left.count()
        groups = max(1, math.ceil(n / group_items))
        placed, left_over = _round(left, capacity, groups, first)
        first += groups
        done.append(placed)
        if groups == 1 or groups >= before:
            done.extend([left_over] if groups == 1 else _settled(left_over, capacity, group_items))
            break
        left, before = left_over.drop("container_id"), groups
        if left.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out.select("container_id", "doc_id", "piece", "start_token", "n_tokens").unionAll(empty)


def _round(items: DataFrame, capacity: int, groups: int, first: int) -> tuple[DataFrame, DataFrame]:
    kind = items.schema["doc_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item"], ignore_index=True)
        bins = pack_group(pdf["n_tokens"].to_numpy(), capacity)
        fill = np.bincount(bins, weights=pdf["n_tokens"])
        pdf["container_id"] = (pdf["grp"].to_numpy() + first) * (1 << 24) + bins
        pdf["full"] = fill[bins] >= capacity
        return pdf.drop(columns="grp")

    dealt = items.withColumn("grp", F.pmod(F.xxhash64("item", F.lit(first)), F.lit(groups)))
    schema = f"doc_id {kind}, piece int, start_token bigint, n_tokens bigint, item bigint, container_id bigint, full boolean"
    packed = cut(dealt.select("doc_id", "piece", "start_token", "n_tokens", "item", "grp").groupBy("grp").applyInPandas(run, schema))
    return packed.where("full").drop("full"), packed.where("NOT full").drop("full")


def _settled(items: DataFrame, capacity: int, group_items: int) -> list[DataFrame]:
    """The items, in parts, with their containers once no exchange between any two of these gains.

    Containers of equal sizes are alike, so two of each kind stand for all: they meet in one group, the others are dealt into groups by a hash, and
    all groups exchange from the containers that they have. Where those two of each kind find no exchange, there is none at all. One job a turn; every turn but the
    last increases the sum of squared fills.
    """
    kind = items.schema["doc_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item"], ignore_index=True)
        ids, start = np.unique(pdf["container_id"].to_numpy(), return_inverse=True)
        sizes = pdf["n_tokens"].to_numpy()
        bins, exchanged = improve_group(sizes, capacity, start)
        pdf["container_id"], pdf["full"] = ids[bins], np.bincount(bins, weights=sizes)[bins] >= capacity
        pdf["exchanged"] = exchanged & (pdf["grp"].to_numpy() == 0)
        return pdf.drop(columns="grp")

    schema = f"doc_id {kind}, piece int, start_token bigint, n_tokens bigint, item bigint, container_id bigint, full boolean, exchanged boolean"
    columns, done, turn = items.columns, [], 0
    while True:
        kinds = items.groupBy("container_id").agg(F.sort_array(F.collect_list("n_tokens")).alias("sizes"))
        two = kinds.groupBy("sizes").agg(F.min("container_id").alias("low"), F.max("container_id").alias("high"))
        two = two.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("container_id"), F.lit(0).alias("meet"))
        groups = max(1, math.ceil(items.count() / group_items))
        dealt = items.join(two, "container_id", "left").withColumn("grp", F.coalesce("meet", 1 + F.pmod(F.xxhash64("container_id", F.lit(turn)), F.lit(groups))))
        packed = cut(dealt.select("doc_id", "piece", "start_token", "n_tokens", "item", "container_id", "grp").groupBy("grp").applyInPandas(run, schema))
        if packed.where("exchanged").isEmpty():
            return [*done, packed.select(columns)]
        done.append(packed.where("full").select(columns))
        items, turn = packed.where("NOT full").select(columns), turn + 1
