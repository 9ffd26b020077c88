"""Rolling-hash fingerprints of records, selected by winnowing."""

from __future__ import annotations

import math
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from kindred.functions.codepoints import mix, tokens

#: Tokens in a seed; a record that can't be sure of so long a common run uses shorter ones.
K = 4
#: Sizes from which the guaranteed run is taken as that of the size itself.
LARGEST = 1024


@lru_cache(maxsize=8)
def guaranteed_run(threshold: float) -> np.ndarray:
    """By the number of distinct tokens of a record: the least length of the longest run of common tokens that any
    record with a Jaccard similarity of `threshold` shares with it, if both sets are in one order.

    i common of u tokens leave u - i differing ones, which part the common ones into at most u - i + 1 runs.
    """
    out = np.zeros(LARGEST + 1, np.int64)
    for n in range(1, LARGEST + 1):
        best = n
        for u in range(n, int(n / threshold + 1e-9) + 1):
            i = max(math.ceil(threshold * u - 1e-9), 0)
            if i <= n:
                best = min(best, math.ceil(i / (u - i + 1)))
        out[n] = best
    return out


def exact_below(threshold: float) -> int:
    """Records of fewer distinct tokens have no partner but those of the very same tokens: n of n + 1 tokens are too few for the threshold."""
    return next((n for n in range(1, LARGEST) if n >= threshold * (n + 1) - 1e-9), LARGEST) if threshold < 1 else LARGEST


@lru_cache(maxsize=8)
def seed_lengths(threshold: float) -> tuple[int, int, int]:
    """(short, from_size, until_size): seeds of `short` tokens below until_size, of K from from_size; records between use both.

    A pair across from_size shares its seeds of `short` tokens, as until_size is beyond any partner of a smaller record.
    Records below `exact_below` are one seed each and do not count here.
    """
    run, least = guaranteed_run(threshold), exact_below(threshold)
    from_size = next((n for n in range(least, LARGEST + 1) if run[n:].min() >= K), LARGEST + 1)
    until_size = int((from_size - 1) / threshold + 1e-9) + 1
    short = max(1, int(run[least : min(until_size, LARGEST + 1)].min(initial=K)))
    return min(short, K), from_size, until_size


class Records(NamedTuple):
    """The distinct tokens of each record, in the order of their hashes."""

    row: np.ndarray
    token: np.ndarray
    size: np.ndarray
    first: np.ndarray


def records(fields: list[pa.Array]) -> Records:
    found = [tokens(x) for x in fields]
    rows = len(fields[0])
    row, value = np.concatenate([t.row for t in found]).astype(np.uint64), np.concatenate([t.hash for t in found])
    # one sort of (row, hash): the hash gives up as many bits as the row needs
    bits = np.uint64(max(1, int(rows).bit_length()))
    key = np.unique((row << (np.uint64(64) - bits)) | (value >> bits))
    row, value = (key >> (np.uint64(64) - bits)).astype(np.int64), (key << bits) >> np.uint64(24)
    size = np.bincount(row, minlength=rows)
    return Records(row, value, size, np.cumsum(size) - size)


def bitmap(r: Records) -> np.ndarray:
    """64 bits a record: every token sets one, so that records which differ in d tokens differ in at most d bits."""
    out = np.zeros(len(r.size), np.uint64)
    some = r.size > 0
    if some.any():
        out[some] = np.bitwise_or.reduceat(np.uint64(1) << (mix(r.token, 5) & np.uint64(63)), r.first[some])
    return out


def _windows(r: Records, k: int, width: np.ndarray, rows: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, fingerprint, weight of its rarest token): in every window of width[record] seeds of k tokens the one of least weight, ties by hash."""
    at = np.nonzero(rows[r.row] & (np.arange(len(r.row)) - r.first[r.row] <= r.size[r.row] - k))[0]
    if not len(at):
        return at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    owner = r.row[at]
    fp, light, rarest = r.token[at], weight[at], weight[at]
    for j in range(1, k):
        fp = mix(fp, 17) + r.token[at + j]
        light = light + weight[at + j]
        rarest = np.minimum(rarest, weight[at + j])
    fp = mix(fp, 18 + k)
    # the weight in the upper bits, the hash below: one number to compare
    value = (light.astype(np.uint64) << np.uint64(48)) | (fp >> np.uint64(16))
    n, chosen = len(at), np.zeros(len(at), bool)
    w = np.minimum(width[owner], r.size[owner] - k + 1)
    for size in np.unique(w):
        start = np.nonzero(w == size)[0]
        start = start[start + size - 1 < n]
        start = start[owner[start + size - 1] == owner[start]]
        best, low = start, value[start]
        for j in range(1, size):
            other = value[start + j]
            best, low = np.where(other < low, start + j, best), np.minimum(other, low)
        chosen[best] = True
    return owner[chosen], fp[chosen], rarest[chosen]


def _rare_prefix(r: Records, threshold: float, weight: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, first, size): of each of `rows` so many of its rarest tokens that any two records with a Jaccard similarity of `threshold` share one.

    They share at least ceil(threshold * n) of the n tokens of either, in one order by rarity, so the rarest shared one is among the
    first n - ceil(threshold * n) + 1 of both.
    """
    inside = rows[r.row]
    order = np.nonzero(inside)[0][np.lexsort((r.token[inside], weight[inside], r.row[inside]))]
    held = np.where(rows, r.size, 0)
    first = np.cumsum(held) - held
    size = np.where(rows, r.size - np.ceil(threshold * r.size - 1e-9).astype(np.int64) + 1, 0)
    at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
    return r.token[order][at], np.cumsum(size) - size, size


def fingerprints(r: Records, threshold: float, common: np.ndarray, weights: np.ndarray, frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """(record, fingerprint): a sample of each record's seeds of which any two records with a Jaccard similarity of at
    least `threshold` share one.

    A window spans no more tokens than the guaranteed run, so both records select the least seed of their common run.
    `common` (sorted hashes) and `weights` say how frequent tokens are; seeds of rare tokens weigh least and are preferred. A seed
    whose tokens all weigh `frequent` or more is split by a second one: it comes out once with each of the record's rarest tokens
    (`_rare_prefix`), of which a similar record shares one, instead of by itself.
    Records too short for any partner but an equal one are one seed.
    """
    run = guaranteed_run(threshold)[np.minimum(r.size, LARGEST)]
    weight = np.zeros(len(r.token), np.uint64)
    if len(common) and len(r.token):
        at = np.minimum(np.searchsorted(common, r.token), len(common) - 1)
        weight = np.where(common[at] == r.token, weights[at], 0).astype(np.uint64)
    least = exact_below(threshold)
    short, from_size, until_size = seed_lengths(threshold)
    parts = [_windows(r, K, np.maximum(run - K + 1, 1), r.size >= from_size, weight)]
    if until_size > least:
        parts.append(_windows(r, short, np.maximum(run - short + 1, 1), (r.size >= max(short, least)) & (r.size < until_size), weight))
    owner, fp, rarest = (np.concatenate([p[k] for p in parts]) for k in range(3))
    split = rarest >= frequent
    rows = np.zeros(len(r.size), bool)
    rows[owner[split]] = True
    token, first, size = _rare_prefix(r, threshold, weight, rows)
    own, seed = owner[split], fp[split]
    n = size[own]
    at = np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
    by, second = np.repeat(own, n), mix(np.repeat(mix(seed, 19), n) + token[at], 20)
    whole = np.nonzero((r.size > 0) & (r.size < least))[0]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(r.token, 21), dtype=np.uint64)])
    with np.errstate(over="ignore"):
        sets = mix(sums[r.first[whole] + r.size[whole]] - sums[r.first[whole]], 22)
    return np.concatenate([owner[~split], by, whole]), np.concatenate([fp[~split], second, sets])
