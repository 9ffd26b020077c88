"""Columns over arrays: padding, truncation, segments, top k."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad(values: Column, size: int | Column, padding: str = "pre", truncating: str = "pre", value=0, kind: str = "int") -> Column:
    """Arrays of one length. An empty or null array becomes `size` times `value`, whatever the side."""
    if padding not in ("pre", "post") or truncating not in ("pre", "post"):
        raise ValueError("padding and truncating are `pre` or `post`")
    size = F.lit(size) if isinstance(size, int) else size
    values = F.coalesce(values, F.array().cast(f"array<{kind}>"))
    n = F.size(values)
    kept = F.when(n > size, F.slice(values, n - size + 1 if truncating == "pre" else F.lit(1), size)).otherwise(values)
    fill = F.array_repeat(F.lit(value).cast(kind), (size - F.least(n, size)).cast("int"))
    return F.concat(fill, kept) if padding == "pre" else F.concat(kept, fill)


def pad_right(values: Column, size: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(0), F.greatest(F.lit(size) - F.size(values), F.lit(0))))


def truncated_sizes(sizes: list[Column], most: Column | int) -> list[Column]:
    """Lengths after taking tokens, one by one, from whichever sequence is then longest (ties: the first) until all fit in `most`.

    In closed form: all are cut to one level, and of what fits above it the later sequences keep one more each.
    """
    most = F.lit(most) if isinstance(most, int) else most
    total = reduce(lambda a, b: a + b, sizes)
    # the level: the greatest L with the sum of least(size, L) at most `most`; one of these for k sequences cut
    ordered = F.array_sort(F.array(*sizes))
    k = len(sizes)
    level = F.lit(0)
    for cutting in range(1, k + 1):
        rest = reduce(lambda a, b: a + b, [F.element_at(ordered, i) for i in range(1, k - cutting + 1)], F.lit(0))
        candidate = F.floor((most - rest) / cutting)
        level = F.greatest(level, F.when(candidate <= F.element_at(ordered, k - cutting + 1), candidate).otherwise(F.lit(0)))
    level = F.greatest(level, F.lit(0)).cast("int")
    base = [F.least(s, level) for s in sizes]
    spare = most - reduce(lambda a, b: a + b, base)
    out: list[Column] = []
    for i in range(k - 1, -1, -1):
        longer = (sizes[i] > level) & (spare > 0)
        out.insert(0, F.when(total <= most, sizes[i]).otherwise(base[i] + longer.cast("int")))
        spare = spare - longer.cast("int")
    return out


def drop_at(values: Column, index: int, n: Column) -> Column:
    """`values` after taking `n` elements, one by one, at `index` (negative: from the end)."""
    size = F.size(values)
    if index >= 0:
        return F.concat(F.slice(values, F.lit(1), F.lit(index)), F.slice(values, F.least(n + index + 1, size + 1), size))
    tail = -index - 1
    return F.concat(F.slice(values, F.lit(1), F.greatest(size - tail - n, F.lit(0))), F.slice(values, F.greatest(size - tail, F.lit(0)) + 1, F.lit(tail)) if tail else F.slice(values, 1, 0))


def truncate_together(most: int, index: int, *sequences: Column) -> list[Column]:
    sizes = truncated_sizes([F.size(s) for s in sequences], most)
    return [drop_at(s, index, F.size(s) - n) for s, n in zip(sequences, sizes)]


def with_markers(tokens: Column, start: str = "[CLS]", end: str = "[SEP]") -> Column:
    return F.concat(F.array(F.lit(start)), tokens, F.array(F.lit(end)))


def segments(first: Column, second: Column | None = None) -> Column:
    zeros = F.array_repeat(F.lit(0), F.size(first))
    return zeros if second is None else F.concat(zeros, F.array_repeat(F.lit(1), F.size(second)))


def top_k(values: Column, k: int) -> Column:
    """The k largest, descending."""
    return F.slice(F.sort_array(values, asc=False), 1, k)


def log_bucket(offset: Column, size: int, most: int) -> Column:
    """Relative positions as they are within half of `size`, beyond it in buckets of which each is wider than the last by one factor, up to `most`.

    The borders of the buckets are known beforehand: the b-th ends at half * ratio ** b, ratio being such that the last, of half - 1, ends at
    most - 1. A bucket's number is that of the borders below the distance; farther ones go on in the same way.
    """
    half, far = size // 2, F.abs(offset)
    ratio = ((most - 1) / half) ** (1 / (half - 1))
    borders = [half * ratio**b for b in range(half)]
    within = sum((far > round(x, 9)).cast("int") for x in borders)
    beyond = F.ceil(F.log(F.greatest(far, F.lit(1)) / half) / F.lit(math.log(ratio)))
    bucket = F.when(far <= most - 1, within).otherwise(beyond) + half
    return F.when(far < half, offset).otherwise(bucket * F.signum(offset)).cast("int")
