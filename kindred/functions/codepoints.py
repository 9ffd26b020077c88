"""Texts of an Arrow batch as one NumPy array of code points: classes, bare keys and tokens without a loop over rows.

A JVM regular expression with Unicode classes takes some 30 microseconds a text here, these kernels about one.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import unicodedata

#: All code points have an entry of their own.
LIMIT = 0x110000
#: Code points beyond are unassigned, private or marks (tags and selectors, in the last range): neither letters nor digits.
LETTERS_END, SELECTORS = 0x33480, (0xE0000, 0xE01F0)
#: Chinese characters: extension A, the main block, compatibility ideographs, the supplementary planes.
CJK_RANGES = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3347F))
#: CJK radicals, which Unicode counts among the symbols though they are read as characters.
RADICALS = (0x2E80, 0x2FDF)

OTHER, WORD, CJK, MARK = 0, 1, 2, 3


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(class, lower case) by code point."""
    kind, lower = np.zeros(LIMIT, np.uint8), np.arange(LIMIT, dtype=np.uint32)
    for cp in (*range(LETTERS_END), *range(*SELECTORS)):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        if c.isalnum():
            kind[cp] = WORD
        elif unicodedata.category(c)[0] == "M":
            kind[cp] = MARK
        lower[cp] = ord(c.lower()[0])
    kind[RADICALS[0] : RADICALS[1] + 1] = CJK
    for low, high in CJK_RANGES:
        kind[low : high + 1] = np.where(kind[low : high + 1] == WORD, CJK, kind[low : high + 1])
    return kind, lower


class Decoded(NamedTuple):
    points: np.ndarray  #: lower-cased code points of all texts, one after another
    kind: np.ndarray  #: their classes
    row: np.ndarray  #: the text of each
    rows: int


def decode(texts: pa.Array, lower: bool = True) -> Decoded:
    """Null texts are as empty ones."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lens = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    data = "".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(data, np.uint32)
    kind, low = tables()
    return Decoded(low[points] if lower else points, kind[points], np.repeat(np.arange(len(lens)), lens), len(lens))


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def span_hash(points: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of each span of `points`: the spans cover `points` exactly, in order."""
    at = np.arange(len(points), dtype=np.uint64) - np.repeat(start, length).astype(np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(points.astype(np.uint64) | (at << np.uint64(24)), seed), dtype=np.uint64)])
        return mix(sums[start + length] - sums[start] + length.astype(np.uint64), seed + 1)


def bare_hashes(texts: pa.Array, seeds: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each seed the hash of each text without blanks, letter case and punctuation, and whether a letter or digit is left."""
    d = decode(texts)
    kept = d.kind > 0
    points, row = d.points[kept], d.row[kept]
    length = np.bincount(row, minlength=d.rows)
    start = np.concatenate([[0], np.cumsum(length)[:-1]]) if d.rows else np.zeros(0, np.int64)
    solid = np.bincount(d.row[(d.kind == WORD) | (d.kind == CJK)], minlength=d.rows) > 0
    return [span_hash(points, start, length, s) for s in seeds], solid


class Tokens(NamedTuple):
    row: np.ndarray
    hash: np.ndarray
    start: np.ndarray  #: in code points, over all texts
    length: np.ndarray
    points: np.ndarray  #: of all texts


def tokens(texts: pa.Array, seed: int = 7, lower: bool = True) -> Tokens:
    """A Chinese character is a token, else a run of letters and digits; in the order of the text."""
    return tokens_of(decode(texts, lower), seed)


def tokens_of(d: Decoded, seed: int = 7) -> Tokens:
    word = d.kind == WORD
    joined = np.zeros(len(word), bool)  # continues the token before
    if len(word):
        joined[1:] = word[1:] & word[:-1] & (d.row[1:] == d.row[:-1])
    inside = word | (d.kind == CJK)
    points = d.points[inside]
    opens = np.nonzero((~joined)[inside])[0]
    length = np.diff(np.append(opens, len(points)))
    where = np.nonzero(inside)[0][opens]
    return Tokens(d.row[where], span_hash(points, opens, length, seed), where, length, d.points)
