"""Columns over texts: tokenisers, cleaners, character classes, n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kindred.functions.binding import let

# Punctuation that word splitting turns into blanks, with tab and line feed.
FILTERS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'

# Ranges of Chinese characters (inclusive) of the BERT tokenisers.
CJK_BLOCKS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
CJK_CLASS = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in CJK_BLOCKS)
#: Marks that decomposition sets free.
NONSPACING = regex.compile(r"\p{Mn}+")
#: ASCII symbols count as punctuation, with Unicode's P categories.
PUNCTUATION_CLASS = r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\p{P}"

# The substitutions of the English cleaner, in order; a bracket or question mark keeps a backslash before it.
CLEANING = (
    (r"[^A-Za-z0-9(),!?'`]", " "),
    (r"'s", " 's"),
    (r"'ve", " 've"),
    (r"n't", " n't"),
    (r"'re", " 're"),
    (r"'d", " 'd"),
    (r"'ll", " 'll"),
    (r",", " , "),
    (r"!", " ! "),
    (r"\(", r" \\\( "),
    (r"\)", r" \\\) "),
    (r"\?", r" \\\? "),
    (r"\s{2,}", " "),
)


# Full-width and Chinese punctuation, after which decoded text has no blank.
CJK_PUNCTUATION = (
    "\uff02\uff03\uff04\uff05\uff06\uff07\uff08\uff09\uff0a\uff0b\uff0c\uff0d\uff0f\uff1a\uff1b\uff1c\uff1d\uff1e\uff20\uff3b\uff3c\uff3d\uff3e\uff3f\uff40"
    "\uff5b\uff5c\uff5d\uff5e\uff5f\uff60\uff62\uff63\uff64\u3000\u3001\u3003\u3008\u3009\u300a\u300b\u300c\u300d\u300e\u300f\u3010\u3011\u3014\u3015\u3016\u3017\u3018"
    "\u3019\u301a\u301b\u301c\u301d\u301e\u301f\u3030\u303e\u303f\u2013\u2014\u2018\u2019\u201b\u201c\u201d\u201e\u201f\u2026\u2027\ufe4f\ufe51\ufe54\u00b7\uff01\uff1f\uff61\u3002"
)
#: Blanks that go from decoded text: runs, those in contractions, after marks that open or bind, within decimals.
DECODING = (
    (" +", " "),
    ("' (re|m|s|t|ve|d|ll) ", "'$1 "),
    (r"([\+\-/=\{\(<\[" + CJK_PUNCTUATION + "]) ", "$1"),
    (r"([0-9]\.) ([0-9])", "$1$2"),
)


def present(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t != "")


def split_literal(text: Column, sep: str) -> Column:
    """Split at a literal; empty parts are kept."""
    return F.split(text, "\\Q" + sep + "\\E", -1)


def word_tokens(text: Column, filters: str = FILTERS, lower: bool = True, sep: str = " ") -> Column:
    """Lower case, filter characters to the separator, split, empty ones dropped."""
    out = F.lower(text) if lower else text
    if len(sep) == 1:
        out = F.translate(out, filters, sep * len(filters))
    else:
        out = F.regexp_replace(out, "[" + "".join("\\" + c if not c.isalnum() else c for c in filters) + "]", sep)
    return present(split_literal(out, sep))


def characters(text: Column) -> Column:
    """Every character a token, blanks too."""
    return present(F.split(text, ""))


def lower_tokens(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.lower(t))


def clean_english(text: Column) -> Column:
    for pattern, put in CLEANING:
        text = F.regexp_replace(text, pattern, put)
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


def char_ngrams(text: Column, low: int, high: int, strip_blanks: bool = False) -> Column:
    """All substrings of low to high - 1 characters, by length and then position; a null text has none."""
    if strip_blanks:
        text = F.replace(text, F.lit(" "), F.lit(""))

    def of(text: Column, n: int) -> Column:
        places = F.sequence(F.lit(1), F.length(text) - n + 1)
        return F.when(F.length(text) >= n, F.transform(places, lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return let(text, lambda t: F.concat(*[of(t, n) for n in range(low, high)]))


def word_ngrams(tokens: Column, low: int, high: int, sep: str = " ") -> Column:
    """All runs of low to high tokens (inclusive)."""

    def of(tokens: Column, n: int) -> Column:
        places = F.sequence(F.lit(1), F.size(tokens) - n + 1)
        return F.when(F.size(tokens) >= n, F.transform(places, lambda i: F.array_join(F.slice(tokens, i, n), sep))).otherwise(F.array().cast("array<string>"))

    return let(tokens, lambda t: F.concat(*[of(t, n) for n in range(low, high + 1)]))


def is_space(char: Column) -> Column:
    return char.isin(" ", "\n", "\r", "\t") | char.rlike(r"^\p{Zs}$")


def is_punctuation(char: Column) -> Column:
    return char.rlike(f"^[{PUNCTUATION_CLASS}]$")


def is_cjk(char: Column) -> Column:
    return char.rlike(f"^[{CJK_CLASS}]$")


def is_control(char: Column) -> Column:
    """Controls and format characters; tab, line feed and carriage return are such, and blanks as well."""
    return char.rlike(r"^[\p{Cc}\p{Cf}]$")


def is_special(token: Column) -> Column:
    return (F.length(token) > 0) & token.startswith("[") & token.endswith("]")


def stem(token: Column) -> Column:
    return F.regexp_replace(token, "^##", "")


def is_redundant(token: Column) -> Column:
    """Pieces of several characters that hold a Chinese character or punctuation."""
    return (F.length(stem(token)) > 1) & ~is_special(token) & stem(token).rlike(f"[{CJK_CLASS}{PUNCTUATION_CLASS}]")


def basic_tokens(text: Column, pre_tokenize: Callable[[Column], Column] | None = None, known: list[str] | None = None) -> Column:
    """BERT's first split: punctuation and Chinese characters stand alone, blanks part, controls go.

    `pre_tokenize` makes an array of words of the text; those in `known` stay whole, the others are split as texts of their own.
    """
    if pre_tokenize is not None:
        whole = (lambda w: w.isin(known)) if known else (lambda w: F.lit(False))
        return F.flatten(F.transform(pre_tokenize(text), lambda w: F.when(whole(w), F.array(w)).otherwise(basic_tokens(w))))
    text = F.regexp_replace(text, f"([{PUNCTUATION_CLASS}{CJK_CLASS}])", " $1 ")
    text = F.regexp_replace(text, r"[\p{Zs}\n\r\t]", " ")
    text = F.regexp_replace(text, r"[\x{0}\x{FFFD}\p{Cc}\p{Cf}]", "")
    return present(F.split(text, " "))


def translated(tokens: Column, names: dict[str, str]) -> Column:
    """`tokens` with those that have another name replaced by it."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.transform(tokens, lambda t: F.coalesce(F.element_at(table, t), t))


@F.pandas_udf(StringType())
def _strip_accents(texts: pd.Series) -> pd.Series:
    """One decomposition and one regular expression over a whole batch, its texts joined by a character that no text holds."""
    known = texts.fillna("")
    sep = next(c for c in map(chr, range(0xE000, 0xF900)) if not known.str.contains(c, regex=False).any())
    plain = NONSPACING.sub("", unicodedata.normalize("NFD", sep.join(known).lower())).split(sep)
    return pd.Series(plain, index=texts.index).where(texts.notna(), None)


def lower_without_accents(text: Column) -> Column:
    """Lower case, decomposed, marks dropped. Plain ASCII stays in the JVM; the rest goes to an Arrow UDF, as Spark has no decomposition."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _strip_accents(text)).otherwise(F.lower(text))


def decode_pieces(pieces: Column) -> Column:
    """Readable text of word pieces; markers in brackets are left out.

    Pieces behind `##`, single Chinese characters and single punctuation marks join what precedes them, and so does what follows a
    Chinese character; a blank stands before any other piece and after a mark. Then blanks within contractions and
    decimals, and after the marks that open or bind, go.
    """

    def mark(p: Column) -> Column:
        return (F.length(p) == 1) & is_punctuation(p)

    def placed(pieces: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            before = F.get(pieces, i - 1)
            cjk_before = F.coalesce(F.substring(before, -1, 1).rlike(f"[{CJK_CLASS}]"), F.lit(False))
            glued = p.startswith("##") | ((F.length(p) == 1) & is_cjk(p)) | mark(p) | cjk_before
            return F.concat(F.when(glued, "").otherwise(" "), stem(p), F.when(mark(p) & ~is_cjk(p), " ").otherwise(""))

        return F.array_join(F.transform(pieces, one), "")

    text = let(F.filter(pieces, lambda p: ~is_special(p)), placed)
    for pattern, put in DECODING:
        text = F.regexp_replace(text, pattern, put)
    return F.trim(text)


def levenshtein(a: Column, b: Column) -> Column:
    """Unit-cost edit distance over code points."""
    return F.levenshtein(a, b)
