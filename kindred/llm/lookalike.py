"""Texts that look the same but hold different characters, brought to one form (problem 3)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.codepoints import CJK_RANGES, RADICALS, tokens
from kindred.session import broadcast_upto, cut

# Cyrillic and Greek letters, and the Latin letters that look like them.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝҮүӀӏԌԚԜѵ", "ABESIJKMHOPCTYXaeopcyxsijhdqwYyIlGQWv")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονραικυγϲϳ", "ABEZHIKMNOPTYXovpaikuycj")
OTHER_LETTERS = ("\u0251\u0261", "ag")
# Armenian and Cherokee letters, and the Latin ones that look like them.
ARMENIAN = ("ԼՍՕզհոսցօ", "LUOqhnugo")
CHEROKEE = ("ᎠᎢᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏴ", "DTAJEWMHGZVSLCPKB")
# Blanks about as wide as a usual one; U+3000, em and hair spaces look different.
SPACES = "\u00a0\u2002\u2004\u2005\u2007\u2008\u202f"
# Ranges whose characters are other code points for one and the same: full-width letters and digits,
# Latin ligatures, Roman numerals, CJK radicals and compatibility ideographs.
SAME = ((0x2160, 0x217F), (0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0xFB00, 0xFB06), RADICALS, (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
# What is not seen, beside Unicode's format characters.
UNSEEN = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0"

LOOK = dict(zip(CYRILLIC[0] + GREEK[0] + OTHER_LETTERS[0] + ARMENIAN[0] + CHEROKEE[0], CYRILLIC[1] + GREEK[1] + OTHER_LETTERS[1] + ARMENIAN[1] + CHEROKEE[1])) | dict.fromkeys(SPACES, " ")
_CJK = "".join(f"{chr(a)}-{chr(b)}" for a, b in (*CJK_RANGES, RADICALS))
MARKS = "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20f0\ufe20-\ufe2f"
_IGNORED = "\u00ad\u061c\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff" + UNSEEN
#: A Chinese character or a run of letters, digits and marks, with the ignorables within and behind.
PIECE = re.compile(f"[{_CJK}][{_IGNORED}]*|(?:[^\\W_{_CJK}]|[{MARKS}{_IGNORED}])+")
#: Characters of which it is known that they stand for themselves: no text of these alone needs a look.
PLAIN = r"[^\x00-\x7F\x{4E00}-\x{9FFF}\x{3000}-\x{303F}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{00C0}-\x{024F}]"


@lru_cache(maxsize=1 << 14)
def _fold_char(c: str) -> str:
    o = ord(c)
    if c in LOOK:
        return LOOK[c]
    if unicodedata.category(c) == "Cf" or 0xFE00 <= o <= 0xFE0F or c in UNSEEN:
        return ""
    if any(a <= o <= b for a, b in SAME):
        return unicodedata.normalize("NFKC", c)
    return c


def fold(text: str) -> str:
    """The table: each character by the one it looks like, ignorables gone, accents composed."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", "".join(map(_fold_char, unicodedata.normalize("NFD", text))))


def needs_look(text: Column) -> Column:
    return text.rlike(PLAIN)


def _clean(word: str) -> bool:
    """Whether a token may be a canonical spelling: it stands for itself, or is of Greek or Cyrillic letters throughout."""
    if word.isascii():
        return True
    scripts = {unicodedata.name(c, " ").split()[0] for c in word if c.isalpha()}
    if fold(word) == word:
        return len(scripts & {"LATIN", "GREEK", "CYRILLIC"}) < 2
    return scripts in ({"GREEK"}, {"CYRILLIC"}) and unicodedata.is_normalized("NFC", word)


def letters_of(token: str) -> str:
    """The letters of a token as the automaton counts them: folded, accents apart."""
    return unicodedata.normalize("NFD", fold(token))


def _key(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts))) >> 1


def _segments(size: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of edits + 1 parts of a word of `size` letters."""
    base, longer = divmod(size, edits + 1)
    out, at = [], 0
    for k in range(edits + 1):
        n = base + (k >= edits + 1 - longer)
        out.append((at, n))
        at += n
    return out


def word_keys(word: str, edits: int) -> list[int]:
    """The tries that hold a word. Without edits one, by length and first letters, which zero-cost steps keep. With edits one for each of
    edits + 1 segments of the word, of which any spelling within so many edits holds one unchanged; words of up to `edits` letters are apart."""
    letters = letters_of(word)
    if not edits:
        return [_key(len(letters), letters[:3])]
    if len(letters) <= edits:
        return [_key("short")]
    return [_key(len(letters), k, letters[at : at + n]) for k, (at, n) in enumerate(_segments(len(letters), edits))]


def token_keys(token: str, edits: int) -> list[int]:
    """The tries in which a token's words within `edits` edits are: of every possible length those of its parts that may be a segment, moved by up to `edits`."""
    letters = letters_of(token)
    if not edits:
        return word_keys(token, 0)
    out = {_key("short")} if len(letters) <= 2 * edits else set()
    for size in range(max(edits + 1, len(letters) - edits), len(letters) + edits + 1):
        for k, (at, n) in enumerate(_segments(size, edits)):
            starts = range(max(0, at - edits), min(len(letters) - n, at + edits) + 1)
            out |= {_key(size, k, letters[p : p + n]) for p in starts}
    return list(out)


def build_trie(words: Iterable[tuple[str, int]]) -> dict:
    """Nodes by letter, accents apart; at the end of a word its (count, spelling)."""
    root: dict = {}
    for word, n in words:
        node = root
        for c in unicodedata.normalize("NFD", word):
            node = node.setdefault(c, {})
        node[""] = (n, word)
    return root


def spellings(trie: dict, token: str, most: float = 0.0, other: float = 1.0) -> list[tuple[float, int, str]]:
    """(cost, -count, word) of the words of `trie` that a weighted edit automaton accepts at a cost of at most `most`.

    It reads the token's characters as they are, with accents apart. Passing over an ignorable costs nothing, nor does a step from a character to
    a letter of the trie that it looks like, or to several where it is a ligature. Any other replacement, letter too much or too few costs `other`.
    """
    raw, found = unicodedata.normalize("NFD", token), {}
    stack, seen = [(trie, 0, "", 0.0)], {}
    while stack:
        # `rest` is what of the last character read is still to be matched
        node, at, rest, cost = stack.pop()
        if seen.get((id(node), at, rest), most + 1) <= cost:
            continue
        seen[id(node), at, rest] = cost
        if not rest and at < len(raw):
            looks = _fold_char(raw[at])
            stack.append((node, at + 1, looks, cost))
            continue
        if not rest and "" in node:
            n, word = node[""]
            found[word] = min(found.get(word, (cost, -n)), (cost, -n))
        if rest and cost + other <= most:
            stack.append((node, at, rest[1:], cost + other))
        for c, child in node.items():
            if not c:
                continue
            if rest and _fold_char(c) == rest[0]:
                stack.append((child, at, rest[1:], cost))
            elif cost + other <= most:
                if rest:
                    stack.append((child, at, rest[1:], cost + other))
                stack.append((child, at, rest, cost + other))
    return sorted((cost, n, word) for word, (cost, n) in found.items())


def choose(found: list[tuple[float, int, str]], token: str) -> tuple | None:
    """The canonical spelling, last in what orders it: of the cheapest words the folded spelling itself, else the most frequent, else the smallest."""
    folded = fold(token)
    return min(((cost, word != folded, n, word) for cost, n, word in found), default=None)


def vocabulary(texts: DataFrame, edits: int) -> DataFrame:
    """(key, word, n): clean tokens of all texts, case kept, with their occurrences and the tries that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, int] = {}
            for column in batch.columns:
                t = tokens(column, lower=False)
                _, first, n = np.unique(t.hash, return_index=True, return_counts=True)
                for a, k, count in zip(t.start[first].tolist(), t.length[first].tolist(), n.tolist()):
                    word = t.points[a : a + k].astype("<u4").tobytes().decode("utf-32-le", "replace")
                    out[word] = out.get(word, 0) + count
            rows = [(k, w, n) for w, n in out.items() if _clean(w) for k in word_keys(w, edits)]
            keys, words, counts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["key", "word", "n"])

    return texts.mapInArrow(run, "key bigint, word string, n bigint")


def odd_pieces(text: str) -> set[str]:
    """The tokens of a text that may be spelt oddly: not ASCII, and not a plain Chinese character."""
    return {x for x in PIECE.findall(text) if not x.isascii() and not (len(x) == 1 and "一" <= x <= "鿿")}


def _odd_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, odd = [], []
        for row, text in enumerate(batch.column(2).to_pylist()):
            own = odd_pieces(text)
            at += [row] * len(own)
            odd += own
        at = pa.array(at, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(odd, pa.string())], ["h1", "h2", "token"])


def _keyed_tokens(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, t) for t in batch.column(0).to_pylist() for k in token_keys(t, edits)]
            keys, words = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.string())], ["key", "token"])

    return run


def _traverse(most: float):
    """Of rows sorted by key, odd tokens before words: the words that each token reaches in the trie of its key."""
    names, kinds = ["token", "cost", "other", "n", "spelling"], [pa.string(), pa.float64(), pa.bool_(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, odd, words = None, [], []

        def done() -> Iterator[tuple]:
            trie = build_trie(words)
            for token in odd:
                best = choose(spellings(trie, token, most), token)
                if best:
                    yield token, *best

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            out: list[tuple] = []
            for k, kind, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    out += done()
                    key, odd, words = k, [], []
                if kind == 0:
                    odd.append(word)
                elif odd:
                    words.append((word, n))
            yield batch_of(out)
        yield batch_of(list(done()))

    return run


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, pairs in zip(batch.column("text").to_pylist(), batch.column("pairs").to_pylist()):
            known = {p["token"]: p["spelling"] for p in pairs or ()}
            odd, parts, end = odd_pieces(text), [], 0
            for m in PIECE.finditer(text):
                parts += [fold(text[end : m.start()]), known.get(m[0]) or fold(m[0]) if m[0] in odd else m[0]]
                end = m.end()
            out.append(unicodedata.normalize("NFC", "".join(parts) + fold(text[end:])))
        yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), pa.array(out, pa.string())], ["h1", "h2", "canonical"])


def _hashes(text: str) -> list[Column]:
    """128 bits of a text, which stand for it in joins."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), F.col(text)).alias("h2")]


def canonical_forms(df: DataFrame, fields: tuple[str, ...] = ("text_a", "text_b"), *, most_cost: float = 0.0, broadcast_keys: int = 1_000_000) -> DataFrame:
    """(h1, h2, canonical) of every distinct text of `fields` that holds a character outside the plain ones, by 128 bits of the text; other texts stand for themselves.

    The vocabulary is taken from all texts: words that stand for themselves, or are of Greek or Cyrillic letters throughout, with
    their counts. It is laid out in tries, one for each length and beginning, so that no task holds more than one such trie, and those
    without an odd token are never shuffled. Every odd token runs through its trie as a weighted edit automaton; its
    canonical spelling is the word it reaches, and where it reaches none, the table's. At `most_cost` 0 only look-alikes
    and ignorables are passed over; at a cost of e edits the tries are those of e + 1 segments, so that no word within e edits is lost.
    Blanks and ignorables between tokens go by the table; plain blanks, case, punctuation and visible accents stay as they are.

    Null and plain texts do not come out; an empty table gives an empty result.
    """
    edits = int(most_cost + 1e-9)
    texts = df.select(F.explode(F.array(*fields)).alias("text"))
    texts = texts.where(F.col("text").isNotNull() & needs_look(F.col("text"))).select(*_hashes("text"), "text")
    odd = cut(texts.groupBy("h1", "h2").agg(F.first("text").alias("text")))
    tokens_of = cut(odd.mapInArrow(_odd_tokens, "h1 bigint, h2 bigint, token string"))
    keyed = cut(tokens_of.select("token").distinct().mapInArrow(_keyed_tokens(edits), "key bigint, token string"))
    keys, _ = broadcast_upto(cut(keyed.select("key").distinct()), broadcast_keys)
    words = vocabulary(df.select(*fields), edits).join(keys, "key", "left_semi").groupBy("key", "word").agg(F.sum("n").alias("n"))
    both = keyed.select("key", F.lit(0).alias("kind"), F.col("token").alias("word"), F.lit(0).cast("long").alias("n"))
    both = both.unionAll(words.select("key", F.lit(1), "word", "n"))
    reached = both.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(_traverse(most_cost), "token string, cost double, other boolean, n bigint, spelling string")
    spelled = reached.groupBy("token").agg(F.min(F.struct("cost", "other", "n", "spelling")).alias("best")).select("token", F.col("best.spelling").alias("spelling"))
    known = tokens_of.join(spelled, "token").groupBy("h1", "h2").agg(F.collect_list(F.struct("token", "spelling")).alias("pairs"))
    return odd.join(known, ["h1", "h2"], "left").select("h1", "h2", "text", "pairs").mapInArrow(_rewrite, "h1 bigint, h2 bigint, canonical string")


def consistent_texts(df: DataFrame, fields: tuple[str, ...] = ("text_a", "text_b"), **how) -> DataFrame:
    """`df` with each of `fields` in its canonical form; null and plain texts are as they were, all columns and rows are kept."""
    forms = cut(canonical_forms(df, fields, **how)).toDF("__h1", "__h2", "__form")
    for field in fields:
        odd = F.coalesce(needs_look(F.col(field)), F.lit(False))
        h1, h2 = _hashes(field)
        changed = df.where(odd).withColumn("__h1", h1).withColumn("__h2", h2).join(forms, ["__h1", "__h2"])
        changed = changed.withColumn(field, F.col("__form")).drop("__h1", "__h2", "__form")
        df = df.where(~odd).unionByName(changed)
    return df


def _by_form(df: DataFrame, id_col: str, fields: tuple[str, ...], **how) -> tuple[DataFrame, DataFrame]:
    """(id, field_name, k1, k2, raw) of odd and of plain texts: 128 bits of the canonical form and 64 of the text as it is."""
    forms = cut(canonical_forms(df, fields, **how).where(F.trim("canonical") != "").select("h1", "h2", F.xxhash64("canonical").alias("k1"), F.xxhash64(F.lit(1), "canonical").alias("k2")))
    rows = df.select(F.col(id_col).alias("id"), F.explode(F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f))))).alias("field_name", "text"))
    rows = rows.where(F.col("text").isNotNull() & F.col("id").isNotNull())
    odd = needs_look(F.col("text"))
    hashed = rows.where(odd).select("id", "field_name", *_hashes("text"))
    strange = cut(hashed.join(forms, ["h1", "h2"]).select("id", "field_name", "k1", "k2", F.col("h1").alias("raw")))
    h1, h2 = _hashes("text")
    return strange, rows.where(~odd).select("id", "field_name", h1.alias("k1"), h2.alias("k2"), h1.alias("raw"))


FORM = ["field_name", "k1", "k2"]


def look_alikes_found(df: DataFrame, id_col: str = "pair_id", fields: tuple[str, ...] = ("text_a", "text_b"), **how) -> DataFrame:
    """(id_1, id_2, field_name): rows whose texts in one field have one canonical form but are not the same string.

    One of two such texts at least has odd characters, so odd texts, by canonical form, are joined with all texts; rows carry
    128 bits of their canonical form instead of the text. Null texts and forms of blanks alone take no part. Every pair
    comes out; `look_alike_classes` gives the same links without pairs.
    """
    strange, plain = _by_form(df, id_col, fields, **how)
    left = strange.withColumnRenamed("id", "a").withColumnRenamed("raw", "raw_a")
    with_plain = left.join(plain, FORM).where("raw_a <> raw").select(F.least("a", "id").alias("id_1"), F.greatest("a", "id").alias("id_2"), "field_name")
    with_odd = left.join(strange, FORM).where("raw_a <> raw AND a < id").select(F.col("a").alias("id_1"), F.col("id").alias("id_2"), "field_name")
    return with_plain.where("id_1 <> id_2").unionAll(with_odd).distinct()


def look_alike_classes(df: DataFrame, id_col: str = "pair_id", fields: tuple[str, ...] = ("text_a", "text_b"), **how) -> DataFrame:
    """(id_col, field_name, class_id, n_links): each row with a look-alike in a field, the smallest id of its form, and how many rows
    have the form in another spelling. Forms are counted in two levels, by spelling and then by form, so a form of most rows costs a row a task; no pair is made."""
    strange, plain = _by_form(df, id_col, fields, **how)
    forms = strange.select(*FORM).distinct()
    rows = strange.unionByName(plain.join(forms, FORM, "left_semi")).distinct()
    spelled = rows.groupBy(*FORM, "raw").agg(F.count(F.lit(1)).alias("own"), F.min("id").alias("low"))
    whole = spelled.groupBy(*FORM).agg(F.sum("own").alias("all"), F.min("low").alias("class_id"), F.count(F.lit(1)).alias("spellings"))
    links = cut(spelled.join(whole.where("spellings > 1"), FORM).select(*FORM, "raw", "class_id", (F.col("all") - F.col("own")).alias("n_links")))
    return rows.join(links, [*FORM, "raw"]).select(F.col("id").alias(id_col), "field_name", "class_id", "n_links")
