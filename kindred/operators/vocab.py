"""Vocabularies and what is done with them: sequences, n-gram mining, rare words, word pieces."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.text import char_ngrams
from kindred.operators.corpus import ranked_rows
from kindred.session import broadcast_upto, cut


#: Vocabularies of up to so many tokens (counted) are sent to all tasks; larger ones are joined by a shuffle.
MOST_SENT = 1_000_000


def texts_to_sequences(tokens: DataFrame, vocab: DataFrame, num_words: int | None = None, oov_index: int | None = None) -> DataFrame:
    """(doc_id, seq array<int>): indices of the tokens in order; unknown tokens and indices from `num_words` become `oov_index`, or go where that is None."""
    known, _ = broadcast_upto(cut(vocab.select("token", "idx")), MOST_SENT)
    words = tokens.select("doc_id", F.posexplode("tokens").alias("pos", "token"))
    idx = F.col("idx") if num_words is None else F.when(F.col("idx") < num_words, F.col("idx"))
    if oov_index is not None:
        idx = F.coalesce(idx, F.lit(oov_index))
    coded = words.join(known, "token", "left").select("doc_id", "pos", idx.alias("idx")).where("idx IS NOT NULL")
    seqs = coded.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "idx"))).alias("s"))
    joined = tokens.select("doc_id").join(seqs, "doc_id", "left")
    return joined.select("doc_id", F.coalesce(F.transform("s", lambda x: x["idx"]), F.array().cast("array<int>")).alias("seq"))


def sequences_to_texts(seqs: DataFrame, vocab: DataFrame, oov_token: str | None = None) -> DataFrame:
    """(doc_id, text): tokens of the indices joined by blanks; unknown indices become `oov_token`, or go."""
    known, _ = broadcast_upto(cut(vocab.select("token", "idx")), MOST_SENT)
    words = seqs.select("doc_id", F.posexplode("seq").alias("pos", "idx")).join(known, "idx", "left")
    token = F.coalesce("token", F.lit(oov_token)) if oov_token else F.col("token")
    words = words.select("doc_id", "pos", token.alias("token")).where("token IS NOT NULL")
    texts = words.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("s"))
    joined = seqs.select("doc_id").join(texts, "doc_id", "left")
    return joined.select("doc_id", F.coalesce(F.array_join(F.transform("s", lambda x: x["token"]), " "), F.lit("")).alias("text"))


def tokens_to_ids(tokens: DataFrame, vocab: DataFrame, unknown: int) -> DataFrame:
    return texts_to_sequences(tokens, vocab, oov_index=unknown)


def ngram_counts(lines: DataFrame, text_col: str, min_freq: int = 10, max_ngram: int = 3) -> DataFrame:
    """(ngram, n, cnt): character n-grams of 2 to `max_ngram` over all lines."""
    grams = lines.where(F.col(text_col).isNotNull()).select(F.explode(char_ngrams(F.col(text_col), 2, max_ngram + 1)).alias("ngram"))
    return grams.groupBy("ngram").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= min_freq).select("ngram", F.length("ngram").alias("n"), "cnt")


def pruned_ngrams(grams: DataFrame, max_ngram: int = 3, prune_suffix: bool = False) -> DataFrame:
    """`grams` without those that stand in a longer one of the same count, at its end only if `prune_suffix`.

    Every longer gram names its proper substrings, and one equi-join on (gram, count) finds what to drop.
    """

    def inner(n: int) -> list:
        last = n + 1 if prune_suffix else n
        return [F.substring("ngram", s + 1, e - s) for e in range(2, last) for s in range(e - 1) if not (s == 0 and e == n)]

    covered = None
    for n in range(3, max_ngram + 1):
        parts = inner(n)
        if parts:
            part = grams.where(F.col("n") == n).select(F.explode(F.array(*parts)).alias("ngram"), "cnt")
            covered = part if covered is None else covered.unionAll(part)
    return grams if covered is None else grams.join(covered.distinct(), ["ngram", "cnt"], "left_anti")


def frequency_map(records: DataFrame, columns: list[str], sep: str = " ", min_freq: int = 1) -> DataFrame:
    """(token, cnt, idx string): tokens of all columns, ranked from 0 by count, ties by token."""
    words = records.select(F.explode(F.concat(*[F.coalesce(F.split(F.col(c), sep), F.array().cast("array<string>")) for c in columns])).alias("token"))
    counted = words.where("token <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= min_freq)
    return ranked_rows(counted, [F.desc("cnt"), F.asc("token")], "rank").select("token", "cnt", (F.col("rank") - 1).cast("string").alias("idx"))


def map_rare_words(records: DataFrame, frequencies: DataFrame, id_col: str, columns: tuple[str, str], *, min_freq: int = 5, first_rare: int = 35_000, sep: str = " ") -> DataFrame:
    """(id, field, pos, token, idx string): frequent tokens by the map, rare ones numbered from `first_rare` in each record by first appearance, first text first."""

    def words(c: str, field: int) -> DataFrame:
        return records.select(F.col(id_col).alias("id"), F.lit(field).alias("field"), F.posexplode(F.split(F.col(c), sep)).alias("pos", "token"))

    both = words(columns[0], 0).unionAll(words(columns[1], 1)).where("token <> ''")
    frequent, _ = broadcast_upto(cut(frequencies.where(F.col("cnt") >= min_freq).select("token", "idx")), MOST_SENT)
    joined = both.join(frequent, "token", "left")
    known = joined.where("idx IS NOT NULL").select("id", "field", "pos", "token", "idx")
    rare = joined.where("idx IS NULL").select("id", "field", "pos", "token")
    first = rare.withColumn("first", F.min(F.struct("field", "pos")).over(Window.partitionBy("id", "token")))
    number = F.dense_rank().over(Window.partitionBy("id").orderBy("first")) + first_rare - 1
    return known.unionAll(first.select("id", "field", "pos", "token", number.cast("string").alias("idx")))


def cipher_vocabulary(tokens: DataFrame, base: int = 0x4E00) -> DataFrame:
    """(token, char): every distinct token, by first appearance (doc_id, position), gets the next code point from `base`, the surrogates left out. More tokens than there are code points are an error."""
    first = tokens.select("doc_id", F.posexplode("tokens").alias("pos", "token")).groupBy("token").agg(F.min(F.struct("doc_id", "pos")).alias("first"))

    @F.pandas_udf("string")
    def char(rank: pd.Series) -> pd.Series:
        point = rank + base - 1
        point = point.where(point < 0xD800, point + 0x800)
        if len(point) and point.max() > 0x10FFFF:
            raise ValueError(f"more distinct tokens than code points from {base:#x}")
        return point.map(chr)

    return ranked_rows(first, [F.asc("first")], "rank").select("token", char("rank").alias("char"))


def decode_cipher(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, text): the characters of the tokens in order; tokens without one are left out."""
    chars = tokens.select("doc_id", F.posexplode("tokens").alias("pos", "token")).join(known, "token")
    return chars.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "char"))), lambda x: x["char"]), "").alias("text"))


def similar_words(matches: DataFrame, most: int = 15, least: float = 0.68) -> DataFrame:
    """Of (word, other, similarity): others as long as the word and above `least`, the `most` best of each, ties by other."""
    fits = matches.where((F.length("word") == F.length("other")) & (F.col("similarity") > least))
    window = Window.partitionBy("word").orderBy(F.desc("similarity"), "other")
    return fits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= most)


def ngram_meta(words: DataFrame, matches: DataFrame, **how) -> DataFrame:
    """(word, ids, n, likes) of (word): the code points of its characters, its length, and those of the words like it by `similar_words` of
    (word, other, similarity), best first; words without a vector or a like are kept."""

    def points(w: Column) -> Column:
        return F.array_join(F.transform(F.split(w, ""), lambda c: F.ascii(c)).cast("array<string>"), " ")

    near = similar_words(matches, **how).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("rank", "other"))).alias("s"))
    named = near.select("word", F.array_join(F.transform("s", lambda x: points(x["other"])), "|").alias("likes"))
    distinct = words.select("word").where("word <> ''").distinct()
    return distinct.join(named, "word", "left").select("word", points(F.col("word")).alias("ids"), F.length("word").alias("n"), F.coalesce("likes", F.lit("")).alias("likes"))


def rare_word_lines(records: DataFrame, id_col: str, columns: tuple[str, str], label_col: str, *, min_freq: int = 5, first_rare: int = 35_000, sep: str = " ") -> DataFrame:
    """(id, line): of each record the ids of both texts and the label, parted by tabs: the lines of a file of records with their rare words numbered."""
    mapped = map_rare_words(records, frequency_map(records, list(columns), sep), id_col, columns, min_freq=min_freq, first_rare=first_rare, sep=sep)
    texts = mapped.groupBy("id").agg(*(F.array_sort(F.collect_list(F.when(F.col("field") == k, F.struct("pos", "idx")))).alias(f"t{k}") for k in (0, 1)))
    ids = [F.array_join(F.transform(F.coalesce(f"t{k}", F.array().cast("array<struct<pos:int,idx:string>>")), lambda x: x["idx"]), sep) for k in (0, 1)]
    joined = records.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label")).join(texts, "id", "left")
    return joined.select("id", F.concat_ws("\t", *ids, F.coalesce("label", F.lit(""))).alias("line"))


def load_vocabulary(lines: DataFrame, line_col: str = "value", no_col: str = "line_no") -> DataFrame:
    """(token, idx) of numbered lines, one token each: the id is the rank of its first line; blank lines are none."""
    token = F.trim(F.col(line_col))
    first = lines.where(token != "").groupBy(token.alias("token")).agg(F.min(no_col).alias("first"))
    return ranked_rows(first, [F.asc("first")], "rank").select("token", (F.col("rank") - 1).cast("int").alias("idx"))


def _matches(texts: DataFrame, text: str, low: int, high: int, known: DataFrame, mark: str = "") -> DataFrame:
    """(text, found): of each text the (start, length) of its substrings of `low` to `high` characters in `known`(piece); one that does not
    begin the text is looked up behind `mark`. The vocabulary is joined, so it may have any size."""
    start = F.explode(F.sequence(F.lit(1), F.length(text) - (low - 1))).alias("start")
    starts = texts.where(F.length(text) >= low).select(text, start)
    spans = starts.select(text, "start", F.explode(F.sequence(F.lit(low), F.least(F.lit(high), F.length(text) - F.col("start") + 1))).alias("n"))
    piece = F.concat(F.when(F.col("start") > 1, mark).otherwise(""), F.substring(text, F.col("start"), F.col("n")))
    hits = spans.select(text, F.col("start").alias("start"), "n", piece.alias("piece")).join(known.select("piece").distinct(), "piece", "left_semi")
    return hits.groupBy(text).agg(F.collect_list(F.struct("start", "n")).alias("found"))


def word_pieces(words: DataFrame, vocab: DataFrame, col: str = "word", *, longest: int = 200) -> DataFrame:
    """(word, pieces): greedy longest matches of each distinct word in `vocab`(piece), inner pieces behind `##`; a word in `vocab`, without a
    full match, or of over `longest` characters, stays whole.

    All substrings of the distinct words meet the vocabulary in one semi-join; no vocabulary is sent to tasks. Null words are left out.
    """
    distinct = words.select(F.col(col).alias("word")).where("word IS NOT NULL").distinct()
    found = _matches(distinct.where(F.length("word") <= longest), "word", 1, longest, vocab, "##")

    @F.pandas_udf("array<string>")
    def split(words: pd.Series, found: pd.Series) -> pd.Series:
        def one(word: str, spans) -> list[str]:
            best: dict[int, int] = {}
            for span in [] if spans is None else spans:
                best[span["start"] - 1] = max(best.get(span["start"] - 1, 0), span["n"])
            out, at = [], 0
            while at < len(word) and at in best:
                out.append(("##" if at else "") + word[at : at + best[at]])
                at += best[at]
            return out if at == len(word) and word else [word]

        return pd.Series([one(w, s) for w, s in zip(words, found)], dtype=object)

    return distinct.join(found, "word", "left").select("word", split("word", "found").alias("pieces"))


def random_segments(lines: DataFrame, id_col: str, text_col: str, grams: DataFrame, *, seed: int = 1, times: int = 10, max_ngram: int = 4) -> DataFrame:
    """(id, tokens): up to `times` distinct cuts of each line into characters and n-grams of `grams`(ngram), chosen at random.

    The choice at a place is the md5 of seed, id, number of the cut and place, so it is the same on every run. The n-grams
    are joined to the lines' substrings, so there may be any number of them. Null and empty lines have no cut; rows with one id and text are one.
    """
    rows = lines.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text <> ''").distinct()
    found = _matches(rows.select("text").distinct(), "text", 2, max_ngram, grams.select(F.col("ngram").alias("piece")))

    @F.pandas_udf("array<array<string>>")
    def cuts(ids: pd.Series, texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for key, text, spans in zip(ids, texts, found):
            lengths, seen = {}, {}
            for span in [] if spans is None else spans:
                lengths.setdefault(span["start"] - 1, []).append(span["n"])
            for k in range(times):
                at, tokens = 0, []
                while at < len(text):
                    options = [1, *sorted(lengths.get(at, ()))]
                    drawn = int(hashlib.md5(f"{seed}:{key}:{k}:{at}".encode()).hexdigest()[:8], 16)
                    n = options[drawn % len(options)]
                    tokens.append(text[at : at + n])
                    at += n
                seen[tuple(tokens)] = None
            out.append([list(t) for t in seen])
        return pd.Series(out, dtype=object)

    joined = rows.join(found, "text", "left")
    return joined.select("id", F.explode(cuts(F.col("id").cast("string"), "text", "found")).alias("tokens"))
