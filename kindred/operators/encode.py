"""Text pairs as rows of ids for encoders: one sequence a text, both joined, every text by itself, or four arrays side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import word_tokens
from kindred.operators.pairs import encode_pairs, ids_text, padded_ids
from kindred.operators.vocab import texts_to_sequences

FORMS = ("plain", "joint", "single", "tetrad")


def encoded(pairs: DataFrame, known: DataFrame, size: int, form: str = "joint", *, id_col: str = "pair_id", a: str = "text_a", b: str = "text_b", label: str = "labels", unknown: int = 1, tokenize: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """Pairs as ids of `known`(token, idx), padded to `size` by 0; tokens outside it are `unknown`, a missing label is 0.

    plain: (id, a_ids, b_ids, label) without markers. joint: (id, ids, segments, label) of both texts as one sequence. single:
    (id, side, ids, segments, label), two rows a pair, side 0 and 1. tetrad: (id, a_ids, a_segments, b_ids, b_segments, label). Ids and
    segments are texts of numbers between blanks. Pairs with a null text are left out; with markers, tokens go from before the last one where a sequence is too long.
    """
    if form not in FORMS:
        raise ValueError(f"form is one of {FORMS}")
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(id_col).alias("id"), tokenize(F.col(a)).alias("a"), tokenize(F.col(b)).alias("b"), F.coalesce(F.col(label).cast("string"), F.lit("0")).alias("label"))
    if form == "joint":
        tokens, parts = encode_pairs(F.col("a"), F.col("b"), size)
        sides = rows.select("id", F.lit(0).alias("side"), "label", tokens.alias("tokens"), parts.alias("segments"))
    else:
        both = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(c).alias("tokens")) for k, c in enumerate("ab")))).alias("s")
        sides = rows.select("id", "label", both).select("id", "s.side", "label", "s.tokens")
        if form != "plain":
            tokens, parts = encode_pairs(F.col("tokens"), None, size)
            sides = sides.select("id", "side", "label", tokens.alias("tokens"), parts.alias("segments"))
    keyed = sides.withColumn("doc_id", F.struct("id", "side"))
    seqs = texts_to_sequences(keyed.select("doc_id", "tokens"), known, oov_index=unknown).select("doc_id", ids_text(padded_ids(F.col("seq"), size)).alias("ids"))
    told = keyed.select("doc_id", "label", *([] if form == "plain" else [ids_text(padded_ids(F.col("segments"), size)).alias("segments")]))
    out = told.join(seqs, "doc_id").select("doc_id.id", "doc_id.side", *(c for c in told.columns if c != "doc_id"), "ids")
    if form == "joint":
        return out.select("id", "ids", "segments", "label")
    if form == "single":
        return out.select("id", "side", "ids", "segments", "label")
    names = {"ids": "ids"} if form == "plain" else {"ids": "ids", "segments": "segments"}
    one = [F.max(F.when(F.col("side") == k, F.col(c))).alias(f"{s}_{n}") for k, s in enumerate("ab") for c, n in names.items()]
    return out.groupBy("id", "label").agg(*one).select("id", *(f"{s}_{n}" for s in "ab" for n in names.values()), "label")


def encoded_lines(rows: DataFrame, sep: str = "\t") -> DataFrame:
    """(value): the columns of `encoded` but the id as lines, for `readers.write_lines`; of single texts the first side comes first."""
    return rows.select(F.concat_ws(sep, *(c for c in rows.columns if c not in ("id", "side"))).alias("value"))
