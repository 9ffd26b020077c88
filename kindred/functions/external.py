"""Tokenisers outside the JVM: SentencePiece models and pluggable word segmenters, on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The segmenter that needs no model: a Chinese character, or a run of other letters and digits, or a single other mark.
PLAIN_WORD = r"[㐀-䶿一-鿿豈-﫿]|[\p{L}\p{N}&&[^㐀-䶿一-鿿豈-﫿]]+|[^\s\p{Z}\p{L}\p{N}]"


@lru_cache(maxsize=2)
def _model(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def sentence_pieces(df: DataFrame, text_col: str, out_col: str = "ids", model: str = MODEL, decode: bool = False) -> DataFrame:
    """`df` with the ids of each text under a SentencePiece model (or, with `decode`, the text of each id array). The driver reads the
    model and sends it along; null stays null."""
    with open(model, "rb") as file:
        data = df.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("string" if decode else "array<int>")
    def run(col: pd.Series) -> pd.Series:
        m = _model(data.value)
        if decode:
            out = m.decode([[] if ids is None else [int(i) for i in ids] for ids in col])
        else:
            out = m.encode(col.fillna("").tolist())
        return pd.Series(out, index=col.index, dtype=object).where(col.notna(), None)

    return df.withColumn(out_col, run(F.col(text_col)))


def piece_kinds(df: DataFrame, id_col: str, model: str = MODEL) -> DataFrame:
    """`df` with `piece`, `special` (a control, unknown or unused piece) and `decodable` (known and not special) of each SentencePiece id; null stays null."""
    with open(model, "rb") as file:
        data = df.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("struct<piece: string, special: boolean, decodable: boolean>")
    def run(col: pd.Series) -> pd.DataFrame:
        m = _model(data.value)
        rows = []
        for i in col:
            known = i == i and i is not None and 0 <= int(i) < m.vocab_size()
            k = int(i) if known else 0
            special = known and bool(m.is_control(k) or m.is_unknown(k) or m.is_unused(k))
            rows.append((m.id_to_piece(k), special, not special) if known else (None, False, False))
        return pd.DataFrame(rows, columns=["piece", "special", "decodable"])

    return df.withColumn("__kind", run(F.col(id_col))).select("*", "__kind.*").drop("__kind")


def segmented(df: DataFrame, text_col: str, out_col: str = "words", segment: Callable[[str], list[str]] | None = None, sep: str = " ") -> DataFrame:
    """`df` with the words of each text, joined by `sep`. `segment` is any function from a text to its words that the workers can import;
    without one PLAIN_WORD is used, within the JVM. Null stays null."""
    if segment is None:
        return df.withColumn(out_col, F.array_join(F.regexp_extract_all(F.col(text_col), F.lit(f"({PLAIN_WORD})"), 1), sep))
    cut = segment

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda t: None if t is None else sep.join(cut(t)))

    return df.withColumn(out_col, run(F.col(text_col)))
