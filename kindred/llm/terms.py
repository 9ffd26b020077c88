"""Occurrences and record counts of every term, by a global integer dictionary and blockwise count arrays (problem 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.session import cut

#: Identifiers per block, a power of two; a block's two arrays take 16 bytes an identifier.
BLOCK = 1 << 13
#: Terms of a chunk of records that are encoded together.
CHUNK = 1 << 20
#: Blocks that a task accumulates before it hands them on: 128 MB.
MAX_BLOCKS = 1024


def distinct_records(df: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """(doc_id, tokens): one row per id. Of rows that share an id the greatest array is taken, a null one last."""
    return df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(tokens_col).alias("tokens"))


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records in chunks: the distinct terms of each chunk and, record by record, the places of its terms among them."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        lists = batch.column(0)
        sizes = np.diff(lists.offsets.to_numpy())
        ends = np.cumsum(sizes)
        first = 0
        while first < len(lists):
            # whole records, up to CHUNK terms unless a single one has more
            reached = ends[first] - sizes[first] + CHUNK
            last = max(first + 1, int(np.searchsorted(ends, reached, "right")))
            values = lists[first:last].flatten().dictionary_encode()
            if len(values):
                arrays = values.dictionary, values.indices.cast(pa.int32()), pa.array(sizes[first:last].astype(np.int32))
                lists_of = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in arrays]
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + number]), *lists_of], ["chunk", "words", "codes", "sizes"])
                number += 1
            first = last


def _block_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts occurrences and records of the encoded terms of each chunk in one pair of arrays per block of identifiers."""
    blocks: dict[int, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        keys = list(blocks)
        flat = np.concatenate([blocks[k] for k in keys]) if keys else np.zeros((0, 2), np.int64)
        offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BLOCK)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), *(pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(flat[:, k]))) for k in (0, 1))],
            ["block", "counts", "records"],
        )

    for batch in batches:
        for row in range(batch.num_rows):
            codes, sizes, ids = (batch.column(k)[row].values.to_numpy(zero_copy_only=False) for k in ("codes", "sizes", "ids"))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            # of each identifier of the chunk: its occurrences, and the records it is in
            n = np.bincount(codes, minlength=len(ids))
            d = np.bincount(np.unique(owner * len(ids) + codes) % len(ids), minlength=len(ids))
            order = np.argsort(ids // BLOCK, kind="stable")
            keys, first = np.unique(ids[order] // BLOCK, return_index=True)
            for key, at in zip(keys.tolist(), np.split(order, first[1:])):
                sums = blocks.setdefault(key, np.zeros((BLOCK, 2), np.int64))
                sums[ids[at] % BLOCK] += np.stack([n[at], d[at]], 1)  # an identifier is once in a chunk
            if len(blocks) > MAX_BLOCKS:
                yield flush()
                blocks = {}
    if blocks:
        yield flush()


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the arrays of each block; all of a block's rows are in this task, one block after another."""
    at, sums = None, None

    def done() -> pa.RecordBatch:
        used = np.nonzero(sums[:, 0])[0]
        return pa.RecordBatch.from_arrays([pa.array(at * BLOCK + used), pa.array(sums[used, 0]), pa.array(sums[used, 1])], ["term_id", "word_counts", "word_docs"])

    for batch in batches:
        for row, block in enumerate(batch.column(0).to_pylist()):
            if block != at:
                if at is not None:
                    yield done()
                at, sums = block, np.zeros((BLOCK, 2), np.int64)
            for k in (0, 1):
                sums[:, k] += batch.column(k + 1)[row].values.to_numpy(zero_copy_only=False)
    if at is not None:
        yield done()


def term_dictionary(terms: DataFrame) -> DataFrame:
    """(token, term_id) of the distinct tokens of `terms`. Identifiers are dense within a partition, so that blocks are
    full; they are written to the checkpoint folder, as a task that runs again may meet its rows in another order."""
    return cut(terms.select("token").distinct().withColumn("term_id", F.monotonically_increasing_id()))


def term_counts(
    df: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", *, rare_below: int = 3, common_above: float = 0.05
) -> DataFrame:
    """(token, word_counts, word_docs, mark) of every lower-cased term of the whole collection.

    Each id counts once, however often it is delivered; null ids, null and empty tokens and null arrays add nothing, but
    a record without tokens counts as a record. Records are encoded in chunks over the chunk's own terms, the distinct terms of all chunks
    get the identifiers of one global dictionary, and each chunk's terms are replaced by theirs; occurrences and records are then counted by identifier in
    arrays, block by block, and the arrays summed by identifier range. mark is `rare` where fewer than `rare_below` records hold the term,
    `common` where more than `common_above` of all records do, else null. A term
    that is in every record is shuffled once a chunk. An empty table gives an empty result; other
    columns are not read.
    """
    docs = distinct_records(df, id_col, tokens_col)
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    tokens = F.filter(F.transform("tokens", lambda t: F.lower(t)), lambda t: t.isNotNull() & (t != ""))
    lists = docs.where(F.col("tokens").isNotNull()).select(tokens.alias("tokens"))
    chunks = cut(lists.mapInArrow(_encoded, "chunk bigint, words array<string>, codes array<int>, sizes array<int>"))
    words = chunks.select("chunk", F.posexplode("words").alias("code", "token"))
    dictionary = term_dictionary(words)
    ids = words.join(dictionary, "token").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("code", "term_id"))).alias("ids"))
    encoded = chunks.select("chunk", "codes", "sizes").join(ids.select("chunk", F.col("ids.term_id").alias("ids")), "chunk")
    blocks = encoded.select("codes", "sizes", "ids").mapInArrow(_block_arrays, "block bigint, counts array<bigint>, records array<bigint>")
    summed = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_sum_blocks, "term_id bigint, word_counts bigint, word_docs bigint")
    mark = F.when(F.col("word_docs") < rare_below, "rare").when(F.col("word_docs") > common_above * F.col("total"), "common")
    return summed.join(dictionary, "term_id").crossJoin(F.broadcast(total)).select("token", "word_counts", "word_docs", mark.alias("mark"))
