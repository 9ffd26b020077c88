"""Corpus documents that hold passages of test items (problem 8)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.codepoints import mix, tokens
from kindred.session import broadcast_upto, cut, parallel, salted_join

#: Where a sentence ends, for the instruction that an item opens with.
ENDS = re.compile(r"(?<=[.?!。？！])")


class Terms(NamedTuple):
    row: np.ndarray
    term: np.ndarray
    pos: np.ndarray  #: of its first token, within the text
    size: np.ndarray  #: tokens in each text


def positional_terms(texts: pa.Array) -> Terms:
    """Every two neighbouring tokens are a term, at the position of the first; case, blanks and punctuation are gone."""
    t = tokens(texts)
    size = np.bincount(t.row, minlength=len(texts))
    pos = np.arange(len(t.row)) - (np.cumsum(size) - size)[t.row]
    at = np.nonzero(pos < size[t.row] - 1)[0]
    return Terms(t.row[at], mix(mix(t.hash[at], 23) + t.hash[at + 1], 29), pos[at], size)


def item_terms(items: DataFrame, shared_by: int, broadcast_rows: int) -> DataFrame:
    """(item, term, at, size) of (item, item_id, text), without standard instructions: an opening sentence that at least `shared_by` items have."""
    opening = F.split("text", ENDS.pattern, 2)[0]
    key = F.trim(F.lower(opening))
    shared = cut(items.groupBy(key.alias("opening")).agg(F.count_distinct("item_id").alias("n")).where(F.col("n") >= shared_by).select("opening"))
    told = items.withColumn("opening", key).withColumn("skip", F.length(opening))
    instructed = told.join(broadcast_upto(shared, broadcast_rows)[0], "opening", "left_semi").where(F.col("skip") < F.length("text"))
    own = told.join(broadcast_upto(instructed.select("item"), broadcast_rows)[0], "item", "left_anti").select("item", "text")
    worded = own.unionAll(instructed.select("item", F.col("text").substr(F.col("skip") + 1, F.length("text"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = positional_terms(batch.column(1))
            columns = [batch.column(0).take(pa.array(t.row)), pa.array(t.term.view(np.int64)), pa.array(t.pos.astype(np.int32)), pa.array(t.size[t.row].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "term", "at", "size"])

    return worded.mapInArrow(run, "item bigint, term bigint, at int, size int")


def positional_index(docs: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """(doc_id, part, terms, pos): the postings of each text of (doc_id, part, text), of the sorted `wanted` terms only, or of all where that is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = positional_terms(batch.column(2))
            row, term, pos = t.row, t.term, t.pos
            if wanted is not None:
                at = np.minimum(np.searchsorted(wanted, term), len(wanted) - 1)
                hit = wanted[at] == term
                row, term, pos = row[hit], term[hit], pos[hit]
            held, first = np.unique(row, return_index=True)
            offsets = pa.array(np.append(first, len(row)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(term.view(np.int64)), pa.array(pos.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(held)), batch.column(1).take(pa.array(held)), *lists], ["doc_id", "part", "terms", "pos"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, part bigint, terms array<bigint>, pos array<int>")


class Wordings(NamedTuple):
    """The terms of items, sorted, with the item (its place in `ids`) and position of each, and the items' sizes in tokens."""

    ranked: np.ndarray
    item: np.ndarray
    at: np.ndarray
    ids: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, terms: np.ndarray, at: np.ndarray, size: np.ndarray) -> Wordings:
        """From one entry a term: its item, the term, its position and the item's size."""
        known, first, code = np.unique(ids, return_index=True, return_inverse=True)
        terms = terms.view(np.uint64)
        order = np.argsort(terms, kind="stable")
        return Wordings(terms[order], code[order], at[order].astype(np.int64), known, size[first])


def _runs(known: Wordings, wanted: np.ndarray, terms: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Rows of (item, document position, item position, tokens), in this order: the longest exact runs that a document and each of the `wanted` items both hold."""
    low = np.searchsorted(known.ranked, terms)
    n = np.searchsorted(known.ranked, terms, "right") - low
    hit = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    asked = np.zeros(len(known.ids), bool)
    asked[np.searchsorted(known.ids, wanted)] = True
    kept = asked[known.item[hit]]
    hit, there = hit[kept], np.repeat(pos, n)[kept].astype(np.int64)
    item, here = known.item[hit], known.at[hit]
    by = np.lexsort((here, there - here, item))
    item, here, there = item[by], here[by], there[by]
    opens = np.ones(len(here), bool)
    opens[1:] = (here[1:] != here[:-1] + 1) | (there[1:] != there[:-1] + 1) | (item[1:] != item[:-1])
    start = np.nonzero(opens)[0]
    length = np.diff(np.append(start, len(here))) + 1
    out = np.stack([item[start], there[start], here[start], length], 1)
    return out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]


def near_clusters(runs: np.ndarray, gap: int, least: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(item, its runs as rows of item position, document position, tokens) of each cluster of runs that could be a passage.

    Runs that are farther apart than `gap` in the document are in no chain together; a cluster counts if its runs cover least[item] tokens of the item.
    """
    if not len(runs):
        return []
    item, there, here, n = runs.T
    # items one after the other, far apart
    place = there + item * (there.max() + n.max() + gap + 2)
    reached = np.maximum.accumulate(place + n)
    opens = np.nonzero(np.append(True, place[1:] - reached[:-1] > gap))[0]
    ends, out = np.append(opens[1:], len(runs)), []
    for k in np.nonzero(np.add.reduceat(n, opens) >= least[item[opens]])[0].tolist():
        own = slice(opens[k], ends[k])
        a, m = here[own], n[own]
        covered = np.zeros(int((a + m).max()) + 1, np.int64)
        np.add.at(covered, a, 1)
        np.add.at(covered, a + m, -1)
        if (np.cumsum(covered) > 0).sum() >= least[item[opens[k]]]:
            own = np.stack([a, there[own], m], 1)
            out.append((int(item[opens[k]]), own[np.lexsort((own[:, 2], own[:, 1], own[:, 0]))]))
    return out


def best_passage(runs: list[tuple[int, int, int]], gap: int) -> tuple[int, int, int, int, int]:
    """(tokens held, item from, item to, document from, document to) of the chain of runs that holds most, in order, with no gap beyond `gap` tokens on either side."""
    score, back = [], []
    for k, (a, b, n) in enumerate(runs):
        top, before = float(n), -1
        for m in range(k - 1, -1, -1):
            c, d, o = runs[m]
            if c >= a or d >= b:
                continue
            over = max(0, c + o - a, d + o - b)
            left, right = a - c - o, b - d - o
            if over < n and left <= gap and right <= gap:
                gained = score[m] + n - over - 0.1 * abs(left - right)
                if gained > top:
                    top, before = gained, m
        score.append(top)
        back.append(before)
    at = max(range(len(runs)), key=lambda k: score[k])
    path = []
    while at >= 0:
        path.append(runs[at])
        at = back[at]
    path.reverse()
    held, reached = 0, 0
    for a, _, n in path:
        held += max(0, a + n - max(a, reached))
        reached = max(reached, a + n)
    return held, path[0][0], path[-1][0] + path[-1][2], path[0][1], path[-1][1] + path[-1][2]


def accepted_passage(runs: list[tuple[int, int, int]], gap: int, size: int, share: float, density: float) -> tuple[int, int, int, int, int] | None:
    """The chain of a cluster's runs that holds most among those that span `share` of the item's `size` tokens with at least `density` of them held; None if no chain does.

    The chain of the highest score is tried first. Where it falls short, the most that any chain from one run to another holds is
    found for all pairs of a first and a last run, so a shorter, denser passage is not lost behind a longer, sparser one.
    """

    def fits(held: float, start: int, end: int) -> bool:
        return end - start >= share * size - 1e-9 and held >= density * max(end - start, 1) - 1e-9

    best = best_passage(runs, gap)
    if fits(*best[:3]):
        return best
    a, b, n = np.array(runs).T
    before, gains = [], []
    for k in range(len(runs)):
        over = np.maximum(0, np.maximum(a[:k] + n[:k] - a[k], b[:k] + n[:k] - b[k]))
        near = (a[k] - a[:k] - n[:k] <= gap) & (b[k] - b[:k] - n[:k] <= gap)
        m = np.nonzero((a[:k] < a[k]) & (b[:k] < b[k]) & (over < n[k]) & near)[0]
        before.append(m)
        gains.append(n[k] - over[m])
    found = []
    for low in range(0, len(runs), 256):
        starts = np.arange(low, min(low + 256, len(runs)))
        held = np.full((len(starts), len(runs)), -np.inf)
        held[starts - low, starts] = n[starts]
        for k in range(low, len(runs)):
            if len(before[k]):
                held[:, k] = np.maximum(held[:, k], (held[:, before[k]] + gains[k]).max(1))
        span = (a + n)[None, :] - a[starts][:, None]
        s, k = np.nonzero((held >= density * np.maximum(span, 1) - 1e-9) & (span >= share * size - 1e-9))
        found += [(int(held[i, j]), -int(b[starts[i]]), int(starts[i]), int(j)) for i, j in zip(s, k)]
    if not found:
        return None
    most, _, first, last = max(found)
    return most, int(a[first]), int(a[last] + n[last]), int(b[first]), int(b[last] + n[last])


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text_col: str = "text",
    *,
    share: float = 0.5,
    density: float = 0.75,
    spare: float = 0.2,
    gap: int = 10,
    shared_by: int = 3,
    most_terms: int = 1_000_000,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """(doc_id, item_id, held, item_share, density, doc_from, doc_to): documents with a passage that spans at least
    `share` of an item's wording, of which at least `density` stands in the document, in order.

    One pass over the documents builds the distributed positional index (terms of two neighbouring tokens, with positions, one
    row of postings for each text), restricted to terms of items; it is written to the checkpoint folder and all that follows reads it. Of each item the most
    frequent terms (by counts over all documents) are spared and the others, from the rarest on, are anchors; the index meets them in one
    join by term, and documents that hold enough of an item's anchors are candidates. The filter loses no passage that the rule accepts: a passage of n tokens holds at least
    density * n of them in runs of two or more, so at least half as many of the item's terms. Of the least such number over
    all passages the share `spare` is how many terms are no anchors; the rest of it is how many anchors a document must hold. For
    candidates the lists of all terms of the item are intersected with offsets: runs that both hold, chained in
    order with gaps of at most `gap` tokens, which is the proximity match (an exact phrase is one run). The opening
    sentence that at least `shared_by` items share is an instruction and no wording.

    Items stay a table. Up to `most_terms` distinct terms of items go to the tasks as an array (8 MB), so that other postings do not
    leave them; beyond, postings are kept whole. Tables of up to `broadcast_rows` rows (counted) are broadcast; beyond, joins
    shuffle, anchors of terms that much of the corpus holds with salts. Null and empty texts, and items of fewer than two
    tokens, match nothing; rows with the same id count as one document or item if they hold the same text, else each text is
    matched. Ties go to the earlier passage. Empty tables give an empty result; other columns are not read.
    """
    docs = docs.where(F.col(text_col).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_col).alias("part"), F.col(text_col).alias("text"))
    items = items.where(F.col(text_col).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(text_col).alias("text")).distinct()
    items = cut(items.withColumn("item", F.monotonically_increasing_id()))
    asked = cut(item_terms(items, shared_by, broadcast_rows))
    terms, small = broadcast_upto(cut(asked.select("term").distinct()), most_terms)
    # an array of the distinct terms; there is always one, which then matches nothing
    wanted = np.unique(np.append(terms.toArrow()["term"].to_numpy(), 0).astype(np.int64).view(np.uint64)) if small else None
    index = cut(positional_index(parallel(docs), wanted))
    # a text's own repeats of a term count once
    postings = index.select("doc_id", "part", F.explode(F.array_distinct("terms")).alias("term"))
    frequency = cut(postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(terms, "term", "left_semi"))
    # terms that no document holds are no anchors
    known = asked.join(broadcast_upto(frequency, broadcast_rows)[0], "term")
    by_rarity = Window.partitionBy("item").orderBy("n", "at")
    least = F.greatest(F.lit(1), F.ceil(F.ceil(density * F.greatest(F.lit(2), F.ceil(share * F.col("size") - 1e-9)) - 1e-9) / 2))
    dropped = F.least(F.floor(spare * least + 1e-9), least - 1)
    ranked = known.select("item", "term", "at", F.row_number().over(by_rarity).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy("item")).alias("held"), least.alias("least"), dropped.alias("dropped"))
    anchors = cut(ranked.where(F.col("rank") <= F.col("held") - F.col("dropped")).select("item", "term", "at", (F.col("least") - F.col("dropped")).alias("need")))
    few, small = broadcast_upto(anchors, broadcast_rows)
    hits = postings.join(few, "term") if small else salted_join(postings, few, "term", frequency)
    near = hits.groupBy("doc_id", "part", "item", "need").agg(F.count(F.lit(1)).alias("n")).where("n >= need").select("doc_id", "part", "item")
    if broadcast_upto(asked, broadcast_rows)[1]:
        # a row a document, with the numbers of its candidates; the wordings of all items are with the tasks
        sent = asked.select("item", "term", "at", "size").toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(Wordings.of(*(sent[c].to_numpy() for c in ("item", "term", "at", "size"))))
        pairs = near.groupBy("doc_id", "part").agg(F.collect_list("item").alias("items")).join(index, ["doc_id", "part"]).select("doc_id", "items", "terms", "pos")
    else:
        shared = None
        by_item = asked.groupBy("item").agg(F.collect_list("term").alias("wording"), F.collect_list("at").alias("at"), F.max("size").alias("size"))
        pairs = near.join(index, ["doc_id", "part"]).join(by_item, "item").select("doc_id", F.array("item").alias("items"), "terms", "pos", "wording", "at", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                own = {c: batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in batch.schema.names if c not in ("doc_id", "size")}
                if shared:
                    known = shared.value
                else:
                    n = len(own["wording"])
                    known = Wordings.of(np.repeat(own["items"], n), own["wording"], own["at"], np.repeat(batch.column("size")[row].as_py(), n))
                runs = _runs(known, own["items"], own["terms"].view(np.uint64), own["pos"])
                for item, cluster in near_clusters(runs, gap, density * share * known.size - 1e-9):
                    size = int(known.size[item])
                    best = accepted_passage([tuple(r) for r in cluster.tolist()], gap, size, share, density)
                    if best:
                        held, start, end, first, last = best
                        out.append((row, int(known.ids[item]), held, (end - start) / size, held / (end - start), first, last))
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(columns[0], pa.int64())), *(pa.array(c, q) for c, q in zip(columns[1:], kinds))], ["doc_id", "item", "held", "item_share", "density", "doc_from", "doc_to"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # few bytes, much to compute: a number of parts that adaptive execution does not lower
    pairs = pairs.repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism * 2))
    found = pairs.mapInArrow(run, f"doc_id {kind}, item bigint, held int, item_share double, density double, doc_from int, doc_to int")
    named = found.join(broadcast_upto(items.select("item", "item_id"), broadcast_rows)[0], "item")
    best = F.max_by(F.struct("held", "item_share", "density", "doc_from", "doc_to"), F.struct("held", -F.col("doc_from")))
    return named.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")
