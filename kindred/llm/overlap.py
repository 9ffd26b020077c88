"""Records of evaluation splits that occur, exactly or almost, in the training split (problem 2)."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.codepoints import CJK_RANGES, RADICALS, mix
from kindred.llm.copies import formatting_keys
from kindred.llm.winnow import Records, bitmap, fingerprints, records
from kindred.session import broadcast_upto, cut

_CJK = "".join(f"{chr(a)}-{chr(b)}" for a, b in (*CJK_RANGES, RADICALS))
TOKEN = re.compile(f"[{_CJK}]|[^\\W_{_CJK}]+")

PAIR_COLUMNS = ["train_sig", "train_sig2", "eval_sig", "eval_sig2", "seeds", "train_aligned", "eval_aligned", "eval_coverage", "similarity", "equal"]
PAIR_TYPES = ["bigint"] * 4 + ["int"] + ["double"] * 4 + ["boolean"]
#: Size field that marks the fingerprint of a whole record's formatting key.
WHOLE = -1


def _common_tokens(df: DataFrame, fields: list[str], most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The hashes of the `most` tokens that are in the most records, sorted, the weights of their counts, and the number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, n = np.unique(records(batch.columns).token, return_counts=True)
            columns = [pa.array([*token.view(np.int64).tolist(), None], pa.int64()), pa.array(np.append(n, batch.num_rows))]
            yield pa.RecordBatch.from_arrays(columns, ["token", "n"])

    counted = df.select(*fields).mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    # the row without a token is that of the number of records, which no token exceeds
    top = counted.where("n > 1 OR token IS NULL").orderBy(F.desc_nulls_first(F.col("token").isNull()), F.desc("n"), "token").limit(most + 1).collect()
    total, top = (top[0]["n"], top[1:]) if top else (0, [])
    token = np.array([r["token"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], np.array([weight_of(r["n"]) for r in top], np.uint64)[order], total


def weight_of(records: float) -> int:
    """How much a token in so many records weighs: eight times the binary logarithm."""
    return int(8 * math.log2(max(records, 1)))


def _signed(texts: list[pa.Array]) -> tuple[Records, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, formatting key, two halves of a signature of 128 bits, whether the row takes part): rows with one signature have one formatting key and one set of tokens, so all pairs of such rows are alike."""
    low, high, solid = formatting_keys(texts)
    r = records(texts)
    sig = []
    for k, (x, y) in enumerate(((low, high), (high, low))):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(r.token, 61 + k), dtype=np.uint64)])
        with np.errstate(over="ignore"):
            tokens = sums[r.first + r.size] - sums[r.first]
            sig.append(mix(mix(x.view(np.uint64) ^ mix(y.view(np.uint64), 67), 71 + k) + tokens, 73).view(np.int64))
    return r, low, *sig, solid


def _fingerprint_rows(df: DataFrame, fields: list[str], threshold: float, common: np.ndarray, weights: np.ndarray, frequent: int) -> DataFrame:
    """(fp, sig, bits, size): the selected seeds of each record, and one for its whole formatting key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, low, sig, other, solid = _signed(batch.columns)
            # a batch gives copies of a record once
            once = np.zeros(len(sig), bool)
            once[np.unique(np.stack([sig, other], 1), axis=0, return_index=True)[1] if len(sig) else []] = True
            solid &= once
            owner, fp = fingerprints(r, threshold, common, weights, frequent)
            some = solid[owner]
            owner, fp = owner[some], fp[some].view(np.int64)
            bits, whole = bitmap(r).view(np.int64), np.nonzero(solid)[0]
            out = [
                np.concatenate([fp, low[whole]]),
                np.concatenate([sig[owner], sig[whole]]),
                np.concatenate([bits[owner], np.zeros(len(whole), np.int64)]),
                np.concatenate([r.size[owner], np.full(len(whole), WHOLE)]).astype(np.int32),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["fp", "sig", "bits", "size"])

    # one shuffle, by fp, serves the copies that are left and the join
    rows = df.select(*fields).mapInArrow(run, "fp bigint, sig bigint, bits bigint, size int")
    return rows.repartition("fp").dropDuplicates()


def _members(df: DataFrame, fields: list[str]) -> DataFrame:
    """(sig, sig2, id, train, th), th being a hash of the texts as they are, which tells rows with one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, sig, other, solid = _signed(batch.columns[3:])
            keep = pa.array(np.nonzero(solid)[0])
            columns = [pa.array(sig).take(keep), pa.array(other).take(keep), *(batch.column(k).take(keep) for k in range(3))]
            yield pa.RecordBatch.from_arrays(columns, ["sig", "sig2", "id", "train", "th"])

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", "train", F.xxhash64(*fields).alias("th"), *fields).mapInArrow(run, f"sig bigint, sig2 bigint, id {kind}, train boolean, th bigint")


def _collinear(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of places that follow each other on both sides; no two share a side's place."""
    tails: list[int] = []
    ends, back = [], []
    for k, (_, b) in enumerate(places):
        at = bisect_left(tails, b)
        back.append(ends[at - 1] if at else -1)
        tails[at : at + 1], ends[at : at + 1] = [b], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(places[k])
        k = back[k]
    return out[::-1]


def _unique_places(x: list, y: list) -> list[tuple[int, int]]:
    """Where values that occur once in either stand in both, in the order of the first."""
    once = [{v: k for k, v in enumerate(z) if counts[v] == 1} for z, counts in ((x, Counter(x)), (y, Counter(y)))]
    return [(k, once[1][v]) for v, k in once[0].items() if v in once[1]]


def align(x: list[str], y: list[str], seed: int = 2) -> tuple[int, set[str]]:
    """(seeds chained, tokens aligned): seeds of `seed` tokens that occur once in either text are chained, the chain is extended along both
    texts until they differ, and the gaps between are filled by tokens that occur once in either side of the gap, in order."""
    grams = [list(zip(*(z[k:] for k in range(seed)))) for z in (x, y)]
    chain = _collinear(_unique_places(*grams))
    held: set[str] = set()
    a = b = 0
    for i, j in [*chain, (len(x), len(y))]:
        if i < a or j < b:
            continue
        p, q = i, j
        while p > a and q > b and x[p - 1] == y[q - 1]:
            p, q = p - 1, q - 1
        held.update(x[p:i])
        while p > a and q > b and x[a] == y[b]:
            held.add(x[a])
            a, b = a + 1, b + 1
        if p > a and q > b:
            held.update(x[a + k] for k, _ in _collinear(_unique_places(x[a:p], y[b:q])))
        a, b = i, j
        while a < len(x) and b < len(y) and x[a] == y[b]:
            held.add(x[a])
            a, b = a + 1, b + 1
    return len(chain), held


def _verify(threshold: float):
    """For each candidate pair: the chain of its seeds over the two texts, the alignment it extends to, and whether the pair counts.

    A record's texts are read one after the other; an exchanged pair aligns with its texts exchanged. Tokens aligned decide where they reach the threshold.
    As word order does not matter, tokens that both hold elsewhere are added where they do not: the exact comparison.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {k: batch.column(k).to_pylist() for k in ("train_sig", "train_sig2", "eval_sig", "eval_sig2", "ta", "tb", "ea", "eb")}
            keys = [formatting_keys([batch.column(k), batch.column(m)])[:2] for k, m in (("ta", "tb"), ("ea", "eb"))]
            same = (keys[0][0] == keys[1][0]) & (keys[0][1] == keys[1][1])
            out: list[tuple] = []
            for at, (*sigs, ta, tb, ea, eb) in enumerate(zip(*rows.values())):
                x, ya, yb = TOKEN.findall(f"{ta} {tb}".lower()), TOKEN.findall(ea.lower()), TOKEN.findall(eb.lower())
                n, m = len(set(x)), len({*ya, *yb})
                seeds, held = align(x, ya + yb)
                if len(held) < max(n, m):
                    seeds, held = max((seeds, held), align(x, yb + ya), key=lambda r: len(r[1]))
                both, aligned = len(held), len(held)
                if both < threshold * (n + m - both) - 1e-9:
                    both = len(set(x).intersection(ya + yb))
                if same[at] or (n + m and both >= threshold * (n + m - both) - 1e-9):
                    both = len(set(x).intersection(ya + yb))
                    out.append((*sigs, seeds, aligned / max(1, n), aligned / max(1, m), both / max(1, m), both / (n + m - both) if n + m else 1.0, bool(same[at])))
            kinds = [pa.int64()] * 4 + [pa.int32()] + [pa.float64()] * 4 + [pa.bool_()]
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], PAIR_COLUMNS)

    return run


class Overlaps(NamedTuple):
    """pairs between classes of copies, named by the 128 bits of their signatures: train_sig, train_sig2, eval_sig, eval_sig2, the
    seeds chained, the share of either record's tokens that the chain's alignment covers, the share of the evaluation record's
    tokens that the other holds anywhere, the similarity, and whether they are equal up to formatting; and members(sig, sig2, id,
    train): the rows of each class that is in a pair."""

    pairs: DataFrame
    members: DataFrame

    def side(self, train: bool) -> DataFrame:
        name = "train" if train else "eval"
        rows = self.members.where("train" if train else "NOT train")
        return rows.select(F.col("sig").alias(f"{name}_sig"), F.col("sig2").alias(f"{name}_sig2"), F.col("id").alias(f"{name}_id"))

    def by_row(self) -> DataFrame:
        """Every pair of rows, copies included: as many as there are."""
        pairs = self.pairs.join(self.side(True), TRAIN).join(self.side(False), EVAL)
        return pairs.drop(*TRAIN, *EVAL)

    def links(self) -> DataFrame:
        """(id, train, class_id, n_links): each row in a pair, the smallest id of its class on its side, and with how many rows of the other side it is paired. No pair of rows is made."""
        out = None
        for train, own, other in ((True, TRAIN, EVAL), (False, EVAL, TRAIN)):
            mine, theirs = self.side(train), self.side(not train)
            sizes = theirs.groupBy(*other).agg(F.count(F.lit(1)).alias("n"))
            n = self.pairs.select(*own, *other).join(sizes, other).groupBy(*own).agg(F.sum("n").alias("n_links"))
            id_col = "train_id" if train else "eval_id"
            first = mine.groupBy(*own).agg(F.min(id_col).alias("class_id"))
            part = mine.join(n.join(first, own), own).select(F.col(id_col).alias("id"), F.lit(train).alias("train"), "class_id", "n_links")
            out = part if out is None else out.unionAll(part)
        return out


TRAIN, EVAL = ["train_sig", "train_sig2"], ["eval_sig", "eval_sig2"]


def cross_split_overlaps(
    df: DataFrame,
    id_col: str = "pair_id",
    fields: tuple[str, str] = ("text_a", "text_b"),
    split_col: str = "split_name",
    *,
    train: str = "train",
    held_out: tuple[str, ...] = ("dev", "test"),
    threshold: float = 0.85,
    common_tokens: int = 65_536,
    frequent: float = 0.04,
    least_frequent: int = 1024,
    broadcast_rows: int = 1_000_000,
) -> Overlaps:
    """Training and held-out records that are equal up to formatting and the order of the two texts, or whose distinct tokens coincide
    to at least `threshold` (tokens in both by tokens in either): pairs of classes of copies, and their members.

    Winnowing: each record's distinct tokens are put into one order (that of their hashes), so that neither word order
    nor exchanged texts matter. Two records which differ in d tokens then share a run of ceil(common / (d + 1)) tokens;
    windows of no more than that run select the least of their rolling hashes, so each qualifying pair shares a selected
    one: no pair is missed. Hashes of rare tokens count as less, with the counts of the `common_tokens` most frequent
    tokens (a fixed bound on what tasks receive; others count as rare, which costs time but no pair). Seeds of tokens that are each in
    a share `frequent` of the records, and in `least_frequent` of them, are split by a second seed (`winnow.fingerprints`), so that a frequent wording is no key by itself.
    Fingerprints are joined across splits, once for each class of copies however large it is, and a 64-bit sketch in
    each row drops, within the join, pairs that differ in more tokens than they may. Of every other candidate the whole texts are
    read: seeds that occur once in either are chained in the order of the texts, the chain is extended to an alignment, and its tokens decide,
    with those that both hold in another place added where it falls short. Formatting keys
    join the same way as a fingerprint of the whole.

    Rows with a null id or split, or a text that is null or has no letter or digit, take no part; rows with one id and split count
    once, each of their texts by itself. Texts are compared whole. Up to `broadcast_rows` classes and ids in pairs are
    broadcast, more are joined by a shuffle. An empty table gives an empty result; other columns are not read.
    """
    a, b = fields
    sides = F.when(F.col(split_col) == train, True).when(F.col(split_col).isin(*held_out), False)
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(a).alias("a"), F.col(b).alias("b"), sides.alias("train"))
    rows = rows.where("train IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL")
    common, weights, n_records = _common_tokens(rows, ["a", "b"], common_tokens)
    left, right = (_fingerprint_rows(rows.where(side), ["a", "b"], threshold, common, weights, weight_of(max(least_frequent, frequent * n_records))) for side in ("train", "NOT train"))
    left, right = left.toDF("fp", "train_sig", "t_bits", "t_size"), right.toDF("fp", "eval_sig", "e_bits", "e_size")
    total = F.col("t_size") + F.col("e_size")
    # i common of n + m tokens make a similarity of i / (n + m - i)
    least = F.ceil(total * F.lit(threshold / (1 + threshold)) - 1e-6)
    near = F.bit_count(F.col("t_bits").bitwiseXOR(F.col("e_bits"))) <= total - 2 * least
    whole = (F.col("t_size") == WHOLE) & (F.col("e_size") == WHOLE)
    known = (F.col("t_size") > 0) & (F.col("e_size") > 0)
    found = cut(left.join(right, "fp").where(whole | (known & near)).select("train_sig", "eval_sig").distinct())
    sigs = cut(found.select(F.col("train_sig").alias("sig")).union(found.select("eval_sig")).distinct())
    members = cut(_members(rows, ["a", "b"]).join(broadcast_upto(sigs, broadcast_rows)[0], "sig", "left_semi").distinct())
    first = cut(members.groupBy("sig", "sig2", "train").agg(F.min(F.struct("id", "th")).alias("r")).select("sig", "sig2", "train", "r.*"))
    texts = rows.withColumn("th", F.xxhash64("a", "b")).join(broadcast_upto(first, broadcast_rows)[0], ["id", "train", "th"])
    texts = cut(texts.dropDuplicates(["sig", "sig2", "train"]).select("sig", "sig2", "train", "a", "b"))
    left = texts.where("train").select(F.col("sig").alias("train_sig"), F.col("sig2").alias("train_sig2"), F.col("a").alias("ta"), F.col("b").alias("tb"))
    right = texts.where("NOT train").select(F.col("sig").alias("eval_sig"), F.col("sig2").alias("eval_sig2"), F.col("a").alias("ea"), F.col("b").alias("eb"))
    joined = found.join(left, "train_sig").join(right, "eval_sig").select(*TRAIN, *EVAL, "ta", "tb", "ea", "eb")
    return Overlaps(joined.mapInArrow(_verify(threshold), ", ".join(map(" ".join, zip(PAIR_COLUMNS, PAIR_TYPES)))), members.drop("th").distinct())


def overlaps_found(df: DataFrame, **how) -> DataFrame:
    """(id_1, id_2), the smaller id first."""
    pairs = cross_split_overlaps(df, **how).by_row()
    return pairs.select(F.least("train_id", "eval_id").alias("id_1"), F.greatest("train_id", "eval_id").alias("id_2")).distinct()


def overlap_report(df: DataFrame, id_col: str = "pair_id", split_col: str = "split_name", source_col: str = "source", **how) -> DataFrame:
    """(split_name, source, n_records, n_overlapping, n_pairs, n_equal, mean_coverage) of each held-out split and source; null sources are a source of their own."""
    found = cross_split_overlaps(df, id_col=id_col, split_col=split_col, **how)
    # training copies are counted by class, so that no pair of rows is made
    sizes = found.side(True).groupBy(*TRAIN).agg(F.count(F.lit(1)).alias("n"))
    classes = found.pairs.join(sizes, TRAIN).groupBy(*EVAL).agg(F.sum("n").alias("links"), F.max(F.col("equal").cast("int")).alias("equal"), F.max("eval_coverage").alias("coverage"))
    best = found.side(False).join(classes, EVAL)
    best = best.groupBy("eval_id").agg(F.sum("links").alias("links"), F.max("equal").alias("equal"), F.max("coverage").alias("coverage"))
    held_out = df.where(F.col(split_col).isin(*how.get("held_out", ("dev", "test"))))
    held_out = held_out.select(F.col(id_col).alias("eval_id"), F.col(split_col).alias("split_name"), F.col(source_col).alias("source"))
    joined = held_out.join(best, "eval_id", "left")
    return joined.groupBy("split_name", "source").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count("links").alias("n_overlapping"),
        F.coalesce(F.sum("links"), F.lit(0)).alias("n_pairs"),
        F.coalesce(F.sum("equal"), F.lit(0)).cast("long").alias("n_equal"),
        F.round(F.avg("coverage"), 6).alias("mean_coverage"),
    )


def overlap_links(df: DataFrame, id_col: str = "pair_id", **how) -> DataFrame:
    """(id_col, class_id, n_links): one row for each overlapping record, with the class of copies it is in and the number of records of the other side it overlaps with."""
    return cross_split_overlaps(df, id_col=id_col, **how).links().select(F.col("id").alias(id_col), "class_id", "n_links")
