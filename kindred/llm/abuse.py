"""Scores for abusive, hateful or sexual content by a chain of linear classifiers (problem 9)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.codepoints import CJK, LIMIT, OTHER, WORD, Decoded, decode, mix, tables, tokens_of
from kindred.llm.lookalike import CYRILLIC, GREEK, SPACES
from kindred.session import parallel

#: Hashed features; and tokens in a stretch of text without the end of a sentence.
WIDTH, STRETCH = 1 << 20, 24
# Characters that stand for letters in disguised words.
LEET = ("@$013457", "asoieast")
# What is put between the characters of a disguised word.
FILLERS = "*~～.·_-xX|/^+#"
# Ends of sentences; the first ones only before a blank or the end.
ENDS, CJK_ENDS = ".?!", "。？！；;\n"
# Words by which a group of toxic stretches is named.
SEEDS = {
    "sexual": "fuck lick nudes naked porn xxx tits moan sex strip horny 裸 呻 脱 炮 骚 爽 妇 色",
    "threat": "choke punched kill burn slapped die dead hurt beat disappear hope swear 死 打 杀 扔 砍 弄",
    "hate": "vermin animal thieves liars dirty country disease born breed kind 虫 畜 偷 赶 配 害 群",
    "insult": "idiot moron stupid useless worthless scumbag loser bastard dumbass halfwit imbecile cretin lowlife pathetic brainless shut filthy 贱 废 蠢 渣 傻 脑 滚 嘴 狗 痴 蛋",
}


@lru_cache(maxsize=1)
def _stand_ins() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the letter it stands for, and whether it is passed over."""
    kind, _ = tables()
    table = np.arange(LIMIT, dtype=np.uint32)
    for a, b in (CYRILLIC, GREEK, LEET):
        for x, y in zip(a, b):
            table[ord(x)] = ord(y.lower())
    for c in range(0xFF01, 0xFF5F):  # full-width forms
        if kind[c] == WORD:
            table[c] = ord(chr(c - 0xFEE0).lower())
    for c in SPACES:
        table[ord(c)] = 32
    ignored = np.zeros(LIMIT, bool)
    ignored[[0xAD, 0xFEFF, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), *range(0x300, 0x370)]] = True
    return table, ignored


def _undisguised(d: Decoded) -> Decoded:
    """Look-alikes and stand-ins by their letters; ignorables, fillers within words and drawn-out letters gone."""
    points, row = d.points, d.row
    kind, _ = tables()
    table, ignored = _stand_ins()
    keep = ~ignored[points]
    points, row = table[points[keep]], row[keep]
    k = kind[points]

    def beside(test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.zeros(len(test), bool), np.zeros(len(test), bool)
        if len(test):
            same = row[1:] == row[:-1]
            left[1:], right[:-1] = test[:-1] & same, test[1:] & same
        return left, right

    filler = np.isin(points, [ord(c) for c in FILLERS])
    cjk_left, cjk_right = beside(k == CJK)
    latin = (k == WORD) & (points < 0x250)
    word_left, word_right = beside(latin)
    points = np.where((points == ord("!")) & word_left & word_right, np.uint32(ord("i")), points)
    drop = filler & cjk_left & cjk_right | np.isin(points, [ord("*")]) & (word_left | word_right)
    if len(points) > 2:
        run = np.zeros(len(points), bool)  # the third and further ones of a run of one letter
        run[2:] = (points[2:] == points[1:-1]) & (points[2:] == points[:-2]) & latin[2:] & (row[2:] == row[:-2])
        inside = run.copy()
        inside[1:-1] |= run[2:]  # and the second one with them
        drop |= inside
    points, row = points[~drop], row[~drop]
    return Decoded(points, kind[points], row, d.rows)


class Stretches(NamedTuple):
    """Sentences, or parts of long ones: the text and the span of features of each."""

    row: np.ndarray
    start: np.ndarray
    feature: np.ndarray
    token: np.ndarray  #: hash of the token at each third feature


def stretches(texts: pa.Array) -> Stretches:
    """Features are the one, two and three tokens that end at each position within a sentence."""
    d = _undisguised(decode(texts))
    t = tokens_of(d)
    n = len(t.row)
    if not n:
        none = np.zeros(0, np.int64)
        return Stretches(none, none, none.astype(np.int32), none.astype(np.uint64))
    follows = np.ones(len(d.points), bool)  # whether a blank or the end of the text comes next
    follows[:-1] = (d.kind[1:] == OTHER) | (d.row[1:] != d.row[:-1])
    end = np.isin(d.points, [ord(c) for c in CJK_ENDS]) | np.isin(d.points, [ord(c) for c in ENDS]) & follows
    sentence = np.cumsum(end)[t.start]
    new = np.ones(n, bool)
    new[1:] = (t.row[1:] != t.row[:-1]) | (sentence[1:] != sentence[:-1])
    first = np.nonzero(new)[0]
    # broken lines: what is shorter than four tokens goes on with what follows in its text
    short = np.diff(first) < 4
    new[first[1:][short & (t.row[first[1:]] == t.row[first[:-1]])]] = False
    first = np.nonzero(new)[0]
    pos = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    new |= pos % STRETCH == 0
    h = t.hash
    two, three = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    two[1:] = mix(mix(h[:-1], 31) + h[1:], 37)
    three[2:] = mix(two[1:-1] + h[2:], 41)
    feature = np.stack([h % np.uint64(WIDTH), np.where(pos > 0, two % np.uint64(WIDTH), h % np.uint64(WIDTH)), np.where(pos > 1, three % np.uint64(WIDTH), h % np.uint64(WIDTH))], 1)
    start = np.nonzero(new)[0]
    return Stretches(t.row[start], start * 3, feature.astype(np.int32).ravel(), h)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Link(NamedTuple):
    """A linear model of hashed features and the probabilities of the links before it."""

    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def predict(self, feature: np.ndarray, start: np.ndarray, before: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(0)
        size = np.diff(np.append(start, len(feature)))
        w = self.weights[feature]
        z = np.add.reduceat(w, start) / np.sqrt(size) + before @ self.earlier + self.bias
        # a stretch without any feature met in training says nothing
        return _sigmoid(z) * (np.add.reduceat((w != 0).astype(np.int32), start) > 0)


def fit_link(feature: np.ndarray, start: np.ndarray, before: np.ndarray, y: np.ndarray, importance: np.ndarray, *, rounds: int = 60, rate: float = 0.4, ridge: float = 5e-6) -> Link:
    """Logistic regression by full-batch Adam; features of fewer than three stretches weigh nothing."""
    size = np.diff(np.append(start, len(feature)))
    used, code = np.unique(feature, return_inverse=True)
    frequent = np.bincount(code) >= 3
    slot = np.where(frequent, np.cumsum(frequent) - 1, -1)[code]
    owner = np.repeat(np.arange(len(start)), size)
    kept = slot >= 0
    slot, owner = slot[kept], owner[kept]
    scale = 1 / np.sqrt(size)
    d, e = int(frequent.sum()), before.shape[1]
    w = np.zeros(d + e + 1)
    w[-1] = np.log(max(1e-4, np.average(y, weights=importance)) / max(1e-4, 1 - np.average(y, weights=importance)))
    m, v, total = np.zeros_like(w), np.zeros_like(w), importance.sum()
    for step in range(1, rounds + 1):
        z = np.bincount(owner, weights=w[:d][slot], minlength=len(start)) * scale + before @ w[d:-1] + w[-1]
        g = importance * (_sigmoid(z) - y) / total
        grad = np.concatenate([np.bincount(slot, weights=(g * scale)[owner], minlength=d) + ridge * w[:d], g @ before, [g.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= rate * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    weights = np.zeros(WIDTH, np.float32)
    weights[used[frequent]] = w[:d]
    return Link(weights, w[d:-1], float(w[-1]))


def _take(s: Stretches, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, starts) of the chosen stretches."""
    size = np.diff(np.append(s.start, len(s.feature)))[chosen]
    start = np.cumsum(size) - size
    at = np.repeat(s.start[chosen] - start, size) + np.arange(size.sum())
    return s.feature[at], start


def _pack(link: Link) -> bytes:
    used = np.nonzero(link.weights)[0].astype(np.int32)
    return b"".join((np.array([len(used), len(link.earlier)], np.int64).tobytes(), used.tobytes(), link.weights[used].tobytes(), link.earlier.tobytes(), np.array([link.bias]).tobytes()))


def _unpack(data: bytes) -> Link:
    n, e = np.frombuffer(data, np.int64, 2).tolist()
    weights = np.zeros(WIDTH, np.float32)
    weights[np.frombuffer(data, np.int32, n, 16)] = np.frombuffer(data, np.float32, n, 16 + 4 * n)
    return Link(weights, np.frombuffer(data, np.float64, e, 16 + 8 * n).copy(), float(np.frombuffer(data, np.float64, 1, 16 + 8 * n + 8 * e)[0]))


class Fits:
    """Fits of one step of the chain, each in a task of its own: one for each fold and, at the end of a step, one of all stretches."""

    def __init__(self, spark: SparkSession, s: Stretches, fold: np.ndarray, folds: int) -> None:
        self.spark, self.fold, self.folds = spark, fold, folds
        self.shared = spark.sparkContext.broadcast((s, fold))

    def run(self, before: np.ndarray, y: np.ndarray, importance: np.ndarray, whole: bool) -> tuple[np.ndarray, Link | None]:
        """Each stretch's probability from a model that saw no stretch of its document; and, if `whole`, a model of all."""
        shared, step = self.shared, self.spark.sparkContext.broadcast((before, y, importance))

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s, fold = shared.value
            before, y, importance = step.value
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    seen, held = np.nonzero((fold != k) & (importance > 0))[0], np.nonzero(fold == k)[0]
                    out = b""
                    if len(seen) and (k < 0 or len(held)):
                        link = fit_link(*_take(s, seen), before[seen], y[seen], importance[seen])
                        out = _pack(link) if k < 0 else link.predict(*_take(s, held), before[held]).astype(np.float64).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([out], pa.binary())], ["k", "out"])

        first = -1 if whole else 0
        rows = self.spark.range(first, self.folds, 1, self.folds - first).mapInArrow(fit, "k bigint, out binary").collect()
        step.unpersist()
        p, link = np.zeros(len(self.fold)), None
        for k, out in rows:
            if k < 0:
                link = _unpack(bytes(out))
            elif out:
                p[self.fold == k] = np.frombuffer(bytes(out), np.float64)
        return p, link


class Chain(NamedTuple):
    categories: tuple[str, ...]
    links: tuple[Link, ...]
    threshold: float


def _seeded(s: Stretches, words: str) -> np.ndarray:
    wanted = tokens_of(decode(pa.array([words]))).hash
    has = np.isin(s.token, wanted)
    return np.add.reduceat(has, s.start // 3) > 0


def word_groups(s: Stretches, chosen: np.ndarray, groups: int, rounds: int = 20) -> np.ndarray:
    """For each of the `chosen` stretches its group of like wording, -1 for those of rare words alone: spherical k-means over their words, weighted by how
    many stretches of all hold them, from centres that are each the stretch farthest from those before."""
    size = np.diff(np.append(s.start, len(s.feature))) // 3
    owner = np.repeat(np.arange(len(size)), size)
    words, code = np.unique(s.token, return_inverse=True)
    pairs = np.unique(owner * len(words) + code)
    held_by = np.bincount(pairs % len(words), minlength=len(words))
    row = np.full(len(size), -1)
    row[chosen] = np.arange(len(chosen))
    own, word = row[pairs // len(words)], pairs % len(words)
    own, word = own[own >= 0], word[row[pairs // len(words)] >= 0]
    column, word = np.unique(word, return_inverse=True)
    often = np.bincount(word) >= 3
    slot, weight = np.cumsum(often) - 1, np.log(len(size) / held_by[column])
    x = np.zeros((len(chosen), int(often.sum())), np.float32)
    kept = often[word]
    x[own[kept], slot[word[kept]]] = weight[word[kept]]
    norm = np.linalg.norm(x, axis=1)
    some = np.nonzero(norm > 0)[0]
    out = np.full(len(chosen), -1)
    if not len(some):
        return out
    x = x[some] / norm[some, None]
    centres = [x[0]]
    nearest = x @ centres[0]
    while len(centres) < min(groups, len(x)):
        centres.append(x[int(nearest.argmin())])
        nearest = np.maximum(nearest, x @ centres[-1])
    c = np.array(centres)
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    out[some] = (x @ c.T).argmax(1)
    return out


def named_groups(s: Stretches, chosen: np.ndarray, group: np.ndarray, seeds: dict[str, str]) -> np.ndarray:
    """For each of the `chosen` stretches the number of its group's category, -1 for none: the one whose words the group holds most above their share among all chosen ones."""
    has = np.stack([_seeded(s, words)[chosen] for words in seeds.values()], 1).astype(float)
    share = has.mean(0) if len(chosen) else np.zeros(len(seeds))
    names = np.full(int(group.max(initial=-1)) + 2, -1)
    for g in range(len(names) - 1):
        members = group == g
        lift = (has[members].sum(0) + share) / (members.sum() + 1) / np.maximum(share, 1e-9)
        if has[members].any():
            names[g] = int(lift.argmax())
    return names[group]


def fit_chain(spark: SparkSession, texts: list[str], toxic: list[float], *, folds: int = 3, doubt: float = 0.6, groups: int = 24, seeds: dict[str, str] | None = None) -> Chain:
    """The chain: one linear model for each category of `seeds` (SEEDS), in their order, then one for toxicity as such.

    Reviewers call documents toxic, not sentences, so stretches are learnt from first with their document's label and twice
    more with labels cleaned by out-of-fold probabilities: of a toxic document those above one half, or the highest if it is at least 0.15, later 0.3; a
    toxic document without any and a harmless one with a stretch of at least `doubt` are taken for wrong labels. Categories are
    groups of like wording among the toxic stretches (`word_groups`), learnt without words given; a few words only name them (`named_groups`). Every link learns from the stretches' features and the out-of-fold
    probabilities of the links before it, so that it meets at prediction what it met in training. The threshold is the one with
    the best F1 of out-of-fold document scores, the end of the first quarter of those within 0.01 of it. The models of a step's folds are fitted in tasks side by side.
    """
    seeds = seeds or SEEDS
    s, label = stretches(pa.array(texts, pa.string())), np.array(toxic) > 0.5
    if not len(s.start) or not label[s.row].any():
        return Chain((*seeds, "toxic"), (), 1.0)
    fold = (mix(np.arange(len(texts), dtype=np.uint64), 43) % np.uint64(folds)).astype(int)[s.row]
    fits = Fits(spark, s, fold, folds)
    none = np.zeros((len(s.start), 0))
    positive = label[s.row]
    count = np.bincount(s.row, minlength=len(texts))[s.row]
    y, importance = positive.astype(float), np.where(positive, 1 / count, 1.0)
    for least in (0.15, 0.3):
        p, _ = fits.run(none, y, importance, False)
        top = np.zeros(len(texts))
        np.maximum.at(top, s.row, p)
        y = (positive & (p >= np.clip(top[s.row], least, 0.5))).astype(float)
        wrong = ~positive & (p >= doubt)
        importance = np.where(positive & (y == 0), 0.1, 1.0) * ~wrong
    links, before = [], none
    toxic_ones = np.nonzero(y > 0)[0]
    kind = np.full(len(y), -1)
    kind[toxic_ones] = named_groups(s, toxic_ones, word_groups(s, toxic_ones, groups), seeds)
    for number in range(len(seeds)):
        p, link = fits.run(before, (kind == number).astype(float), importance, True)
        links.append(link)
        before = np.column_stack([before, p])
    p, link = fits.run(before, y, importance, True)
    links.append(link)
    fits.shared.unpersist()
    score = np.zeros(len(texts))
    np.maximum.at(score, s.row, p)
    cuts = np.linspace(0.2, 0.9, 71)
    f1 = [2 * (label & (score >= c)).sum() / max(1, label.sum() + (score >= c).sum()) for c in cuts]
    # a stretch is toxic or not, so a wide range of cuts does nearly equally well; the end of its first quarter
    best = cuts[np.nonzero(np.array(f1) >= max(f1) - 0.01)[0]]
    return Chain((*seeds, "toxic"), tuple(links), float(best[len(best) // 4]))


def chain_table(spark: SparkSession, chain: Chain) -> DataFrame:
    """A chain as a table of a row a link, to be written and read again (`chain_of`)."""
    rows = [(k, c, chain.threshold, _pack(link)) for k, (c, link) in enumerate(zip(chain.categories, chain.links))]
    return spark.createDataFrame(rows, "place int, category string, threshold double, link binary")


def chain_of(rows: DataFrame) -> Chain:
    links = sorted(rows.collect(), key=lambda r: r["place"])
    if not links:
        return Chain((*SEEDS, "toxic"), (), 1.0)
    return Chain(tuple(r["category"] for r in links), tuple(_unpack(bytes(r["link"])) for r in links), links[0]["threshold"])


def labelled_documents(docs: DataFrame, labels: DataFrame, most: int) -> tuple[list[str], list[float]]:
    """At most `most` reviewed documents, up to a third of them toxic ones, chosen by a hash of their id; those that reviewers are split over are left out."""
    votes = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.avg("toxic").alias("toxic")).where("toxic <> 0.5")
    reviewed = docs.select("doc_id", "text").where("text IS NOT NULL").join(votes, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = reviewed.where("toxic > 0.5").limit(most // 3).collect()
    rows += reviewed.where("toxic < 0.5").limit(most - len(rows)).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def abuse_chain(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, most_labelled: int = 8000) -> Chain:
    """A chain fitted to at most `most_labelled` reviewed documents, a bounded sample; `chain_table` keeps it for later runs."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return fit_chain(docs.sparkSession, *labelled_documents(source, labels, most_labelled))


def abuse_scores(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, score, abusive, sexual, threat, hate, insult): of each document the highest probability of any of its stretches.

    The chain is sent to the tasks, which score every stretch of every whole text; nothing is shuffled. abusive is whether
    the score reaches the chain's threshold. Null and empty texts score 0; rows that share an id are scored each; a chain
    without any toxic label scores 0; the columns `keep` come along, others are not read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c) for c in keep))
    names = [c for c in chain.categories if c != "toxic"]
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # 4 MB a link

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            s = stretches(batch.column(1))
            before = np.zeros((len(s.start), 0))
            for link in chain.links:
                before = np.column_stack([before, link.predict(s.feature, s.start, before)])
            top = np.zeros((batch.num_rows, len(chain.categories)))
            if chain.links:
                np.maximum.at(top, s.row, before)
            score = np.round(top[:, -1], 6)
            columns = [pa.array(score), pa.array(score >= chain.threshold), *(pa.array(np.round(top[:, k], 6)) for k in range(len(names)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *columns], ["doc_id", *keep, "score", "abusive", *names])

    kinds = [f"{c} {source.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep)]
    return parallel(source).mapInArrow(run, ", ".join([*kinds, "score double", "abusive boolean", *(f"{c} double" for c in names)]))


def abuse_rates(docs: DataFrame, chain: Chain, source_col: str = "source", **how) -> DataFrame:
    """(source, n_documents, n_abusive, rate, mean_score) by source; null sources are a source of their own. The source goes along with its text."""
    scores = abuse_scores(docs.withColumn("__source", F.col(source_col)), chain, keep=("__source",), **how)
    return scores.groupBy(F.col("__source").alias("source")).agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.sum(F.col("abusive").cast("long")).alias("n_abusive"),
        F.round(F.avg(F.col("abusive").cast("int")), 6).alias("rate"),
        F.round(F.avg("score"), 6).alias("mean_score"),
    )


def held_out_figures(docs: DataFrame, labels: DataFrame, *, parts: int = 5, most_labelled: int = 8000) -> DataFrame:
    """(n, toxic, flagged, both): of reviewed documents that the chain was not fitted to, a part in `parts` by a hash of the id, how many
    reviewers call toxic, how many the chain flags, and how many both. The reviewers' wrong labels count as errors."""
    held = F.pmod(F.xxhash64(F.lit(47), "doc_id"), F.lit(parts)) == 0
    chain = abuse_chain(docs.where(~held), labels.where(~held), most_labelled=most_labelled)
    votes = labels.where(held & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.avg("toxic").alias("toxic")).where("toxic <> 0.5")
    told = abuse_scores(docs.where(held & F.col("text").isNotNull()).join(votes, "doc_id"), chain, keep=("toxic",))
    one = F.col("toxic") > 0.5
    return told.agg(F.count(F.lit(1)).alias("n"), F.sum(one.cast("long")).alias("toxic"), F.sum(F.col("abusive").cast("long")).alias("flagged"), F.sum((one & F.col("abusive")).cast("long")).alias("both"))
