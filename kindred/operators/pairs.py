"""Text pairs: sentence graph, components, leakage-free folds, augmentation, encoding to ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.arrays import drop_at, pad, segments, truncated_sizes, with_markers
from kindred.functions.binding import let
from kindred.operators.corpus import ranked_rows
from kindred.session import cut

UNLABELLED = 2


def sentence_id(text: Column) -> Column:
    """A sentence's id is the md5 of its text: the same on every run, without a numbering of all sentences."""
    return F.md5(text)


def sentences(pairs: DataFrame, a: str = "text_a", b: str = "text_b") -> DataFrame:
    """(sid, sentence): the distinct texts of both columns; null ones are none."""
    both = pairs.select(F.col(a).alias("sentence")).unionAll(pairs.select(F.col(b))).where("sentence IS NOT NULL")
    return both.groupBy(sentence_id(F.col("sentence")).alias("sid")).agg(F.first("sentence").alias("sentence"))


def edges(pairs: DataFrame, a: str = "text_a", b: str = "text_b", label: str = "labels") -> DataFrame:
    """(src, dst): labelled pairs of known sentences, once each, the smaller id first."""
    known = pairs.where((F.col(label) != UNLABELLED) & F.col(a).isNotNull() & F.col(b).isNotNull())
    s, d = sentence_id(F.col(a)), sentence_id(F.col(b))
    return known.select(F.least(s, d).alias("src"), F.greatest(s, d).alias("dst")).distinct()


def components(nodes: DataFrame, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): of (id) and (src, dst), each node with the smallest id of its component; nodes without links are their own.

    Large stars and small stars in turn (Kiveris et al., 2014): each round rewires every node to the least neighbour, first among
    larger ones, then among all, so the number of rounds grows with the logarithm of the longest path. Each round's links are cut to the
    checkpoint folder; the loop ends when a round changes nothing, told by the count and a hash sum of the links.
    """

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.select(F.col("src").alias("u"), F.col("dst").alias("v"))
        if large:
            both = both.unionAll(links.select(F.col("dst"), F.col("src")))
        else:
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        joined = both.join(low, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
        else:
            out = joined.select(F.col("v").alias("src"), F.col("m").alias("dst")).unionAll(joined.select(F.col("u"), F.col("m")))
        return out.where("src <> dst").distinct()

    def state(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    now = cut(links.where("src <> dst").distinct())
    before = None
    for _ in range(most_rounds):
        now = cut(star(star(now, True), False))
        if (told := state(now)) == before:
            break
        before = told
    else:
        raise RuntimeError("the components did not settle; raise most_rounds")
    # every node but the least of its component now points to it
    return nodes.select("id").distinct().join(now.select(F.col("src").alias("id"), F.col("dst").alias("c")), "id", "left").select("id", F.coalesce("c", "id").alias("component"))


def sentence_components(pairs: DataFrame) -> DataFrame:
    """(sid, component) of all sentences."""
    nodes = pairs.select(F.explode(F.array(sentence_id(F.col("text_a")), sentence_id(F.col("text_b")))).alias("id")).where("id IS NOT NULL")
    return components(nodes, edges(pairs)).withColumnRenamed("id", "sid")


def pair_components(pairs: DataFrame, comps: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """(id, comp_a, comp_b) of pairs of known sentences; labelled pairs have equal ones."""
    a, b = comps.toDF("sid_a", "comp_a"), comps.toDF("sid_b", "comp_b")
    rows = pairs.where("text_a IS NOT NULL AND text_b IS NOT NULL").select(F.col(id_col).alias("id"), "labels", sentence_id(F.col("text_a")).alias("sid_a"), sentence_id(F.col("text_b")).alias("sid_b"))
    return rows.join(a, "sid_a").join(b, "sid_b").select("id", "labels", "comp_a", "comp_b")


def component_folds(pairs: DataFrame, k: int = 5, seed: int = 1, use_remainder: bool = False) -> DataFrame:
    """(id, component, fold): labelled pairs with the fold in which they are held out.

    Components are shuffled by a hash of (seed, component) and dealt in runs of floor(n / k), so no sentence is in two folds;
    those beyond k runs are never held out (fold null), or are dealt on if `use_remainder`.
    """
    labelled = pair_components(pairs, sentence_components(pairs)).where(F.col("labels") != UNLABELLED)
    labelled = cut(labelled.select("id", F.col("comp_a").alias("component")))
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.col("component")))
    ranked = ranked_rows(labelled.select("component").distinct().withColumn("h", shuffled), [F.asc("h")], "rank")
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    size = F.greatest(F.floor(F.col("n") / k), F.lit(1))
    raw = F.floor((F.col("rank") - 1) / size)
    fold = F.when(raw < k, raw).otherwise(F.pmod(raw, F.lit(k)) if use_remainder else F.lit(None))
    dealt = ranked.crossJoin(F.broadcast(n)).select("component", fold.cast("int").alias("fold"))
    return labelled.join(dealt, "component").select("id", "component", "fold")


def stratified_folds(rows: DataFrame, id_col: str, label_col: str, k: int = 5, seed: int = 1, digits: int = 5) -> DataFrame:
    """(id, label, fold): within each label, rows by a hash of (seed, id) are dealt to the folds in turn.

    Ranks within a label are counted by blocks of that hash, so that a label of most rows is no single task's work.
    """
    keyed = rows.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))).alias("h"))
    keyed = keyed.withColumn("block", F.substring("h", 1, digits))
    sizes = keyed.groupBy("label", "block").agg(F.count(F.lit(1)).alias("n"))
    coarse = sizes.groupBy("label", F.substring("block", 1, 2).alias("top")).agg(F.sum("n").alias("n"))
    top = coarse.select("label", "top", (F.sum("n").over(Window.partitionBy("label").orderBy("top")) - F.col("n")).alias("before_top"))
    inner = Window.partitionBy("label", "top").orderBy("block")
    starts = sizes.withColumn("top", F.substring("block", 1, 2)).withColumn("before_in", F.sum("n").over(inner) - F.col("n"))
    starts = starts.join(F.broadcast(top), ["label", "top"]).select("label", "block", (F.col("before_top") + F.col("before_in")).alias("before"))
    within = F.row_number().over(Window.partitionBy("label", "block").orderBy("h", "id"))
    ranked = keyed.withColumn("rn", within).join(starts, ["label", "block"])
    return ranked.select("id", "label", F.pmod(F.col("before") + F.col("rn") - 1, F.lit(k)).cast("int").alias("fold"))


def symmetric(pairs: DataFrame, a: str = "text_a", b: str = "text_b", dedup: bool = False) -> DataFrame:
    """Each pair and its mirror image."""
    swapped = pairs.withColumn("__a", F.col(a)).withColumn(a, F.col(b)).withColumn(b, F.col("__a")).drop("__a")
    both = pairs.unionByName(swapped)
    return both.dropDuplicates([a, b]) if dedup else both


def shuffled(df: DataFrame, id_col: str, seed: int = 1) -> DataFrame:
    """`df` in a random order that depends on ids and seed only."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col)


def repeated(df: DataFrame, times: int = 2) -> DataFrame:
    """Every row `times` times, as positive pairs of a contrastive batch."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def batches(df: DataFrame, order: list, size: int, stride: int | None = None) -> DataFrame:
    """`df` with batch_id: consecutive rows in a total order, `size` to a batch; with `stride` batches overlap, and rows come once per batch."""
    ranked = ranked_rows(df, order, "__rank")
    if stride is None:
        return ranked.withColumn("batch_id", F.floor((F.col("__rank") - 1) / size)).drop("__rank")
    last = F.floor((F.col("__rank") - 1) / stride)
    first = F.greatest(F.ceil((F.col("__rank") - size) / stride), F.lit(0))
    return ranked.where(first <= last).withColumn("batch_id", F.explode(F.sequence(first, last))).drop("__rank")


def encode_pairs(first: Column, second: Column | None, most: int, truncate_from: int = -2, joint: bool = True) -> tuple[Column, Column]:
    """(tokens, segment ids) of one or two token arrays with markers, within `most` tokens.

    Tokens are taken from before the last marker of whichever sequence is longer; jointly encoded, the second one has no opening marker.
    """
    a = with_markers(first)
    if second is None:
        a = drop_at(a, truncate_from, F.greatest(F.size(a) - most, F.lit(0)))
        return a, segments(a)
    b = with_markers(second)
    # with its opening marker the second counts one more
    sizes = F.array(*truncated_sizes([F.size(first) + 2, F.size(second) + 2], most + 1 if joint else most))
    opening = 1 if joint else 0

    def tokens(kept: Column) -> Column:
        n, m = F.get(kept, F.lit(0)), F.get(kept, F.lit(1))
        head, tail = drop_at(a, truncate_from, F.size(first) + 2 - n), drop_at(b, truncate_from, F.size(second) + 2 - m)
        return F.concat(head, F.slice(tail, F.lit(2), F.greatest(m - 1, F.lit(0))) if joint else tail)

    def parts(kept: Column) -> Column:
        return F.concat(F.array_repeat(F.lit(0), F.get(kept, F.lit(0))), F.array_repeat(F.lit(1), F.greatest(F.get(kept, F.lit(1)) - opening, F.lit(0))))

    return let(sizes, tokens), let(sizes, parts)


def padded_ids(ids: Column, size: int) -> Column:
    return pad(ids, size, "post", "post")


def id_line(*columns: Column, sep: str = "\t") -> Column:
    """Id arrays and scalars as one line: ids joined by blanks, columns by `sep`."""
    return F.concat_ws(sep, *columns)


def ids_text(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), " ")


def ids_from_text(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, " "), lambda t: t != ""), lambda t: t.cast("int"))
