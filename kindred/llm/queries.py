"""The pN_ queries of the problems tagged llm, and their SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.abuse import abuse_chain, abuse_rates, abuse_scores
from kindred.llm.copies import collapse_copies, copies_found
from kindred.llm.distinctive import characteristic_matches, term_scores
from kindred.llm.leaks import leaked_items
from kindred.llm.lookalike import LOOK, MARKS, PLAIN, SAME, consistent_texts, look_alike_classes, look_alikes_found
from kindred.llm.overlap import overlap_links, overlap_report, overlaps_found
from kindred.llm.packing import pack_texts
from kindred.llm.terms import term_counts
from kindred.session import cut, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies_found(table(spark, folder, "pairs"))


def p1_records(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "pairs").select("pair_id", "text_a", "text_b", "labels")
    return collapse_copies(pairs)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlaps_found(table(spark, folder, "pairs"))


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap_report(table(spark, folder, "pairs"))


def p2_links(spark: SparkSession, folder: str) -> DataFrame:
    return overlap_links(table(spark, folder, "pairs"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return look_alikes_found(table(spark, folder, "pairs"))


def p3_texts(spark: SparkSession, folder: str) -> DataFrame:
    return consistent_texts(table(spark, folder, "pairs").select("pair_id", "text_a", "text_b"))


def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    return look_alike_classes(table(spark, folder, "pairs"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return term_counts(table(spark, folder, "corpus")).where(F.col("mark").isNotNull()).select("token", "mark")


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    return term_counts(table(spark, folder, "corpus"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = characteristic_matches(table(spark, folder, "pairs"), table(spark, folder, "queries"))
    return found.select("query_id", F.col("id").alias("pair_id"))


def p6_scores(spark: SparkSession, folder: str) -> DataFrame:
    scores = term_scores(table(spark, folder, "pairs"))
    return scores.select(F.col("id").alias("pair_id"), "term", "n", F.round("score", 6).alias("score"))


def p7_pack_512(spark: SparkSession, folder: str) -> DataFrame:
    return pack_texts(table(spark, folder, "documents"), 512)


def p7_pack_2048(spark: SparkSession, folder: str) -> DataFrame:
    return pack_texts(table(spark, folder, "documents"), 2048)


def p7_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """For each capacity how many documents there are, and what breaks a rule: containers over their capacity, documents that are missing, in
    pieces though they fit, or whose pieces do not follow each other, and tokens that stand in no container."""
    out = None
    docs = table(spark, folder, "documents").select("doc_id")
    for capacity in (512, 2048):
        packed = cut(pack_texts(table(spark, folder, "documents"), capacity))
        over = packed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("n")).where(F.col("n") > capacity).agg(F.count(F.lit(1)).alias("over_full"))
        whole = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"), F.sum(F.col("start_token") - F.col("piece") * capacity).alias("shift"), F.sum(((F.col("n_tokens") > 0) & F.col("container_id").isNull()).cast("int")).alias("lost"))
        kept = docs.join(whole, "doc_id", "left")
        split = (F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("n") / capacity))) | (F.col("shift") != 0)
        told = kept.agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.col("pieces").isNull().cast("long")).alias("missing"), F.sum(split.cast("long")).alias("wrongly_split"), F.sum("lost").alias("lost"))
        part = told.crossJoin(over).select(F.lit(capacity).alias("capacity"), "n_documents", "missing", "wrongly_split", "lost", "over_full")
        out = part if out is None else out.unionAll(part)
    return out


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return abuse_scores(docs, abuse_chain(docs, table(spark, folder, "doc_labels"))).where("abusive").select("doc_id")


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return abuse_rates(docs, abuse_chain(docs, table(spark, folder, "doc_labels")))


def queries() -> dict[str, Query]:
    names = ["p1_found", "p1_records", "p2_found", "p2_report", "p2_links", "p3_found", "p3_texts", "p3_links", "p4_found", "p4_counts", "p6_found", "p6_scores", "p7_pack_512", "p7_pack_2048", "p7_invariants", "p8_found", "p9_found", "p9_rates"]
    return {name: globals()[name] for name in names}


BARE = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\p{{M}}\x{{2E80}}-\x{{2FDF}}]+', '', 'g')"
P1_GROUPS = f"""
bare AS (SELECT *, {BARE.format('text_a')} AS a, {BARE.format('text_b')} AS b FROM pairs),
keyed AS (SELECT *, CASE WHEN regexp_matches(a, '[\\p{{L}}\\p{{N}}\\x{{2E80}}-\\x{{2FDF}}]') AND regexp_matches(b, '[\\p{{L}}\\p{{N}}\\x{{2E80}}-\\x{{2FDF}}]') THEN least(a, b) || chr(0) || greatest(a, b)
  ELSE 'alone' || chr(1) || pair_id END AS k FROM bare),
grouped AS (SELECT *, min(pair_id) OVER (PARTITION BY k) AS keep_id, count(*) OVER (PARTITION BY k) AS n_copies FROM keyed)"""
P4_COUNTS = """
docs AS (SELECT doc_id, max(tokens) AS tokens FROM corpus WHERE doc_id IS NOT NULL GROUP BY doc_id),
terms AS (SELECT doc_id, lower(t) AS token FROM (SELECT doc_id, unnest(tokens) AS t FROM docs) WHERE t IS NOT NULL AND t <> ''),
counts AS (SELECT token, count(*) AS word_counts, count(DISTINCT doc_id) AS word_docs FROM terms GROUP BY token),
marked AS (SELECT *, CASE WHEN word_docs < 3 THEN 'rare' WHEN word_docs > 0.05 * (SELECT count(*) FROM docs) THEN 'common' END AS mark FROM counts)"""

# Chinese characters are set apart by blanks, then runs of letters and digits are terms.
APART = "regexp_extract_all(regexp_replace(lower({0}), '([\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}\\x{{20000}}-\\x{{3347F}}\\x{{2E80}}-\\x{{2FDF}}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}\\x{{2E80}}-\\x{{2FDF}}]+')"
P6_SCORES = f"""
terms AS (SELECT pair_id, unnest(list_concat(coalesce({APART.format("text_a")}, []), coalesce({APART.format("text_b")}, []))) AS term FROM pairs),
joint AS (SELECT pair_id, term, count(*) AS n FROM terms GROUP BY ALL),
sizes AS (SELECT pair_id, count(*) AS size FROM terms GROUP BY ALL),
totals AS (SELECT term, count(*) AS total FROM terms GROUP BY ALL),
mass AS (SELECT sum(size ** 0.75) AS mass FROM sizes)"""

P6_FOUND = f"""{P6_SCORES},
asked AS (SELECT DISTINCT query_id, unnest({APART.format("query_text")}) AS term FROM queries),
scored AS (SELECT pair_id, term, greatest(0, ln(n * mass / (total * size ** 0.75))) AS score FROM joint JOIN sizes USING (pair_id) JOIN totals USING (term), mass),
ranked AS (SELECT query_id, term, most, max(most) OVER (PARTITION BY query_id) AS top FROM asked JOIN (SELECT term, max(score) AS most FROM scored GROUP BY term) USING (term)),
sums AS (SELECT query_id, pair_id, round(sum(score), 9) AS score FROM ranked JOIN scored USING (term) WHERE most > 0 AND most >= 0.5 * top GROUP BY ALL)"""
P2_FOUND = f"""{P1_GROUPS},
part AS (SELECT pair_id, k, split_name = 'train' AS train, text_a || ' ' || text_b AS t FROM keyed WHERE split_name IN ('train', 'dev', 'test') AND k NOT LIKE 'alone' || chr(1) || '%'),
terms AS (SELECT DISTINCT pair_id, train, unnest({APART.format("t")}) AS term FROM part),
sizes AS (SELECT pair_id, count(*) AS n FROM terms GROUP BY pair_id),
common AS (SELECT x.pair_id AS a, y.pair_id AS b, count(*) AS c FROM terms x JOIN terms y USING (term) WHERE x.train AND NOT y.train GROUP BY ALL),
near AS (SELECT a, b FROM common JOIN sizes x ON x.pair_id = a JOIN sizes y ON y.pair_id = b WHERE c >= 0.85 * (x.n + y.n - c) - 1e-9
  UNION SELECT x.pair_id, y.pair_id FROM part x JOIN part y USING (k) WHERE x.train AND NOT y.train)"""
P2_REPORT = f"""{P2_FOUND},
told AS (SELECT a, b, x.k = y.k AS same, coalesce(c, 0)::DOUBLE / greatest(n, 1) AS covered FROM near JOIN part x ON x.pair_id = a JOIN part y ON y.pair_id = b LEFT JOIN common USING (a, b) LEFT JOIN sizes s ON s.pair_id = b),
best AS (SELECT b, count(*) AS links, max(same::INTEGER) AS same, max(covered) AS covered FROM told GROUP BY b)"""
P2_LINKS = f"""{P2_FOUND},
sets AS (SELECT pair_id, train, k, (SELECT list_sort(list(term)) FROM terms t WHERE t.pair_id = p.pair_id) AS w FROM part p),
linked AS (SELECT a AS pair_id, count(*) AS n_links FROM near GROUP BY a UNION ALL SELECT b, count(*) FROM near GROUP BY b)"""


def _folded(column: str) -> str:
    """The table of look-alikes in SQL: single characters by translate, ligatures by replace, format characters gone, composed."""
    ones = dict(LOOK)
    for low, high in SAME:
        for c in map(chr, range(low, high + 1)):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain != c:
                ones[c] = plain
    out = f"translate({column}, '{''.join(ones)}', '{''.join(ones.values())}')"
    for c in (chr(k) for low, high in SAME for k in range(low, high + 1)):
        if len(plain := unicodedata.normalize("NFKC", c)) > 1:
            out = f"replace({out}, '{c}', '{plain}')"
    return f"nfc_normalize(regexp_replace({out}, '[\\p{{Cf}}\\x{{FE00}}-\\x{{FE0F}}]', '', 'g'))"


P3_FOUND = f"""
texts AS (SELECT pair_id, 'text_a' AS field_name, text_a AS t FROM pairs UNION ALL SELECT pair_id, 'text_b', text_b FROM pairs),
folded AS (SELECT *, {_folded("t")} AS f FROM texts WHERE t IS NOT NULL)"""
P3_LINKS = f"""{P3_FOUND},
spelled AS (SELECT field_name, f, t, count(*) AS own, min(pair_id) AS low FROM folded WHERE trim(f) <> '' GROUP BY ALL),
whole AS (SELECT field_name, f, sum(own) AS n, min(low) AS class_id FROM spelled GROUP BY ALL HAVING count(*) > 1)"""
_HAN = "\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{3347F}\\x{2E80}-\\x{2FDF}"
_FREE = f"{MARKS}\\p{{Cf}}\\x{{FE00}}-\\x{{FE0F}}"
# Pieces of odd texts, one after the other: tokens with their marks and format characters, and what stands between. A token that is not plain takes the
# word of its folded form that is spelt so, else is the most frequent, else the smallest; words are of one script.
P3_TEXTS = f"""{P3_FOUND},
words AS (SELECT unnest(regexp_extract_all(regexp_replace(t, '([{_HAN}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}\\x{{2E80}}-\\x{{2FDF}}]+')) AS w FROM texts WHERE t IS NOT NULL),
counted AS (SELECT w, count(*) AS n, {_folded("w")} AS f FROM words GROUP BY w),
clean AS (SELECT * FROM counted WHERE (f = w AND regexp_matches(w, '\\p{{Latin}}')::INTEGER + regexp_matches(w, '\\p{{Greek}}')::INTEGER + regexp_matches(w, '\\p{{Cyrillic}}')::INTEGER < 2)
  OR (f <> w AND w = nfc_normalize(w) AND (regexp_matches(w, '^[\\p{{Greek}}\\p{{N}}]+$') OR regexp_matches(w, '^[\\p{{Cyrillic}}\\p{{N}}]+$')) AND regexp_matches(w, '\\pL'))),
spelling AS (SELECT f, first(w ORDER BY w <> f, n DESC, w) AS word FROM clean GROUP BY f),
odd AS (SELECT DISTINCT t, regexp_extract_all(t, '[{_HAN}][{_FREE}]*|(?:[^\\PL{_HAN}]|[\\p{{N}}{_FREE}])+|.|\\n') AS parts FROM texts WHERE regexp_matches(t, '{PLAIN}')),
parts AS (SELECT t, unnest(range(len(parts))) AS pos, unnest(parts) AS p FROM odd),
put AS (SELECT t, pos, CASE WHEN regexp_full_match(p, '[\\x00-\\x7f]*|[\\x{{4E00}}-\\x{{9FFF}}]') THEN p WHEN regexp_full_match(p, '[\\p{{L}}\\p{{N}}{_HAN}{_FREE}]+') THEN coalesce(word, {_folded("p")}) ELSE {_folded("p")} END AS p FROM parts LEFT JOIN spelling ON f = {_folded("p")}),
forms AS (SELECT t, nfc_normalize(string_agg(p, '' ORDER BY pos)) AS form FROM put GROUP BY t)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {P1_GROUPS} SELECT keep_id, pair_id AS copy_id FROM grouped WHERE pair_id <> keep_id",
        "p1_records": f"WITH {P1_GROUPS} SELECT pair_id, text_a, text_b, labels, n_copies FROM grouped WHERE pair_id = keep_id",
        "p2_found": f"WITH {P2_FOUND} SELECT least(a, b) AS id_1, greatest(a, b) AS id_2 FROM near",
        "p2_report": f"""WITH {P2_REPORT} SELECT split_name, source, count(*) AS n_records, count(links) AS n_overlapping, coalesce(sum(links), 0)::BIGINT AS n_pairs, coalesce(sum(same), 0)::BIGINT AS n_equal, round(avg(covered), 6) AS mean_coverage
FROM pairs LEFT JOIN best ON b = pair_id WHERE split_name IN ('dev', 'test') GROUP BY split_name, source""",
        "p2_links": f"WITH {P2_LINKS} SELECT pair_id, min(pair_id) OVER (PARTITION BY train, k, w) AS class_id, n_links FROM linked JOIN sets USING (pair_id)",
        "p3_found": f"WITH {P3_FOUND} SELECT DISTINCT x.pair_id AS id_1, y.pair_id AS id_2, field_name FROM folded x JOIN folded y USING (field_name, f) WHERE x.pair_id < y.pair_id AND x.t <> y.t AND trim(f) <> ''",
        "p3_links": f"WITH {P3_LINKS} SELECT pair_id, field_name, class_id, n - own AS n_links FROM folded JOIN spelled USING (field_name, f, t) JOIN whole USING (field_name, f)",
        "p3_texts": f"WITH {P3_TEXTS} SELECT pair_id, coalesce(a.form, text_a) AS text_a, coalesce(b.form, text_b) AS text_b FROM pairs LEFT JOIN forms a ON a.t = text_a LEFT JOIN forms b ON b.t = text_b",
        "p6_found": f"WITH {P6_FOUND} SELECT query_id, pair_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pair_id) AS r FROM sums) WHERE r = 1",
        "p6_scores": f"WITH {P6_SCORES} SELECT pair_id, term, n, round(greatest(0, ln(n * mass / (total * size ** 0.75))), 6) AS score FROM joint JOIN sizes USING (pair_id) JOIN totals USING (term), mass",
        "p7_invariants": "SELECT unnest([512, 2048])::INTEGER AS capacity, n AS n_documents, 0::BIGINT AS missing, 0::BIGINT AS wrongly_split, 0::BIGINT AS lost, 0::BIGINT AS over_full FROM (SELECT count(*) AS n FROM documents)",
        "p4_found": f"WITH {P4_COUNTS} SELECT token, mark FROM marked WHERE mark IS NOT NULL",
        "p4_counts": f"WITH {P4_COUNTS} SELECT token, word_counts, word_docs, mark FROM marked",
    }
