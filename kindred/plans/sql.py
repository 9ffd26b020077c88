"""DuckDB SQL of the core queries, by name."""

from __future__ import annotations

from kindred.functions.text import CJK_CLASS, CJK_PUNCTUATION, PUNCTUATION_CLASS
from kindred.operators import lsh

DOCS = "docs AS (SELECT doc_id, list_filter(coalesce(max(tokens), []), lambda t: t IS NOT NULL) AS tokens FROM corpus WHERE doc_id IS NOT NULL GROUP BY doc_id)"
LOWERED = DOCS.replace("docs AS", "raw_docs AS", 1) + ", docs AS (SELECT doc_id, list_transform(tokens, lambda t: lower(t)) AS tokens FROM raw_docs)"
INDEX = """
words AS (SELECT doc_id, len(tokens) AS doc_len, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM docs),
tf AS (SELECT doc_id, token, doc_len, count(*) AS cnt FROM words GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY ALL),
stats AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avg_len FROM docs)"""
BASE, LOWER_BASE = f"WITH {DOCS}, {INDEX}", f"WITH {LOWERED}, {INDEX}"
ASKED = "(VALUES ('how', 1, 6), ('the', 2, 6), ('garage', 1, 6), ('的', 1, 6), ('zzz', 1, 6)) q(token, q_cnt, q_len)"

SMOOTH, PROB = "ln((n_docs + 0.5) / (df + 0.5))", "ln((n_docs - df + 0.5) / (df + 0.5))"
TF = "(cnt::DOUBLE / doc_len)"
TD = f"(3.0 * {TF} / (2.0 * (0.25 + 0.75 * doc_len / avg_len) + {TF}))"
TQ = "(2.2 * (q_cnt::DOUBLE / q_len) / (1.2 + q_cnt::DOUBLE / q_len))"


def _top(score: str, k: int) -> str:
    limit = f" ORDER BY score DESC, doc_id LIMIT {k}" if k else ""
    return f"""{BASE}, found AS (SELECT doc_id, sum(q_cnt * {score}) AS score FROM tf JOIN {ASKED} USING (token) JOIN df USING (token), stats GROUP BY doc_id)
SELECT doc_id, round(coalesce(score, 0.0), 6) AS score FROM docs LEFT JOIN found USING (doc_id){limit}"""


def _weights(weight: str) -> str:
    return f"{BASE} SELECT w.doc_id, pos::INTEGER AS pos, w.token, round({weight}, 6) AS weight FROM words w JOIN tf USING (doc_id, token) JOIN df ON df.token = w.token, stats".replace("doc_len", "tf.doc_len").replace("tf.doc_len, unnest", "doc_len, unnest").replace("AS tf.doc_len", "AS doc_len").replace("token, tf.doc_len, count", "token, doc_len, count")


def _padded(weight: str) -> str:
    return f"""{BASE}, weighed AS (SELECT w.doc_id, w.pos, {weight.replace("doc_len", "tf.doc_len")} AS weight FROM words w JOIN tf USING (doc_id, token) JOIN df ON df.token = w.token, stats)
SELECT d.doc_id, p.pos::INTEGER AS pos, round(coalesce(w.weight, 0.0)::FLOAT::DOUBLE, 5) AS weight FROM docs d CROSS JOIN (SELECT unnest(range(12)) AS pos) p LEFT JOIN weighed w ON w.doc_id = d.doc_id AND w.pos = p.pos"""


VOCAB = """
first_seen AS (SELECT token, count(*) AS cnt, count(DISTINCT doc_id) AS df, min((doc_id, pos)) AS f FROM words GROUP BY token),
vocab AS (SELECT token, (row_number() OVER (ORDER BY cnt DESC, f))::INTEGER + {0} AS idx, cnt, df FROM first_seen)"""


def filters_sql(column: str) -> str:
    """Split into words: filter characters to blanks."""
    return f"list_filter(string_split(translate(lower({column}), '!\"#$%&()*+,-./:;<=>?@[\\]^_`{{|}}~' || chr(9) || chr(10), repeat(' ', 34)), ' '), lambda t: t <> '')"


def _clean(column: str) -> str:
    from kindred.functions.text import CLEANING

    out = column
    for pattern, put in CLEANING:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{put.replace(chr(39), chr(39) * 2).replace(chr(92) * 3, chr(92) * 2)}', 'g')"
    return f"lower(regexp_replace({out}, '^\\s+|\\s+$', '', 'g'))"


def basic_sql(column: str) -> str:
    out = f"regexp_replace({column}, '([{PUNCTUATION_CLASS}{CJK_CLASS}])', ' \\1 ', 'g')"
    out = f"regexp_replace({out}, '[\\p{{Zs}}\\n\\r\\t]', ' ', 'g')"
    out = f"regexp_replace({out}, '[\\x00\\x{{FFFD}}\\p{{Cc}}\\p{{Cf}}]', '', 'g')"
    return f"list_filter(string_split({out}, ' '), lambda t: t <> '')"


VECTORS = "v AS (SELECT vec_id AS item_id, list_transform(embedding, lambda x: x::DOUBLE) AS vec, label FROM embeddings)"
MET = f"""{VECTORS}, met AS (SELECT x.item_id AS query_id, y.item_id, x.vec AS a, y.vec AS b, (x.label = y.label)::INTEGER AS same FROM v x JOIN v y ON x.item_id <> y.item_id WHERE x.item_id % 20 = 0)"""
DOT, NORM = "list_inner_product({0}, {1})", "sqrt(list_inner_product({0}, {0}))"
COS = "list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b)))"


def _zip(expr: str, a: str = "a", b: str = "b") -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {expr.replace('X', f'{a}[i]').replace('Y', f'{b}[i]')}))"


def _met(*columns: str) -> str:
    return f"WITH {MET} SELECT query_id, item_id, {', '.join(columns)} FROM met"


SCORED = f"{MET}, scored AS (SELECT query_id, item_id, same, round({COS}, 6) AS score FROM met)"
MATRICES = f"{VECTORS}, m AS (SELECT item_id, list_transform(range(8), lambda k: vec[k * 8 + 1 : k * 8 + 8]) AS m FROM v)"

SHINGLED = f"""
worded AS (SELECT doc_id AS item_id, coalesce({filters_sql('text')}, []) AS w FROM documents),
grams AS (SELECT item_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) ELSE [] END AS g FROM worded),
features AS (SELECT DISTINCT item_id, (('0x' || substr(md5(f), 1, 8))::BIGINT % {lsh.PRIME}) AS f FROM (SELECT item_id, unnest(g) AS f FROM grams))"""


def _signatures(n: int) -> str:
    rows = ", ".join(f"({p}, {a}, {b})" for p, a, b in lsh.permutations(n))
    return f"""{SHINGLED}, perm AS (SELECT * FROM (VALUES {rows}) t(p, a, b)),
hashed AS (SELECT item_id, p, min((f * a::BIGINT + b) % {lsh.PRIME}) AS h FROM features, perm GROUP BY ALL),
sig AS (SELECT d.item_id, perm.p, coalesce(h, -1) AS h FROM (SELECT item_id FROM worded) d CROSS JOIN perm LEFT JOIN hashed x ON x.item_id = d.item_id AND x.p = perm.p)"""


def _bands(band: int) -> str:
    return f"""{_signatures(band * 5)}, banded AS (SELECT item_id, (p // 5 + 1)::INTEGER AS band, md5(string_agg(h::VARCHAR, ',' ORDER BY p) || '|' || (p // 5 + 1)::VARCHAR) AS bucket FROM sig GROUP BY item_id, p // 5)"""


def _fingerprints() -> str:
    family, factors = lsh.stable_family(3, 4, 64), lsh.fingerprint_factors(4)
    rows = ", ".join(f"({j}, {i}, {list(a)}, {b}::DOUBLE, {factors[i]})" for j, f in enumerate(family) for i, (a, b) in enumerate(f))
    return f"""{VECTORS}, hash_fn AS (SELECT round, i, list_transform(a, lambda x: x::DOUBLE) AS a, b, rho FROM (VALUES {rows}) t(round, i, a, b, rho)),
summed AS (SELECT item_id, round, sum(floor(list_inner_product(vec, a) + b)::BIGINT * rho)::BIGINT AS s FROM v, hash_fn GROUP BY ALL),
fp AS (SELECT item_id, round::INTEGER AS round, ((s % {lsh.MODULUS}) + {lsh.MODULUS}) % {lsh.MODULUS} AS fp FROM summed)"""


PROBABILITY = "counts AS (SELECT token, count(*) AS c FROM words GROUP BY token), prob AS (SELECT token, c::DOUBLE / sum(c) OVER () AS p FROM counts)"
POOLED = f"""{BASE}, {PROBABILITY},
dims AS (SELECT token, 0.001 / (0.001 + p) AS weight, d AS dim, (('0x' || substr(md5(token), d * 4 + 1, 4))::BIGINT - 32768) / 32768.0::DOUBLE AS x FROM prob, (SELECT unnest(range(8)) AS d)),
pooled AS (SELECT doc_id, dim::INTEGER AS dim, sum(weight * cnt / doc_len * x) AS x FROM tf JOIN dims USING (token) GROUP BY ALL)"""

GRAMS = """
grams AS (SELECT text_a[i : i + n - 1] AS ngram FROM (SELECT text_a, n, unnest(range(1, length(text_a) - n + 2)) AS i FROM pairs, (VALUES (2), (3)) t(n) WHERE length(text_a) >= n)),
counted AS (SELECT ngram, length(ngram)::INTEGER AS n, count(*) AS cnt FROM grams GROUP BY ngram HAVING count(*) >= 10)"""
IDMAP = """
tokens AS (SELECT pair_id, field, (u.p - 1)::INTEGER AS pos, list_extract(parts, u.p) AS token FROM (
  SELECT pair_id, 0 AS field, string_split(text_a, ' ') AS parts FROM pairs UNION ALL SELECT pair_id, 1, string_split(text_b, ' ') FROM pairs) s, unnest(range(1, len(parts) + 1)) u(p)),
freq AS (SELECT token, count(*) AS cnt, (row_number() OVER (ORDER BY count(*) DESC, token) - 1)::VARCHAR AS idx FROM tokens WHERE token <> '' GROUP BY token)"""

GRAPH = """
sentences AS (SELECT DISTINCT md5(s) AS sid, s AS sentence FROM (SELECT text_a AS s FROM pairs UNION ALL SELECT text_b FROM pairs) WHERE s IS NOT NULL),
edges AS (SELECT DISTINCT least(md5(text_a), md5(text_b)) AS src, greatest(md5(text_a), md5(text_b)) AS dst FROM pairs WHERE labels <> 2 AND text_a IS NOT NULL AND text_b IS NOT NULL),
both_ways AS (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges),
reach AS (SELECT sid AS u, sid AS v FROM sentences UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON b.u = r.v),
comps AS (SELECT u AS sid, min(v) AS component FROM reach GROUP BY u)"""
COMPONENTS = f"WITH RECURSIVE {GRAPH}"

LEXICAL = """
rows_ AS (SELECT pair_id, replace(coalesce(text_a, '') || ' ' || coalesce(text_b, ''), ' ', '') AS t FROM pairs WHERE labels IN (0, 1)),
grams AS (SELECT pair_id, t[i : i + n - 1] AS term FROM (SELECT pair_id, t, n, unnest(range(1, length(t) - n + 2)) AS i FROM rows_, (VALUES (1), (2), (3)) s(n) WHERE length(t) >= n)),
tf AS (SELECT pair_id, term, count(*) AS cnt FROM grams GROUP BY ALL),
lens AS (SELECT pair_id, count(*) AS len FROM grams GROUP BY ALL),
df AS (SELECT term, count(*) AS df, sum(cnt) AS total FROM tf GROUP BY ALL)"""

ENCODED = f"""
w AS (SELECT pair_id, {filters_sql('text_a')} AS a, {filters_sql('text_b')} AS b FROM pairs WHERE text_a IS NOT NULL AND text_b IS NOT NULL),
s AS (SELECT *, len(a) + 2 AS n, len(b) + 2 AS m FROM w),
c AS (SELECT *, CASE WHEN n + m <= 21 THEN n WHEN m <= 10 THEN 21 - m WHEN n <= 10 THEN n ELSE 10 END AS na, CASE WHEN n + m <= 21 THEN m WHEN m <= 10 THEN m WHEN n <= 10 THEN 21 - n ELSE 11 END AS nb FROM s),
encoded AS (SELECT pair_id, na, nb - 1 AS nb, list_concat(['[CLS]'], a[1 : na - 2], ['[SEP]'], b[1 : nb - 2], ['[SEP]']) AS tokens FROM c)"""
IDS_OF = "SELECT pair_id, string_split(text_a, ' ') AS t FROM pairs WHERE source = 'anon_ids' AND regexp_full_match(text_a, '[0-9]{1,9}( [0-9]{1,9})*')"

PARSED = """
rules AS (SELECT file_name, delim AS d, n_fields AS n, split_name FROM raw_files),
asked AS (SELECT line_id, file_name, split_name, regexp_replace(line_text, '\\r$', '') AS t, '[' || d || ']' AS d, '[^' || d || ']*' AS others, n FROM raw_records LEFT JOIN rules USING (file_name) WHERE line_text IS NOT NULL),
kept AS (SELECT *, '(?:"(?:[^"]|"")*"|(?:[^"' || substr(d, 2, 1) || ']' || others || ')?)' AS field FROM asked WHERE trim(t, ' ' || chr(9)) <> ''),
cells AS (SELECT *, regexp_full_match(t, '(?s)' || field || '(?:' || d || field || ')*') AS closed,
  list_transform(regexp_extract_all(substr(d, 2, 1) || t, '(?s)' || d || '(?:"(?:[^"]|"")*"|' || others || ')'), lambda f: CASE WHEN f[2] = '"' THEN replace(f[3 : -2], '""', '"') ELSE f[2:] END) AS f FROM kept),
parsed AS (SELECT *, CASE WHEN d IS NULL THEN 'unknown_file' WHEN NOT closed THEN 'quoting' WHEN len(f) <> n THEN 'column_count'
  WHEN len(list_filter(f[1:2], lambda x: NOT regexp_matches(x, '[^\\s\\p{Z}]') OR regexp_matches(x, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}\\x{fffd}]'))) > 0
    OR n = 3 AND NOT regexp_full_match(f[3], '[\\s\\p{Z}]*[012][\\s\\p{Z}]*') THEN 'bad_value' END AS reason FROM cells)"""
PIECED = f"""
words AS (SELECT DISTINCT t AS word FROM (SELECT unnest(tokens) AS t FROM docs) WHERE t <> ''),
often AS (SELECT t AS token FROM (SELECT doc_id, unnest(tokens) AS t FROM docs) WHERE t <> '' GROUP BY t HAVING count(DISTINCT doc_id) >= 3),
chars AS (SELECT DISTINCT unnest(string_split(word, '')) AS c FROM words),
known AS (SELECT token AS piece FROM often UNION SELECT '##' || substr(token, 1, 3) FROM often UNION SELECT c FROM chars UNION SELECT '##' || c FROM chars),
spans AS (SELECT word, pos, unnest(range(1, length(word) - pos + 1)) AS n FROM (SELECT word, unnest(range(length(word))) AS pos FROM words WHERE length(word) <= 200)),
best AS (SELECT word, pos, max(n) AS n FROM (SELECT word, pos, n, CASE WHEN pos > 0 THEN '##' ELSE '' END || substr(word, pos + 1, n) AS piece FROM spans) JOIN known USING (piece) GROUP BY ALL),
steps AS (SELECT word, 0::BIGINT AS pos, '' AS pieces FROM words UNION ALL SELECT s.word, s.pos + b.n, s.pieces || CASE WHEN s.pos > 0 THEN ' ##' ELSE '' END || substr(s.word, (s.pos + 1)::BIGINT, b.n) FROM steps s JOIN best b ON b.word = s.word AND b.pos = s.pos)"""

SQL: dict[str, str] = {
    "p5_found": f"WITH {PARSED} SELECT line_id, reason FROM parsed WHERE reason IS NOT NULL",
    "p5_rows": f"WITH {PARSED} SELECT line_id, file_name, split_name, f[1] AS text_a, f[2] AS text_b, CASE WHEN n = 3 THEN regexp_extract(f[3], '[012]')::INTEGER END AS labels FROM parsed WHERE reason IS NULL",
    "lower_no_accents": "SELECT pair_id, regexp_replace(strip_accents(lower(text_a)), '\\p{Mn}', '', 'g') AS plain FROM pairs",
    "segmented_texts": "SELECT pair_id, array_to_string(regexp_extract_all(regexp_replace(text_a, '([㐀-䶿一-鿿豈-﫿])', ' \\1 ', 'g'), '[\\p{L}\\p{N}]+|[^\\s\\p{Z}\\p{L}\\p{N}]'), ' ') AS words FROM pairs",
    "word_piece_tokens": f"WITH RECURSIVE {LOWERED}, {PIECED} SELECT word, coalesce(pieces, word) AS pieces FROM words LEFT JOIN (SELECT word, pieces FROM steps WHERE pos = length(word)) USING (word)",
    "random_ngram_segments": """WITH RECURSIVE grams AS (SELECT g FROM (SELECT query_text[i : i + n - 1] AS g FROM (SELECT query_text, n, unnest(range(1, length(query_text) - n + 2)) AS i FROM queries, (VALUES (2), (3), (4)) t(n) WHERE length(query_text) >= n)) GROUP BY g HAVING count(*) >= 3),
lines AS (SELECT DISTINCT query_id, query_text AS t FROM queries WHERE query_text <> ''),
spots AS (SELECT DISTINCT t, unnest(range(length(t))) AS pos FROM lines),
hits AS (SELECT t, pos, n FROM spots, (VALUES (1), (2), (3), (4)) s(n) WHERE n = 1 OR pos + n <= length(t) AND substr(t, pos + 1, n) IN (SELECT g FROM grams)),
options AS (SELECT t, pos, list(n ORDER BY n) AS o FROM hits GROUP BY ALL),
steps AS (SELECT query_id, t, k, 0::BIGINT AS pos, '' AS tokens FROM lines, (SELECT unnest(range(10)) AS k) UNION ALL
  SELECT query_id, t, k, pos + n, tokens || CASE WHEN pos > 0 THEN '|' ELSE '' END || substr(t, pos + 1, n) FROM (SELECT s.*, o[('0x' || substr(md5('1:' || query_id || ':' || k || ':' || s.pos), 1, 8))::BIGINT % len(o) + 1] AS n FROM steps s JOIN options x ON x.t = s.t AND x.pos = s.pos))
SELECT DISTINCT query_id, tokens FROM steps WHERE pos = length(t)""",
    "decoded_pieces": f"""WITH p AS (SELECT pair_id, list_filter(string_split(array_to_string(list_transform({basic_sql('text_a')}, lambda t: CASE WHEN length(t) > 6 THEN substr(t, 1, 4) || ' ##' || substr(t, 5) ELSE t END), ' '), ' '), lambda t: NOT (t LIKE '[%' AND t LIKE '%]')) AS p FROM pairs WHERE text_a IS NOT NULL),
m AS (SELECT pair_id, list_transform(range(1, len(p) + 1), lambda i: [p[i], CASE WHEN p[i] LIKE '##%' OR regexp_full_match(p[i], '[{CJK_CLASS}{PUNCTUATION_CLASS}]') OR i > 1 AND regexp_matches(p[i - 1], '[{CJK_CLASS}]$') THEN '' ELSE ' ' END, CASE WHEN regexp_full_match(p[i], '[{PUNCTUATION_CLASS}]') THEN ' ' ELSE '' END]) AS m FROM p),
t AS (SELECT pair_id, regexp_replace(array_to_string(list_transform(m, lambda x: x[2] || regexp_replace(x[1], '^##', '') || x[3]), ''), ' +', ' ', 'g') AS t FROM m),
u AS (SELECT pair_id, regexp_replace(t, chr(39) || ' (re|m|s|t|ve|d|ll) ', chr(39) || '\\1 ', 'g') AS t FROM t),
x AS (SELECT pair_id, regexp_replace(t, '([\\+\\-/=\\{{\\(<\\[{CJK_PUNCTUATION}]) ', '\\1', 'g') AS t FROM u)
SELECT y.pair_id, decoded FROM pairs y LEFT JOIN (SELECT pair_id, trim(regexp_replace(t, '([0-9]\\.) ([0-9])', '\\1\\2', 'g')) AS decoded FROM x) USING (pair_id)""",
    "encode_text_pairs": f"WITH {ENCODED} SELECT pair_id, array_to_string(tokens, ' ') AS tokens, array_to_string(list_concat(list_transform(range(na), lambda x: 0), list_transform(range(nb), lambda x: 1)), ' ') AS segments FROM encoded",
    "bert_pair_ids": f"""WITH {ENCODED}, words AS (SELECT unnest(list_concat(a, b)) AS token FROM w),
known AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 3 AS idx FROM words GROUP BY token HAVING count(*) >= 2 UNION ALL VALUES ('[CLS]', 2), ('[SEP]', 3)),
u AS (SELECT pair_id, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM encoded),
ids AS (SELECT pair_id, list(coalesce(idx, 1) ORDER BY pos) AS ids FROM u LEFT JOIN known USING (token) GROUP BY pair_id)
SELECT pair_id, array_to_string(list_concat(ids, list_transform(range(20 - len(ids)), lambda x: 0)), ' ') AS ids, array_to_string(list_concat(list_transform(range(na), lambda x: 0), list_transform(range(nb), lambda x: 1), list_transform(range(20 - na - nb), lambda x: 0)), ' ') AS segments FROM ids JOIN encoded USING (pair_id)""",
    "id_lines_read_back": f"SELECT pair_id, unnest(range(len(t)))::INTEGER AS pos, unnest(t)::INTEGER AS id FROM ({IDS_OF})",
    "cipher_decode": f"""WITH u AS (SELECT pair_id, unnest(range(len(t))) AS pos, unnest(t) AS token FROM ({IDS_OF})), f AS (SELECT token, min((pair_id, pos)) AS f FROM u GROUP BY token),
k AS (SELECT token, chr((19967 + row_number() OVER (ORDER BY f))::INTEGER) AS c FROM f) SELECT pair_id AS doc_id, string_agg(c, '' ORDER BY pos) AS text FROM u JOIN k USING (token) GROUP BY pair_id""",
    "vocab_load": "SELECT token, (row_number() OVER (ORDER BY n) - 1)::INTEGER AS idx FROM (SELECT trim(token, ' ') AS token, min(shard_id::BIGINT * 1000000 + idx) AS n FROM tokenizer_state WHERE trim(token, ' ') <> '' AND idx IS NOT NULL GROUP BY ALL)",
    "ngram_char_ids": f"WITH {GRAMS.replace('counted AS (', 'counted AS MATERIALIZED (')}, c AS MATERIALIZED (SELECT ngram, unnest(range(n))::INTEGER AS pos, unnest(string_split(ngram, '')) AS token FROM counted), k AS (SELECT token, row_number() OVER (ORDER BY token) AS idx FROM (SELECT DISTINCT token FROM c)) SELECT ngram, pos, idx FROM c JOIN k USING (token)",
    "unknown_query_tokens": f"{LOWER_BASE} SELECT DISTINCT query_id, token FROM (SELECT query_id, unnest({filters_sql('query_text')}) AS token FROM queries) WHERE token NOT IN (SELECT token FROM df)",
    "log_buckets": """WITH o AS (SELECT query_id, query_id - 50 AS o FROM queries)
SELECT query_id, CASE WHEN abs(o) < 8 THEN o ELSE (ceil(ln(CASE WHEN abs(o) <= 8 THEN 8 ELSE abs(o) END / 8.0::DOUBLE) / ln(63 / 8.0::DOUBLE) * 7) + 8) * sign(o) END::INTEGER AS bucket FROM o""",
    "lexical_bm25_features": f"WITH {LEXICAL} SELECT pair_id, term, round(ln(((SELECT count(*) FROM lens) + 0.5) / (df + 0.5)) * 3.0 * (cnt::DOUBLE / len) / (2.0 * (0.25 + 0.75 * len / (SELECT avg(len) FROM lens)) + cnt::DOUBLE / len), 6) AS weight FROM tf JOIN lens USING (pair_id) JOIN df USING (term) WHERE total > 2",
    "corpus_stats": f"{BASE} SELECT n_docs, round(avg_len, 6) AS avg_len FROM stats",
    "term_freq": f"{BASE} SELECT doc_id, token, doc_len, cnt FROM tf",
    "doc_freq": f"{BASE} SELECT token, df FROM df",
    "vocab_index": f"{LOWER_BASE}, {VOCAB.format(1)} SELECT token, idx, cnt, df FROM vocab UNION ALL SELECT '[UNK]', 1, 0, 0",
    "texts_to_sequences": f"{LOWER_BASE}, {VOCAB.format(1)} SELECT d.doc_id, coalesce(s.seq, []) AS seq FROM docs d LEFT JOIN (SELECT doc_id, list(CASE WHEN idx < 500 THEN idx ELSE 1 END ORDER BY pos) AS seq FROM words JOIN vocab USING (token) GROUP BY doc_id) s USING (doc_id)",
    "sequences_to_texts": f"{LOWER_BASE}, {VOCAB.format(0)} SELECT d.doc_id, coalesce(s.text, '') AS text FROM docs d LEFT JOIN (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS text FROM words JOIN vocab USING (token) WHERE idx < 500 GROUP BY doc_id) s USING (doc_id)",
    "distinct_tokens": f"WITH {DOCS} SELECT doc_id, list_sort(list_distinct(tokens)) AS tokens FROM docs",
    "bm25_topk": _top(f"{SMOOTH} * {TD} * {TQ}", 50),
    "bm25_topk_probidf": _top(f"{PROB} * {TD} * {TQ}", 50),
    "bm25_no_tq": _top(f"{SMOOTH} * {TD}", 50),
    "tfidf_topk": _top(f"{TF} * {SMOOTH}", 50),
    "tfidf_all_scores": _top(f"{TF} * {SMOOTH}", 0),
    "bm25_queries_topk": f"""{LOWER_BASE}, qw AS (SELECT query_id, len(w) AS q_len, unnest(w) AS token FROM (SELECT query_id, {filters_sql('query_text')} AS w FROM queries)),
q AS (SELECT query_id, token, q_len, count(*) AS q_cnt FROM qw GROUP BY ALL),
found AS (SELECT query_id, doc_id, round(sum(q_cnt * {SMOOTH} * {TD} * {TQ}), 6) AS score FROM tf JOIN q USING (token) JOIN df USING (token), stats GROUP BY ALL)
SELECT query_id, doc_id, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM found) WHERE rank <= 10""",
    "tfidf_weights": _weights(f"{TF} * {SMOOTH}"),
    "bm25_weights": _weights(f"{SMOOTH} * {TD}"),
    "bm25_weights_tq": _weights(f"{SMOOTH} * {TD} * (2.2 * {TF} / (1.2 + {TF}))"),
    "tfidf_weights_padded": _padded(f"{TF} * {SMOOTH}"),
    "bm25_weights_padded": _padded(f"{SMOOTH} * {TD}"),
    "sk_tfidf_ngrams": f"""WITH {LOWERED}, g AS (SELECT doc_id, unnest(list_concat(tokens, CASE WHEN len(tokens) >= 2 THEN list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]) ELSE [] END)) AS term FROM docs),
gtf AS (SELECT doc_id, term, count(*) AS cnt FROM g GROUP BY ALL), gdf AS (SELECT term, count(*) AS df FROM gtf GROUP BY ALL),
raw AS (SELECT doc_id, term, cnt * (ln((1.0 + (SELECT count(*) FROM docs)) / (1 + df)) + 1) AS w FROM gtf JOIN gdf USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw""",
    "keywords_per_doc": f"""{BASE}, k AS (SELECT doc_id, token, round({TF} * {SMOOTH}, 9) AS weight FROM tf JOIN df USING (token), stats)
SELECT doc_id, token, round(weight, 6) AS weight, rank FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, token))::INTEGER AS rank FROM k) WHERE rank <= 5""",
    "word_tokens": f"SELECT pair_id, unnest(range(len(w)))::INTEGER AS pos, unnest(w) AS token FROM (SELECT pair_id, {filters_sql('text_a')} AS w FROM pairs WHERE text_a IS NOT NULL)",
    "char_tokens": "SELECT query_id, unnest(range(length(query_text)))::INTEGER AS pos, unnest(string_split(query_text, '')) AS token FROM queries WHERE query_text <> ''",
    "clean_str": f"SELECT pair_id, {_clean('text_a')} AS cleaned FROM pairs",
    "char_ngrams": "SELECT query_id, t[i : i + n - 1] AS gram, count(*) AS cnt FROM (SELECT query_id, t, n, unnest(range(1, length(t) - n + 2)) AS i FROM (SELECT query_id, replace(query_text, ' ', '') AS t FROM queries), (VALUES (1), (2), (3)) s(n) WHERE length(t) >= n) GROUP BY ALL",
    "bert_basic_tokens": f"SELECT pair_id, unnest(range(len(w)))::INTEGER AS pos, unnest(w) AS token FROM (SELECT pair_id, {basic_sql('text_a')} AS w FROM pairs WHERE text_a IS NOT NULL)",
    "char_classes": f"""WITH c AS (SELECT DISTINCT unnest(string_split(query_text, '')) AS c FROM queries WHERE query_text <> ''),
s AS (SELECT c, c IN (' ', chr(10), chr(13), chr(9)) OR regexp_matches(c, '^\\p{{Zs}}$') AS space FROM c)
SELECT c, space, regexp_matches(c, '^[{PUNCTUATION_CLASS}]$') AS punctuation, regexp_matches(c, '^[{CJK_CLASS}]$') AS cjk, regexp_matches(c, '^[\\p{{Cc}}\\p{{Cf}}]$') AS control FROM s""",
    "levenshtein_pairs": "SELECT p_brand, p_type, levenshtein(p_brand, p_type)::INTEGER AS distance FROM (SELECT DISTINCT p_brand, p_type FROM part)",
    "pad_truncate": f"""{LOWER_BASE}, {VOCAB.format(1)}, seqs AS (SELECT d.doc_id, coalesce(s.seq, []) AS seq FROM docs d LEFT JOIN (SELECT doc_id, list(idx ORDER BY pos) AS seq FROM words JOIN vocab USING (token) GROUP BY doc_id) s USING (doc_id)),
modes AS (SELECT doc_id, p || '-' || t AS mode, p, CASE WHEN len(seq) <= 12 THEN seq WHEN t = 'pre' THEN seq[len(seq) - 11 : len(seq)] ELSE seq[1:12] END AS kept FROM seqs, (VALUES ('pre'), ('post')) a(p), (VALUES ('pre'), ('post')) b(t)),
filled AS (SELECT *, list_transform(range(12 - len(kept)), lambda x: 0) AS fill FROM modes)
SELECT doc_id, mode, array_to_string(CASE WHEN p = 'pre' THEN list_concat(fill, kept) ELSE list_concat(kept, fill) END, ' ') AS ids FROM filled""",
    "sliding_batches": """WITH r AS (SELECT query_id, row_number() OVER (ORDER BY query_id) AS rn FROM queries)
SELECT b.rn - 1 AS batch_id, min(r.query_id) AS first, max(r.query_id) AS last, count(*) AS n FROM r b JOIN r ON r.rn BETWEEN b.rn AND b.rn + 7 GROUP BY b.rn""",
    "even_batches": "SELECT (rn - 1) // 64 AS batch_id, min(pair_id) AS first, count(*) AS n FROM (SELECT pair_id, row_number() OVER (ORDER BY pair_id) AS rn FROM pairs) GROUP BY ALL",
    "k_max_pool": f"WITH {VECTORS}, t AS (SELECT item_id AS vec_id, list_sort(vec, 'DESC')[1:4] AS x FROM v) SELECT vec_id, unnest(range(4))::INTEGER AS pos, round(unnest(x), 6) AS x FROM t",
    "text_pair_to_ids": f"""WITH docs AS (SELECT pair_id * 2 AS doc_id, {filters_sql('text_a')} AS tokens FROM pairs WHERE text_a IS NOT NULL AND text_b IS NOT NULL UNION ALL SELECT pair_id * 2 + 1, {filters_sql('text_b')} FROM pairs WHERE text_a IS NOT NULL AND text_b IS NOT NULL), {INDEX}, {VOCAB.format(1)},
seqs AS (SELECT d.doc_id, coalesce(s.seq, [])[1:16] AS seq FROM docs d LEFT JOIN (SELECT doc_id, list(idx ORDER BY pos) AS seq FROM words JOIN vocab USING (token) GROUP BY doc_id) s USING (doc_id)),
ids AS (SELECT doc_id, array_to_string(list_concat(seq, list_transform(range(16 - len(seq)), lambda x: 0)), ' ') AS ids FROM seqs)
SELECT pair_id, a.ids || chr(9) || b.ids || chr(9) || coalesce(labels, 0) AS line FROM pairs JOIN ids a ON a.doc_id = pair_id * 2 JOIN ids b ON b.doc_id = pair_id * 2 + 1""",
    "truncate_pairs": f"""WITH s AS (SELECT pair_id, len({filters_sql('text_a')}) AS a, len({filters_sql('text_b')}) AS b FROM pairs WHERE text_a IS NOT NULL AND text_b IS NOT NULL)
SELECT pair_id, CASE WHEN a + b <= 12 THEN a WHEN a <= 6 THEN a WHEN b <= 6 THEN 12 - b ELSE 6 END::INTEGER AS n_a, CASE WHEN a + b <= 12 THEN b WHEN b <= 6 THEN b WHEN a <= 6 THEN 12 - a ELSE 6 END::INTEGER AS n_b FROM s""",
    "euclidean_pairs": _met(f"round(sqrt({_zip('(X - Y) * (X - Y)')}), 6) AS euclidean"),
    "cosine_floored_pairs": _met(f"round(list_inner_product(a, b) / greatest(sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b)), 1e-8), 6) AS cosine"),
    "cosine_pairs": _met(f"round({COS}, 6) AS cosine", f"round((1 - {COS}) / 2, 6) AS distance"),
    "manhattan_pairs": _met(f"round({_zip('abs(X - Y)')}, 6) AS manhattan"),
    "minkowski_pairs": _met(f"round(pow({_zip('pow(X - Y, 4)')}, 0.25), 6) AS minkowski"),
    "hamming_pairs": f"WITH {MET}, w AS (SELECT query_id, item_id, a, b, list_avg(a) AS ma, list_avg(b) AS mb FROM met) SELECT query_id, item_id, {_zip('((X >= ma) <> (Y >= mb))::INTEGER')}::INTEGER AS hamming FROM w",
    "jaccard_pairs": f"WITH {MET} SELECT query_id, item_id, round({_zip('((X > 0.1) <> (Y > 0.1))::INTEGER')}::DOUBLE / nullif({_zip('((X > 0.1) OR (Y > 0.1))::INTEGER')}, 0), 6) AS jaccard FROM met",
    "pearson_pairs": f"WITH {MET}, w AS (SELECT query_id, item_id, a, b, list_avg(a) AS ma, list_avg(b) AS mb FROM met) SELECT query_id, item_id, round({_zip('(X - ma) * (Y - mb)')} / sqrt({_zip('(X - ma) * (X - ma)')} * {_zip('(Y - mb) * (Y - mb)')}), 6) AS pearson FROM w",
    "kl_pairs": f"""WITH {MET}, e AS (SELECT query_id, item_id, list_transform(a, lambda x: exp(x)) AS p, list_transform(b, lambda x: exp(x)) AS q FROM met),
n AS (SELECT query_id, item_id, list_transform(p, lambda x: x / list_sum(p)) AS a, list_transform(q, lambda x: x / list_sum(q)) AS b FROM e) SELECT query_id, item_id, round({_zip('X * ln(X / Y)')}, 6) AS kl FROM n""",
    "mahalanobis_dims": f"""WITH {VECTORS}, ab AS (SELECT x.item_id, unnest(range(64)) AS d, unnest(x.vec) AS a, unnest(y.vec) AS b FROM v x JOIN v y ON y.item_id = x.item_id + 1),
c AS (SELECT item_id, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS co FROM ab GROUP BY ALL)
SELECT i.item_id, count(*) AS n, round(sum(sqrt(((i.a - j.a) ** 2 * vb - 2 * (i.a - j.a) * (i.b - j.b) * co + (i.b - j.b) ** 2 * va) / (va * vb - co * co))), 4) AS total FROM ab i JOIN ab j ON i.item_id = j.item_id AND i.d < j.d JOIN c ON c.item_id = i.item_id GROUP BY i.item_id""",
    "knn_cosine": f"WITH {MET}, r AS (SELECT query_id, item_id, round({COS}, 6) AS cosine FROM met) SELECT query_id, item_id, cosine, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id))::INTEGER AS rank FROM r) WHERE rank <= 10",
    "l2_normalised": f"WITH {VECTORS} SELECT item_id, unnest(range(64))::INTEGER AS dim, round(unnest(list_transform(vec, lambda x: x / sqrt(list_inner_product(vec, vec)))), 6) AS x FROM v",
    "maxsim_cosine": f"""WITH {MATRICES}, n AS (SELECT item_id, list_transform(m, lambda t: list_transform(t, lambda x: x / greatest(sqrt(list_inner_product(t, t)), 1e-12))) AS m FROM m)
SELECT q.item_id AS query_id, d.item_id, round(list_sum(list_transform(q.m, lambda t: list_max(list_transform(d.m, lambda u: list_inner_product(t, u))))), 6) AS score FROM n q JOIN n d ON q.item_id <> d.item_id WHERE q.item_id % 20 = 0""",
    "maxsim_l2": f"""WITH {MATRICES} SELECT q.item_id AS query_id, d.item_id, round(list_sum(list_transform(q.m, lambda t: list_max(list_transform(d.m, lambda u: -pow(list_distance(t, u), 2))))), 6) AS score FROM m q JOIN m d ON q.item_id <> d.item_id WHERE q.item_id % 20 = 0""",
    "attention_pool": f"""WITH {MATRICES}, s AS (SELECT item_id, m, list_transform(m, lambda t: exp(list_inner_product(m[1], t) / sqrt(8.0))) AS e FROM m),
u AS (SELECT item_id, unnest(range(8)) AS dim, m, e FROM s)
SELECT item_id, dim::INTEGER AS dim, round(list_sum(list_transform(range(1, 9), lambda k: e[k] * m[k][dim + 1])) / list_sum(e), 6) AS x FROM u""",
    "mean_pool_by_label": f"WITH {VECTORS}, u AS (SELECT label, unnest(range(64))::INTEGER AS dim, unnest(vec) AS x FROM v) SELECT label, dim, round(avg(x), 6) AS x FROM u GROUP BY ALL",
    "minhash_signatures": f"WITH {_signatures(10)} SELECT item_id, p::INTEGER AS p, h FROM sig",
    "minhash_bands": f"WITH {_bands(4)} SELECT item_id, band, bucket FROM banded",
    "minhash_search": f"WITH {_bands(20)}, full_ AS (SELECT * FROM banded WHERE item_id IN (SELECT item_id FROM features)) SELECT DISTINCT q.item_id AS query_id, x.item_id FROM full_ q JOIN full_ x USING (band, bucket) WHERE q.item_id % 20 = 0 AND q.item_id <> x.item_id",
    "e2lsh_hashes": f"WITH {_fingerprints()} SELECT item_id, round, fp FROM fp",
    "e2lsh_search": f"WITH {_fingerprints()} SELECT DISTINCT q.item_id AS query_id, x.item_id FROM fp q JOIN fp x USING (fp) WHERE q.item_id % 20 = 0 AND q.item_id <> x.item_id",
    "e2lsh_search_per_round": f"WITH {_fingerprints()} SELECT DISTINCT q.item_id AS query_id, x.item_id FROM fp q JOIN fp x USING (fp, round) WHERE q.item_id % 20 = 0 AND q.item_id <> x.item_id",
    "sif_weights": f"{BASE}, {PROBABILITY} SELECT token, round(0.001 / (0.001 + p), 6) AS weight FROM prob",
    "usif_weights": f"""{BASE}, {PROBABILITY}, s AS (SELECT count(*) AS v FROM prob), al AS (SELECT sum((p > 1 - pow(1 - 1.0 / v, 12))::INTEGER)::DOUBLE / max(v) AS alpha, max(v) AS v FROM prob, s),
a AS (SELECT (1 - alpha) / nullif(alpha * v / 2.0, 0) AS a FROM al) SELECT token, round(a / (a / 2 + p), 6) AS weight FROM prob, a""",
    "sif_pooled": f"{POOLED} SELECT doc_id, dim, round(x, 6) AS x FROM pooled",
    "sif_projected": f"{POOLED} SELECT doc_id, dim, round(x - sum(x) OVER (PARTITION BY doc_id) / 8, 6) AS x FROM pooled",
    "ngram_counts": f"WITH {GRAMS} SELECT ngram, n, cnt FROM counted",
    "ngram_pruned": f"WITH {GRAMS} SELECT ngram, n, cnt FROM counted c WHERE NOT EXISTS (SELECT 1 FROM counted l WHERE l.n = 3 AND c.n = 2 AND l.cnt = c.cnt AND substr(l.ngram, 1, 2) = c.ngram)",
    "idmap": f"WITH {IDMAP} SELECT token, cnt, idx FROM freq",
    "oov_map": f"""WITH {IDMAP}, joined AS (SELECT t.*, f.idx FROM tokens t LEFT JOIN freq f ON f.token = t.token AND f.cnt >= 5 WHERE t.token <> ''),
rare AS (SELECT *, min((field, pos)) OVER (PARTITION BY pair_id, token) AS f FROM joined WHERE idx IS NULL)
SELECT pair_id AS id, field, pos, token, idx FROM joined WHERE idx IS NOT NULL UNION ALL SELECT pair_id, field, pos, token, (dense_rank() OVER (PARTITION BY pair_id ORDER BY f) + 34999)::VARCHAR FROM rare""",
    "similar_words": f"""WITH w AS (SELECT DISTINCT unnest({filters_sql('query_text')}) AS token FROM queries),
v AS (SELECT token, list_transform(range(8), lambda d: (('0x' || substr(md5(token), d * 4 + 1, 4))::BIGINT - 32768) / 32768.0::DOUBLE) AS vec FROM w),
c AS (SELECT x.token AS word, y.token AS other, round(list_inner_product(x.vec, y.vec) / sqrt(list_inner_product(x.vec, x.vec)) / sqrt(list_inner_product(y.vec, y.vec)), 6) AS similarity FROM v x JOIN v y ON x.token <> y.token),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY similarity DESC, other) AS r FROM c) WHERE r <= 100)
SELECT word, other, similarity, rank FROM (SELECT *, (row_number() OVER (PARTITION BY word ORDER BY similarity DESC, other))::INTEGER AS rank FROM n WHERE length(word) = length(other) AND similarity > 0.68) WHERE rank <= 15""",
    "stopword_filter": f"{BASE} SELECT doc_id, pos::INTEGER AS pos, token FROM words WHERE lower(token) NOT IN ('the', 'a', 'to', 'how', '的', '我')",
    "pair_lines": "WITH s AS (SELECT regexp_replace(line_text, '^\\s+|\\s+$', '', 'g') AS l FROM raw_records), p AS (SELECT string_split(l, chr(9)) AS f FROM s WHERE l <> '') SELECT f[1] AS text_a, f[2] AS text_b, CASE WHEN len(f) <> 3 THEN 0 WHEN regexp_full_match(trim(f[3], ' '), '[0-9]{1,9}') THEN trim(f[3], ' ')::INTEGER END AS labels FROM p WHERE len(f) >= 2",
    "json_pairs": "SELECT substr(sha256(coalesce(text_a, '') || chr(9) || coalesce(text_b, '')), 1, 32) AS rid, coalesce(labels, 2) AS labels, text_a, text_b FROM pairs",
    "sentence_ids": f"{COMPONENTS} SELECT sid, sentence FROM sentences",
    "sentence_edges": f"{COMPONENTS} SELECT src, dst FROM edges",
    "sentence_components": f"{COMPONENTS} SELECT sid, component FROM comps",
    "component_violations": f"{COMPONENTS} SELECT labels, count(*) AS n FROM pairs JOIN comps a ON a.sid = md5(text_a) JOIN comps b ON b.sid = md5(text_b) WHERE a.component <> b.component GROUP BY labels",
    "kfold_by_component": f"""{COMPONENTS}, l AS (SELECT pair_id AS id, component FROM pairs JOIN comps ON sid = md5(text_a) WHERE text_b IS NOT NULL AND labels <> 2),
r AS (SELECT component, row_number() OVER (ORDER BY md5('1:' || component)) AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT component FROM l)),
f AS (SELECT component, (rank - 1) // greatest(n // 5, 1) AS fold FROM r) SELECT id, component, CASE WHEN fold < 5 THEN fold END::INTEGER AS fold FROM l JOIN f USING (component)""",
    "kfold_stratified": "SELECT pair_id AS id, labels AS label, ((row_number() OVER (PARTITION BY labels ORDER BY md5('1:' || pair_id), pair_id) - 1) % 5)::INTEGER AS fold FROM pairs WHERE labels IS NOT NULL",
    "symmetric_pairs": "SELECT pair_id, text_a, text_b FROM pairs UNION ALL SELECT pair_id, text_b, text_a FROM pairs",
    "repeated_pairs": "SELECT pair_id, unnest([0, 1])::INTEGER AS copy FROM pairs",
    "unlabelled_filter": "SELECT labels, count(*) AS n FROM pairs WHERE labels <> 2 GROUP BY labels",
    "shuffled_order": "SELECT query_id, row_number() OVER (ORDER BY md5('1:' || query_id), query_id) AS rank FROM queries",
    "tokenizer_lines": "SELECT pair_id, 0::INTEGER AS pos, text_a AS line FROM pairs UNION ALL SELECT pair_id, 1, text_b FROM pairs",
    "contrastive_loss": f"WITH {SCORED} SELECT round(sum(same * 0.25 * (1 - score) ** 2 + (1 - same) * CASE WHEN score >= 0.2 THEN score ** 2 ELSE 0 END), 4) AS loss FROM scored",
    "siamese_bce": f"WITH {SCORED}, p AS (SELECT *, 1 / (1 + exp(-score)) AS p FROM scored) SELECT round(avg(-(same * ln(p) + (1 - same) * ln(1 - p))), 6) AS loss, round(avg((score >= 0.1)::INTEGER), 6) AS share FROM p",
    "cross_entropy_accuracy": f"""WITH {SCORED}, p AS (SELECT *, 1 / (1 + exp(-4 * score)) AS p FROM scored), q AS (SELECT *, CASE WHEN same = 1 THEN p ELSE 1 - p END AS own FROM p)
SELECT round(avg(-ln(own)), 6) AS loss, round(avg(-ln(own)), 6) AS logits_loss, round(avg(ln(exp(p) + exp(1 - p)) - own), 6) AS double_loss, round(avg(((p > 0.5)::INTEGER = same)::INTEGER), 6) AS accuracy FROM q""",
    "simcse_loss": f"""WITH {VECTORS}, s AS (SELECT x.item_id // 16 AS batch, x.item_id AS i, x.item_id // 2 = y.item_id // 2 AS own, 20 * list_inner_product(x.vec, y.vec) / (sqrt(list_inner_product(x.vec, x.vec)) * sqrt(list_inner_product(y.vec, y.vec))) AS s FROM v x JOIN v y ON x.item_id // 16 = y.item_id // 16 AND x.item_id <> y.item_id),
p AS (SELECT batch, i, ln(sum(exp(s))) - max(CASE WHEN own THEN s END) AS l FROM s GROUP BY ALL) SELECT batch, round(avg(l), 6) AS loss FROM p GROUP BY batch""",
    "auc": f"""WITH {SCORED}, r AS (SELECT same, (rank() OVER (ORDER BY score) + rank() OVER (ORDER BY score) + count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored),
n AS (SELECT sum(same)::DOUBLE AS p, count(*) - sum(same) AS q FROM scored) SELECT round((sum(r)::DOUBLE - max(p) * (max(p) + 1) / 2) / (max(p) * max(q)), 6) AS auc FROM r, n WHERE same = 1""",
    "lr_schedule": "SELECT query_id AS step, round(CASE WHEN query_id < 40 THEN query_id / 40.0::DOUBLE WHEN query_id < 80 THEN 1 + (query_id - 40) / 40.0::DOUBLE * -0.9 ELSE 0.1 END, 6) AS rate FROM queries",
    "running_avg": "SELECT event_id, (sum(value::DECIMAL(18, 4)) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING))::DOUBLE / row_number() OVER (ORDER BY event_id) AS average FROM events",
    "lexical_classifier_features": f"WITH {LEXICAL} SELECT pair_id, term, round(cnt::DOUBLE / len * ln(((SELECT count(*) FROM lens) + 0.5) / (df + 0.5)), 6) AS weight FROM tf JOIN lens USING (pair_id) JOIN df USING (term) WHERE total > 2",
}
