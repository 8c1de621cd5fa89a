"""The queries of this package: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import annsearch, bpe, exactdedup, filteraudit, langid, latticelm, lexsearch, linerules, neardup, packing, pii, qualitycnn, warc
from lamina.session import table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents, learned from nine tenths of them."""
    return latticelm.score_documents(table(spark, sf_dir, "documents"), PIECES, langid.held_out("doc_id", 10, 0))


def op2_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line rules over all documents, with the boilerplate that they have in common."""
    docs = table(spark, sf_dir, "documents")
    return linerules.apply_rules(docs, linerules.common_lines(docs), with_text=False)


OP3_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
win AS (SELECT r, k, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM (
  SELECT r, k, ws[k] AS a, ws[k + 1] AS b, ws[k + 2] AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS k FROM w))),
rep AS (SELECT r, count(DISTINCT k + d) AS n FROM win, (VALUES (0), (1), (2)) AS o(d) WHERE win.n > 1 GROUP BY r),
a AS (SELECT r, text, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM (SELECT r, text, string_split(text, chr(10)) AS ls FROM d)),
l AS (SELECT r, k, text, line FROM a WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
t AS (SELECT line FROM (SELECT DISTINCT text, line FROM l) GROUP BY line
  HAVING count(*) >= {linerules.LEAST_COMMON} AND {linerules.COMMON_SHARE} * count(*) >= (SELECT count(DISTINCT text) FROM l)),
c AS (SELECT r, k, line, line IN (SELECT line FROM t) AS common, length(line) AS size, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n,
  len(regexp_extract_all(line, '{linerules.SHOUT}')) AS shout, len(regexp_extract_all(line, '{linerules.SYMBOLS}')) AS symbol,
  len(regexp_extract_all(line, '{linerules.BARS}')) AS bar, len(regexp_extract_all(line, '{linerules.SENTENCE}')) AS mark FROM l),
f AS (SELECT *, (shout >= 2 AND 4 * shout >= n) OR (symbol >= 3 AND 2 * symbol >= n) OR (n >= 20 AND mark = 0)
  OR (bar >= 2 AND 6 * bar >= n) OR (n <= 2 AND mark = 0) OR common OR regexp_matches(line, '{linerules.BOILERPLATE}') AS bad FROM c),
y AS (SELECT a.r, coalesce(string_agg(a.line, chr(10) ORDER BY a.k) FILTER (f.bad IS NULL OR NOT f.bad), '') AS clean FROM a LEFT JOIN f ON f.r = a.r AND f.k = a.k GROUP BY a.r),
g AS (SELECT r, count(*) - count(DISTINCT line) AS dup, sum(size) AS line_chars, coalesce(sum(size) FILTER (bad), 0) AS lost_chars FROM f GROUP BY r),
b AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '{linerules.SYMBOLS}')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars, CAST(coalesce(line_chars, 0) AS BIGINT) AS line_chars, CAST(length(clean) AS BIGINT) AS clean_chars, sha256(clean) AS clean_sha256
  FROM w LEFT JOIN rep USING (r) LEFT JOIN g USING (r) LEFT JOIN y USING (r)),
e AS (SELECT *, n_words < {linerules.LEAST_WORDS} OR 100 * n_repeat_words > {linerules.MOST_REPEATED} * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND 100 * lost_chars <= {linerules.MOST_LOST} * line_chars AS kept FROM e"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from documents outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out("doc_id", 4, 2).alias("held_out"))
    model = langid.learn(docs.where(~F.col("held_out")))
    return langid.identify(docs.drop("lang"), model).drop("text")


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, read back and indexed."""
    index = warc.archive_and_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS original FROM pages),
h AS (SELECT *, sha1(body) AS d, page_id <> original AS again FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  ((CAST('0x' || substr(d, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) + 1, 1)), '') AS payload_digest,
 CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN original END AS refers_to FROM h"""


def op6_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labels outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", langid.held_out("doc_id", 4, 2).alias("held_out"))
    model = qualitycnn.learn(docs, table(spark, sf_dir, "labels").where(~langid.held_out("doc_id", 4, 2)))
    return qualitycnn.score(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents; no text is changed before comparison."""
    return exactdedup.exact_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
 sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents, on two-word shingles."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


#: Links from an inverted index of shingles: every pair that shares one is compared on the full sets.
OP8_SQL = """WITH RECURSIVE w AS (
 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 2 THEN [ws[1]]
  ELSE list_distinct(list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND least(a.n, b.n) * 100 >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (max(a.n) + max(b.n) - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT p.a, r.c FROM r JOIN p ON p.b = r.doc_id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(c) AS component_id, s.doc_id = min(c) AS kept
FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(sh)"""


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of all documents."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), VOCABULARY, with_ids=False)


def op10_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.summary(pii.personal_data(table(spark, sf_dir, "documents")))


def op11_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector, among all."""
    return annsearch.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in all orders, by source."""
    rows = filteraudit.judged_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filteraudit.audit(rows, "ABCDE")


#: What a prefix leaves is counted by part and the set of filters a document fails.
OP12_SQL = """WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
  + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first, false)::INT AS mask
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(k AS INT) AS step, filter_order[k] AS f, 1 << (ascii(filter_order[k]) - 65) AS bit,
  list_sum([0] || list_transform(range(1, k), lambda j: 1 << (ascii(filter_order[j]) - 65)))::INT AS before FROM o, range(1, 6) t(k)),
g AS (SELECT part, filter_order, step, f, sum(n) FILTER (mask & before = 0 AND mask & bit = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit <> 0) AS removed,
  sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
  sum(good) FILTER (mask & before = 0 AND mask & bit <> 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0) AS toxic_lost FROM c, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
 coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley FROM g"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for each benchmark item."""
    shards, many = lexsearch.index(table(spark, sf_dir, "documents"))
    return lexsearch.search(shards, many, table(spark, sf_dir, "benchmark"))


OP13_SQL = """WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
c AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM t),
p AS (SELECT r, doc_id, len(ts)::BIGINT AS n, term, count(*) AS tf FROM (SELECT r, doc_id, ts, unnest(ts) AS term FROM t) GROUP BY r, doc_id, len(ts), term),
v AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, r, doc_id, sum(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN v USING (term) JOIN p USING (term), c GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 10"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lattice_lm, op2_bestfit_packing, op3_line_rules, op4_language_id, op5_warc_index, op6_quality_cnn, op7_exact_dedup, op8_minhash_neardup, op9_bpe_codec, op10_pii_bootstrap, op11_kmeans_tree, op12_filter_audit, op13_lexical_search)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_rules": OP3_SQL, "op5_warc_index": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op8_minhash_neardup": OP8_SQL, "op12_filter_audit": OP12_SQL, "op13_lexical_search": OP13_SQL}
