"""One query per operator over its whole table, with production parameters, and the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerpulse.llm import conversations, ctw, decontam, html_text, langid, ngram_join, paragraphs, pieces, spelling, toxicity, vecdedup, warc, wavelet
from tickerpulse.session import work_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# CRC-32 of a string in SQL: the table of the 256 remainders, then one step per byte.
CRC_TABLE = """crc_table AS (SELECT list(r ORDER BY i) AS t FROM (SELECT i,
  list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM range(256) x(i)))"""


def crc32_sql(text: str) -> str:
    """An expression over ``crc_table``; DuckDB gives bytes of a string as two hex digits each."""
    text = f"CAST({text} AS VARCHAR)"
    data = f"hex(encode({text}))"
    step = f"xor(t[1 + (xor(crc_so_far, CAST('0x' || substr({data}, 2 * crc_at + 1, 2) AS BIGINT)) & 255)], crc_so_far >> 8)"
    return f"xor(list_reduce(list_prepend(4294967295, range(octet_length(encode({text})))), lambda crc_so_far, crc_at: {step}), 4294967295)"


@query("op1_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, unhex(sha1(payload)) AS raw, sha1(payload) AS hex FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY hex, n) AS first FROM d),
five AS (SELECT *, list_transform(range(8), lambda k: CAST('0x' || substr(hex, 5 * k + 1, 5) AS BIGINT)) AS parts FROM r)
SELECT page_id, n AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((parts[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM five""")
def warc_round_trip(spark, sf_dir):
    path = work_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), "page_id", "url", "html", path)
    found = warc.read(spark, path).where("kind = 'record'")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_language")
def language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.fit(docs.where("NOT held_out AND doc_id IS NOT NULL"), "text", "lang")
    found = langid.label(docs.select("doc_id", "held_out", "text"), "text", model)
    return found.select(
        "doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"),
        F.size("language.spans").alias("n_spans"),
    )


@query("op3_vector_dedup", """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b
  ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reached AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u),
roots AS (SELECT u, least(u, min(v)) AS root FROM reached GROUP BY u),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts c ON vec_id = c.u LEFT JOIN roots r ON vec_id = r.u""")
def vector_dedup(spark, sf_dir):
    return vecdedup.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


@query("op4_decontamination")
def decontamination(spark, sf_dir):
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.contaminated(docs, benchmark, "doc_id", "text", "item_id", "text")


@query("op5_toxicity")
def toxic_documents(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, "doc_id", "text", "toxic")
    found = toxicity.score(docs, "doc_id", "text", model)
    return found.select("doc_id", "expected_severity", "grade", (F.col("expected_severity") >= 0.3).alias("toxic"))


@query("op6_main_text")
def main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    model = html_text.fit(pages, "html")
    return html_text.extract(pages, "html", model).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op7_token_shards")
def token_shards(spark, sf_dir):
    path = work_path(spark, "shards")
    wavelet.write_shards(table(spark, sf_dir, "documents"), "doc_id", "text", path, BYTE_BPE, special=True)
    return wavelet.read_documents(spark, path)


@query("op8_paragraph_dedup")
def paragraph_dedup(spark, sf_dir):
    return paragraphs.removals(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("op9_ngram_join")
def ngram_pairs(spark, sf_dir):
    return ngram_join.similar(table(spark, sf_dir, "documents"), "doc_id", "text").drop("text_hash")


@query("op10_pieces")
def sentence_pieces(spark, sf_dir):
    return pieces.digest(table(spark, sf_dir, "documents"), "doc_id", "text", PIECE_MODEL)


@query("op11_spelling", f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, n, {crc32_sql("doc_id || ':' || run")} AS h FROM counted, crc_table),
spoilt AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoilt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, n, unnest(range(length(word))) AS k FROM words),
shorter AS (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS rest FROM places),
near AS (SELECT a.word AS u, b.word AS v, b.n AS n FROM shorter a JOIN shorter b USING (k, rest) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word),
best AS (SELECT u, count(*) AS n_near, min((-n, v)) AS b FROM near GROUP BY u),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * n THEN b[2] END AS form, CASE WHEN -b[1] >= 2 * n THEN -b[1] END AS form_n
  FROM words LEFT JOIN best ON word = u),
chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.root FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)""")
def spelling_variants(spark, sf_dir):
    return spelling.variant_groups(spelling.vocabulary(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query("op12_conversations", f"""
WITH {CRC_TABLE},
own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS p,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, CAST({crc32_sql("c")} % 4 AS BIGINT) AS h FROM (SELECT DISTINCT c FROM own), crc_table),
lent AS (SELECT v.c, o.p, o.role, o.text FROM convs v JOIN own o ON o.c = v.c - v.c % 20 WHERE o.p <= v.h),
turns AS (SELECT * FROM lent UNION ALL
  SELECT o.c, o.p - v.h + (SELECT count(*) FROM lent l WHERE l.c = o.c), o.role, o.text FROM own o JOIN convs v USING (c) WHERE o.p > v.h),
paths AS (SELECT c, list((role, text) ORDER BY p) AS seq FROM turns GROUP BY c),
whole AS (SELECT c, coalesce(seq, []) AS seq FROM convs LEFT JOIN paths USING (c)),
steps AS (SELECT c, d, seq, md5(CAST(seq[1:d] AS VARCHAR)) AS k, md5(CAST(seq[1:d - 1] AS VARCHAR)) AS up FROM (SELECT c, seq, unnest(range(len(seq) + 1)) AS d FROM whole)),
nodes AS (SELECT d, k, min(c) AS c, count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN up END) AS up,
  any_value(CASE WHEN d > 0 THEN len(regexp_extract_all(seq[d][2], '[^\x20\x09-\x0D]+')) ELSE 0 END) AS w,
  coalesce(string_agg(c, ',' ORDER BY c) FILTER (len(seq) = d), '') AS ends FROM steps GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY d, up),
below AS (SELECT DISTINCT s.d, s.k, e.d AS e_d, e.k AS e_k FROM steps s JOIN steps e USING (c) WHERE e.d >= s.d),
sums AS (SELECT b.d, b.k, CAST(sum((n.n_convs - 1) * n.w) AS BIGINT) AS saved, CAST(sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS leaves
  FROM below b JOIN nodes n ON n.d = b.e_d AND n.k = b.e_k LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k GROUP BY b.d, b.k)
SELECT n.c AS conv_id, n.d AS depth, p.c AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums USING (d, k) LEFT JOIN kids USING (d, k) LEFT JOIN nodes p ON p.d = n.d - 1 AND p.k = n.up""")
def conversation_prefixes(spark, sf_dir):
    return conversations.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op13_lm_score")
def lm_scores(spark, sf_dir):
    return ctw.scores(table(spark, sf_dir, "documents"), "doc_id", "text")
