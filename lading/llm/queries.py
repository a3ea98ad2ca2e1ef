"""The operators' queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lading.llm import (
    decontaminate, dialogues, imatch, langid, lexical, licenses, pieces, pii, quality, secrets, simhash, toxicity,
    warc,
)
from lading.llm.common import fold, shared_folder, table


def op1_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.mask(docs, "a key of this query's own").select("doc_id", "text", "n_replaced", "kinds")


def op2_imatch(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.edited_likeness(table(spark, folder, "documents"))


def op3_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return found.drop("text")


def op4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    encoded = pieces.encode(docs, pieces.read_model())
    return encoded.select("doc_id", F.size("ids").alias("n_pieces"), "lossless", "ids")


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    records = warc.with_revisits(table(spark, folder, "pages"))
    written = warc.write_monolithic(records, archives)
    found = warc.read_all(warc.normalise_all(written))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    held = (fold("doc_id", 5) == 0).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held, "score", "predicted")


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    net = quality.train(docs, table(spark, folder, "labels"))
    held = (fold("doc_id", 5) == 0).alias("held_out")
    return quality.score(docs, net).select("doc_id", held, "score", "predicted")


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    langs, net = langid.train(docs)
    held = (fold("doc_id", 4) == 2).alias("held_out")
    return langid.predict(docs.select("doc_id", "text"), langs, net).select("doc_id", held, "lang_pred", "score")


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, folder, "documents"))


def op11_dialogues(spark: SparkSession, folder: str) -> DataFrame:
    damaged = dialogues.damage(table(spark, folder, "conversations"))
    return dialogues.reports(dialogues.repair(damaged, F.col("dropped")))


def op12_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.find(docs, secrets.train(docs))
    *base, added = (secrets.number("secrets", kind).alias(f"n_{kind}") for kind in secrets.KINDS)
    base_sha256 = F.sha2(secrets.as_text("secrets", secrets.KINDS[:3]), 256).alias("base_sha256")
    return found.select("doc_id", *base, base_sha256, secrets.as_text("secrets").alias("spans"), added)


QUERIES = {
    "op1_surrogates": op1_surrogates,
    "op2_imatch": op2_imatch,
    "op3_licenses": op3_licenses,
    "op4_pieces": op4_pieces,
    "op5_decontaminate": op5_decontaminate,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_language": op9_language,
    "op10_simhash": op10_simhash,
    "op11_dialogues": op11_dialogues,
    "op12_lexical": op12_lexical,
    "op13_secrets": op13_secrets,
}
_BASE = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _imatch_sql() -> str:
    edges = ", ".join(f"'{e}'" for e in imatch.EDGES)
    return rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
    coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id,
    coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS next_text
  FROM documents WINDOW w AS (ORDER BY doc_id DESC)),
versions AS (
  SELECT doc_id, 0 AS v, text FROM docs
  UNION ALL
  SELECT doc_id, 1, left(text, n - n // 3) || left(next_text, n // 3) FROM docs),
terms AS (
  SELECT DISTINCT doc_id, v, unnest(regexp_split_to_array({_BASE}, '[^\p{{L}}\p{{N}}]+')) AS term FROM versions),
lexicon AS (
  SELECT term FROM terms WHERE v = 0 AND term <> '' GROUP BY term
  HAVING count(*) >= greatest(2, {imatch.LEAST_SHARE} * (SELECT count(*) FROM docs))
     AND count(*) <= {imatch.MOST_SHARE} * (SELECT count(*) FROM docs)),
parts AS (
  SELECT term, k FROM lexicon, range({len(imatch.EDGES)}) AS t(k)
  WHERE substr(md5(k || ':' || term), 1, 2) < [{edges}][k + 1]),
hashes AS (
  SELECT doc_id, v, k, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) AS h
  FROM terms JOIN parts USING (term) GROUP BY doc_id, v, k),
prints AS (
  SELECT doc_id, v, list(coalesce(h, '{imatch.NONE}') ORDER BY k) AS f
  FROM (SELECT doc_id, v, k FROM versions, range({len(imatch.EDGES)}) AS t(k)) LEFT JOIN hashes USING (doc_id, v, k)
  GROUP BY doc_id, v),
pairs AS (
  SELECT d.doc_id, d.n AS n_chars, sha256(e.text) AS edited_sha256, a.f AS fa, b.f AS fb, c.f AS fc
  FROM docs d JOIN versions e ON e.doc_id = d.doc_id AND e.v = 1
  JOIN prints a ON a.doc_id = d.doc_id AND a.v = 0
  JOIN prints b ON b.doc_id = d.doc_id AND b.v = 1
  JOIN prints c ON c.doc_id = d.next_id AND c.v = 0)
SELECT doc_id, n_chars, edited_sha256, array_to_string(fa, '.') AS fingerprint,
  array_to_string(fb, '.') AS edited_fingerprint,
  CASE WHEN fa = fb THEN 1.0::DOUBLE ELSE coalesce(
    len(list_filter(list_zip(fa, fb), lambda x: x[1] = x[2] AND x[1] <> '{imatch.NONE}'))::DOUBLE
    / nullif(len(list_filter(list_zip(fa, fb), lambda x: x[1] <> '{imatch.NONE}' OR x[2] <> '{imatch.NONE}')), 0), 1) END AS near_edited,
  CASE WHEN fa = fc THEN 1.0::DOUBLE ELSE coalesce(
    len(list_filter(list_zip(fa, fc), lambda x: x[1] = x[2] AND x[1] <> '{imatch.NONE}'))::DOUBLE
    / nullif(len(list_filter(list_zip(fa, fc), lambda x: x[1] <> '{imatch.NONE}' OR x[2] <> '{imatch.NONE}')), 0), 1) END AS near_next
FROM pairs
"""


_WARC_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
  FROM pages),
hexed AS (
  SELECT page_id, payload, last,
    array_to_string(list_transform(range(1, 41), lambda i:
      lpad(bin(instr('0123456789abcdef', substr(sha1(payload), i, 1)) - 1), 4, '0')), '') AS bits
  FROM payloads)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + 16 * CAST(substr(bits, 1 + 5 * i, 1) AS INT) + 8 * CAST(substr(bits, 2 + 5 * i, 1) AS INT)
      + 4 * CAST(substr(bits, 3 + 5 * i, 1) AS INT) + 2 * CAST(substr(bits, 4 + 5 * i, 1) AS INT)
      + CAST(substr(bits, 5 + 5 * i, 1) AS INT) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM hexed
"""

_LEXICAL_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs WHERE len(terms) > 0),
found AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM found, totals GROUP BY term, n_docs),
items AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY item_id, term),
lengths AS (SELECT r, doc_id, 25 + (75 * len(terms) * n_docs) // n_terms AS m FROM docs, totals),
scores AS (
  SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM items JOIN found USING (term) JOIN weights USING (term) JOIN lengths USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

ORACLE: dict[str, str] = {"op2_imatch": _imatch_sql(), "op6_warc": _WARC_SQL, "op12_lexical": _LEXICAL_SQL}
