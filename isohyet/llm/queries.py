"""Queries of the corpus operators: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.llm import byte_bpe, decontam, hard_negatives, itq_dedup, licenses, line_dedup, pii, quality_qda, repair_ids, simhash, suffix_dedup, warc, whitening
from isohyet.llm._common import cut, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = pii.listed(F.col("base"), pii.BASE)
    return found.select(
        "doc_id",
        *[F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in pii.BASE],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        *[F.size(f"added.{k}").cast("long").alias(f"n_added_{k}") for k in pii.LOOSE],
        (F.size(base) + sum(F.size(f"added.{k}") for k in pii.LOOSE)).cast("long").alias("n_spans"),
        F.array_join(F.concat(base, pii.listed(F.col("added"), pii.LOOSE)), ",").alias("spans"),
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = byte_bpe.byte_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = repair_ids.id_file_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = cut(quality_qda.with_statistics(docs).drop("text"), "statistics")
    model = quality_qda.train(stats, table(spark, sf_dir, "labels"))
    return quality_qda.score_statistics(stats, model).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex(F.col("lanes")[0]), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op10_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = itq_dedup.near_vectors(table(spark, sf_dir, "embeddings"))
    return near.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    parts = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "part")
    rows = out.select(F.col("id").alias("vec_id"), "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", parts)
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "part.whitened", "part.explained", "identity_error")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda b: b["start"])
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        listed("base.label").alias("base_labels"), listed(F.concat("base.label", "found.label")).alias("labels"), "score",
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc, op10_itq, op11_whitening, op12_licenses, op13_hard_negatives, op2_pii, op3_suffix_dedup, op4_byte_bpe, op5_decontamination, op6_repair_ids, op7_line_dedup, op8_quality, op9_simhash)}


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS low FROM p WHERE octet_length(encode(html)) >= 100 GROUP BY html)
SELECT page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes, sha256(p.html) AS payload_digest,
  CASE WHEN low <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN low <> page_id THEN low END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
"""
OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (SELECT vec_id AS v, vec_id AS low FROM embeddings UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.v AND l.b > r.low),
c AS (SELECT v, min(low) AS low FROM r GROUP BY v)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, low AS component_id, vec_id = low AS kept
FROM embeddings JOIN c ON c.v = vec_id LEFT JOIN n ON n.a = vec_id
"""
OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
d AS (SELECT k, max(doc_id) AS keep FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(d.k) FILTER (l.doc_id <> d.keep) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (d.k IS NULL OR l.doc_id = d.keep), '')) AS kept_sha256
FROM l LEFT JOIN d USING (k) GROUP BY doc_id
"""

OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op7_line_dedup": OP7_SQL, "op10_itq": OP10_SQL, "op13_hard_negatives": OP13_SQL}
