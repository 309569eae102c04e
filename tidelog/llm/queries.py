"""The operators' queries over the driver's tables, and their equivalents in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import exact_dedup, licenses, mixing, near_dedup, packing, quality, secrets, sharding, token_output, toxicity
from tidelog.llm.common import read_table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.training_order(read_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_digest(read_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.col("doc_id").cast("string"))  # the table has no file names: a source is a directory
    return licenses.scan_licenses(docs.select("doc_id", "text", path.alias("path")), "path", by_content=True)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    own = [op1_toxicity, op2_packing, op3_mixing, op4_exact_dedup, op5_token_output, op6_quality, op7_licenses, op8_secrets, op9_sharding, op10_near_dedup]
    return {f.__name__: f for f in own}


_W = r"[^\x20\x09-\x0D]"

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, source, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS k, len(regexp_extract_all(coalesce(text, ''), '{_W}+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w,
  ([-0.5, 0.0, 0.5])[((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS tilt FROM d GROUP BY source),
l AS (SELECT *, 3.0::DOUBLE * source_size AS cap,
  ((SELECT sum(source_size) FROM s) - coalesce(sum(3.0::DOUBLE * source_size) OVER b, 0))::DOUBLE / ((SELECT sum(w) FROM s) - coalesce(sum(w) OVER b, 0)) AS level
  FROM s WINDOW b AS (ORDER BY 3.0::DOUBLE * source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, tilt, CASE WHEN cap < level * w THEN cap ELSE least(cap, w * coalesce((SELECT arg_min(level, cap / w) FROM l WHERE NOT cap < level * w), 0)) END AS target FROM l),
p AS (SELECT d.*, source_size, target, tilt, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
v AS (SELECT doc_id, size, tilt, e, greatest(0, least(size, round(target)::BIGINT - (source_size * e + pos))) AS words,
  greatest(0.0, least(1.0, ((source_size * e + pos)::DOUBLE + size::DOUBLE / 2) / target)) AS u FROM p, (VALUES (0), (1), (2), (3)) v(e) WHERE target > 0),
r AS (SELECT doc_id, e, position, row_number() OVER (ORDER BY position, doc_id, size, e) - 1 AS first_rank
  FROM (SELECT *, CASE WHEN tilt = 0 THEN u ELSE (-(1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * u)) / (2 * tilt) END AS position FROM v WHERE words > 0))
SELECT p.doc_id, size, source_size, target,
  (SELECT sum(greatest(0, least(size, round(target)::BIGINT - (source_size * e + pos)))) FROM (VALUES (0), (1), (2), (3)) v(e))::BIGINT AS taken,
  position AS first_position, first_rank
FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.e = 0
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

OP6_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_W}+') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
win AS (SELECT doc_id, i, w[i:i+4] AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2), (3), (4)) v(k) GROUP BY doc_id),
m AS (SELECT d.doc_id, text, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  len(list_filter(lines, lambda x: regexp_matches(x, '{_W}')))::BIGINT AS n_lines, len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '{_W}'))))::BIGINT AS n_other, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_lines - n_other AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(text, '\p{{L}}')) AS n_letters FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 4 > n_words OR word_chars < n_words * 2 OR word_chars > n_words * 16 OR n_dup_lines * 10 > n_lines * 3 OR n_upper * 2 > n_letters OR n_letters * 2 < word_chars) AS kept
FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op6_quality": OP6_SQL}
