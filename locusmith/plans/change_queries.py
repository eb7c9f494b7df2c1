"""Queries of problems 3 (changes between snapshots) and 4 (references to records that do not exist)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locusmith.operators.orphans import corpus_orphans, orphans_per_period
from locusmith.operators.snapshots import changes_per_delivery, document_snapshot_changes
from locusmith.plans.store import table

SNAPSHOT_COLUMNS = ["snapshot_id", "id", "content_hash", "edition", "is_current", "delivered_at"]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_snapshot_changes(table(spark, sf_dir, "document_snapshots", SNAPSHOT_COLUMNS))


def p3_per_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes_per_delivery(p3_found(spark, sf_dir))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_orphans(
        table(spark, sf_dir, "gold_questions", ["id", "expected_units", "created_at"]),
        table(spark, sf_dir, "expectations", ["expectation_id", "locator", "source_id", "recorded_at"]),
        table(spark, sf_dir, "stored_units", ["locator", "ingested_at", "deleted_at"]),
        table(spark, sf_dir, "emitted_documents", ["source_id", "emitted_at", "withdrawn_at"]),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_table", "ref_id", "ref_value").distinct()


def p4_per_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans_per_period(_orphans(spark, sf_dir))


P3_SQL = """
WITH latest AS (
  SELECT snapshot_id, id, lower(content_hash) AS h, nullif(trim(edition), '') AS e, is_current AS c
  FROM document_snapshots WHERE snapshot_id IS NOT NULL AND id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_id, id
    ORDER BY delivered_at DESC NULLS LAST, lower(content_hash) DESC NULLS LAST, nullif(trim(edition), '') DESC NULLS LAST, is_current DESC NULLS LAST) = 1
), d AS (SELECT snapshot_id, lead(snapshot_id) OVER (ORDER BY snapshot_id) AS following FROM (SELECT DISTINCT snapshot_id FROM latest)),
old AS (SELECT d.following AS snapshot_id, l.id, l.h, l.e, l.c FROM latest l JOIN d ON l.snapshot_id = d.snapshot_id WHERE d.following IS NOT NULL),
new AS (SELECT l.* FROM latest l WHERE l.snapshot_id > (SELECT min(snapshot_id) FROM latest)),
found AS (
  SELECT coalesce(n.snapshot_id, o.snapshot_id) AS snapshot_id, coalesce(n.id, o.id) AS id,
    CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM new n FULL JOIN old o ON n.snapshot_id = o.snapshot_id AND n.id = o.id
  WHERE o.id IS NULL OR n.id IS NULL OR n.h IS DISTINCT FROM o.h OR n.e IS DISTINCT FROM o.e OR n.c IS DISTINCT FROM o.c
)"""

P4_SQL = """
WITH refs AS (
  SELECT 'gold_questions.expected_units' AS ref_table, id AS ref_id, unnest(expected_units) AS ref_value, created_at AS t FROM gold_questions
  UNION ALL SELECT 'expectations.locator', CAST(expectation_id AS VARCHAR), locator, recorded_at FROM expectations
  UNION ALL SELECT 'expectations.source_id', CAST(expectation_id AS VARCHAR), source_id, recorded_at FROM expectations
), parents AS (
  SELECT DISTINCT 'unit' AS kind, lower(trim(locator)) AS k, ingested_at AS a, deleted_at AS z FROM stored_units
  UNION ALL SELECT DISTINCT 'source', lower(trim(source_id)), emitted_at, withdrawn_at FROM emitted_documents
), found AS (
  SELECT DISTINCT ref_table, ref_id, ref_value, t FROM refs
  WHERE trim(ref_value) <> '' AND NOT EXISTS (
    SELECT 1 FROM parents p WHERE p.k = lower(trim(refs.ref_value)) AND p.a <= refs.t AND (p.z IS NULL OR p.z > refs.t)
      AND p.kind = CASE WHEN refs.ref_table = 'expectations.source_id' THEN 'source' ELSE 'unit' END)
)"""

QUERIES = {"p3_found": p3_found, "p3_per_delivery": p3_per_delivery, "p4_found": p4_found, "p4_per_period": p4_per_period}

ORACLE = {
    "p3_found": P3_SQL + " SELECT * FROM found",
    "p3_per_delivery": P3_SQL + " SELECT snapshot_id, change, count(*) AS records FROM found GROUP BY ALL",
    "p4_found": P4_SQL + " SELECT DISTINCT ref_table, ref_id, ref_value FROM found",
    "p4_per_period": P4_SQL
    + " SELECT ref_table, strftime(timezone('UTC', t), '%Y-%m') AS period, count(*) AS orphans, count(DISTINCT ref_value) AS missing_values FROM found GROUP BY ALL",
}
