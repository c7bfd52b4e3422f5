"""The operators over the driver's tables: one query opN_<name> each, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballot.llm.common import spread, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ballot.llm.line_dedup import line_dedup

    docs = documents(spark, sf_dir)
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ballot.llm.simhash import simhash_classes

    return simhash_classes(documents(spark, sf_dir))


def op3_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ballot.llm.quality_pu import quality_scores

    docs = documents(spark, sf_dir)
    return quality_scores(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ballot.llm.secrets import secret_spans

    found = secret_spans(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_secrets")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ballot.llm.toxicity import toxicity_scores

    docs = documents(spark, sf_dir)
    return toxicity_scores(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ballot.llm.pii import pii_spans

    found = pii_spans(documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_pii")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ballot.llm.quality_rules import FIXED, quality_rules

    docs = documents(spark, sf_dir)
    return quality_rules(docs, table(spark, sf_dir, "labels")).select("doc_id", *FIXED, "base_failed", "kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ballot.llm.decontam import contamination

    return contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ballot.llm.html_extract import main_text

    return main_text(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ballot.llm.packing import pack

    return pack(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


OP1_SQL = """
WITH lines AS (
  SELECT row, doc_id, unnest(range(1, len(parts) + 1)) AS place, unnest(parts) AS line
  FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT row) >= 5
), marked AS (
  SELECT keyed.*, keep IS NOT NULL AND keep IS DISTINCT FROM doc_id AS gone FROM keyed LEFT JOIN repeated USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row, doc_id
"""

ORACLE_SQL = {"op1_line_dedup": OP1_SQL}
