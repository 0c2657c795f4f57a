"""Findings derived from the driver's tables, by SQL that Spark and DuckDB both run (``{k}`` is the JSON access)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDINGS = """
SELECT event_id AS arrival, CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'base' ELSE 'current' END AS scan,
  CASE event_id % 3 WHEN 0 THEN 'semgrep' WHEN 1 THEN 'trivy' ELSE 'codeql' END AS tool,
  concat('rule.', event_type, '.', CAST(event_id % 7 AS varchar(10))) AS rule_id,
  CASE event_type WHEN 'purchase' THEN 'sca' WHEN 'signup' THEN 'secret' ELSE 'sast' END AS domain,
  concat('Finding ', CAST(event_id % 7 AS varchar(10))) AS title, concat('seen at ', CAST({k} AS varchar(10))) AS description,
  CASE WHEN value >= 93 THEN 'critical' WHEN value >= 45 THEN 'high' WHEN value >= 18 THEN 'medium' WHEN value >= 5 THEN 'low' ELSE 'info' END AS severity,
  CASE CAST(floor(event_id / 12) AS bigint) % 5 WHEN 0 THEN 'CWE-89' WHEN 1 THEN 'CWE-79' WHEN 2 THEN 'CWE-74' WHEN 3 THEN 'CWE-704' ELSE 'CWE-22' END AS cwe,
  concat(CASE user_id % 4 WHEN 0 THEN 'src' WHEN 1 THEN 'tests' WHEN 2 THEN 'docs' ELSE 'scripts' END, '/u', CAST(user_id AS varchar(20)), '_', CAST(event_id % 4 AS varchar(10)), '.py') AS file_path,
  {k} + 1 AS line_start, {k} + 1 + CAST(event_id % 3 AS int) AS line_end,
  CASE event_id % 11 WHEN 0 THEN 'false_positive' WHEN 1 THEN 'true_positive' WHEN 2 THEN 'true_positive' WHEN 3 THEN NULL ELSE 'needs_human' END AS verdict,
  CASE WHEN event_id % 11 = 3 THEN NULL ELSE CAST(event_id % 101 AS double) / 100 END AS confidence,
  CASE WHEN event_type = 'purchase' THEN concat('pkg', CAST(event_id % 50 AS varchar(10))) END AS package_name,
  CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN '2.0' END AS fixed_version,
  CASE WHEN event_type = 'purchase' AND event_id % 5 <> 4 THEN event_id % 5 < 2 END AS is_direct,
  CASE WHEN event_type = 'purchase' AND event_id % 3 <> 0 THEN concat('CVE-2024-', CAST(event_id % 40 AS varchar(10))) END AS cve_id,
  CASE WHEN event_type = 'signup' THEN 'token' END AS secret_kind, CASE WHEN event_type = 'signup' THEN CAST(1000 + event_id % 9000 AS varchar(10)) END AS last_four,
  concat('x = call(', CAST(event_id % 97 AS varchar(10)), ', "u', CAST(user_id % 13 AS varchar(10)), '")  # note') AS code
FROM events"""

SPARK_K = "CAST(get_json_object(props, '$.k') AS int)"
DUCK_K = "CAST(json_extract_string(props, '$.k') AS int)"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finding rows (flat, with structs for package and secret)."""
    flat = spark.sql(FINDINGS.format(k=SPARK_K).replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    package = F.when(F.col("package_name").isNotNull(), F.struct(F.col("package_name").alias("name"), F.lit("1.0").alias("installed_version"), "fixed_version", "is_direct"))
    secret = F.when(F.col("secret_kind").isNotNull(), F.struct(F.col("secret_kind").alias("kind"), "last_four"))
    return flat.withColumns({"cwe_ids": F.array("cwe"), "package": package, "secret": secret, "tool_version": F.lit("1")})
