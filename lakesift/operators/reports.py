"""SARIF documents of findings: ordered, nested, and bounded in size by parts.

A bundle's findings are dealt into parts by a hash of their file, so many that a part holds about `most` of them; each
part is one document with its own rules and results, in the order of file, line, severity and rule. Whatever a
bundle's size, no more than a part is gathered.

Defined results: a bundle without findings has no document; equal findings are results of their own; an empty table
gives no document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.functions.dialect import Dialect, Duck
from lakesift.operators import rules

VERSION, SCHEMA, DRIVER = "2.1.0", "https://json.schemastore.org/sarif-2.1.0.json", "lakesift"
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
MOST = 5000


def sarif(findings: DataFrame, most: int = MOST, reject: tuple[str, ...] = rules.REJECTED) -> DataFrame:
    """(bundle, part, document) of (bundle, path, line, rule_id, severity) rows."""
    parts = findings.groupBy("bundle").agg(F.ceil(F.count("*") / most).alias("parts"), F.max(F.col("severity").isin(*reject)).alias("bad"))
    at = F.conv(F.substring(F.sha2(F.coalesce("path", F.lit("")), 256), 1, 7), 16, 10).cast("long")
    dealt = findings.join(parts.withColumnRenamed("bundle", "of"), F.col("bundle").eqNullSafe(F.col("of"))).withColumn("part", at % F.col("parts"))
    levels = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    text = F.lower(F.replace(F.col("rule_id"), F.lit("_"), F.lit(" ")))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), F.coalesce(levels[F.col("severity")], F.lit("warning")).alias("level"), F.struct(text.alias("text")).alias("message"), F.array(place).alias("locations"))
    row = F.struct("path", "line", "severity", "rule_id", result.alias("result"))
    rule = F.struct(F.col("rule_id").alias("id"), F.struct(text.alias("text")).alias("shortDescription"))
    by = dealt.groupBy("bundle", "part").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.array_sort(F.collect_set(rule)).alias("rules"), F.max("bad").alias("bad"))
    run = F.struct(
        F.struct(F.struct(F.lit(DRIVER).alias("name"), F.col("rules").alias("rules")).alias("driver")).alias("tool"), F.array(F.struct((~F.col("bad")).alias("executionSuccessful"))).alias("invocations"),
        F.transform("rows", lambda r: r["result"]).alias("results"), F.struct(F.when(F.col("bad"), F.lit("REJECTED")).otherwise("PASS").alias("decision"), F.col("bundle").alias("sourceInput")).alias("properties"),
    )
    document = F.to_json(F.struct(F.lit(VERSION).alias("version"), F.lit(SCHEMA).alias("$schema"), F.array(run).alias("runs")))
    return by.select("bundle", "part", document.alias("document"))


QUERY_MOST = 8


def q_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sarif(spark.sql(f"WITH {rules.findings(Dialect(sf_dir))} SELECT * FROM findings"), QUERY_MOST)


_LEVEL = "CASE severity " + " ".join(f"WHEN '{s}' THEN '{x}'" for s, x in LEVELS.items()) + " ELSE 'warning' END"
ORACLE_SQL = {
    "sarif_documents": f"""WITH {rules.findings(Duck())},
parts AS (SELECT bundle, ceil(count(*) / {QUERY_MOST}.0)::BIGINT AS parts, bool_or(severity IN ('critical', 'high')) AS bad FROM findings GROUP BY bundle),
dealt AS (SELECT f.*, bad, ('0x' || sha256(path)[1:7])::BIGINT % parts AS part, lower(replace(rule_id, '_', ' ')) AS text FROM findings f JOIN parts p ON f.bundle = p.bundle),
shown AS (SELECT bundle, part, string_agg('{{"id":"' || rule_id || '","shortDescription":{{"text":"' || text || '"}}}}', ',' ORDER BY rule_id) AS rules FROM (SELECT DISTINCT bundle, part, rule_id, text FROM dealt) GROUP BY bundle, part),
listed AS (
  SELECT bundle, part, any_value(bad) AS bad, string_agg('{{"ruleId":"' || rule_id || '","level":"' || {_LEVEL} || '","message":{{"text":"' || text || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":'
    || to_json(path)::VARCHAR || '}},"region":{{"startLine":' || line || '}}}}}}]}}', ',' ORDER BY path, line, severity, rule_id) AS results FROM dealt GROUP BY bundle, part)
SELECT l.bundle, l.part, '{{"version":"{VERSION}","$schema":"{SCHEMA}","runs":[{{"tool":{{"driver":{{"name":"{DRIVER}","rules":[' || rules || ']}}}},"invocations":[{{"executionSuccessful":' || (NOT bad)::VARCHAR
  || '}}],"results":[' || results || '],"properties":{{"decision":"' || CASE WHEN bad THEN 'REJECTED' ELSE 'PASS' END || '","sourceInput":' || to_json(l.bundle)::VARCHAR || '}}}}]}}' AS document
FROM listed l JOIN shown n ON l.bundle = n.bundle AND l.part = n.part""",
}
QUERIES = {"sarif_documents": q_sarif}
