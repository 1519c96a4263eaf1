"""Catalogue tables: rules, patterns, categories, severities, languages.

All are fixed-size lookup tables (at most a few dozen rows whatever the corpus), built as local
relations, so their size is known to the optimizer and every join with them is a broadcast join.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codesieve.catalog import fixed_values as V
from codesieve.catalog import prose

STRINGS = pa.list_(pa.string())

RULE_FIELDS = [
    ("rule_id", pa.string()), ("title", pa.string()), ("description", pa.string()),
    ("severity", pa.string()), ("confidence", pa.string()), ("owasp_category", pa.string()),
    ("enabled", pa.bool_()), ("rule_type", pa.string()), ("regexes", STRINGS),
]
PATTERN_FIELDS = [
    ("pattern_id", pa.string()), ("name", pa.string()), ("description", pa.string()),
    ("severity", pa.string()), ("confidence", pa.string()), ("owasp_category", pa.string()),
    ("cwe_ids", pa.list_(pa.int32())), ("regex_patterns", STRINGS), ("examples", STRINGS),
    ("primary_remediation", pa.string()), ("alternative_remediation", pa.string()),
    ("references", STRINGS), ("languages", STRINGS), ("tags", STRINGS),
]


def local_table(spark: SparkSession, fields: list, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=pa.schema(fields)))


def rule_rows() -> list[dict]:
    return [{"rule_id": rule_id, "title": title, "description": prose.RULE_NOTES[rule_id],
             "severity": severity, "confidence": confidence, "owasp_category": category,
             "enabled": True, "rule_type": "regex" if rule_id in V.RULE_REGEXES else "ast",
             "regexes": V.RULE_REGEXES.get(rule_id, [])}
            for rule_id, title, severity, confidence, category, _ in V.RULES]


def references(cwe_ids: list[int]) -> list[str]:
    """The public page of each weakness of a pattern."""
    return [f"https://cwe.mitre.org/data/definitions/{cwe}.html" for cwe in cwe_ids]


def pattern_rows() -> list[dict]:
    rows = []
    for pattern_id, (name, severity, confidence, cwes, languages, tags) in V.PATTERNS.items():
        description, primary, alternative, examples = prose.PATTERN_NOTES[pattern_id]
        rows.append({
            "pattern_id": pattern_id, "name": name, "description": description,
            "severity": severity, "confidence": confidence, "owasp_category": pattern_id[:3],
            "cwe_ids": cwes, "regex_patterns": V.PATTERN_REGEXES[pattern_id], "examples": examples,
            "primary_remediation": primary, "alternative_remediation": alternative,
            "references": references(cwes), "languages": languages, "tags": tags})
    return rows


def rules(spark: SparkSession) -> DataFrame:
    return local_table(spark, RULE_FIELDS, rule_rows())


def patterns(spark: SparkSession) -> DataFrame:
    return local_table(spark, PATTERN_FIELDS, pattern_rows())


def rule_pattern_map(spark: SparkSession) -> DataFrame:
    return local_table(spark, [("rule_id", pa.string()), ("pattern_id", pa.string())],
                       [{"rule_id": r[0], "pattern_id": r[-1]} for r in V.RULES])


def categories(spark: SparkSession) -> DataFrame:
    fields = [("category_id", pa.string()), ("name", pa.string()), ("description", pa.string()),
              ("risk_factors", STRINGS), ("impact", pa.string())]
    return local_table(spark, fields, [
        dict(zip([f[0] for f in fields], (category, name, *prose.CATEGORY_NOTES[category])))
        for category, name in V.CATEGORIES])


def severities(spark: SparkSession) -> DataFrame:
    fields = [("severity", pa.string()), ("score", pa.int32()), ("description", pa.string()),
              ("response_time", pa.string()), ("business_impact", pa.string())]
    return local_table(spark, fields, [
        {"severity": s, "score": score, "description": prose.SEVERITY_NOTES[s],
         "response_time": prose.SEVERITY_TIMES[s][0], "business_impact": prose.SEVERITY_TIMES[s][1]}
        for s, score in V.SEVERITIES])


def languages(spark: SparkSession, analyzers: dict[str, list[str]] | None = None) -> DataFrame:
    """Languages with an analyzer and the extensions it accepts."""
    analyzers = analyzers or V.ANALYZER_EXTENSIONS
    return local_table(spark, [("language", pa.string()), ("extensions", STRINGS)],
                       [{"language": k, "extensions": v} for k, v in analyzers.items()])


def extension_map(spark: SparkSession) -> DataFrame:
    return local_table(spark, [("extension", pa.string()), ("language", pa.string())],
                       [{"extension": k, "language": v} for k, v in V.EXTENSION_LANGUAGES.items()])


def risky_imports(spark: SparkSession) -> DataFrame:
    return local_table(spark, [("module", pa.string()), ("reason", pa.string())],
                       [{"module": m, "reason": prose.IMPORT_REASONS[m]} for m in V.RISKY_IMPORTS])


def rule_listing(spark: SparkSession) -> DataFrame:
    """The ten categories a scan can report, with a one-line description."""
    return categories(spark).filter("category_id <> 'GEN'").selectExpr(
        "category_id AS code", "name AS title", "description")
