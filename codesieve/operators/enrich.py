"""Findings: flatten file results and join them with the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.catalog import tables
from codesieve.functions.expressions import let
from codesieve.functions.text import highlight, snippet, split_lines

FINDING_COLUMNS = [
    "filename", "rule_id", "title", "description", "detail", "severity", "confidence", "owasp_category",
    "owasp_category_name", "pattern_id", "line_number", "column_number", "code_snippet",
    "highlighted_code", "cwe_ids", "primary_remediation", "alternative_remediation", "references", "tags"]

# Fields of the public finding record (no rule id and no detail).
RECORD_COLUMNS = [
    "title", "description", "severity", "owasp_category", "owasp_category_name", "line_number",
    "column_number", "code_snippet", "highlighted_code", "filename", "confidence", "cwe_ids",
    "primary_remediation", "alternative_remediation", "references", "tags", "pattern_id"]


# Findings whose snippets are cut together; bounds what one row holds, and changes no result.
SNIPPET_BLOCK = 16


def with_snippets(findings: Column, text: Column, context: int = 2, escape: bool = False) -> Column:
    """Findings of one file with ``code_snippet`` and ``highlighted_code`` cut from its text."""
    def one(f: Column, lines: Column) -> Column:
        return let(snippet(lines, f["line_number"], context), lambda code: f.withField("code_snippet", code)
                   .withField("highlighted_code", highlight(code, f["matched_text"], escape)))

    return let(split_lines(text), lambda lines: F.transform(findings, lambda f: one(f, lines)))


def flatten_findings(file_results: DataFrame, context: int = 2, escape: bool = False) -> DataFrame:
    """One row per finding, with its snippet.

    File results hold positions and the text; snippets are cut here, for a block of findings at a time, so
    neither very many findings nor very long lines make a large row.
    """
    blocks = F.transform(F.sequence(F.lit(1), F.size("findings"), F.lit(SNIPPET_BLOCK)),
                         lambda i: F.slice("findings", i, F.lit(SNIPPET_BLOCK)))
    blocks = F.when(F.size("findings") > 0, blocks)
    found = file_results.select("filename", "text", F.explode(blocks).alias("block"))
    cut = with_snippets(F.col("block"), F.col("text"), context, escape)
    return found.select("filename", F.explode(cut).alias("f")).select("filename", "f.*")


def flat_positions(file_results: DataFrame) -> DataFrame:
    """One row per finding without its snippet; all that figures need."""
    return file_results.select("filename", F.explode("findings").alias("f")).select("filename", "f.*")


def enrich(matches: DataFrame, patterns: DataFrame | None = None,
           rule_patterns: DataFrame | None = None) -> DataFrame:
    """Catalogue values for each match.

    Mapped rules take description, weaknesses and guidance from their pattern; a mapping to a
    missing pattern falls back to the category of the rule; unmapped rules fall in ``GEN``.
    The built-in catalogue tables have a fixed size; for tables of the caller Spark chooses the join.
    """
    spark = matches.sparkSession
    mapping = tables.rule_pattern_map(spark) if rule_patterns is None else rule_patterns
    catalogue = (tables.patterns(spark) if patterns is None else patterns).select(
        F.col("pattern_id").alias("_pattern"), F.col("owasp_category").alias("_pattern_category"),
        F.col("description").alias("_description"), "cwe_ids", "primary_remediation",
        "alternative_remediation", "references", "tags")
    names = tables.categories(spark).select(F.col("category_id").alias("_code"), F.col("name").alias("_name"))

    known = mapping.select("rule_id", F.col("pattern_id").alias("_mapped")) \
        .join(catalogue, F.col("_mapped") == F.col("_pattern"), "left")
    built_in = patterns is None and rule_patterns is None
    known = F.broadcast(known) if built_in else known
    joined = matches.join(known, "rule_id", "left") \
        .withColumn("owasp_category", F.when(F.col("_mapped").isNull(), "GEN").otherwise(F.col("owasp_category"))) \
        .withColumn("_code_used", F.coalesce("_pattern_category", "owasp_category")) \
        .join(F.broadcast(names), F.col("_code_used") == F.col("_code"), "left")
    return joined \
        .withColumn("owasp_category_name", F.concat_ws(": ", "_code", "_name")) \
        .withColumn("description", F.coalesce("_description", "detail")) \
        .withColumn("pattern_id", F.coalesce("_pattern", F.lit(""))) \
        .withColumn("primary_remediation", F.coalesce("primary_remediation", F.lit(""))) \
        .withColumn("alternative_remediation", F.coalesce("alternative_remediation", F.lit(""))) \
        .withColumn("cwe_ids", F.coalesce("cwe_ids", F.array().cast("array<int>"))) \
        .withColumn("references", F.coalesce("references", F.array().cast("array<string>"))) \
        .withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))) \
        .drop("_mapped", "_pattern", "_pattern_category", "_description", "_code_used", "_code", "_name")


def findings(file_results: DataFrame, patterns: DataFrame | None = None,
             rule_patterns: DataFrame | None = None) -> DataFrame:
    """Enriched findings of file results."""
    return enrich(flatten_findings(file_results), patterns, rule_patterns).select(*FINDING_COLUMNS)
