"""End-to-end scans: files in, findings, file results and reports out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.catalog import manage, tables
from codesieve.functions.content import decode_text
from codesieve.operators import enrich, filters, rollups
from codesieve.operators.scan import scan_files
from codesieve.options import ScanOptions
from codesieve.sources.sinks import materialize
from codesieve.sources.tables import source_files
from codesieve.sources.tree import list_tree, read_contents


@dataclass
class Scan:
    """Result of a scan: file results with nested findings, and what derives from them."""

    file_results: DataFrame
    options: ScanOptions

    @property
    def findings(self) -> DataFrame:
        return enrich.findings(self.file_results)

    def materialized(self, path: str | None = None) -> Scan:
        """The same scan over a written table, for several reports from one pass over the corpus."""
        return Scan(materialize(self.file_results, path), self.options)

    def report(self) -> dict[str, DataFrame]:
        """Tables of the scan report."""
        findings = self.findings
        figures = enrich.enrich(enrich.flat_positions(self.file_results))  # without snippets
        return {
            "summary": rollups.severity_totals(self.file_results),
            "breakdown": rollups.breakdown(figures),
            "categories": rollups.category_groups(figures),
            "top_cwes": rollups.top_cwes(figures),
            "findings": rollups.findings_by_category(findings),
            "files": rollups.file_report(self.file_results),
        }


def scan_table(table: DataFrame, options: ScanOptions | None = None, path: str = "path",
               content: str = "content", language: str | None = None, rules: DataFrame | None = None,
               custom_rules=(), analyzers: dict[str, list[str]] | None = None, python_rules=()) -> Scan:
    """Scan a table of path and content (text or binary): the way to scan large corpora.

    Partitioning follows the table: a scan adds no shuffle.
    """
    options = options or ScanOptions.of()
    files = filters.analyzable_files(source_files(table, path, content), options, analyzers, language)
    return Scan(scan_files(files, options.min_severity, rules, custom_rules, python_rules=python_rules), options)


def scan_tree(spark: SparkSession, root: str, options: ScanOptions | None = None, language: str | None = None,
              rules: DataFrame | None = None, custom_rules=(), partitions: int | None = None,
              analyzers: dict[str, list[str]] | None = None, python_rules=()) -> Scan:
    """Scan a directory tree; excluded files are never read."""
    options = options or ScanOptions.of()
    listed = filters.analyzable_files(list_tree(spark, root), options, analyzers, language)
    read = read_contents(listed, partitions).select(
        "path", "language", "size", decode_text(F.col("content")).alias("text"), F.coalesce("error", "read_error").alias("read_error"))
    return Scan(scan_files(read, options.min_severity, rules, custom_rules, python_rules=python_rules), options)


def scan_run(scan: Scan, target: str) -> DataFrame:
    """One row describing the run, with its totals."""
    import json

    return rollups.severity_totals(scan.file_results).select(
        F.lit(target).alias("target_path"), F.current_timestamp().alias("start_time"),
        F.lit(json.dumps(scan.options.values, sort_keys=True)).alias("analyzer_config"), "*")


def self_check(spark: SparkSession, options: ScanOptions | None = None, rules: DataFrame | None = None,
               analyzers: dict[str, list[str]] | None = None) -> DataFrame:
    """One row: options valid, rules and analyzers valid, some language enabled."""
    options = options or ScanOptions()
    languages = tables.languages(spark, analyzers)
    bad_rules = manage.validate_rules(rules if rules is not None else tables.rules(spark)) \
        .select((~F.col("is_valid")).alias("bad"), F.lit(False).alias("on"))
    known = languages.select(
        (F.col("language").isNull() | (F.coalesce(F.size("extensions"), F.lit(0)) <= 0)).alias("bad"),
        F.coalesce(F.col("language").isin(*options.enabled_languages), F.lit(False)).alias("on"))
    return bad_rules.unionByName(known).agg(
        F.lit(not options.problems()).alias("config_valid"),
        (F.count_if("bad") == 0).alias("analyzers_valid"), (F.count_if("on") > 0).alias("languages_enabled"))
