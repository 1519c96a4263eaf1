"""Roll-ups of file results and findings.

Per-file figures come from the findings array of the row and need no shuffle.  Global figures are
grouped by severity, category or weakness: few keys, aggregated on the map side, so a key that
holds a third of all rows costs one partial sum per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.catalog import fixed_values as V
from codesieve.catalog import tables
from codesieve.functions.text import category_code, category_title
from codesieve.operators.enrich import with_snippets

SEVERITY_NAMES = [s[0] for s in V.SEVERITIES]


def _of_severity(name: str) -> Column:
    return F.size(F.filter("findings", lambda f: F.lower(f["severity"]) == name))


def _category(column: str = "owasp_category") -> Column:
    return category_code(F.coalesce(F.col(column), F.lit("GEN")))


# ------------------------------------------------------------------ per file
def severity_by_file(file_results: DataFrame) -> DataFrame:
    """Counts of the four severities for each file; other severities are in none of them."""
    return file_results.select("filename", *[_of_severity(s).alias(s) for s in SEVERITY_NAMES])


def file_report(file_results: DataFrame) -> DataFrame:
    """File results with their finding count, nested findings with their snippets included."""
    return file_results.withColumn("findings", F.when(F.size("findings") > 0, with_snippets(F.col("findings"), F.col("text")))
                                   .otherwise(with_snippets(F.col("findings"), F.lit("")))) \
        .withColumn("vulnerability_count", F.size("findings")).drop("text")


def files_with_findings(file_results: DataFrame) -> DataFrame:
    return file_results.filter(F.size("findings") > 0)


def clean_files(file_results: DataFrame) -> DataFrame:
    return file_results.filter(F.size("findings") == 0)


def files_in(files: DataFrame, findings: DataFrame, key: str = "filename", present: bool = True) -> DataFrame:
    """Files with (or without) a finding when both are separate tables.

    Findings are reduced to their distinct keys first, so a file with very many findings joins once.
    """
    keys = findings.select(key).distinct()
    return files.join(keys, key, "left_semi" if present else "left_anti")


# ------------------------------------------------------------------ global
def severity_totals(file_results: DataFrame) -> DataFrame:
    """One row: totals by severity, files with findings, files."""
    return file_results.agg(
        F.coalesce(F.sum(F.size("findings").cast("long")), F.lit(0)).alias("total_vulnerabilities"),
        *[F.coalesce(F.sum(_of_severity(s).cast("long")), F.lit(0)).alias(s) for s in SEVERITY_NAMES],
        F.count_if(F.size("findings") > 0).alias("files_with_issues"),
        F.count("*").alias("total_files"))


def category_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy(_category().alias("category")).agg(F.count("*").alias("finding_count"))


def breakdown(findings: DataFrame) -> DataFrame:
    """Counts by severity, by category and in total, from one pass over the findings."""
    keyed = findings.select(F.lower("severity").alias("severity"), _category().alias("category"))
    sets = keyed.groupingSets([["severity"], ["category"], []], "severity", "category") \
        .agg(F.count("*").alias("finding_count"), F.grouping_id().alias("_set"))
    return sets.select(
        F.when(F.col("_set") == 1, "severity").when(F.col("_set") == 2, "category")
        .otherwise("total").alias("dimension"),
        F.coalesce("severity", "category", F.lit("all")).alias("value"), "finding_count")


def cwe_counts(findings: DataFrame) -> DataFrame:
    """Findings per weakness; an id listed twice by a pattern counts twice.

    Counted per distinct id list first, so the explode runs over a handful of rows.
    """
    per_list = findings.groupBy("cwe_ids").agg(F.count("*").alias("n"))
    return per_list.select(F.explode("cwe_ids").alias("cwe_id"), "n") \
        .groupBy("cwe_id").agg(F.sum("n").alias("finding_count"))


def top_cwes(findings: DataFrame, k: int = 5) -> DataFrame:
    return cwe_counts(findings).orderBy(F.desc("finding_count"), "cwe_id").limit(k)


def category_groups(findings: DataFrame) -> DataFrame:
    """All eleven categories with their finding count; unknown codes count as general."""
    dim = tables.categories(findings.sparkSession).select(
        F.col("category_id").alias("category"), category_title(F.col("category_id"), F.col("name")).alias("title"))
    codes = [c for c, _ in V.CATEGORIES]
    counts = findings.groupBy(F.when(_category().isin(*codes), _category()).otherwise("GEN").alias("category")) \
        .agg(F.count("*").alias("n"))
    return dim.join(counts, "category", "left").select(
        "category", "title", F.coalesce("n", F.lit(0)).alias("finding_count"))


def findings_by_category(findings: DataFrame) -> DataFrame:
    """Findings with the title of their report group, as a flat table.

    A category may hold most findings of a corpus, so groups are never collected into one value;
    write the table partitioned by ``category`` to read one group.
    """
    codes = [c for c, _ in V.CATEGORIES]
    titles = F.create_map(*[F.lit(x) for c, n in V.CATEGORIES for x in (c, n if c == "GEN" else f"{c}: {n}")])
    category = F.when(_category().isin(*codes), _category()).otherwise("GEN")
    return findings.withColumn("category", category).withColumn("category_title", titles[F.col("category")])


def gate(file_results: DataFrame) -> DataFrame:
    """One row: has the scan failed, that is, did any finding remain?"""
    return file_results.agg((F.coalesce(F.max(F.size("findings")), F.lit(0)) > 0).alias("failed"),
                            F.coalesce(F.sum(F.size("findings").cast("long")), F.lit(0)).alias("findings"))


def capability_statistics(rules: DataFrame, languages: DataFrame, options) -> DataFrame:
    """One row: analyzers, languages, categories, extensions and the options in force."""
    enabled = options.enabled_languages
    values = languages.select(F.lit("language").alias("kind"), F.col("language").alias("value")) \
        .unionByName(languages.select(F.lit("extension").alias("kind"), F.explode("extensions").alias("value"))) \
        .unionByName(rules.select(F.lit("category").alias("kind"), F.col("owasp_category").alias("value")))

    def of(kind: str, extra: Column = F.lit(True)) -> Column:
        return F.sort_array(F.collect_set(F.when((F.col("kind") == kind) & extra, F.col("value"))))

    is_enabled = F.col("value").isin(*enabled)
    return values.agg(
        of("language").alias("supported_languages"), of("language", is_enabled).alias("enabled_languages"),
        of("category").alias("supported_owasp_categories"), of("extension").alias("supported_extensions")) \
        .withColumn("total_analyzers", F.size("supported_languages")) \
        .withColumn("enabled_analyzers", F.size("enabled_languages")) \
        .withColumn("min_severity", F.lit(options.min_severity)) \
        .withColumn("include_tests", F.lit(options.include_tests))


def analyzer_info(rules: DataFrame, languages: DataFrame, options, language: str) -> DataFrame:
    """``capability_statistics`` of one language; no row for a language without an analyzer."""
    known = languages.filter(F.col("language") == language)
    return capability_statistics(rules, known, options).filter("total_analyzers > 0")


def catalogue_info(patterns: DataFrame) -> DataFrame:
    """One row about the catalogue: edition of the category list, categories, patterns."""
    codes = [c for c, _ in V.CATEGORIES]
    return patterns.agg(
        F.lit(V.CATEGORY_EDITION).alias("edition"), F.lit(len(codes) - 1).alias("total_categories"),
        F.count("*").alias("available_patterns"), F.lit(",".join(codes)).alias("categories"))
