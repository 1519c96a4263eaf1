"""Filters on file tables; all are cheap, path or size only, and belong before any read of content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.catalog import fixed_values as V
from codesieve.functions import paths
from codesieve.functions.text import severity_score
from codesieve.options import ScanOptions


def exclude_paths(files: DataFrame, globs: list[str], path: str = "path") -> DataFrame:
    """Drop files whose path or name matches any glob."""
    return files.filter(~paths.matches_globs(F.col(path), globs))


def prune_directories(files: DataFrame, globs: list[str], path: str = "path") -> DataFrame:
    """Drop files below any excluded directory."""
    return files.filter(~paths.in_pruned_directory(F.col(path), globs))


def limit_size(files: DataFrame, max_bytes: float, size: str = "size") -> DataFrame:
    return files.filter(F.col(size) <= max_bytes)


def with_analyzer(files: DataFrame, analyzers: dict[str, list[str]] | None = None,
                  path: str = "path") -> DataFrame:
    """Add ``language`` and keep files some analyzer accepts."""
    return files.withColumn("language", paths.analyzer_language(F.col(path), analyzers)) \
        .filter("language is not null")


def only_language(files: DataFrame, language: str, analyzers: dict[str, list[str]] | None = None) -> DataFrame:
    known = analyzers or V.ANALYZER_EXTENSIONS
    if language not in known:
        raise ValueError(f"no analyzer for language {language!r}; known: {sorted(known)}")
    return files.filter(F.col("language") == language)


def analyzable_files(files: DataFrame, options: ScanOptions, analyzers: dict[str, list[str]] | None = None,
                     language: str | None = None) -> DataFrame:
    """All file filters of a scan, cheapest first."""
    globs = options.exclusion_globs
    if options.max_file_bytes is not None:
        files = limit_size(files, options.max_file_bytes)
    kept = with_analyzer(files, analyzers).filter(~F.col("language").isin(*options.disabled_languages))
    if language is not None:
        kept = only_language(kept, language, analyzers)
    return prune_directories(exclude_paths(kept, globs), globs)


def reaches_severity(severity: Column, min_severity: str) -> Column:
    return severity_score(severity) >= severity_score(F.lit(min_severity))


def at_least(findings: DataFrame, min_severity: str, severity: str = "severity") -> DataFrame:
    """Keep findings at or above a severity; unknown severities rank lowest."""
    return findings.filter(reaches_severity(F.col(severity), min_severity))


def safe_paths(files: DataFrame, base: str, path: str = "path", working_directory: str = "/") -> DataFrame:
    return files.filter(paths.is_safe_path(F.col(path), base, working_directory))
