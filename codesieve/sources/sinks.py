"""Sinks: findings as partitioned tables, reports as a set of tables, shared intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from codesieve.operators.enrich import RECORD_COLUMNS


def records(findings: DataFrame) -> DataFrame:
    """The public finding record."""
    return findings.select(*RECORD_COLUMNS)


def write_findings(findings: DataFrame, path: str, file_format: str = "parquet", mode: str = "overwrite") -> None:
    """Findings partitioned by severity, so a severity threshold reads only its directories."""
    findings.write.mode(mode).partitionBy("severity").format(file_format).save(path)


def write_report(report: dict[str, DataFrame], path: str, file_format: str = "json", mode: str = "overwrite") -> None:
    """Each table of a report below one directory."""
    for name, table in report.items():
        table.write.mode(mode).format(file_format).save(f"{path}/{name}")


def shared_folder(spark) -> str:
    """Folder for intermediate tables that all executors see: the cluster's checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("give a path, or set spark.checkpoint.dir to a folder shared by all executors")
    return folder


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a table once and read it back.

    A scan feeds several reports; from a written table each reads only its columns, and a lost
    executor repeats no scan.
    """
    path = path or f"{shared_folder(df.sparkSession).rstrip('/')}/codesieve-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
