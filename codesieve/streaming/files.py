"""The same scan over a growing file table.

Scanning is a per-file projection without state, so a stream of files runs through the batch plan
unchanged; each file is scanned once when it arrives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codesieve.options import ScanOptions
from codesieve.plans.scan import Scan, scan_table


def scan_arriving_files(spark: SparkSession, folder: str, schema: str, options: ScanOptions | None = None,
                        file_format: str = "parquet", max_files_per_trigger: int = 1000, **columns) -> Scan:
    """Scan over a folder of file tables that is still being written."""
    arriving: DataFrame = spark.readStream.schema(schema).format(file_format) \
        .option("maxFilesPerTrigger", max_files_per_trigger).load(folder)
    return scan_table(arriving, options, **columns)
