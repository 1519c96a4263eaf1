"""Written intermediate tables in the shared folder, so that lost executors repeat little."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
    folder = "file://" + tempfile.mkdtemp(prefix="codesieve-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def slices(batches, rows: int = 512, most_bytes: int = 4 << 20):
    """Arrow batches cut to few rows and bytes each: what Python holds of long texts at a time stays small. A longer row
    is a slice of its own. Memory that a batch took goes back to the system before the next one comes."""
    import pyarrow as pa

    for batch in batches:
        low = 0
        while low < batch.num_rows:
            high = min(batch.num_rows, low + rows)
            while high > low + 1 and _bytes_of(batch, low, high) > most_bytes:
                high = low + (high - low) // 2
            yield batch.slice(low, high - low)
            low = high
        del batch
        pa.default_memory_pool().release_unused()


def _bytes_of(batch, low: int, high: int) -> int:
    return sum(c.slice(low, high - low).nbytes for c in batch.columns)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table once and read it back: cuts the lineage, and later plans read only their columns."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
