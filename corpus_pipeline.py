"""A training-corpus pipeline over ``documents``: each stage is one operator of the subpackage ``llm``.

A stage takes (spark, docs, sf_dir) and returns a table, which the next one gets written and reread. All but the last
return the columns of documents; the last returns the pieces of the packed sequences. SQL can express neither the
language model nor patience diff nor the tokenizer, so ``ORACLE_SQL`` is None and ``tests/llm`` compares each stage with
plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm import decontamination, line_dedup, packing, simhash
from codesieve.llm.lineage import written
from codesieve.llm.queries import BYTE_BPE, documents_by_language, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay, as they are; null and blank texts go. Repeated rows stay."""
    return documents_by_language(docs).where(F.col("language").isNotNull()).select("row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go; so do documents of which nothing is left. Null texts stay null,
    n_chars (where there is such a column) follows the text, and any other column stays as it is."""
    found = line_dedup.delete_duplicate_lines(docs.select(F.struct("*").alias("given"), "doc_id", "text"))
    left = found.where((F.col("removed_lines") == 0) | (F.col("text") != ""))
    given = F.col("given").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        given = F.when(F.col("removed_lines") > 0, given.withField("n_chars", F.length("text").cast("long"))).otherwise(given)
    return left.select(given.alias("given")).select("given.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id (null first, ties by text)."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and blank texts hold none."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of at most 1024 tokens; a null text is one piece with the end id alone."""
    name, spaces = BYTE_BPE
    return packing.pack(docs, tokenizer_path(name), spaces, end_id=2, size=1024, memo_bytes=64 << 20) \
        .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language id", language_id),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
