"""File tables: any relation with a path and a content column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions import content as C
from codesieve.functions import paths, text


def source_files(table: DataFrame, path: str | Column = "path", content: str | Column = "content",
                 encoding: str | None = None) -> DataFrame:
    """``(path, size, text)`` from a table; binary content is decoded, text is taken as it is."""
    path = F.col(path) if isinstance(path, str) else path
    content = F.col(content) if isinstance(content, str) else content
    named = table.select(path.alias("path"), content.alias("content"))
    size = F.octet_length("content").cast("long").alias("size")
    if named.schema["content"].dataType.simpleString() == "binary":
        return named.select("path", size, C.decode_text(F.col("content"), encoding).alias("text"))
    return named.select("path", size, F.col("content").alias("text"))


def file_profile(files: DataFrame) -> DataFrame:
    """Profile of raw files ``(path, content[, read_error])``: type, language, lines, hash."""
    raw, path = F.col("content"), F.col("path")
    size = F.coalesce(F.length(raw), F.lit(0)).cast("long")
    error = F.col("read_error") if "read_error" in files.columns else F.lit(None).cast("string")
    base = files.select("path", "content", error.alias("error"), size.alias("size"),
                        F.coalesce(C.is_text(path, raw, size), F.lit(False)).alias("is_text"))
    lang = F.when(F.col("is_text"), paths.file_language(path))

    def if_text(value: Column, default: Column) -> Column:
        return F.when(F.col("is_text") & F.col("error").isNull(), value).otherwise(default)

    null = F.lit(None).cast("string")
    return base.select(
        "path", paths.base_name(path).alias("name"), paths.extension(path).alias("extension"),
        lang.alias("language"), "size",
        if_text(text.code_lines(C.decode_text(raw), paths.file_language(path)), F.lit(0)).alias("lines"),
        "is_text", if_text(C.detect_encoding(raw), null).alias("encoding"),
        if_text(text.content_hash(raw), null).alias("hash"),
        paths.media_type(path).alias("mime_type"), "error")


def safe_files(files: DataFrame, max_size: int | None = None) -> DataFrame:
    """Text files, not above ``max_size`` if one is given."""
    size = F.length("content").cast("long")
    return files.filter(C.is_safe_to_read(F.col("path"), F.col("content"), size, max_size))
