"""Functions on raw file bytes: decoding, encoding and text detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesieve.catalog import fixed_values as V
from codesieve.functions.paths import extension


def _valid_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def _utf16_mark(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def decode_text(content: Column, encoding: str | None = None, max_size: int | None = None) -> Column:
    """Bytes to text: strict UTF-8, else UTF-16 by its mark, else Latin-1; null when too big.

    Line ends become newlines on the UTF-8 branch only.  An explicit encoding replaces
    undecodable bytes; an unknown one falls back to the ladder.
    """
    latin = F.decode(content, "ISO-8859-1")
    ladder = F.when(_valid_utf8(content), unix_newlines(content.cast("string"))) \
        .when(_utf16_mark(content) & (F.length(content) % 2 == 0), F.decode(content, "UTF-16")) \
        .otherwise(latin)
    name = (encoding or "").lower().replace("_", "-")
    if name in ("utf-8", "utf8"):
        text = unix_newlines(F.make_valid_utf8(content.cast("string")))
    elif name in ("latin-1", "iso-8859-1", "latin1"):
        text = unix_newlines(latin)
    elif name in ("ascii", "us-ascii"):
        text = unix_newlines(F.regexp_replace(latin, r"[\x80-\xff]", "�"))
    else:
        text = ladder
    return F.when(F.length(content) <= max_size, text) if max_size else text


def detect_encoding(content: Column) -> Column:
    """Encoding of the whole content by its mark and validity, null when undecided."""
    latin = F.decode(content, "ISO-8859-1")
    return F.when(F.length(content) == 0, F.lit(None)) \
        .when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", "UTF-8-SIG") \
        .when(_utf16_mark(content), "UTF-16") \
        .when(~latin.rlike(r"[\x80-\xff]"), "ascii") \
        .when(_valid_utf8(content), "utf-8")


def looks_like_text(content: Column, size: Column, max_size: int | None = None) -> Column:
    """Content test: no NUL, and valid UTF-8 or mostly printable; not above ``max_size`` if one is given."""
    latin = F.decode(content, "ISO-8859-1")
    printable = F.length(F.regexp_replace(latin, r"[^\x20-\x7e\t\n\r]", ""))
    return F.when(size > max_size if max_size else F.lit(False), False) \
        .when(F.length(content) == 0, True) \
        .when(latin.contains("\u0000"), False) \
        .when(_valid_utf8(content), True) \
        .otherwise(printable / F.length(content) > V.MIN_PRINTABLE_RATIO)


def is_text(path: Column, content: Column, size: Column) -> Column:
    """Text test: by extension when it is known, else by content."""
    ext = extension(path)
    return F.when(ext.isin(*V.BINARY_EXTENSIONS), False) \
        .when(ext.isin(*V.TEXT_EXTENSIONS), True) \
        .otherwise(looks_like_text(content, size))


def is_safe_to_read(path: Column, content: Column, size: Column, max_size: int | None = None) -> Column:
    """Text, and not above ``max_size`` if one is given."""
    text = is_text(path, content, size)
    return (size <= max_size) & text if max_size else text
