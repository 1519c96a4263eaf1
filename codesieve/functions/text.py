"""Text functions: lines, snippets, highlighting, line counts, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesieve.catalog import fixed_values as V
from codesieve.functions.expressions import let, occurrences
from codesieve.functions.fold import SPACE_CLASS

# Line ends of Python's str.splitlines(); the remaining white space never ends a line.
LINE_END = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
IN_LINE_SPACE = r"\t\x1f \xa0\u1680\u2000-\u200a\u202f\u205f\u3000"


def split_lines(text: Column) -> Column:
    """Lines of a text as an array; a final line end adds no empty line, '' has no lines."""
    pieces = F.split(text, rf"\r\n|[{LINE_END}]", -1)
    return let(pieces, lambda p: F.when(
        F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def strip(text: Column) -> Column:
    """Remove white space (Unicode) at both ends."""
    return F.regexp_replace(text, rf"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+\z", "")


def snippet(lines: Column, line: Column, context: int = 2) -> Column:
    """Up to ``2 * context + 1`` lines around a 1-based line, joined by newlines."""
    first = F.greatest(F.lit(1), line - context)
    last = F.least(F.size(lines), line + context)
    return F.array_join(F.slice(lines, first, F.greatest(F.lit(0), last - first + 1)), "\n")


def highlight(code: Column, matched: Column, escape: bool = False) -> Column:
    """Wrap every literal occurrence of the matched text in a mark tag."""
    if escape:
        code, matched = escape_markup(code), escape_markup(matched)
    return F.when(F.coalesce(matched, F.lit("")) == "", code).otherwise(
        F.replace(code, matched, F.concat(F.lit(V.HIGHLIGHT_OPEN), matched, F.lit(V.HIGHLIGHT_CLOSE))))


def escape_markup(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def code_snippet(text: Column, line: Column, path: Column, language: Column, context: int = 3) -> Column:
    """Numbered lines around a target line; null when the line is outside the text."""
    def build(lines: Column) -> Column:
        first = F.greatest(F.lit(1), line - context)
        last = F.least(F.size(lines), line + context)
        part = F.slice(lines, first, F.greatest(F.lit(0), last - first + 1))
        return F.when((line >= 1) & (line <= F.size(lines)), F.struct(
            path.alias("file_path"), line.alias("target_line"), first.alias("start_line"),
            last.alias("end_line"),
            F.transform(part, lambda content, i: F.struct(
                (first + i).alias("line_number"), content.alias("content"),
                (first + i == line).alias("is_target"))).alias("lines"),
            language.alias("language")))

    return let(split_lines(text), build)


def nonblank_lines(text: Column) -> Column:
    """Number of lines holding more than white space; one linear pass, no line array."""
    return F.regexp_count(text, F.lit(rf"(?:\A|[{LINE_END}])[{IN_LINE_SPACE}]*+[^{SPACE_CLASS}]"))


def code_lines(text: Column, language: Column) -> Column:
    """Non-blank lines without comment lines, by the comment rules of the language."""
    stripped = F.filter(F.transform(split_lines(text), strip), lambda s: s != "")

    def count(keep) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(False).alias("open"))

        def advance(acc: Column, s: Column) -> Column:
            is_open, counted = keep(acc["open"], s)
            return F.struct((acc["n"] + counted.cast("int")).alias("n"), is_open.alias("open"))

        return F.aggregate(stripped, zero, advance, lambda acc: acc["n"])

    def python_line(is_open: Column, s: Column):
        hash_line = s.startswith("#")
        odd = (occurrences(s, '"""') % 2 == 1) | (occurrences(s, "'''") % 2 == 1)
        now_open = F.when(~hash_line & odd, ~is_open).otherwise(is_open)
        bare_quotes = s.isin('"""', "'''")
        return now_open, ~hash_line & ~now_open & ~bare_quotes

    def slash_line(is_open: Column, s: Column):
        line_comment = s.startswith("//")
        closes = ~line_comment & s.contains("*/")
        now_open = F.when(line_comment, is_open).when(closes, F.lit(False)) \
            .otherwise(is_open | s.contains("/*"))
        return now_open, ~line_comment & ~closes & ~now_open

    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0) \
        .when(language == "python", count(python_line)) \
        .when(language.isin(*V.SLASH_COMMENT_LANGUAGES), count(slash_line)) \
        .when(language.isin(*V.HASH_COMMENT_LANGUAGES),
              F.size(F.filter(stripped, lambda s: ~s.startswith("#")))) \
        .otherwise(F.size(stripped))


def content_hash(content: Column, algorithm: str = "sha256") -> Column:
    """Hex digest of text or bytes; null for an unknown algorithm."""
    digests = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256),
               "sha512": lambda c: F.sha2(c, 512)}
    digest = digests.get(algorithm)
    return digest(content) if digest else F.lit(None).cast("string")


def text_line(text: Column, number: Column) -> Column:
    """One line by 1-based number, null outside the text; lines end at newlines only."""
    return F.when(number >= 1, F.get(F.split(text, "\n", -1), number - 1))


def text_line_range(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first``..``last`` (1-based, inclusive), clamped to the text."""
    def build(lines: Column) -> Column:
        low = F.greatest(F.lit(1), first)
        return F.slice(lines, low, F.greatest(F.lit(0), F.least(F.size(lines), last) - low + 1))

    return let(F.split(text, "\n", -1), build)


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    prefix = F.substring(text, F.lit(1), offset)
    return 1 + F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit("")))


def column_of(text: Column, offset: Column) -> Column:
    """0-based column of a 0-based character offset."""
    return F.length(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1))


def severity_score(severity: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for name, score, *_ in V.SEVERITIES for x in (name, score)])
    return F.coalesce(F.try_element_at(ranks, F.lower(severity)), F.lit(V.UNKNOWN_SEVERITY_SCORE))


def category_code(category: Column) -> Column:
    """'A03: Injection' -> 'A03'."""
    return F.trim(F.substring_index(category, ":", 1))


def category_title(code: Column, name: Column) -> Column:
    """'A03: Injection'; the general category is shown by name alone."""
    return F.when(code == "GEN", name).otherwise(F.concat_ws(": ", code, name))


def size_mb(size: Column) -> Column:
    return size / F.lit(1024 * 1024)
