"""Path functions: parts, language, exclusion globs, normalization."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesieve.catalog import fixed_values as V

# Media types by extension for the file kinds the profile knows; others are null.
MEDIA_TYPES = {
    ".py": "text/x-python", ".js": "text/javascript", ".html": "text/html", ".htm": "text/html",
    ".xml": "text/xml", ".json": "application/json", ".txt": "text/plain", ".c": "text/plain",
    ".h": "text/plain", ".md": "text/markdown", ".css": "text/css", ".csv": "text/csv",
    ".sh": "application/x-sh", ".pdf": "application/pdf", ".zip": "application/zip",
    ".tar": "application/x-tar", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg",
    ".gif": "image/gif", ".bmp": "image/bmp", ".svg": "image/svg+xml", ".mp3": "audio/mpeg",
    ".mp4": "video/mp4", ".pyc": "application/x-python-code", ".bin": "application/octet-stream",
    ".so": "application/octet-stream", ".dll": "application/octet-stream",
    ".exe": "application/octet-stream",
}


def base_name(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; '' for none, as in '.hidden' or 'name.'."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)\z", 1))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def file_language(path: Column) -> Column:
    return _lookup(V.EXTENSION_LANGUAGES, extension(path))


def media_type(path: Column) -> Column:
    return _lookup(MEDIA_TYPES, extension(path))


def analyzer_language(path: Column, analyzers: dict[str, list[str]] | None = None) -> Column:
    """Language whose analyzer accepts the file (by extension, any case), else null."""
    table = {e: lang for lang, exts in (analyzers or V.ANALYZER_EXTENSIONS).items() for e in exts}
    return _lookup(table, extension(path))


def glob_regex(glob: str) -> str:
    """Shell glob as an anchored Java expression; ``*`` also crosses ``/``."""
    def bracket(body: str) -> str:
        negate = "^" if body.startswith("!") else ""
        return "[" + negate + re.sub(r"([\[\]^&\\])", r"\\\1", body[len(negate):]) + "]"

    out = []
    for token in re.findall(r"\[!?\]?[^\]]*\]|.", glob, re.S):
        if token == "*":
            out.append(".*")
        elif token == "?":
            out.append(".")
        elif token.startswith("[") and len(token) > 1:
            out.append(bracket(token[1:-1]))
        else:
            out.append(re.sub(r"([^\w\s/])", r"\\\1", token))
    return r"(?s)\A" + "".join(out) + r"\z"


def one_of_globs(globs: list[str]) -> str:
    """All globs as one expression, so a path is tested once."""
    return r"(?s)\A(?:" + "|".join(glob_regex(g)[len(r"(?s)\A"):-len(r"\z")] for g in globs) + r")\z"


def matches_globs(path: Column, globs: list[str]) -> Column:
    """True when a glob matches the whole path or its last part."""
    if not globs:
        return F.lit(False)
    regex = one_of_globs(globs)
    return path.rlike(regex) | base_name(path).rlike(regex)


def ancestors(path: Column) -> Column:
    """Directories above a relative path, outermost first: 'a/b/c.py' -> ['a', 'a/b']."""
    parts = F.split(path, "/", -1)
    depth = F.size(parts) - 1
    return F.when(depth > 0, F.transform(
        F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))) \
        .otherwise(F.array().cast("array<string>"))


def in_pruned_directory(path: Column, globs: list[str]) -> Column:
    """True when a glob excludes any directory above the file, hence its whole subtree."""
    return F.exists(ancestors(path), lambda d: matches_globs(d, globs)) if globs else F.lit(False)


def normalize_path(path: Column, base: str = "/") -> Column:
    """Lexical absolute path: joined to ``base``, without '.', '..' or doubled slashes."""
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))
    parts = F.filter(F.split(full, "/", -1), lambda p: ~p.isin("", "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(
        p == "..", F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.array_append(acc, p)))
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def is_safe_path(path: Column, base: str | None = None, working_directory: str = "/") -> Column:
    """True when the normalized path lies at or below the normalized base."""
    if base is None:
        return F.lit(True)
    root = normalize_path(F.lit(base), working_directory)
    full = normalize_path(path, working_directory)
    return (root == "/") | (full == root) | full.startswith(F.concat(root, F.lit("/")))
