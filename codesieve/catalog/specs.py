"""Rule tables turned into the expressions a scan evaluates.

A scan needs its expressions as literals (compiled once per task, tested in one projection), so an
enabled rule table is read to the driver when the plan is built: as many rows as the plan has expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codesieve.catalog import fixed_values as V
from codesieve.catalog import tables
from codesieve.functions.regex import RegexSpec

RULE_ATTRIBUTES = ["title", "severity", "confidence", "owasp_category", "detail"]

# Words a match of an expression cannot do without; purely a shortcut, never a condition of its own.
_SECRET_WORDS = ("password", "token", "secret", "key")
_NEEDS = {
    "PY003": [
        [("key", "token", "secret", "password")], [("mysql://", "postgres://", "mongodb://")], [("akia",)],
        [("-----begin",)], [("password", "passwd", "pwd")], [("eyj",)]],
    "PY006": [[("debug",)], [("app.debug",)], [("app.run(",)], [("debug",)], [("verbose",)]],
    "PY007": [[("requests.",), ("+",)], [("urllib.request.urlopen",), ("+",)], [("httplib.",), ("+",)]],
    "PY008": [[("log",), _SECRET_WORDS, ("(",), (")",)], [("print(",), _SECRET_WORDS, (")",)]],
    "PY009": [[("password",), ("==",)], [("user",), ("==",)], [("password",), ("[",)]],
    "A01_001": [[("open",), ("+",)], [("file",), ("+",)], [("{",), (".txt", ".log", ".conf", ".xml")]],
    "A01_002": [
        [("@app.route(",)], [("def",), ("admin", "delete", "modify", "update")],
        [("function",), ("admin", "delete", "modify", "update")]],
    "A02_001": [
        [("key", "secret", "password", "pwd", "token")], [("akia",)], [("-----begin",)],
        [("mysql://", "postgres://", "mongodb://")], [("eyj",)]],
    "A02_002": [
        [("hashlib.",)], [("des", "rc4", "md4", "md5", "sha1")], [("cipher.",)],
        [(".create()",)], [("random.",)]],
    "A03_001": [
        [("select", "insert", "update", "delete"), ("+",), ("from", "into", "set", "where")],
        [("execute",), ("+",)], [("query",), ("%s",)],
        [("select", "insert", "update", "delete"), ("{",)], [("cursor.execute",), ("+",)]],
    "A03_002": [
        [("os.system", "subprocess."), ("+",)], [("exec", "eval", "system"), ("+",)],
        [("shell=true",), ("+",)], [("runtime.getruntime().exec(", "processbuilder("), ("+",)]],
    "A04_001": [
        [("@app.route(",)], [("def",), ("login", "authenticate", "send_sms", "verify")],
        [("function",), ("login", "register", "forgot")]],
    "A05_001": [[("debug",)], [("app.debug",)], [("app.run(",)], [("development",)], [("console.log",)]],
    "A06_001": [[("django",)], [("flask",)], [("requests",)], [("jquery",)], [("spring",)]],
    "A07_001": [
        [("password",), ("==",)], [("user",), ("==",)], [("password",), ("[",)], [("auth",)], [("session[",)]],
    "A08_001": [
        [("pickle.",)], [("yaml.load",)], [("eval",)], [("exec",)], [("unserialize",)], [("json.parse",)]],
    "A09_001": [
        [("log",), _SECRET_WORDS + ("ssn", "credit"), ("(",), (")",)], [("print",), _SECRET_WORDS, (")",)],
        [("console.log(",), _SECRET_WORDS], [("logger.",), _SECRET_WORDS]],
    "A10_001": [
        [("requests.",), ("+",)], [("urllib.request.urlopen",), ("+",)], [("fetch",), ("+",)],
        [("http",), ("{",)], [("curl", "wget"), ("$",)]],
}


def _needs(owner_id: str, index: int, pattern: str) -> tuple[tuple[str, ...], ...]:
    known = V.RULE_REGEXES.get(owner_id) or V.PATTERN_REGEXES.get(owner_id) or []
    if index < len(known) and known[index] == pattern:
        return tuple(_NEEDS[owner_id][index])
    return ()


def _collect(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def rule_specs(rules: DataFrame | None = None, min_severity: str | None = None) -> list[RegexSpec]:
    """Expressions of the enabled regex rules at or above a severity (all built-in rules by default)."""
    if rules is None:
        rows = tables.rule_rows()
    else:
        rows = _collect(rules.filter(F.col("enabled") & (F.size("regexes") > 0)).orderBy("rule_id"))
    return [
        RegexSpec(row["rule_id"], number, pattern, needs=_needs(row["rule_id"], number, pattern),
                  attributes={k: row.get(k if k != "detail" else "description") for k in RULE_ATTRIBUTES})
        for row in rows if reaches(row["severity"], min_severity)
        for number, pattern in enumerate(row["regexes"]) if compile_error(pattern) is None]


def expression_specs(owners: DataFrame) -> list[RegexSpec]:
    """Each distinct expression (``pattern``) that compiles, once, whoever owns it."""
    distinct = owners.select("pattern").where("pattern is not null").distinct().orderBy("pattern")
    return [RegexSpec("", number, row["pattern"]) for number, row in enumerate(_collect(distinct)) if compile_error(row["pattern"]) is None]


def pattern_specs(patterns: DataFrame | None = None) -> list[RegexSpec]:
    """Expressions of the catalogue, each bound to the languages of its pattern."""
    rows = tables.pattern_rows() if patterns is None else _collect(patterns.orderBy("pattern_id"))
    return [
        RegexSpec(row["pattern_id"], number, pattern, needs=_needs(row["pattern_id"], number, pattern),
                  languages=tuple(sorted(row["languages"])),
                  attributes={k: row[k] for k in ("name", "severity", "confidence", "owasp_category")})
        for row in rows for number, pattern in enumerate(row["regex_patterns"] or []) if compile_error(pattern) is None]


def broken_patterns(patterns: DataFrame) -> DataFrame:
    """pattern_id, pattern_no, error: the expressions that a scan leaves out because they do not compile."""
    errors = F.posexplode(compile_errors("regex_patterns")).alias("pattern_no", "error")
    return patterns.select("pattern_id", errors).where("error is not null")


def dependency_specs() -> list[RegexSpec]:
    return [RegexSpec("DEPENDENCY", number, pattern, ignore_case=True)
            for number, pattern in enumerate(V.DEPENDENCY_REGEXES)]


def compile_error(pattern: str | None) -> str | None:
    """What is wrong with an expression, None if it compiles."""
    try:
        re.compile(pattern or "", re.M)
    except (re.error, OverflowError, RecursionError) as problem:
        return f"expression {pattern!r} does not compile: {problem}"
    return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def compile_errors(expressions):
    """Per row: what is wrong with each expression, null if it compiles."""
    return expressions.map(lambda xs: [compile_error(x) for x in xs] if xs is not None else [])


def structural_rows(rules: DataFrame | None) -> dict[str, dict]:
    """Enabled structural rules by id, with the values of the table."""
    rows = tables.rule_rows() if rules is None else _collect(rules.filter(F.col("enabled") & (F.col("rule_type") == "ast")))
    return {r["rule_id"]: r for r in rows if r["rule_type"] == "ast"}


def severity_rank(severity: str | None) -> int:
    return {s[0]: s[1] for s in V.SEVERITIES}.get((severity or "").lower(), V.UNKNOWN_SEVERITY_SCORE)


def reaches(severity: str | None, min_severity: str | None) -> bool:
    return min_severity is None or severity_rank(severity) >= severity_rank(min_severity)
