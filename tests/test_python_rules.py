"""Python rules inside a scan, expressions that only Python runs, the rule log and versions of rules."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from codesieve import ScanOptions, scan_table
from codesieve.catalog import manage, specs, tables
from codesieve.functions.pymatch import LinePlaces, PythonRule
from codesieve.operators import executions
from codesieve.operators.scan import scan_files

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, language string, text string").withColumn("size", F.length("text").cast("long"))


def todo(path, text):
    return ({"line_number": n, "column_number": line.find("TODO"), "matched_text": "TODO", "detail": f"in {path}"}
            for n, line in enumerate(text.split("\n"), 1) if "TODO" in line)


def raising(path, text):
    yield {"line_number": 1}
    if "bad" in path:
        raise KeyError(path)


ROWS = [("a.py", "python", "x = 1\n# TODO\nDEBUG = True"), ("bad.py", "python", "TODO TODO\n"), ("c.js", "javascript", "// TODO"),
        ("empty.py", "python", ""), ("none.py", "python", None)]


def test_findings_and_errors_of_each_rule_stand_alone(spark):
    rules = [PythonRule("X1", todo, "To do", "low", languages=("python",)), PythonRule("X2", raising, "Raises", "high", owasp_category="A03")]
    done = scan_files(files(spark, ROWS), python_rules=rules, rules=tables.rules(spark).filter("rule_id = 'PY006'"))
    rows = {r.filename: r for r in done.collect()}
    found = {name: [(f.rule_id, f.severity, f.line_number, f.column_number, f.matched_text, f.detail) for f in r.findings if f.rule_id != "PY006"]
             for name, r in rows.items()}
    assert found == {
        "a.py": [("X1", "low", 2, 2, "TODO", "in a.py"), ("X2", "high", 1, 0, "", "")],
        # what a rule found before it raised does not count; the other rule's finding does
        "bad.py": [("X1", "low", 1, 0, "TODO", "in bad.py")], "c.js": [("X2", "high", 1, 0, "", "")], "empty.py": [], "none.py": []}
    assert [f.rule_id for f in rows["a.py"].findings] == ["PY006", "PY006", "X1", "X2"]  # two expressions of PY006 match
    assert {n: [(e.rule_id, e.message) for e in r.rule_errors] for n, r in rows.items() if r.rule_errors} == {"bad.py": [("X2", "KeyError: 'bad.py'")]}
    log = executions.rule_executions(done, tables.rules(spark).filter("rule_id = 'PY006'"), python_rules=rules)
    assert {(r.filename, r.rule_id): (r.status, r.match_count, r.error_message) for r in log.collect() if r.filename in ("bad.py", "a.py")} == {
        ("a.py", "PY006"): ("success", 2, None), ("a.py", "X1"): ("success", 1, None), ("a.py", "X2"): ("success", 1, None),
        ("bad.py", "PY006"): ("success", 0, None), ("bad.py", "X1"): ("success", 1, None), ("bad.py", "X2"): ("error", 0, "KeyError: 'bad.py'")}


def test_threshold_enrichment_and_snippets(spark):
    def both(path, text):
        return [{"severity": "high", "line_number": 2, "matched_text": "TODO"}, {"line_number": 1}]

    table = files(spark, ROWS[:1]).select("path", F.col("text").alias("content"))
    scan = scan_table(table, ScanOptions.of(min_severity="medium"), python_rules=[PythonRule("X3", both, "Both", "low", owasp_category="A05")])
    got = [(r.rule_id, r.severity, r.title, r.line_number, r.code_snippet) for r in scan.findings.filter("rule_id = 'X3'").collect()]
    assert got == [("X3", "high", "Both", 2, "x = 1\n# TODO\nDEBUG = True")]


@pytest.mark.parametrize("match, error", [
    ({"line_number": "1"}, "TypeError"), ({"severity": None}, "TypeError"), ({"colour": 1}, "ValueError"), ({"rule_id": "other"}, "ValueError"), (7, "TypeError")])
def test_matches_that_are_none(spark, match, error):
    done = scan_files(files(spark, ROWS[:1]), rules=tables.rules(spark).filter("false"), python_rules=[PythonRule("X4", lambda path, text: [match])])
    row = done.first()
    assert row.findings == [] and row.rule_errors[0].message.startswith(error)


def test_expressions_that_only_python_runs_in_a_whole_scan(spark):
    rules = tables.rules(spark).filter("rule_id in ('PY006', 'PY009')").withColumn(
        "regexes", F.when(F.col("rule_id") == "PY009", F.array(F.lit("(a)?b(?(1)c|d)"), F.lit("(broken"), F.lit("x{}"))).otherwise(F.col("regexes")))
    text = "abc\nbd x{}\nDEBUG = True"
    row = scan_files(files(spark, [("a.py", "python", text)]), rules=rules).first()
    assert sorted((f.rule_id, f.line_number, f.column_number, f.matched_text) for f in row.findings) == [
        ("PY006", 3, 0, "DEBUG = True"), ("PY006", 3, 0, "DEBUG = True"), ("PY009", 1, 0, "abc"), ("PY009", 2, 0, "bd"), ("PY009", 2, 3, "x{}")]


def test_broken_patterns_are_left_out_and_reported(spark):
    patterns = tables.patterns(spark).filter("pattern_id = 'A05_001'").withColumn("regex_patterns", F.array(F.lit("(x"), F.lit("debug")))
    assert [s.pattern_no for s in specs.pattern_specs(patterns)] == [1]
    assert [(r.pattern_id, r.pattern_no) for r in specs.broken_patterns(patterns).collect()] == [("A05_001", 0)]


def test_the_log_filters_no_findings_per_rule(spark):
    done = scan_files(files(spark, ROWS), "low")
    log = executions.rule_executions(done.select("filename", "error", "parsed", "findings"), tables.rules(spark))
    plan = log._jdf.queryExecution().optimizedPlan().toString()
    assert "array_except" in plan and plan.count("'PY001'") <= 2 and "filter(findings" not in plan


def test_the_latest_valid_version_counts(spark):
    def rule(rule_id, title, severity="low", version=0):
        return (rule_id, title, "text", severity, "high", "A04", True, "regex", ["x"], version)

    columns = "rule_id string, title string, description string, severity string, confidence string, owasp_category string, " \
              "enabled boolean, rule_type string, regexes array<string>, version int"
    new = spark.createDataFrame([rule("X1", "second", version=2), rule("X1", "third, invalid", "fatal", 3), rule("X1", "first", version=1),
                                 rule("PY006", "replaced", version=5), rule("PY006", "older", version=4)], columns).repartition(3)
    got = manage.upsert_rules(tables.rules(spark), new, "version").filter("rule_id in ('X1', 'PY006')").collect()
    assert sorted((r.rule_id, r.title) for r in got) == [("PY006", "replaced"), ("X1", "second")]
    # without versions the last row of an id counts
    rows = spark.createDataFrame([rule("X1", "first"), rule("X1", "second")], columns).drop("version").coalesce(1)
    assert [r.title for r in manage.upsert_rules(tables.rules(spark), rows).filter("rule_id = 'X1'").collect()] == ["second"]


def test_places_of_offsets():
    text = "a\n\nbc\n"
    assert [LinePlaces(text).of(k) for k in range(len(text) + 1)] == [(1, 0), (1, 1), (2, 0), (3, 0), (3, 1), (3, 2), (4, 0)]
