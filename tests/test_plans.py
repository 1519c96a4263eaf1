import os

import pytest
from pyspark.sql import functions as F

from codesieve import ScanOptions, scan_table, scan_tree
from codesieve.catalog import fixed_values as V
from codesieve.catalog import manage, tables
from codesieve.operators import enrich, executions, filters, rollups, scan
from codesieve.plans.scan import scan_run, self_check
from codesieve.sources import sinks
from codesieve.functions.pymatch import PythonRule
from codesieve.functions.structural import match
from codesieve.sources.tables import file_profile, safe_files
from codesieve.sources.tree import list_tree, read_contents
from codesieve.streaming.files import scan_arriving_files

FILES = {
    "a.py": b"import os\nos.system(cmd)\n", "A.PY": b"eval(x)\n", "b.pyw": b"DEBUG = True\r\nx = 1\r\n",
    "__init__.py": b"eval(y)\n", "_p.py": b"x = 1\n", ".hid/c.py": b"eval(z)\n", "_priv/d.py": b"print(token)\n",
    "empty.py": b"", "test_x.py": b"eval(x)\n", "x_test.py": b"eval(x)\n", "tests/a/b.py": b"eval(x)\n",
    "src/tests/ok.py": b"eval(x)\n", "venv/lib/m.py": b"eval(x)\n", "m.pyc": b"\x00\x01", "requirements.txt": b"django==1.1\n",
    "app.js": b"eval(x)\n", "latin.py": b"# caf\xe9\neval(x)\n", "bom.py": "﻿eval(x)\n".encode(),
    "bad.py": b"def f(:\n  DEBUG = True\n", "old.py": b"print 'x'\npassword = 'abcdefgh1'\n",
    "big.py": b"#" * (10 * 1024 * 1024) + b"\n", "deep/er/est/e.py": b"eval(x)\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tree")
    for name, data in FILES.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    os.symlink(folder, folder / "loop")
    return str(folder)


@pytest.mark.parametrize("tasks", [1, 3])
def test_tree_lists_every_file(spark, root, tasks):
    listed = {r.path: r["size"] for r in list_tree(spark, root, tasks).collect()}
    assert listed == {name: len(data) for name, data in FILES.items()}


def test_tree_reads_contents(spark, root):
    got = {r.path: bytes(r.content) for r in read_contents(list_tree(spark, root), 3).collect()}
    assert got == FILES
    gone = spark.createDataFrame([(root + "/nope.py",)], "full_path string")
    row = read_contents(gone, 1).collect()[0]
    assert row.content is None and "nope.py" in row.read_error


def test_tree_by_uri(spark, root):
    uri = "file://" + root
    got = {r.path: bytes(r.content) for r in read_contents(list_tree(spark, uri + "/tests", 2), 2).collect()}
    assert got == {"a/b.py": FILES["tests/a/b.py"]}


def test_single_file_tree(spark, root):
    assert [(r.path, r["size"]) for r in list_tree(spark, root + "/a.py").collect()] == [("a.py", len(FILES["a.py"]))]


def test_tree_scan(spark, root):
    result = scan_tree(spark, root, partitions=4)
    files = {r.filename: r for r in result.file_results.collect()}
    assert set(files) == {"a.py", "A.PY", "b.pyw", "__init__.py", "_p.py", ".hid/c.py", "_priv/d.py", "empty.py",
                          "src/tests/ok.py", "latin.py", "bom.py", "bad.py", "old.py", "deep/er/est/e.py", "big.py"}
    limited = scan_tree(spark, root, ScanOptions.of(max_file_size_mb=10), partitions=4)
    assert set(files) - {r.filename for r in limited.file_results.collect()} == {"big.py"}
    assert files["empty.py"].error == V.UNREADABLE_FILE_ERROR and files["empty.py"].lines_of_code == 0
    assert files["bad.py"].parsed is False and files["bad.py"].error is None
    found = sorted((r.filename, r.rule_id, r.line_number) for r in result.findings.collect())
    assert found == sorted([
        ("a.py", "PY002", 2), ("A.PY", "PY005", 1), ("b.pyw", "PY006", 1), ("b.pyw", "PY006", 1),
        ("__init__.py", "PY005", 1), (".hid/c.py", "PY005", 1), ("_priv/d.py", "PY008", 1), ("_priv/d.py", "PY015", 1),
        ("src/tests/ok.py", "PY005", 1), ("latin.py", "PY005", 2), ("bad.py", "PY006", 2), ("bad.py", "PY006", 2),
        ("old.py", "PY003", 2), ("deep/er/est/e.py", "PY005", 1)])


def test_deep_trees_unreadable_entries_and_their_errors(spark, tmp_path):
    folder = tmp_path / "deep"
    branch = folder.joinpath(*[f"level{k}" for k in range(10)])
    branch.mkdir(parents=True)
    for k in range(5):
        (branch / f"f{k}.py").write_text("eval(x)\n")
    (folder / "gone.py").symlink_to(folder / "nowhere.py")
    os.symlink(folder, branch / "loop")
    listed = {r.path: r for r in list_tree(spark, str(folder), tasks=3).collect()}
    below = "/".join(f"level{k}" for k in range(10))
    assert set(listed) == {f"{below}/f{k}.py" for k in range(5)} and all(r.error is None for r in listed.values())
    missing = list_tree(spark, str(folder / "not there")).collect()
    assert len(missing) == 1 and "No such file" in missing[0].error
    lost = list_tree(spark, str(folder)).withColumns({
        "full_path": F.concat("full_path", F.lit("x")), "language": F.lit("python")})
    read = read_contents(lost).select("path", "language", "size", F.col("content").cast("string").alias("text"), "read_error")
    errors = {r.error for r in scan.scan_files(read).collect()}
    assert len(errors) == 5 and all("No such file" in e for e in errors)


def test_options():
    options = ScanOptions.of({"exclusions": {"test_patterns": ["t/*"]}}, min_severity="high", include_tests=True)
    assert (options.min_severity, options.exclusion_globs) == ("high", V.DEFAULT_OPTIONS["exclusions"]["patterns"])
    assert ScanOptions.of(max_file_size_mb=2).max_file_bytes == 2 * 1024 * 1024
    assert "t/*" in ScanOptions.of({"exclusions": {"test_patterns": ["t/*"]}}).exclusion_globs
    assert ScanOptions.of().with_exclusions("q/*").exclusion_globs.count("q/*") == 1
    assert ScanOptions.of().exclusion_globs.count("q/*") == 0
    for bad in ({"min_severity": "fatal"}, {"max_file_size_mb": 0}, {"max_file_size_mb": "x"}):
        with pytest.raises(ValueError):
            ScanOptions.of(**bad)
    with pytest.raises(ValueError):
        filters.only_language(None, "cobol")


def source_table(spark, sources):
    return spark.createDataFrame(sources, "path string, content string")


def test_enrichment(spark):
    files = source_table(spark, [("a.py", "eval(x)\n"), ("b.py", "import os\n")])
    scanned = scan_table(files).file_results
    row = enrich.findings(scanned).collect()[0]
    pattern = [p for p in tables.pattern_rows() if p["pattern_id"] == "A08_001"][0]
    assert (row.description, row.pattern_id, row.cwe_ids) == (pattern["description"], "A08_001", [502, 915])
    assert row.owasp_category_name == "A08: Software and Data Integrity Failures"
    assert row.primary_remediation == pattern["primary_remediation"] and row.references == pattern["references"]
    assert sinks.records(enrich.findings(scanned)).columns[0] == "title"

    mapping = tables.local_table(spark, [("rule_id", tables.pa.string()), ("pattern_id", tables.pa.string())],
                                 [{"rule_id": "PY005", "pattern_id": "A99_999"}])
    fallback = enrich.findings(scanned, rule_patterns=mapping).collect()[0]
    assert fallback.owasp_category == "A08" and fallback.owasp_category_name.startswith("A08: ")
    assert (fallback.pattern_id, fallback.cwe_ids, fallback.tags) == ("", [], [])
    unmapped = enrich.findings(scanned, rule_patterns=mapping.filter("false")).collect()[0]
    assert (unmapped.owasp_category, unmapped.owasp_category_name) == ("GEN", "GEN: General Security Issues")


def test_many_findings_on_long_lines_have_their_snippets(spark):
    source = "x = 1\n" + "eval(a); DEBUG = True; " * 50 + "\ny = 2\n"
    files = source_table(spark, [("a.py", source), ("b.py", "eval(x)\n"), ("c.py", "y = 1\n"), ("d.py", "")])
    results = scan_table(files).file_results
    flat = {(r.filename, r.rule_id, r.column_number): r.code_snippet for r in enrich.flatten_findings(results).collect()}
    assert enrich.flatten_findings(results).count() == 151 and all(s and ("eval(" in s or "DEBUG" in s) for s in flat.values())
    report = {r.filename: r for r in rollups.file_report(results).collect()}
    assert {k: r.vulnerability_count for k, r in report.items()} == {"a.py": 150, "b.py": 1, "c.py": 0, "d.py": 0}
    assert {(n, f.rule_id, f.column_number): f.code_snippet for n, r in report.items() for f in r.findings} == flat
    assert all(f.highlighted_code for r in report.values() for f in r.findings)


def test_the_rule_table_decides_structural_rules(spark):
    files = source_table(spark, [("a.py", "import hashlib\nhashlib.md5(x)\neval(y)\nx = 1\n")])
    one = lambda rules, severity="low", **more: sorted(
        (f.rule_id, f.title, f.severity, f.line_number) for r in scan_table(
            files, ScanOptions.of(min_severity=severity), rules=rules, **more).file_results.collect() for f in r.findings)
    rules = tables.rules(spark)
    regex = rules.filter("rule_id = 'PY004'").withColumns({"title": F.lit("x"), "rule_type": F.lit("regex"), "regexes": F.array(F.lit("eval"))})
    assert [f for f in one(manage.upsert_rules(rules, regex)) if f[0] == "PY004"] == [("PY004", "x", "high", 3)]
    renamed = rules.filter("rule_id = 'PY005'").withColumns({"title": F.lit("renamed"), "severity": F.lit("low")})
    assert ("PY005", "renamed", "low", 3) in one(manage.upsert_rules(rules, renamed))
    assert not [f for f in one(manage.upsert_rules(rules, renamed), "medium") if f[0] == "PY005"]
    mine = lambda facts: F.transform(facts["calls"], lambda c: match("MINE", "mine", "low", "high", "A01", c, F.lit("d")))
    assert [f for f in one(rules, custom_rules=[mine]) if f[0] == "MINE"] and not [
        f for f in one(rules, "critical", custom_rules=[mine]) if f[0] == "MINE"]


def test_broken_expressions_are_errors_of_their_rule(spark):
    rules = tables.rules(spark).filter("rule_id in ('PY006', 'PY009')").withColumn(
        "regexes", F.when(F.col("rule_id") == "PY009", F.array(F.lit("(abc"))).otherwise(F.col("regexes")))
    checked = {r.rule_id: r for r in manage.validate_rules(rules).collect()}
    assert checked["PY006"].is_valid and not checked["PY009"].is_valid and "does not compile" in checked["PY009"].errors[0]
    files = source_table(spark, [("a.py", "DEBUG = True\n")])
    log = {r.rule_id: r for r in executions.rule_executions(
        scan_table(files, ScanOptions.of(min_severity="low"), rules=rules).file_results, rules).collect()}
    assert (log["PY006"].status, log["PY009"].status) == ("success", "error") and "compile" in log["PY009"].error_message


def test_languages_can_be_switched_off(spark):
    files = source_table(spark, [("a.py", "DEBUG = True\n")])
    off = ScanOptions.of({"languages": {"python": {"enabled": False}}})
    assert scan_table(files, off).file_results.count() == 0 and scan_table(files).file_results.count() == 1


def test_union_and_invariants(spark):
    one = source_table(spark, [("a.py", "eval(x)\nDEBUG = True\n")])
    two = source_table(spark, [("b.py", "print(token)\n"), ("c.py", "x = 1\n")])
    key = lambda df: sorted(map(str, df.findings.collect()))
    both = scan_table(one.union(two))
    assert key(both) == sorted(key(scan_table(one)) + key(scan_table(two)))
    totals = rollups.severity_totals(both.file_results).collect()[0]
    assert totals.total_vulnerabilities == totals.critical + totals.high + totals.medium + totals.low == 5
    assert (totals.files_with_issues, totals.total_files) == (2, 3)
    per_file = rollups.severity_by_file(both.file_results).collect()
    assert sum(r.critical + r.high + r.medium + r.low for r in per_file) == 5
    assert [r.filename for r in rollups.clean_files(both.file_results).collect()] == ["c.py"]
    assert rollups.gate(both.file_results).collect()[0].failed
    empty = scan_table(two.filter("path = 'c.py'")).file_results
    assert not rollups.gate(empty).collect()[0].failed
    assert rollups.severity_totals(empty.filter("false")).collect()[0].total_vulnerabilities == 0
    assert rollups.category_groups(enrich.findings(empty)).filter("finding_count > 0").count() == 0


def test_severity_threshold_is_decided_before_scanning(spark):
    files = source_table(spark, [("a.py", "print(token)\nrandom.choice(x)\neval(x)\n")])
    for severity, want in (("low", 4), ("medium", 4), ("high", 1), ("critical", 1)):
        assert scan_table(files, ScanOptions.of(min_severity=severity)).findings.count() == want
    plan = scan_table(files, ScanOptions.of(min_severity="critical")).file_results._jdf.queryExecution().toString()
    assert "debug" not in plan.lower()


def test_execution_log(spark):
    files = source_table(spark, [("a.py", "DEBUG = True\n" * 4), ("bad.py", "def (:\n"), ("e.py", "")])
    rules = manage.set_enabled(tables.rules(spark), False, "PY001")
    results = scan_table(files, ScanOptions.of(min_severity="low")).file_results
    log = executions.rule_executions(results, rules, max_matches=3)
    got = {(r.filename, r.rule_id): r for r in log.collect()}
    assert len(got) == 45
    assert got["a.py", "PY001"].status == "skipped" and got["bad.py", "PY002"].status == "failed"
    assert got["bad.py", "PY006"].status == "success" and got["e.py", "PY006"].status == "error"
    debug = got["a.py", "PY006"]
    assert (debug.match_count, len(debug.matches), len(debug.warnings)) == (8, 3, 1)
    every = {(r.filename, r.rule_id): r for r in executions.rule_executions(results, rules).collect()}["a.py", "PY006"]
    assert (every.match_count, len(every.matches), len(every.warnings)) == (8, 8, 0)
    assert [m.line_number for m in debug.matches] == [1, 2, 3]
    summary = executions.execution_summary(log).collect()[0]
    assert (summary.total_rules_executed, summary.status_skipped, summary.rules_with_matches) == (45, 3, 1)
    assert summary.total_matches_found == 8 and abs(summary.match_rate - 1 / 45) < 1e-9
    none = executions.execution_summary(log.filter("false")).collect()[0]
    assert (none.total_rules_executed, none.match_rate) == (0, 0.0)


def test_manage_rules(spark):
    rules = tables.rules(spark)
    assert manage.validate_rules(rules).filter("not is_valid").count() == 0
    assert {r.rule_id for r in manage.select_rules(rules, rule_type="regex").collect()} == set(V.RULE_REGEXES)
    assert manage.select_rules(rules, rule_id="PY007").count() == 1
    assert manage.select_rules(rules, F.col("severity") == "high", category="A01").count() == 1
    off = manage.set_enabled(rules, False, "PY001", "NOPE")
    assert manage.enabled_rules(off).count() == 14
    assert manage.remove_rules(rules, "PY001").count() == 14
    assert {(r.rule_type, r.rule_count) for r in manage.rules_by_type(rules).collect()} == {
        ("regex", 5), ("ast", 10), ("semantic", 0), ("hybrid", 0)}
    stats = manage.rule_statistics(off).collect()[0]
    assert (stats.total_rules, stats.enabled_rules, stats.categories) == (
        15, 14, ["A01", "A02", "A03", "A05", "A07", "A08", "A09", "A10"])
    assert [r.owasp_category for r in manage.supported_categories(rules).collect()] == stats.categories


def test_catalogue(spark):
    patterns = tables.patterns(spark)
    assert patterns.count() == 13
    assert manage.select_patterns(patterns, language="go").select("pattern_id").collect()[0][0] == "A02_001"
    assert manage.select_patterns(patterns, category="A03").count() == 2
    assert manage.select_patterns(patterns, pattern_id="A10_001").count() == 1
    assert manage.search_patterns(patterns, "INJECTION").count() == 2
    assert manage.search_patterns(patterns, "injection", "tags").count() == 2
    assert manage.search_patterns(patterns, "x", "cwe").count() == 0
    stats = {(r.dimension, r.value): r.pattern_count for r in
             manage.pattern_statistics(patterns, tables.severities(spark)).collect()}
    assert stats["severity", "low"] == 0 and stats["severity", "critical"] == 4 and stats["language", "go"] == 1
    added = manage.add_patterns(patterns, patterns.limit(1).withColumn("name", F.lit("changed")))
    assert added.count() == 13 and added.filter("name = 'changed'").count() == 1
    assert tables.rule_listing(spark).count() == 10
    assert tables.languages(spark).collect()[0].extensions == [".py", ".pyw"]
    assert tables.extension_map(spark).count() == len(V.EXTENSION_LANGUAGES) == 30


def test_examples_match_their_own_pattern():
    import re
    for row in tables.pattern_rows():
        for example in row["examples"]:
            assert any(re.search(p, example, re.M) for p in row["regex_patterns"]), (row["pattern_id"], example)


def test_statistics_and_self_check(spark):
    stats = rollups.capability_statistics(tables.rules(spark), tables.languages(spark), ScanOptions.of()).collect()[0]
    assert (stats.total_analyzers, stats.supported_extensions, stats.enabled_languages) == (1, [".py", ".pyw"], ["python"])
    assert stats.min_severity == "medium" and "A10" in stats.supported_owasp_categories
    assert tuple(self_check(spark).collect()[0]) == (True, True, True)
    broken = ScanOptions.of()
    broken.values["analysis"]["min_severity"] = "fatal"
    broken.values["languages"]["python"]["enabled"] = False
    assert tuple(self_check(spark, broken, analyzers={"python": []}).collect()[0]) == (False, False, False)


def test_info(spark):
    info = rollups.catalogue_info(tables.patterns(spark)).collect()[0]
    assert (info.edition, info.total_categories, info.available_patterns) == ("2021", 10, 13)
    args = (tables.rules(spark), tables.languages(spark), ScanOptions.of())
    assert rollups.analyzer_info(*args, "python").count() == 1 and rollups.analyzer_info(*args, "go").count() == 0


def test_python_rule_errors_are_rows(spark):
    def check(path, source):
        if "bad" in source:
            raise ValueError("cannot read this")
        return [{"rule_id": "X", "line_number": 1}]

    files = source_table(spark, [("a", "x"), ("b", "bad")])
    rows = {r.filename: r for r in scan.python_rule(files, check, text="content", rule_id="Y").collect()}
    assert (rows["a"].rule_id, rows["a"].error, rows["a"].column_number) == ("X", None, 0)
    assert (rows["b"].rule_id, rows["b"].error, rows["b"].line_number) == ("Y", "cannot read this", None)


def test_profile(spark, root):
    got = {r.path: r for r in file_profile(read_contents(list_tree(spark, root), 2)).collect()}
    assert (got["latin.py"].lines, got["latin.py"].language, got["latin.py"].encoding) == (1, "python", None)
    assert got["m.pyc"].is_text is False and got["m.pyc"].hash is None and got["m.pyc"].lines == 0
    assert got["app.js"].mime_type == "text/javascript" and got["empty.py"].size == 0
    small = safe_files(read_contents(list_tree(spark, root), 2), 1000)
    assert {r.path for r in small.collect()} == set(FILES) - {"m.pyc", "big.py"}


def test_sinks_and_report(spark, tmp_path):
    files = source_table(spark, [("a.py", "eval(x)\nprint(token)\n"), ("b.py", "x = 1\n")])
    result = scan_table(files).materialized(str(tmp_path / "results"))
    sinks.write_findings(result.findings, str(tmp_path / "findings"))
    back = spark.read.parquet(str(tmp_path / "findings"))
    assert back.filter("severity = 'critical'").count() == 1 and back.count() == 3
    sinks.write_report(result.report(), str(tmp_path / "report"))
    summary = spark.read.json(str(tmp_path / "report" / "summary")).collect()[0]
    assert (summary.total_vulnerabilities, summary.total_files) == (3, 2)
    assert scan_run(result, "corpus").collect()[0].target_path == "corpus"
    assert sinks.materialize(files, str(tmp_path / "shared")).count() == 2


def test_arriving_files(spark, tmp_path):
    files = source_table(spark, [("a.py", "eval(x)\n"), ("b.py", "x = 1\n")])
    files.write.parquet(str(tmp_path / "in"))
    stream = scan_arriving_files(spark, str(tmp_path / "in"), "path string, content string").findings
    query = stream.writeStream.format("memory").queryName("arrived").outputMode("append") \
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.rule_id for r in spark.table("arrived").collect()] == ["PY005"]
    source_table(spark, [("c.py", "DEBUG = True\n")]).write.mode("append").parquet(str(tmp_path / "in"))
    again = stream.writeStream.format("memory").queryName("arrived2").outputMode("append") \
        .option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    again.awaitTermination()
    assert spark.table("arrived2").count() == 3


def test_plan_has_no_shuffle_and_reads_two_columns(spark, tmp_path):
    source_table(spark, [("a.py", "eval(x)\n")]).withColumn("other", F.lit("unused")).write.parquet(str(tmp_path / "t"))
    findings = scan_table(spark.read.parquet(str(tmp_path / "t"))).findings
    plan = findings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan and "Cartesian" not in plan
    assert "ReadSchema: struct<path:string,content:string>" in plan
    assert plan.count("ArrowEvalPython") == 1


def test_log_is_never_the_side_that_is_sent_around(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "keys"))  # a few bytes of key that become files
    files = spark.read.parquet(str(tmp_path / "keys")).select(F.format_string("f%d.py", "id").alias("path"), F.lit("eval(x)\n").alias("content"))
    log = executions.rule_executions(scan_table(files).file_results, tables.rules(spark))
    plan = log._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    assert log.count() == 5 * len(V.RULES)


def test_workers_read_a_text_once(spark):
    """Parser, expressions and Python rules run in one pass of the Python workers, and nothing locates matches a second time."""
    files = source_table(spark, [("a.py", "eval(x)\nDEBUG = True\n"), ("b.py", "password = 'hunter2hunter2'\n")])
    rule = PythonRule("X_ANY", lambda path, text: [{}], "Any", "high")
    results = scan_table(files, python_rules=[rule]).file_results
    plan = results._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "_fold" not in plan
    assert {(r.filename, f.rule_id) for r in results.collect() for f in r.findings} == {
        ("a.py", "PY005"), ("a.py", "PY006"), ("a.py", "X_ANY"), ("b.py", "PY003"), ("b.py", "X_ANY")}


def test_paths_are_looked_up(spark):
    from workload.corpus import PATH_SQL, TEMPLATES, path_column
    keys = spark.range(23 * 29 * len(TEMPLATES)).withColumnRenamed("id", "o_orderkey")
    paths = keys.select(path_column().alias("a"), F.expr(PATH_SQL).alias("b"))
    assert paths.filter("not (a <=> b)").count() == 0
    assert keys.select(path_column())._jdf.queryExecution().executedPlan().toString().count("WHEN") < 10


def test_rules_that_share_an_expression_run_it_once(spark):
    from codesieve.catalog import specs
    rows = [("A", [r"x\s+y"], True), ("B", ["(", r"x\s+y"], True), ("C", [r"x\s+y"], False), ("D", ["none"], True)]
    rules = tables.local_table(spark, tables.RULE_FIELDS, [
        {"rule_id": i, "title": i, "description": i, "severity": "low", "confidence": "high", "owasp_category": "A04",
         "enabled": on, "rule_type": "regex", "regexes": regexes} for i, regexes, on in rows])
    texts = source_table(spark, [("a", "x  y\nx y"), ("b", "z")])
    found = scan.rule_table_scan(texts, rules, ["path"], "content")
    assert sorted((r.path, r.owner_id, r.pattern_no, r.match_no, r.line_number, r.column_number, r.title) for r in found.collect()) == [
        ("a", "A", 0, 1, 1, 0, "A"), ("a", "A", 0, 2, 2, 0, "A"), ("a", "B", 1, 1, 1, 0, "B"), ("a", "B", 1, 2, 2, 0, "B")]
    many = spark.range(1000).select(F.lit(r"x\s+y").alias("pattern"))
    assert len(specs.expression_specs(many)) == 1
    assert scan.rule_table_scan(texts, rules.filter("rule_id = 'C'"), ["path"], "content").count() == 0


def test_rules_of_one_expression_come_in_blocks(spark, tmp_path):
    """Every match meets every rule once, and written rows repeat few rules in one order: they take little room."""
    constants = {"title": "t", "description": "d", "severity": "low", "confidence": "high", "owasp_category": "A04", "rule_type": "regex"}
    rules = spark.range(20_000).select(
        F.concat(F.lit("R"), "id").alias("rule_id"), *[F.lit(v).alias(k) for k, v in constants.items()],
        F.lit(True).alias("enabled"), F.array(F.lit(r"x\s+y"), F.when(F.col("id") < 1300, "z$").otherwise("(")).alias("regexes"))
    texts = spark.range(200).select(F.concat(F.lit("p"), "id").alias("path"), F.when(F.col("id") == 7, "x  y\nz\nz").otherwise("x y").alias("content"))
    found = scan.rule_table_scan(texts, rules, ["path"], "content")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables too large to be sent around
    try:
        found.select("path", "owner_id", "pattern_no", "match_no", "line_number").write.parquet(str(tmp_path / "found"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    written = spark.read.parquet(str(tmp_path / "found"))
    by_path = written.groupBy("path", "pattern_no", "match_no", "line_number").agg(F.count("*").alias("n"), F.countDistinct("owner_id").alias("rules"))
    assert {(r.path, r.pattern_no, r.match_no, r.line_number, r.n, r.rules) for r in by_path.collect()} == {
        ("p7", 1, 1, 2, 1300, 1300), ("p7", 1, 2, 3, 1300, 1300), *((f"p{k}", 0, 1, 1, 20_000, 20_000) for k in range(200))}
    assert sum(f.stat().st_size for f in (tmp_path / "found").glob("*.parquet")) < 0.5 * 200 * 20_000
