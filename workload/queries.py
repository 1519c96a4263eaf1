"""Registered queries: every operator over the driver tables (or code files derived from them)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.catalog import fixed_values as V
from codesieve.catalog import manage, tables
from codesieve.catalog.specs import broken_patterns
from codesieve.functions.pymatch import PythonRule
from codesieve.functions.regex import RegexSpec
from codesieve.functions import content, paths, structural, text
from codesieve.operators import enrich, executions, filters, rollups, scan
from codesieve.options import ScanOptions
from codesieve.plans.scan import scan_table
from codesieve.sources.tables import file_profile, source_files
from workload.corpus import code_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MATCH_COLUMNS = ["pattern_no", "match_no", "line_number", "column_number", "matched_text"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# ------------------------------------------------------------------ inputs
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def with_secret(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Whole texts with a secret put into every third one, before or behind it by its key."""
    secret = F.concat(F.lit("\npassword = 'hunter"), F.col(key).cast("string"), F.lit("xx'\n"))
    return texts.withColumn(text, F.when(F.col(key) % 3 != 0, F.col(text))
                            .when(F.col(key) % 2 == 0, F.concat(secret, text)).otherwise(F.concat(text, secret)))


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All derived Python files, excluded directories included."""
    return filters.with_analyzer(code_files(spark, sf_dir))


def all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_files(spark, sf_dir).withColumn("language", paths.file_language(F.col("path")))


def scanned(spark: SparkSession, sf_dir: str, min_severity: str = "low", **kwargs) -> DataFrame:
    files = python_files(spark, sf_dir).select("path", "language", "text", "size")
    return scan.scan_files(files, min_severity, **kwargs)


def found(spark: SparkSession, sf_dir: str, min_severity: str = "low") -> DataFrame:
    return enrich.findings(scanned(spark, sf_dir, min_severity))


def positions(spark: SparkSession, sf_dir: str, min_severity: str = "low") -> DataFrame:
    """Enriched findings without snippets, for figures."""
    return enrich.enrich(enrich.flat_positions(scanned(spark, sf_dir, min_severity)))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.with_facts(python_files(spark, sf_dir)).select("path", "facts")


def joined(column: str) -> Column:
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


# ------------------------------------------------------------------ regex scans
@query
def secret_scan_documents(spark, sf_dir):
    return scan.rule_scan(documents(spark, sf_dir), ["doc_id"], ["PY003"]).select("doc_id", *MATCH_COLUMNS)


@query
def rule_scan_documents(spark, sf_dir):
    return scan.rule_scan(documents(spark, sf_dir), ["doc_id"]).select("doc_id", "rule_id", *MATCH_COLUMNS)


@query
def anchor_scan(spark, sf_dir):
    """Expressions that match nothing but places: starts and ends of lines."""
    anchors = [RegexSpec("ANCHOR", 0, "^"), RegexSpec("ANCHOR", 1, "$")]
    return scan.regex_scan(documents(spark, sf_dir), anchors, ["doc_id"]).select("doc_id", *MATCH_COLUMNS)


NAMED = "(?P<first_word>[A-Za-z]+) (?P<second>[a-z]+)[.]"


@query
def named_groups(spark, sf_dir):
    found = scan.regex_scan(documents(spark, sf_dir), [RegexSpec("NAMED", 0, NAMED)], ["doc_id"], with_groups=True)
    return found.select("doc_id", "match_no", F.col("named_groups")["first_word"].alias("first_word"),
                        F.col("named_groups")["second"].alias("second"))


@query
def rule_scan_pages(spark, sf_dir):
    pages = with_secret(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html")
    return scan.rule_scan(pages, ["page_id"], text="html").select("page_id", "rule_id", *MATCH_COLUMNS)


@query
def rule_scan_conversations(spark, sf_dir):
    turns = with_secret(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "text")
    return scan.rule_scan(turns, ["conv_id", "turn"]).select("conv_id", "turn", "rule_id", *MATCH_COLUMNS)


@query
def catalogue_scan_documents(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("language", F.lit("csharp"))
    return scan.catalogue_scan(docs, ["doc_id"]).select("doc_id", "pattern_id", *MATCH_COLUMNS)


@query
def catalogue_scan(spark, sf_dir):
    return scan.catalogue_scan(all_files(spark, sf_dir), ["path", "language"]).select(
        "path", "language", "pattern_id", "severity", *MATCH_COLUMNS)


@query
def match_groups(spark, sf_dir):
    """Capture groups of every catalogue match, unmatched groups as null."""
    matches = scan.rule_scan(python_files(spark, sf_dir), ["path"], with_groups=True)
    return matches.select("path", "rule_id", "pattern_no", "match_no", F.posexplode("groups").alias("group_no", "value"))


def _rule_query(name: str, rule_id: str) -> None:
    def run(spark, sf_dir):
        return scan.rule_scan(python_files(spark, sf_dir), ["path"], [rule_id]).select("path", *MATCH_COLUMNS)

    run.__name__ = name
    query(run)


RULE_QUERIES = {"secret_scan": "PY003", "debug_scan": "PY006", "ssrf_scan": "PY007", "log_scan": "PY008",
                "auth_scan": "PY009"}
for _name, _rule in RULE_QUERIES.items():
    _rule_query(_name, _rule)


@query
def dependency_audit(spark, sf_dir):
    return scan.dependency_audit(code_files(spark, sf_dir))


# ------------------------------------------------------------------ structural rules and facts
STRUCTURAL_QUERIES = {
    "sql_injection": ["sql_call", "sql_concatenation"], "command_injection": ["command_injection"],
    "weak_crypto": ["weak_hash", "weak_random"], "deserialization": ["unsafe_deserialization"],
    "auth_bypass": ["always_true"], "session_constant": ["constant_session"],
    "path_traversal": ["path_traversal"], "template_xss": ["template_xss"],
    "exception_leak": ["exception_disclosure"], "debug_print": ["debug_print"],
}


def _structural_query(name: str, rules: list[str]) -> None:
    def run(spark, sf_dir):
        return scan.structural_scan(facts(spark, sf_dir), rules, ["path"]).select(
            "path", "rule_id", "title", "severity", "confidence", "line_number", "column_number")

    run.__name__ = name
    query(run)


for _name, _rules in STRUCTURAL_QUERIES.items():
    _structural_query(_name, _rules)


@query
def parse_status(spark, sf_dir):
    return facts(spark, sf_dir).select("path", F.col("facts.parsed").alias("parsed"))


@query
def imports(spark, sf_dir):
    return scan.code_imports(facts(spark, sf_dir), ["path"])


@query
def risky_imports(spark, sf_dir):
    return scan.risky_imports(facts(spark, sf_dir), ["path"])


@query
def functions(spark, sf_dir):
    return scan.code_functions(facts(spark, sf_dir), ["path"]).select(
        "path", "name", "line_number", joined("args"), joined("decorators"), "has_docstring", "complexity")


@query
def complexity_by_file(spark, sf_dir):
    return facts(spark, sf_dir).select(
        "path", F.size("facts.functions").cast("long").alias("function_count"),
        F.aggregate("facts.functions", F.lit(0), lambda a, f: a + f["complexity"]).cast("long").alias("total_complexity"))


@query
def function_quality(spark, sf_dir):
    return scan.function_quality(facts(spark, sf_dir), ["path"]).select(
        "path", "name", "too_complex", "undocumented")


# ------------------------------------------------------------------ scalar functions
@query
def finding_snippets(spark, sf_dir):
    """Lines around the middle line of every document."""
    docs = documents(spark, sf_dir)
    lines = text.split_lines(F.col("text"))
    return docs.select("doc_id", lines.alias("lines")).select(
        "doc_id", F.size("lines").cast("long").alias("line_count"),
        text.snippet(F.col("lines"), (F.size("lines") / 2).cast("int") + 1).alias("snippet"))


@query
def highlighted(spark, sf_dir):
    """The text with every occurrence of its own first word marked."""
    word = F.substring_index(F.col("text"), " ", 1)
    return documents(spark, sf_dir).select("doc_id", F.md5(text.highlight(F.col("text"), word)).alias("marked_md5"))


@query
def code_snippets(spark, sf_dir):
    """Numbered lines around line 3 of every document."""
    snippet = text.code_snippet(F.col("text"), F.lit(3), F.concat(F.lit("d"), "doc_id"), F.lit(None).cast("string"))
    return documents(spark, sf_dir).select("doc_id", snippet.alias("s")).filter("s is not null") \
        .select("doc_id", F.col("s.start_line").alias("start_line"), F.col("s.end_line").alias("end_line"),
                F.explode("s.lines").alias("l")) \
        .select("doc_id", "start_line", "end_line", "l.line_number", "l.content", "l.is_target")


@query
def loc_nonblank(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.nonblank_lines(F.col("text")).cast("long").alias("loc"))


@query
def loc_code(spark, sf_dir):
    return all_files(spark, sf_dir).select(
        "path", text.code_lines(F.col("text"), F.col("language")).cast("long").alias("code_lines"))


@query
def text_hash(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select(
        "doc_id", text.content_hash(t, "md5").alias("md5"), text.content_hash(t, "sha1").alias("sha1"),
        text.content_hash(t, "sha256").alias("sha256"), F.length(text.content_hash(t, "sha512")).alias("sha512_length"),
        text.content_hash(t, "crc").alias("unknown"))


@query
def file_language(spark, sf_dir):
    p = F.col("path")
    return code_files(spark, sf_dir).select(
        "path", paths.base_name(p).alias("name"), paths.extension(p).alias("extension"),
        paths.file_language(p).alias("language"), paths.media_type(p).alias("mime_type"))


@query
def line_access(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select(
        "doc_id", F.size(F.split(t, "\n", -1)).cast("long").alias("lines"),
        text.text_line(t, F.lit(2)).alias("second_line"),
        F.array_join(text.text_line_range(t, F.lit(2), F.lit(4)), "|").alias("lines_2_to_4"))


@query
def offset_positions(spark, sf_dir):
    middle = (F.length("text") / 2).cast("int")
    return documents(spark, sf_dir).select(
        "doc_id", text.line_of(F.col("text"), middle).cast("long").alias("line"),
        text.column_of(F.col("text"), middle).cast("long").alias("column_number"))


@query
def severity_rank(spark, sf_dir):
    """Severity words derived from order priorities, unknown ones included."""
    word = F.lower(F.substring_index("o_orderpriority", "-", -1))
    named = F.when(word == "urgent", "CRITICAL").otherwise(word)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", named.alias("severity"))
    return orders.withColumn("score", text.severity_score(F.col("severity"))) \
        .withColumn("reported", filters.reaches_severity(F.col("severity"), "medium"))


@query
def category_codes(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for pair in V.CATEGORIES for x in pair])
    findings = found(spark, sf_dir)
    code = text.category_code(F.col("owasp_category_name"))
    return findings.select("filename", "rule_id", "line_number", "column_number", code.alias("code"),
                           text.category_title(code, names[code]).alias("title"))


@query
def file_sizes(spark, sf_dir):
    size = F.octet_length("text")
    return documents(spark, sf_dir).select("doc_id", F.round(text.size_mb(size), 4).alias("size_mb"))


# ------------------------------------------------------------------ file content
def _encoded(spark, sf_dir) -> DataFrame:
    """Documents as bytes in several encodings, by document id."""
    t, n = F.col("text"), F.col("doc_id") % 4
    latin = ~t.rlike("[^\\x00-\\xff]")
    return documents(spark, sf_dir).select(
        "doc_id", "text", F.when(n == 1, F.encode(t, "UTF-16"))
        .when((n == 2) & latin, F.encode(t, "ISO-8859-1"))
        .otherwise(F.encode(t, "UTF-8")).alias("content"))


@query
def decoded_text(spark, sf_dir):
    return _encoded(spark, sf_dir).select("doc_id", F.md5(content.decode_text(F.col("content"))).alias("text_md5"))


@query
def text_detection(spark, sf_dir):
    docs, raw = _encoded(spark, sf_dir), F.col("content")
    ext = F.element_at(F.array(*[F.lit(e) for e in (".py", ".zip", ".dat")]), (F.col("doc_id") % 3 + 1).cast("int"))
    path, size = F.concat(F.lit("d/"), "doc_id", ext), F.length("content").cast("long")
    return docs.select(
        "doc_id", content.is_text(path, raw, size).alias("is_text"),
        content.is_safe_to_read(path, raw, size, 2000).alias("safe_2000"))


@query
def encoding_detection(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return docs.select("doc_id", content.detect_encoding(F.col("content")).alias("encoding"))


@query
def file_profiles(spark, sf_dir):
    files = code_files(spark, sf_dir).select("path", F.encode("text", "UTF-8").alias("content"))
    return file_profile(files).withColumn("lines", F.col("lines").cast("long"))


# ------------------------------------------------------------------ filters
PRUNE_GLOBS = ["venv", "node_modules", "src/r1*", "m?7"]
SIZE_LIMIT = 150


@query
def excluded_files(spark, sf_dir):
    """Files kept by the default exclusions, test globs and one user exclusion."""
    options = ScanOptions.of().with_exclusions("src/r9?/*")
    return filters.exclude_paths(code_files(spark, sf_dir), options.exclusion_globs).select("path")


@query
def included_tests(spark, sf_dir):
    options = ScanOptions.of(include_tests=True)
    return filters.exclude_paths(code_files(spark, sf_dir), options.exclusion_globs).select("path")


@query
def pruned_directories(spark, sf_dir):
    return filters.prune_directories(code_files(spark, sf_dir), PRUNE_GLOBS).select("path")


@query
def size_filter(spark, sf_dir):
    return filters.limit_size(code_files(spark, sf_dir), SIZE_LIMIT).select("path", "size")


@query
def analyzer_dispatch(spark, sf_dir):
    files = filters.with_analyzer(code_files(spark, sf_dir))
    return filters.only_language(files, "python").select("path", "language")


@query
def severity_filter(spark, sf_dir):
    return filters.at_least(found(spark, sf_dir), "high").select(
        "filename", "rule_id", "severity", "line_number", "column_number")


@query
def safe_paths(spark, sf_dir):
    host_path = F.regexp_replace("url", "^https?://", "")
    n = F.col("page_id") % 5
    path = F.when(n == 0, F.concat(F.lit("site/"), host_path)).when(n == 1, F.concat(F.lit("/srv/site/./x/.."), F.lit("/"), host_path)) \
        .when(n == 2, F.concat(F.lit("../../etc/"), host_path)).when(n == 3, F.concat(F.lit("/srv/site2/"), host_path)) \
        .otherwise(F.concat(F.lit("site//a/../../site/"), host_path))
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return pages.select("page_id", paths.normalize_path(F.col("path"), "/srv").alias("normalized"),
                        paths.is_safe_path(F.col("path"), "/srv/site", "/srv").alias("is_safe"))


@query
def files_with_findings(spark, sf_dir):
    return rollups.files_with_findings(scanned(spark, sf_dir)).select("filename")


@query
def clean_files(spark, sf_dir):
    return rollups.clean_files(scanned(spark, sf_dir)).select("filename")


@query
def separate_clean_files(spark, sf_dir):
    """Python files without a finding, files and findings being separate tables."""
    files = python_files(spark, sf_dir).select(F.col("path").alias("filename"))
    debug = scan.rule_scan(python_files(spark, sf_dir), ["path"], ["PY006"]).withColumnRenamed("path", "filename")
    return rollups.files_in(files, debug, present=False)


# ------------------------------------------------------------------ findings and roll-ups
@query
def enriched_findings(spark, sf_dir):
    return found(spark, sf_dir).select(
        "filename", "rule_id", "title", "severity", "confidence", "owasp_category", "owasp_category_name",
        "pattern_id", "line_number", "column_number", F.md5("code_snippet").alias("snippet_md5"),
        F.md5("highlighted_code").alias("highlighted_md5"), joined("cwe_ids"), joined("tags"), joined("references"))


@query
def end_to_end_scan(spark, sf_dir):
    """The whole scan with default options: filters, rules, enrichment, severity threshold."""
    files = code_files(spark, sf_dir).select("path", "text")
    return scan_table(files, content="text").findings.select(
        "filename", "rule_id", "severity", "owasp_category_name", "line_number", "column_number")


@query
def binary_scan(spark, sf_dir):
    """The same scan over raw bytes, rolled up by rule."""
    files = code_files(spark, sf_dir).select("path", F.encode("text", "UTF-8").alias("content"))
    return scan_table(files).findings.groupBy("rule_id", "severity").agg(F.count("*").alias("finding_count"))


@query
def file_results(spark, sf_dir):
    return rollups.file_report(scanned(spark, sf_dir, "medium")).select(
        "filename", "language", "error", "file_size", F.col("lines_of_code").cast("long").alias("lines_of_code"),
        F.col("vulnerability_count").cast("long").alias("vulnerability_count"))


@query
def severity_by_file(spark, sf_dir):
    return rollups.severity_by_file(scanned(spark, sf_dir)).select(
        "filename", *[F.col(s).cast("long").alias(s) for s in rollups.SEVERITY_NAMES])


@query
def severity_total(spark, sf_dir):
    return rollups.severity_totals(scanned(spark, sf_dir))


@query
def category_counts(spark, sf_dir):
    return rollups.category_counts(positions(spark, sf_dir))


@query
def cwe_counts(spark, sf_dir):
    return rollups.cwe_counts(positions(spark, sf_dir))


@query
def cwe_top5(spark, sf_dir):
    return rollups.top_cwes(positions(spark, sf_dir))


@query
def exec_breakdown(spark, sf_dir):
    return rollups.breakdown(positions(spark, sf_dir))


@query
def category_groups(spark, sf_dir):
    return rollups.category_groups(positions(spark, sf_dir))


@query
def findings_by_category(spark, sf_dir):
    return rollups.findings_by_category(found(spark, sf_dir)).select(
        "category", "category_title", "filename", "rule_id", "line_number", "column_number")


@query
def scan_gate(spark, sf_dir):
    return rollups.gate(scanned(spark, sf_dir, "critical"))


# ------------------------------------------------------------------ execution log
@query
def exec_log(spark, sf_dir):
    rules = manage.set_enabled(tables.rules(spark), False, "PY009", "PY013")
    log = executions.rule_executions(scanned(spark, sf_dir), rules)
    return log.select("filename", "rule_id", "status", F.col("match_count").cast("long").alias("match_count"),
                      "error_message", F.size("warnings").cast("long").alias("warning_count"))


@query
def exec_log_summary(spark, sf_dir):
    rules = manage.set_enabled(tables.rules(spark), False, "PY009", "PY013")
    return executions.execution_summary(executions.rule_executions(scanned(spark, sf_dir), rules)) \
        .withColumn("match_rate", F.round("match_rate", 6))


@query
def match_counts(spark, sf_dir):
    """Matches per rule and file, without a limit."""
    log = executions.rule_executions(scanned(spark, sf_dir), tables.rules(spark))
    return log.filter("match_count > 0").select(
        "filename", "rule_id", F.size("matches").cast("long").alias("match_count"))


@query
def replaced_rule_scan(spark, sf_dir):
    """PY004 replaced by a regular expression: its built-in check no longer runs."""
    rules = manage.upsert_rules(tables.rules(spark), tables.rules(spark).filter("rule_id = 'PY004'").withColumns({
        "title": F.lit("import statement"), "rule_type": F.lit("regex"), "regexes": F.array(F.lit("import "))}))
    return scanned(spark, sf_dir, rules=rules).select("filename", F.explode("findings").alias("f")) \
        .filter("f.rule_id = 'PY004'").select("filename", "f.title", "f.line_number", "f.column_number")


@query
def retuned_rule_scan(spark, sf_dir):
    """PY005 renamed and lowered, PY002 kept: the table decides title, severity and threshold."""
    rules = tables.rules(spark).filter("rule_id in ('PY002', 'PY005')") \
        .withColumn("title", F.when(F.col("rule_id") == "PY005", "renamed").otherwise(F.col("title"))) \
        .withColumn("severity", F.when(F.col("rule_id") == "PY005", "medium").otherwise(F.col("severity")))
    return scanned(spark, sf_dir, "medium", rules=rules).select("filename", F.explode("findings").alias("f")) \
        .select("filename", "f.rule_id", "f.title", "f.severity", "f.line_number", "f.column_number")


@query
def file_results_nested(spark, sf_dir):
    """Nested findings of file reports with their snippets, over the whole documents as Python comments and calls."""
    text = F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# ")), F.lit("\nDEBUG = True\n"))
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id", F.lit(".py")).alias("path"), text.alias("text"))
    rules = tables.rules(spark).filter("rule_id = 'PY006'")
    report = rollups.file_report(scan_table(files, content="text", rules=rules).file_results)
    return report.select("filename", F.explode("findings").alias("f")).select(
        "filename", "f.rule_id", "f.line_number", F.md5("f.code_snippet").alias("snippet_md5"),
        F.md5("f.highlighted_code").alias("highlighted_md5"))


@query
def broken_rule_log(spark, sf_dir):
    """A rule whose expression does not compile is logged as an error; the others run."""
    rules = tables.rules(spark).filter("rule_id in ('PY006', 'PY009')").withColumn(
        "regexes", F.when(F.col("rule_id") == "PY009", F.array(F.lit("(abc"))).otherwise(F.col("regexes")))
    log = executions.rule_executions(scanned(spark, sf_dir, rules=rules), rules)
    return log.select("filename", "rule_id", "status", F.col("match_count").cast("long").alias("match_count"))


@query
def exec_status(spark, sf_dir):
    return executions.status_breakdown(executions.rule_executions(scanned(spark, sf_dir), tables.rules(spark)))


@query
def category_executions(spark, sf_dir):
    rules = tables.rules(spark)
    log = executions.rule_executions(scanned(spark, sf_dir), rules)
    return executions.executions_of_category(log, rules, "A03").select(
        "filename", "rule_id", F.col("match_count").cast("long").alias("match_count"))


MATCH_CAP = 10


@query
def match_cap(spark, sf_dir):
    """Matches per rule and file limited to ten, with the warning flag."""
    log = executions.rule_executions(scanned(spark, sf_dir), tables.rules(spark), MATCH_CAP)
    return log.filter("match_count > 0").select(
        "filename", "rule_id", F.size("matches").cast("long").alias("match_count"),
        F.element_at("matches", -1)["line_number"].alias("last_line"),
        (F.size("warnings") > 0).alias("limited"))


# ------------------------------------------------------------------ rules as data
@query
def rule_activity(spark, sf_dir):
    """Every rule with its metadata and finding count, rules without findings included."""
    counts = positions(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("n"))
    return manage.rule_metadata(tables.rules(spark)).join(counts, "rule_id", "left").select(
        "rule_id", "title", "severity", "owasp_category", "confidence", "enabled",
        F.coalesce("n", F.lit(0)).alias("finding_count"))


@query
def category_rules_scan(spark, sf_dir):
    """Only the enabled rules of one category are executed."""
    rules = manage.select_rules(tables.rules(spark), category="A02", enabled_only=True)
    return enrich.findings(scanned(spark, sf_dir, rules=rules)).groupBy("rule_id", "severity") \
        .agg(F.count("*").alias("finding_count"))


@query
def disabled_rules_scan(spark, sf_dir):
    rules = manage.remove_rules(manage.set_enabled(tables.rules(spark), False, "PY006", "PY001"), "PY015")
    return enrich.findings(scanned(spark, sf_dir, rules=rules)).groupBy("rule_id") \
        .agg(F.count("*").alias("finding_count"))


@query
def custom_rule_scan(spark, sf_dir):
    """A user rule is added, one built-in rule is replaced, one invalid rule is rejected."""
    new = tables.local_table(spark, tables.RULE_FIELDS, [
        {"rule_id": "X_IMPORT", "title": "OS import", "description": "imports os", "severity": "low",
         "confidence": "high", "owasp_category": "A04", "enabled": True, "rule_type": "regex",
         "regexes": [r"(?i)import\s+os"]},
        {"rule_id": "PY006", "title": "Debug constant", "description": "debug", "severity": "high",
         "confidence": "high", "owasp_category": "A05", "enabled": True, "rule_type": "regex",
         "regexes": [r"DEBUG\s*=\s*True"]},
        {"rule_id": "X_BAD", "title": "bad", "description": "bad", "severity": "fatal", "confidence": "high",
         "owasp_category": "A05", "enabled": True, "rule_type": "regex", "regexes": ["True"]}])
    rules = manage.upsert_rules(tables.rules(spark), new)
    return enrich.findings(scanned(spark, sf_dir, rules=rules)) \
        .groupBy("rule_id", "owasp_category", "owasp_category_name").agg(F.count("*").alias("finding_count"))


@query
def custom_structural_rule(spark, sf_dir):
    """A user rule over facts: calls of functions named open with one argument."""
    def single_open(f: Column) -> Column:
        return F.transform(
            F.filter(f["calls"], lambda c: (c["name_full"] == "open") & (F.size(c["args"]) == 1)),
            lambda c: structural.match("X_OPEN", "Open call", "low", "low", "A01", c, F.lit("open call")))

    return scan.structural_scan(facts(spark, sf_dir), [single_open], ["path"]).select(
        "path", "rule_id", "line_number", "column_number")


@query
def python_rule(spark, sf_dir):
    """An arbitrary Python rule: lines longer than forty characters."""
    def long_lines(path, source):
        return [{"rule_id": "X_LONG", "title": "Long line", "severity": "low", "confidence": "high",
                 "owasp_category": "GEN", "detail": "long line", "line_number": n}
                for n, line in enumerate(source.split("\n"), 1) if len(line) > 40]

    return scan.python_rule(python_files(spark, sf_dir), long_lines).filter("error is null").select(
        "filename", "rule_id", "line_number")


#: Expressions as users write them, each with a second spelling that any engine reads.
USER_EXPRESSIONS = [
    (r"f\({}\)", r"f\(\{\}\)"), ("th{,2}e", "th{0,2}e"), ("(a)?b(?(1)c| )", "abc|b "), (r"(?x) the \s+ [a-z]+  # two words", r"the\s+[a-z]+"),
    (r"(?a)\w+ing ", "[0-9A-Za-z_]+ing "), (r"(?s)\AT.", r"\A(?s:T.)"), (r"(?P<one>[aeiou])(?:x|yz)", "[aeiou](?:x|yz)"), (r"\d+\Z", r"[0-9]+\z")]


def user_texts(spark, sf_dir):
    """Whole documents; every third one ends with a call of braces and its number."""
    mark = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\nf({}) abc ab b "), F.col("doc_id").cast("string"))).otherwise("")
    return documents(spark, sf_dir).withColumn("text", F.concat("text", mark))


@query
def user_expression_scan(spark, sf_dir):
    """Expressions that Java reads otherwise or not at all, by whichever engine can run them."""
    users = [RegexSpec("USER", n, p) for n, (p, _) in enumerate(USER_EXPRESSIONS)]
    return scan.regex_scan(user_texts(spark, sf_dir), users, ["doc_id"]).select("doc_id", *MATCH_COLUMNS)


@query
def broken_expression_scan(spark, sf_dir):
    """A catalogue with a pattern that does not compile: the others run, and the broken one is reported."""
    patterns = tables.patterns(spark).filter("pattern_id in ('A02_001', 'A05_001')").withColumn(
        "regex_patterns", F.when(F.col("pattern_id") == "A02_001", F.concat(F.array(F.lit("(abc")), "regex_patterns")).otherwise(F.col("regex_patterns")))
    found = scan.catalogue_scan(all_files(spark, sf_dir), ["path", "language"], patterns).groupBy("pattern_id", "pattern_no") \
        .agg(F.count("*").alias("match_count"))
    broken = broken_patterns(patterns).select("pattern_id", "pattern_no", F.lit(None).cast("long").alias("match_count"))
    return found.unionByName(broken)


@query
def indexed_rule_scan(spark, sf_dir):
    """A rule for the name of every part over whole documents that each name one: found through the word index."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rules = parts.select(
        F.concat(F.lit("P"), "p_partkey").alias("rule_id"), F.lit("part").alias("title"), F.lit("names a part").alias("description"),
        F.lit("low").alias("severity"), F.lit("high").alias("confidence"), F.lit("A04").alias("owasp_category"), F.lit(True).alias("enabled"),
        F.lit("regex").alias("rule_type"), F.array(F.concat(F.lit("(?i)^part:\\s+"), F.replace("p_name", F.lit(" "), F.lit("\\s+")), F.lit("$"))).alias("regexes"))
    named = documents(spark, sf_dir).join(parts, F.col("doc_id") * 7 % parts_in(spark, sf_dir) + 1 == F.col("p_partkey"))
    texts = named.select("doc_id", F.concat("text", F.lit("\nPart: "), F.upper("p_name")).alias("text"))
    return scan.rule_table_scan(texts, rules, ["doc_id"]).select(
        "doc_id", F.col("owner_id").alias("rule_id"), "line_number", "column_number")


def parts_in(spark, sf_dir) -> int:
    return table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]


def python_rules() -> list[PythonRule]:
    """Long lines (low), lines that name a password (medium, high in files of even number), and one that fails on some files."""
    def long_lines(path, text):
        return [{"line_number": n, "detail": "long line"} for n, line in enumerate(text.split("\n"), 1) if len(line) > 40]

    def passwords(path, text):
        for n, line in enumerate(text.split("\n"), 1):
            if "password" in line:
                yield {"line_number": n, "column_number": line.index("password"), "severity": "high" if len(path) % 2 == 0 else "medium"}

    def fragile(path, text):
        if len(path) % 3 == 0:
            raise ValueError(f"cannot judge {path}")
        return [{}]

    return [PythonRule("X_LONG", long_lines, "Long line", "low"), PythonRule("X_PASS", passwords, "Password", "medium", owasp_category="A02"),
            PythonRule("X_FRAGILE", fragile, "Fragile", "critical")]


@query
def python_rule_findings(spark, sf_dir):
    """Python rules in a whole scan: threshold, enrichment and snippets as for all other rules."""
    files = code_files(spark, sf_dir).select("path", "text")
    done = scan_table(files, ScanOptions.of(min_severity="medium"), content="text", python_rules=python_rules())
    return done.findings.filter("rule_id like 'X%'").select(
        "filename", "rule_id", "severity", "owasp_category_name", "line_number", "column_number", F.md5("code_snippet").alias("snippet_md5"))


@query
def python_rule_log(spark, sf_dir):
    """Log of Python rules beside built-in ones; where one raised, it has status error and its message."""
    rules = tables.rules(spark).filter("rule_id in ('PY006', 'PY009')")
    done = scanned(spark, sf_dir, rules=rules, python_rules=python_rules())
    return executions.rule_executions(done, rules, python_rules=python_rules()).select(
        "filename", "rule_id", "status", F.col("match_count").cast("long").alias("match_count"), "error_message")


@query
def custom_rule_threshold(spark, sf_dir):
    """Custom structural rules answer to the threshold too: one of two is below it."""
    def opens(rule_id: str, severity: str):
        return lambda f: F.transform(F.filter(f["calls"], lambda c: (c["name_full"] == "open") & (F.size(c["args"]) == 1)),
                                     lambda c: structural.match(rule_id, "Open call", severity, "low", "A01", c, F.lit("open call")))

    done = scanned(spark, sf_dir, "medium", rules=tables.rules(spark).filter("rule_id = 'PY006'"), custom_rules=[opens("X_LOW", "low"), opens("X_HIGH", "high")])
    return done.select("filename", F.explode("findings").alias("f")).filter("f.rule_id like 'X%'").groupBy("f.rule_id", "f.severity") \
        .agg(F.count("*").alias("finding_count"))


@query
def new_language_scan(spark, sf_dir):
    """A second analyzer (by extension) with the catalogue expressions of its language."""
    analyzers = {"python": [".py", ".pyw"], "javascript": [".js"]}
    files = filters.only_language(filters.with_analyzer(code_files(spark, sf_dir), analyzers), "javascript", analyzers)
    return scan.catalogue_scan(files, ["path", "language"]).groupBy("language", "pattern_id") \
        .agg(F.count("*").alias("match_count"))


@query
def patterns_per_language(spark, sf_dir):
    """Files and applicable patterns of each language."""
    files = all_files(spark, sf_dir).groupBy("language").agg(F.count("*").alias("files"))
    patterns = manage.patterns_by_language(tables.patterns(spark)).groupBy("language") \
        .agg(F.count("*").alias("patterns"))
    return files.join(patterns, "language")


@query
def pattern_search(spark, sf_dir):
    """Findings of the patterns whose tags mention injection."""
    hits = manage.search_patterns(tables.patterns(spark), "injection", "tags").select("pattern_id", "name")
    return positions(spark, sf_dir).join(F.broadcast(hits), "pattern_id").groupBy("pattern_id", "name") \
        .agg(F.count("*").alias("finding_count"))


def candidate_rules(spark, sf_dir) -> DataFrame:
    """Rule rows derived from parts, many of them invalid."""
    n = F.col("p_partkey")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.when(n % 11 == 0, F.lit("")).when(n % 11 == 1, F.concat(F.lit("rule!"), n))
        .when(n % 11 == 2, F.repeat(F.lit("r"), 51)).otherwise(F.concat(F.lit("R-"), n)).alias("rule_id"),
        F.col("p_name").alias("title"), F.when(n % 7 != 0, F.col("p_type")).alias("description"),
        pick(["low", "medium", "high", "critical", "fatal"], n).alias("severity"),
        pick(["low", "medium", "high", "sure"], n).alias("confidence"),
        pick(["A01", "A10", "GEN"], n).alias("owasp_category"), (n % 2 == 0).alias("enabled"),
        F.when(n % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("regexes"),
        (n % 3 == 1).alias("structural"), (n % 9 == 2).alias("semantic"), n.alias("part"))


@query
def rule_validation(spark, sf_dir):
    rules = candidate_rules(spark, sf_dir).withColumn("rule_type", manage.rule_type())
    return manage.validate_rules(rules).select(
        "part", "rule_type", F.size("errors").cast("long").alias("error_count"),
        F.size("warnings").cast("long").alias("warning_count"), "is_valid")


@query
def rule_upsert(spark, sf_dir):
    """Derived rules upserted into a derived rule table, counted by category and state."""
    rules = candidate_rules(spark, sf_dir).withColumn("rule_type", manage.rule_type()) \
        .filter(F.col("rule_id").startswith("R-"))
    current = rules.filter(F.col("part") % 2 == 0)
    changed = rules.filter(F.col("part") % 4 != 1).withColumn("enabled", F.lit(False))
    return manage.upsert_rules(current, changed).groupBy("owasp_category", "enabled").agg(
        F.count("*").alias("rules"))


@query
def rule_versions(spark, sf_dir):
    """Versions of rules from the parts table, all in one batch: the latest valid version of each id counts."""
    new = table(spark, sf_dir, "part").select(
        F.concat(F.lit("V"), (F.col("p_partkey") % 97).cast("string")).alias("rule_id"), F.col("p_name").alias("title"),
        F.col("p_type").alias("description"), F.when(F.col("p_size") % 4 == 0, "fatal").otherwise("low").alias("severity"),
        F.lit("high").alias("confidence"), F.lit("A04").alias("owasp_category"), F.lit(True).alias("enabled"), F.lit("regex").alias("rule_type"),
        F.array(F.when(F.col("p_size") % 7 == 0, F.lit("(x")).otherwise(F.col("p_brand"))).alias("regexes"), F.col("p_partkey").alias("version"))
    rules = manage.upsert_rules(tables.rules(spark), new, "version")
    return rules.filter("rule_id like 'V%'").select("rule_id", "title", "description", F.get("regexes", F.lit(0)).alias("expression"))


@query
def derived_rule_statistics(spark, sf_dir):
    rules = candidate_rules(spark, sf_dir).withColumn("rule_type", manage.rule_type())
    return manage.rule_statistics(rules).select(
        "total_rules", "enabled_rules", *[f"{t}_rules" for t in V.RULE_TYPES], joined("categories"),
        "distinct_ids")


@query
def derived_rules_by_type(spark, sf_dir):
    rules = candidate_rules(spark, sf_dir).withColumn("rule_type", manage.rule_type())
    return manage.rules_by_type(rules)


@query
def derived_rules_by_category(spark, sf_dir):
    return manage.rules_by_category(candidate_rules(spark, sf_dir))


@query
def source_table(spark, sf_dir):
    """Pages as a file table: any relation with a path and a content column can be scanned."""
    pages = table(spark, sf_dir, "pages")
    files = source_files(pages, F.concat(F.lit("p/"), "page_id", F.lit(".html")), "html")
    return files.select("path", "size", text.nonblank_lines(F.col("text")).cast("long").alias("loc"))
