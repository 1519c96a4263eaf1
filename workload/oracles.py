"""Reference SQL (DuckDB) for the registered queries.

Regex scans use the RE2 engine of the database; structural rules use the matches written by hand
next to each template.  Five expressions need lookahead, which RE2 lacks; their matches are
written by hand as well.
"""

from __future__ import annotations

from codesieve.catalog import fixed_values as V
from codesieve.catalog import prose, tables
from codesieve.functions.paths import MEDIA_TYPES
from workload.corpus import CODE_FILES_CTE, K, TEMPLATES, language_case, python_templates, quote
from workload.queries import MATCH_CAP, RULE_QUERIES, SIZE_LIMIT, STRUCTURAL_QUERIES, USER_EXPRESSIONS

SPACES = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

RULES = {r[0]: r for r in V.RULES}
PATTERNS = {p["pattern_id"]: p for p in tables.pattern_rows()}
NAMES = dict(V.CATEGORIES)
RULE_SPECS = [(r, n, p) for r, ps in V.RULE_REGEXES.items() for n, p in enumerate(ps)]
LOOKAHEAD = {("A01_002", 0), ("A01_002", 1), ("A01_002", 2), ("A04_001", 1), ("A04_001", 2)}


def sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return str(value)
    return "(" + quote(value) + ")"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(sql(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ------------------------------------------------------------------ building blocks
def matches_of(source: str, keys: str, owner: str, number: int, pattern: str, text: str = "text",
               where: str = "TRUE") -> str:
    """All matches of one expression with their positions."""
    p = sql(pattern)
    return f"""
SELECT {keys}, '{owner}' AS owner_id, CAST({number} AS INTEGER) AS pattern_no, CAST(i AS INTEGER) AS match_no,
  CAST(1 + length(prefix) - length(replace(prefix, chr(10), '')) AS INTEGER) AS line_number,
  CAST(length(string_split(prefix, chr(10))[-1]) AS INTEGER) AS column_number, matched_text
FROM (SELECT {keys}, i, ms[i] AS matched_text,
    array_to_string(list_transform(range(1, i + 1), lambda j: ps[j] || CASE WHEN j < i THEN ms[j] ELSE '' END), '') AS prefix
  FROM (SELECT {keys}, ms, ps, unnest(range(1, len(ms) + 1)) AS i
    FROM (SELECT {keys}, regexp_extract_all({text}, {p}) AS ms, string_split_regex({text}, {p}) AS ps
      FROM {source} WHERE {where} AND regexp_matches({text}, {p}))))"""


def all_matches(source: str, keys: str, specs: list[tuple], text: str = "text") -> str:
    return "\nUNION ALL".join(matches_of(source, keys, *spec[:3], text=text,
                                         where=spec[3] if len(spec) > 3 else "TRUE") for spec in specs)


PY_FILES = f"py_files AS (SELECT * FROM code_files WHERE template_id IN ({', '.join(map(str, python_templates()))}))"
ALL_FILES = f"all_files AS (SELECT *, {language_case()} AS language FROM code_files)"


def _expected() -> list[tuple]:
    rows = []
    for i, template in enumerate(TEMPLATES):
        for rule, line, column, *variant in template.matches:
            _, title, severity, confidence, category, _ = RULES[rule]
            if variant == ["concat"]:
                confidence = "medium"
            if variant == ["random"]:
                title, severity = V.WEAK_RANDOM_TITLE, "medium"
            rows.append((i, rule, title, severity, confidence, category, line, column))
    return rows


EXPECTED = values("expected", "template_id, rule_id, title, severity, confidence, owasp_category, line_number, column_number",
                  _expected())
RULE_DIM = values("rule_dim", "rule_id, title, severity, confidence, owasp_category, pattern_id", list(V.RULES))
PATTERN_DIM = values("pattern_dim", "pattern_id, category, cwe_ids, tags, refs", [
    (p["pattern_id"], f"{p['owasp_category']}: {NAMES[p['owasp_category']]}", ",".join(map(str, p["cwe_ids"])),
     ",".join(p["tags"]), ",".join(p["references"])) for p in PATTERNS.values()])
REGEX_MATCHES = f"regex_matches AS ({all_matches('py_files', 'file_id, path, template_id', RULE_SPECS)})"
FINDINGS = """findings AS (
SELECT f.file_id, f.path AS filename, e.rule_id, e.title, e.severity, e.confidence, e.owasp_category,
  CAST(e.line_number AS INTEGER) AS line_number, CAST(e.column_number AS INTEGER) AS column_number, '' AS matched_text
FROM py_files f JOIN expected e USING (template_id)
UNION ALL
SELECT m.file_id, m.path, r.rule_id, r.title, r.severity, r.confidence, r.owasp_category, m.line_number,
  m.column_number, m.matched_text
FROM regex_matches m JOIN rule_dim r ON m.owner_id = r.rule_id)"""
ENRICHED = """enriched AS (
SELECT f.*, p.pattern_id, p.category AS owasp_category_name, p.cwe_ids, p.tags, p.refs
FROM findings f JOIN rule_dim r ON f.rule_id = r.rule_id JOIN pattern_dim p ON r.pattern_id = p.pattern_id)"""
BASE = (CODE_FILES_CTE, PY_FILES, EXPECTED, RULE_DIM, PATTERN_DIM, REGEX_MATCHES, FINDINGS, ENRICHED)

SEVERITY_SCORE = "CASE {} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 1 END"


def secret_source(table: str, keys: str, key: str, text: str) -> str:
    """Whole texts with a secret put into every third one, before or behind it by its key."""
    secret = f"chr(10) || 'password = ''hunter' || {key} || 'xx''' || chr(10)"
    return (f"(SELECT {keys}, CASE WHEN {key} % 3 <> 0 THEN {text} WHEN {key} % 2 = 0 THEN {secret} || {text} "
            f"ELSE {text} || {secret} END AS {text} FROM {table})")


def lines_of(text: str) -> str:
    pieces = f"string_split_regex({text}, {sql(LINE_ENDS)})"
    return (f"(CASE WHEN {pieces}[-1] = '' THEN list_slice({pieces}, 1, len({pieces}) - 1) ELSE {pieces} END)")


def loc_of(text: str) -> str:
    return f"len(list_filter({lines_of(text)}, lambda l: regexp_matches(l, {sql('[^' + SPACES + ']')})))"


def window_of(lines: str, line: str, before: int, after: int) -> str:
    return f"list_slice({lines}, greatest(1, {line} - {before}), least(len({lines}), {line} + {after}))"


def glob(path: str, *globs: str) -> str:
    """GLOB has '*' crossing '/', as the exclusion globs do."""
    name = f"regexp_extract({path}, '[^/]*$')"
    tests = []
    for g in globs:
        regex = "^" + "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() or c in "_/" else "\\" + c) for c in g) + "$"
        tests += [f"regexp_matches({path}, {sql(regex)})", f"regexp_matches({name}, {sql(regex)})"]
    return "(" + " OR ".join(tests) + ")"


DEFAULT_GLOBS = V.DEFAULT_OPTIONS["exclusions"]["patterns"]
TEST_GLOBS = V.DEFAULT_OPTIONS["exclusions"]["test_patterns"]


def counted(keys: str, source: str = "enriched", where: str = "TRUE", name: str = "finding_count") -> str:
    return f"SELECT {keys}, count(*) AS {name} FROM {source} WHERE {where} GROUP BY ALL"


def build() -> dict[str, str]:
    out: dict[str, str] = {}
    columns = "pattern_no, match_no, line_number, column_number, matched_text"
    secret = [s for s in RULE_SPECS if s[0] == "PY003"]

    # ---------------------------------------------------------------- regex scans
    out["secret_scan_documents"] = f"SELECT doc_id, {columns} FROM ({all_matches('documents', 'doc_id', secret)})"
    for name, source, keys, text in (("documents", "documents", "doc_id", "text"), ("pages", secret_source("pages", "page_id", "page_id", "html"), "page_id", "html"),
                                     ("conversations", secret_source("conversations", "conv_id, turn", "conv_id", "text"), "conv_id, turn", "text")):
        out[f"rule_scan_{name}"] = (f"SELECT {keys}, owner_id AS rule_id, {columns} FROM "
                                    f"({all_matches(source, keys, RULE_SPECS, text)})")
    csharp = [(i, n, p) for i, row in PATTERNS.items() if "csharp" in row["languages"]
              for n, p in enumerate(row["regex_patterns"])]
    out["catalogue_scan_documents"] = (f"SELECT doc_id, owner_id AS pattern_id, {columns} FROM "
                                       f"({all_matches('documents', 'doc_id', csharp)})")
    for name, rule in RULE_QUERIES.items():
        specs = [s for s in RULE_SPECS if s[0] == rule]
        out[name] = with_(CODE_FILES_CTE, PY_FILES) + f"SELECT path, {columns} FROM ({all_matches('py_files', 'path', specs)})"

    specs = [(i, n, p, "language IN (" + ", ".join(f"'{x}'" for x in row["languages"]) + ")")
             for i, row in PATTERNS.items() for n, p in enumerate(row["regex_patterns"]) if (i, n) not in LOOKAHEAD]
    written = [(i, *match) for i, t in enumerate(TEMPLATES) for match in t.lookahead]
    numbered, seen = [], {}
    for template, pattern, number, line, column, matched in written:
        seen[template, pattern, number] = seen.get((template, pattern, number), 0) + 1
        numbered.append((template, pattern, number, seen[template, pattern, number], line, column, matched))
    look = values("written", "template_id, pattern_id, pattern_no, match_no, line_number, column_number, matched_text", numbered)
    pattern_sev = values("pattern_sev", "pattern_id, severity", [(i, row["severity"]) for i, row in PATTERNS.items()])
    catalogue = with_(CODE_FILES_CTE, ALL_FILES, look, pattern_sev) + f"""
SELECT path, language, m.pattern_id, severity, pattern_no, match_no, line_number, column_number, matched_text FROM (
SELECT path, language, owner_id AS pattern_id, {columns} FROM ({all_matches('all_files', 'path, language', specs)})
UNION ALL SELECT path, language, pattern_id, pattern_no, match_no, line_number, column_number, matched_text
FROM all_files JOIN written USING (template_id)) m JOIN pattern_sev USING (pattern_id)"""
    out["catalogue_scan"] = catalogue
    out["new_language_scan"] = (f"SELECT language, pattern_id, count(*) AS match_count FROM ({catalogue}) "
                                "WHERE language = 'javascript' GROUP BY ALL")
    groups = "\nUNION ALL ".join(
        f"SELECT path, '{r}' AS rule_id, {n} AS pattern_no, CAST(i AS INTEGER) AS match_no, {g - 1} AS group_no, "
        f"nullif(gs[i], '') AS value FROM (SELECT path, gs, unnest(range(1, len(gs) + 1)) AS i FROM "
        f"(SELECT path, regexp_extract_all(text, {sql(p)}, {g}) AS gs FROM py_files))"
        for r, n, p in RULE_SPECS for g in range(1, __import__("re").compile(p).groups + 1))
    out["match_groups"] = with_(CODE_FILES_CTE, PY_FILES) + groups
    audit = [("D", n, "(?i)" + p) for n, p in enumerate(V.DEPENDENCY_REGEXES)]
    out["dependency_audit"] = with_(CODE_FILES_CTE) + f"""
SELECT path, pattern_no, line_number, matched_text, 'outdated dependency in ' || path AS warning FROM
({all_matches("(SELECT * FROM code_files WHERE path LIKE '%/requirements.txt')", 'path', audit)}) WHERE match_no = 1"""

    # ---------------------------------------------------------------- structural rules and facts
    for name, rules in STRUCTURAL_QUERIES.items():
        ids = {"sql_call": "PY001", "command_injection": "PY002", "weak_hash": "PY004",
               "unsafe_deserialization": "PY005", "always_true": "PY010", "constant_session": "PY011",
               "path_traversal": "PY012", "template_xss": "PY013", "exception_disclosure": "PY014",
               "debug_print": "PY015"}
        out[name] = with_(CODE_FILES_CTE, PY_FILES, EXPECTED) + f"""
SELECT path, rule_id, title, severity, confidence, CAST(line_number AS INTEGER) AS line_number,
  CAST(column_number AS INTEGER) AS column_number
FROM py_files JOIN expected USING (template_id) WHERE rule_id = '{ids[rules[0]]}'"""
    broken = [i for i in python_templates() if not TEMPLATES[i].parsed]
    empty = [i for i in python_templates() if not TEMPLATES[i].text]
    ids = lambda numbers: ", ".join(map(str, numbers))
    out["parse_status"] = with_(CODE_FILES_CTE, PY_FILES) + f"""
SELECT path, CASE WHEN template_id NOT IN ({ids(empty)}) THEN template_id NOT IN ({ids(broken)}) END AS parsed FROM py_files"""
    modules = values("modules", "template_id, module", [(i, m) for i, t in enumerate(TEMPLATES) for m in t.imports])
    out["imports"] = with_(CODE_FILES_CTE, modules) + "SELECT path, module FROM code_files JOIN modules USING (template_id)"
    risky = values("risky", "module, reason", list(prose.IMPORT_REASONS.items()))
    out["risky_imports"] = with_(CODE_FILES_CTE, modules, risky) + (
        "SELECT path, module, reason FROM code_files JOIN modules USING (template_id) JOIN risky USING (module)")
    function_rows = values("fn", "template_id, raw_name, line_number, args, decorators, has_docstring, complexity",
                           [(i, *f) for i, t in enumerate(TEMPLATES) for f in t.functions])
    function_cte = with_(CODE_FILES_CTE, PY_FILES, function_rows)
    name_sql = f"replace(raw_name, '{K}', CAST(file_id AS VARCHAR))"
    out["functions"] = function_cte + f"""
SELECT path, {name_sql} AS name, CAST(line_number AS INTEGER) AS line_number, args, decorators, has_docstring,
  CAST(complexity AS INTEGER) AS complexity FROM py_files JOIN fn USING (template_id)"""
    out["complexity_by_file"] = function_cte + f"""
SELECT path, CASE WHEN template_id NOT IN ({ids(empty)}) THEN coalesce(n, 0) END AS function_count,
  CASE WHEN template_id NOT IN ({ids(empty)}) THEN coalesce(c, 0) END AS total_complexity
FROM py_files LEFT JOIN (SELECT template_id, count(*) AS n, CAST(sum(complexity) AS BIGINT) AS c FROM fn GROUP BY 1) USING (template_id)"""
    out["function_quality"] = function_cte + f"""
SELECT path, {name_sql} AS name, complexity > {V.MAX_FUNCTION_COMPLEXITY} AS too_complex,
  NOT has_docstring AND raw_name NOT LIKE '\\_%' ESCAPE '\\' AS undocumented
FROM py_files JOIN fn USING (template_id)
WHERE complexity > {V.MAX_FUNCTION_COMPLEXITY} OR (NOT has_docstring AND raw_name NOT LIKE '\\_%' ESCAPE '\\')"""

    # ---------------------------------------------------------------- scalar functions
    doc_lines = f"SELECT doc_id, text, {lines_of('text')} AS ls FROM documents"
    out["finding_snippets"] = f"""SELECT doc_id, CAST(len(ls) AS BIGINT) AS line_count,
array_to_string({window_of('ls', '(len(ls) // 2 + 1)', 2, 2)}, chr(10)) AS snippet FROM ({doc_lines})"""
    word = "string_split(text, ' ')[1]"
    out["highlighted"] = f"""SELECT doc_id, md5(CASE WHEN {word} = '' THEN text ELSE
replace(text, {word}, '{V.HIGHLIGHT_OPEN}' || {word} || '{V.HIGHLIGHT_CLOSE}') END) AS marked_md5 FROM documents"""
    out["code_snippets"] = f"""SELECT doc_id, 1 AS start_line, CAST(least(len(ls), 6) AS INTEGER) AS end_line,
CAST(i AS INTEGER) AS line_number, ls[i] AS content, i = 3 AS is_target
FROM (SELECT doc_id, ls, unnest(range(1, least(len(ls), 6) + 1)) AS i FROM ({doc_lines}) WHERE len(ls) >= 3)"""
    out["loc_nonblank"] = f"SELECT doc_id, CAST({loc_of('text')} AS BIGINT) AS loc FROM documents"
    code_loc = values("loc", "template_id, code_lines", [(i, t.code_lines) for i, t in enumerate(TEMPLATES)])
    out["loc_code"] = with_(CODE_FILES_CTE, code_loc) + (
        "SELECT path, CAST(code_lines AS BIGINT) AS code_lines FROM code_files JOIN loc USING (template_id)")
    out["text_hash"] = ("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, "
                        "128 AS sha512_length, CAST(NULL AS VARCHAR) AS unknown FROM documents")
    media = " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in MEDIA_TYPES.items())
    out["file_language"] = with_(CODE_FILES_CTE) + f"""
SELECT path, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(path, '\\.[^./]*$')) AS extension,
  {language_case()} AS language, CASE lower(regexp_extract(path, '\\.[^./]*$')) {media} END AS mime_type FROM code_files"""
    out["line_access"] = """SELECT doc_id, CAST(len(ls) AS BIGINT) AS lines, ls[2] AS second_line,
array_to_string(list_slice(ls, 2, 4), '|') AS lines_2_to_4 FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"""
    out["offset_positions"] = """SELECT doc_id, CAST(1 + length(p) - length(replace(p, chr(10), '')) AS BIGINT) AS line,
CAST(length(string_split(p, chr(10))[-1]) AS BIGINT) AS column_number
FROM (SELECT doc_id, substring(text, 1, length(text) // 2) AS p FROM documents)"""
    word = "lower(string_split(o_orderpriority, '-')[-1])"
    out["severity_rank"] = f"""SELECT o_orderkey, severity, CAST({SEVERITY_SCORE.format('lower(severity)')} AS INTEGER) AS score,
{SEVERITY_SCORE.format('lower(severity)')} >= 2 AS reported
FROM (SELECT o_orderkey, CASE {word} WHEN 'urgent' THEN 'CRITICAL' ELSE {word} END AS severity FROM orders)"""
    out["category_codes"] = with_(*BASE) + """
SELECT filename, rule_id, line_number, column_number, string_split(owasp_category_name, ':')[1] AS code,
  owasp_category_name AS title FROM enriched"""
    out["file_sizes"] = "SELECT doc_id, round(strlen(text) / 1048576, 4) AS size_mb FROM documents"

    # ---------------------------------------------------------------- file content
    out["decoded_text"] = "SELECT doc_id, md5(text) AS text_md5 FROM documents"
    latin_only = "NOT regexp_matches(text, '[^\\x00-\\x{ff}]')"
    size = (f"CASE WHEN doc_id % 4 = 1 THEN 2 * length(text) + 2 WHEN doc_id % 4 = 2 AND {latin_only} "
            "THEN length(text) ELSE strlen(text) END")
    latin = "text"
    latin_text = (f"NOT regexp_matches({latin}, '[^\\x00-\\x7f]') OR "
                  f"4 * length(regexp_replace({latin}, '[^\\x20-\\x7e\\t\\n\\r]', '', 'g')) > 3 * length({latin})")
    by_content = (f"CASE WHEN text = '' THEN TRUE WHEN doc_id % 4 = 1 THEN FALSE "
                  f"WHEN doc_id % 4 = 2 AND {latin_only} THEN {latin_text} ELSE TRUE END")
    is_text = f"CASE doc_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE {by_content} END"
    out["text_detection"] = (f"SELECT doc_id, {is_text} AS is_text, ({size}) <= 2000 AND ({is_text}) AS safe_2000 "
                             "FROM documents")
    out["encoding_detection"] = f"""SELECT doc_id, CASE WHEN text = '' THEN NULL
  WHEN NOT regexp_matches(text, '[^\\x00-\\x7f]') THEN 'ascii' ELSE 'utf-8' END AS encoding FROM documents"""
    is_ascii = ", ".join(str(i) for i, t in enumerate(TEMPLATES) if t.text.isascii() and t.text)
    out["file_profiles"] = with_(CODE_FILES_CTE, code_loc) + f"""
SELECT path, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(path, '\\.[^./]*$')) AS extension,
  {language_case()} AS language, CAST(strlen(text) AS BIGINT) AS size, CAST(code_lines AS BIGINT) AS lines, TRUE AS is_text,
  CASE WHEN text = '' THEN NULL WHEN template_id IN ({is_ascii}) THEN 'ascii' ELSE 'utf-8' END AS encoding,
  sha256(text) AS hash, CASE lower(regexp_extract(path, '\\.[^./]*$')) {media} END AS mime_type,
  CAST(NULL AS VARCHAR) AS error
FROM code_files JOIN loc USING (template_id)"""

    # ---------------------------------------------------------------- filters
    code = with_(CODE_FILES_CTE)
    out["excluded_files"] = code + f"SELECT path FROM code_files WHERE NOT {glob('path', *DEFAULT_GLOBS, *TEST_GLOBS, 'src/r9?/*')}"
    out["included_tests"] = code + f"SELECT path FROM code_files WHERE NOT {glob('path', *DEFAULT_GLOBS)}"
    out["pruned_directories"] = code + """SELECT path FROM code_files WHERE NOT (
list_contains(list_slice(string_split(path, '/'), 1, -2), 'venv')
OR list_contains(list_slice(string_split(path, '/'), 1, -2), 'node_modules')
OR regexp_matches(path, '^src/r1') OR regexp_matches(path, '/m.7/'))"""
    out["size_filter"] = code + (f"SELECT path, CAST(strlen(text) AS BIGINT) AS size FROM code_files "
                                 f"WHERE strlen(text) <= {SIZE_LIMIT}")
    out["analyzer_dispatch"] = code + ("SELECT path, 'python' AS language FROM code_files "
                                       "WHERE regexp_matches(path, '(?i)\\.pyw?$')")
    base = with_(*BASE)
    out["severity_filter"] = base + ("SELECT filename, rule_id, severity, line_number, column_number FROM enriched "
                                     f"WHERE {SEVERITY_SCORE.format('severity')} >= 3")
    host = "regexp_replace(url, '^https?://', '')"
    tail = f"regexp_replace(regexp_replace({host}, '/+', '/', 'g'), '/$', '')"
    out["safe_paths"] = f"""SELECT page_id, CASE page_id % 5 WHEN 2 THEN '/etc/' WHEN 3 THEN '/srv/site2/' ELSE '/srv/site/' END || {tail} AS normalized,
page_id % 5 NOT IN (2, 3) AS is_safe FROM pages"""
    out["files_with_findings"] = base + "SELECT DISTINCT filename FROM enriched"
    out["clean_files"] = base + "SELECT path AS filename FROM py_files WHERE path NOT IN (SELECT filename FROM enriched)"
    out["separate_clean_files"] = base + ("SELECT path AS filename FROM py_files WHERE path NOT IN "
                                          "(SELECT filename FROM enriched WHERE rule_id = 'PY006')")

    # ---------------------------------------------------------------- findings and roll-ups
    out["enriched_findings"] = base + f"""
, text_lines AS (SELECT path, {lines_of('text')} AS ls FROM py_files),
snippets AS (SELECT e.*, array_to_string({window_of('ls', 'line_number', 2, 2)}, chr(10)) AS snippet
  FROM enriched e JOIN text_lines t ON e.filename = t.path)
SELECT filename, rule_id, title, severity, confidence, owasp_category, owasp_category_name, pattern_id, line_number,
  column_number, md5(snippet) AS snippet_md5, md5(CASE WHEN matched_text = '' THEN snippet ELSE
  replace(snippet, matched_text, '{V.HIGHLIGHT_OPEN}' || matched_text || '{V.HIGHLIGHT_CLOSE}') END) AS highlighted_md5,
  cwe_ids, tags, refs AS "references" FROM snippets"""
    out["end_to_end_scan"] = base + f"""
SELECT filename, rule_id, severity, owasp_category_name, line_number, column_number FROM enriched
WHERE {SEVERITY_SCORE.format('severity')} >= 2 AND NOT {glob('filename', *DEFAULT_GLOBS, *TEST_GLOBS)}"""
    # raw bytes are decoded with line ends normalized; the CRLF template has one match either way
    out["binary_scan"] = base + f"""
SELECT rule_id, severity, count(*) AS finding_count FROM enriched
WHERE {SEVERITY_SCORE.format('severity')} >= 2 AND NOT {glob('filename', *DEFAULT_GLOBS, *TEST_GLOBS)} GROUP BY ALL"""
    per_file = """per_file AS (SELECT path, text, template_id, count(e.filename) AS n,
  count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
  count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low
FROM py_files LEFT JOIN enriched e ON path = filename GROUP BY ALL)"""
    files = base + ", " + per_file
    out["file_results"] = files + f"""
SELECT path AS filename, 'python' AS language, CASE WHEN text = '' THEN '{V.UNREADABLE_FILE_ERROR}' END AS error,
  CAST(strlen(text) AS BIGINT) AS file_size, CAST(CASE WHEN text = '' THEN 0 ELSE {loc_of('text')} END AS BIGINT) AS lines_of_code,
  critical + high + medium AS vulnerability_count FROM per_file"""
    out["severity_by_file"] = files + "SELECT path AS filename, critical, high, medium, low FROM per_file"
    out["severity_total"] = files + """
SELECT CAST(sum(n) AS BIGINT) AS total_vulnerabilities, CAST(sum(critical) AS BIGINT) AS critical, CAST(sum(high) AS BIGINT) AS high,
  CAST(sum(medium) AS BIGINT) AS medium, CAST(sum(low) AS BIGINT) AS low, count(*) FILTER (n > 0) AS files_with_issues,
  count(*) AS total_files FROM per_file"""
    out["scan_gate"] = base + """
SELECT count(*) > 0 AS failed, count(*) AS findings FROM enriched WHERE severity = 'critical'"""
    out["category_counts"] = base + counted("owasp_category AS category")
    cwe = "(SELECT CAST(unnest(string_split(cwe_ids, ',')) AS INTEGER) AS cwe_id FROM enriched)"
    out["cwe_counts"] = base + counted("cwe_id", cwe)
    out["cwe_top5"] = out["cwe_counts"] + " ORDER BY finding_count DESC, cwe_id LIMIT 5"
    out["exec_breakdown"] = base + """
SELECT 'severity' AS dimension, severity AS value, count(*) AS finding_count FROM enriched GROUP BY ALL
UNION ALL SELECT 'category', owasp_category, count(*) FROM enriched GROUP BY ALL
UNION ALL SELECT 'total', 'all', count(*) FROM enriched"""
    category_dim = values("category_dim", "category, title",
                          [(c, n if c == "GEN" else f"{c}: {n}") for c, n in V.CATEGORIES])
    out["category_groups"] = with_(*BASE, category_dim) + """
SELECT category, c.title, count(e.filename) AS finding_count FROM category_dim c
LEFT JOIN enriched e ON category = owasp_category GROUP BY ALL"""
    out["findings_by_category"] = with_(*BASE, category_dim) + """
SELECT category, c.title AS category_title, filename, rule_id, line_number, column_number
FROM enriched e JOIN category_dim c ON category = owasp_category"""

    # ---------------------------------------------------------------- execution log
    def grid(disabled: tuple[str, ...]) -> str:
        rows = [(r[0], r[4], "regex" if r[0] in V.RULE_REGEXES else "ast", r[0] not in disabled) for r in V.RULES]
        return values("rules", "rule_id, category, rule_type, enabled", rows) + f""",
log AS (SELECT path AS filename, r.rule_id, category, CASE WHEN NOT enabled THEN 'skipped' WHEN text = '' THEN 'error'
  WHEN rule_type = 'ast' AND template_id IN ({ids(broken)}) THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN enabled THEN coalesce(n, 0) ELSE 0 END AS match_count
FROM py_files CROSS JOIN rules r LEFT JOIN (SELECT filename, rule_id, count(*) AS n FROM enriched GROUP BY ALL) c
  ON path = c.filename AND r.rule_id = c.rule_id)"""

    log = with_(*BASE, grid(("PY009", "PY013")))
    out["exec_log"] = log + f"""
SELECT filename, rule_id, status, match_count, CASE status WHEN 'error' THEN '{V.UNREADABLE_FILE_ERROR}'
  WHEN 'failed' THEN 'source does not parse' END AS error_message, CAST(0 AS BIGINT) AS warning_count FROM log"""
    out["exec_log_summary"] = log + """
SELECT count(*) AS total_rules_executed, count(*) FILTER (status = 'success') AS successful_rules,
  CAST(sum(match_count) AS BIGINT) AS total_matches_found, count(*) FILTER (status = 'success') AS status_success,
  count(*) FILTER (status = 'failed') AS status_failed, count(*) FILTER (status = 'skipped') AS status_skipped,
  count(*) FILTER (status = 'timeout') AS status_timeout, count(*) FILTER (status = 'error') AS status_error,
  count(*) FILTER (match_count > 0) AS rules_with_matches,
  round(count(*) FILTER (match_count > 0) / count(*), 6) AS match_rate FROM log"""
    log = with_(*BASE, grid(()))
    out["exec_status"] = log + """
SELECT s.status, count(log.status) AS executions FROM (VALUES ('success'), ('failed'), ('skipped'), ('timeout'), ('error')) s(status)
LEFT JOIN log ON s.status = log.status GROUP BY ALL"""
    out["category_executions"] = log + "SELECT filename, rule_id, match_count FROM log WHERE category = 'A03'"
    # structural rules never reach the cap here, so the order inside a rule only matters for regex rules
    out["match_cap"] = with_(*BASE) + f""", ranked AS (
SELECT path AS filename, owner_id AS rule_id, line_number, count(*) OVER (PARTITION BY path, owner_id) AS n,
  row_number() OVER (PARTITION BY path, owner_id ORDER BY pattern_no, match_no) AS rn FROM regex_matches),
structural AS (SELECT filename, rule_id, count(*) AS n FROM enriched
  WHERE rule_id NOT IN ({', '.join(f"'{r}'" for r in V.RULE_REGEXES)}) GROUP BY ALL)
SELECT filename, rule_id, least(n, {MATCH_CAP}) AS match_count, line_number AS last_line, n > {MATCH_CAP} AS limited
FROM ranked WHERE rn = least(n, {MATCH_CAP})
UNION ALL SELECT filename, rule_id, s.n, max(e.line_number), FALSE FROM structural s JOIN enriched e USING (filename, rule_id)
GROUP BY ALL"""

    out["anchor_scan"] = """
SELECT doc_id, CAST(n AS INTEGER) AS pattern_no, CAST(i AS INTEGER) AS match_no, CAST(i AS INTEGER) AS line_number,
  CAST(CASE n WHEN 0 THEN 0 ELSE length(ls[i]) END AS INTEGER) AS column_number, '' AS matched_text
FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
CROSS JOIN (VALUES (0), (1)) v(n)"""
    out["named_groups"] = """
SELECT doc_id, CAST(i AS INTEGER) AS match_no, a[i] AS first_word, b[i] AS second
FROM (SELECT doc_id, a, b, unnest(range(1, len(a) + 1)) AS i FROM (
  SELECT doc_id, regexp_extract_all(text, '([A-Za-z]+) ([a-z]+)[.]', 1) AS a,
    regexp_extract_all(text, '([A-Za-z]+) ([a-z]+)[.]', 2) AS b FROM documents))"""
    out["match_counts"] = with_(*BASE) + "SELECT filename, rule_id, count(*) AS match_count FROM enriched GROUP BY ALL"
    imports = all_matches("py_files", "path", [("PY004", 0, "import ")])
    out["replaced_rule_scan"] = with_(CODE_FILES_CTE, PY_FILES) + f"""
SELECT path AS filename, 'import statement' AS title, line_number, column_number FROM ({imports})"""
    out["retuned_rule_scan"] = base + """
SELECT filename, rule_id, CASE WHEN rule_id = 'PY005' THEN 'renamed' ELSE title END AS title,
  CASE WHEN rule_id = 'PY005' THEN 'medium' ELSE severity END AS severity, line_number, column_number
FROM enriched WHERE rule_id IN ('PY002', 'PY005')"""
    commented = """(SELECT 'd' || doc_id || '.py' AS filename,
      '# ' || replace(text, chr(10), chr(10) || '# ') || chr(10) || 'DEBUG = True' || chr(10) AS text FROM documents)"""
    debug = all_matches(commented, "filename, text", [("PY006", n, p) for n, p in enumerate(V.RULE_REGEXES["PY006"])])
    mark = f"'{V.HIGHLIGHT_OPEN}' || matched_text || '{V.HIGHLIGHT_CLOSE}'"
    out["file_results_nested"] = f"""
SELECT filename, owner_id AS rule_id, line_number, md5(snippet) AS snippet_md5,
  md5(replace(snippet, matched_text, {mark})) AS highlighted_md5
FROM (SELECT *, array_to_string({window_of(lines_of('text'), 'line_number', 2, 2)}, chr(10)) AS snippet FROM ({debug}))"""
    marked = """(SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'f({}) abc ab b ' || doc_id ELSE '' END AS text FROM documents)"""
    out["user_expression_scan"] = f"SELECT doc_id, {columns} FROM ({all_matches(marked, 'doc_id', [('USER', n, p) for n, (_, p) in enumerate(USER_EXPRESSIONS)])})"
    known = [(i, n, p) for i in ("A02_001", "A05_001") for n, p in enumerate(V.PATTERN_REGEXES[i])]
    kept = [(i, n + (i == "A02_001"), p, "language IN (" + ", ".join(f"'{x}'" for x in PATTERNS[i]["languages"]) + ")") for i, n, p in known]
    out["broken_expression_scan"] = with_(CODE_FILES_CTE, ALL_FILES) + f"""
SELECT owner_id AS pattern_id, pattern_no, count(*) AS match_count FROM ({all_matches('all_files', 'path, language', kept)}) GROUP BY ALL
UNION ALL SELECT 'A02_001', 0, NULL"""
    out["indexed_rule_scan"] = """
WITH named AS (SELECT doc_id, text, p_name FROM documents JOIN part ON doc_id * 7 % (SELECT max(p_partkey) FROM part) + 1 = p_partkey)
SELECT doc_id, 'P' || p.p_partkey AS rule_id, CAST(2 + length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS line_number,
  CAST(0 AS INTEGER) AS column_number
FROM named n JOIN part p ON lower(n.p_name) = lower(p.p_name)"""
    lines = f"""SELECT path AS filename, text, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line
  FROM (SELECT path, text, string_split(text, chr(10)) AS ls FROM py_files WHERE text <> '' {{}})"""
    out["python_rule_findings"] = with_(CODE_FILES_CTE, PY_FILES) + f"""
, lines AS ({lines.format(f"AND NOT {glob('path', *DEFAULT_GLOBS, *TEST_GLOBS)}")}),
found AS (
  SELECT filename, 'X_PASS' AS rule_id, CASE WHEN length(filename) % 2 = 0 THEN 'high' ELSE 'medium' END AS severity,
    'GEN: {NAMES["GEN"]}' AS owasp_category_name, n AS line_number, instr(line, 'password') - 1 AS column_number, text
  FROM lines WHERE contains(line, 'password')
  UNION ALL SELECT filename, 'X_FRAGILE', 'critical', 'GEN: {NAMES["GEN"]}', 1, 0, text FROM lines WHERE n = 1 AND length(filename) % 3 <> 0)
SELECT filename, rule_id, severity, owasp_category_name, CAST(line_number AS INTEGER) AS line_number, CAST(column_number AS INTEGER) AS column_number,
  md5(array_to_string({window_of(lines_of('text'), 'line_number', 2, 2)}, chr(10))) AS snippet_md5 FROM found"""
    out["python_rule_log"] = base + f"""
, lines AS ({lines.format("")}),
counts AS (
  SELECT filename, rule_id, count(*) AS match_count FROM enriched WHERE rule_id IN ('PY006', 'PY009') GROUP BY ALL
  UNION ALL SELECT filename, 'X_LONG', count(*) FROM lines WHERE length(line) > 40 GROUP BY ALL
  UNION ALL SELECT filename, 'X_PASS', count(*) FROM lines WHERE contains(line, 'password') GROUP BY ALL
  UNION ALL SELECT filename, 'X_FRAGILE', 1 FROM lines WHERE n = 1 AND length(filename) % 3 <> 0)
SELECT path AS filename, r.rule_id, CASE WHEN text = '' OR raised THEN 'error' ELSE 'success' END AS status,
  CASE WHEN text = '' THEN 0 ELSE coalesce(c.match_count, 0) END AS match_count,
  CASE WHEN text = '' THEN '{V.UNREADABLE_FILE_ERROR}' WHEN raised THEN 'ValueError: cannot judge ' || path END AS error_message
FROM (SELECT *, r.rule_id = 'X_FRAGILE' AND length(path) % 3 = 0 AS raised
  FROM py_files CROSS JOIN (VALUES ('PY006'), ('PY009'), ('X_LONG'), ('X_PASS'), ('X_FRAGILE')) r(rule_id)) r
LEFT JOIN counts c ON c.filename = r.path AND c.rule_id = r.rule_id"""
    out["rule_versions"] = """
SELECT 'V' || p_partkey % 97 AS rule_id, arg_max(p_name, p_partkey) AS title, arg_max(p_type, p_partkey) AS description,
  arg_max(p_brand, p_partkey) AS expression
FROM part WHERE p_size % 4 <> 0 AND p_size % 7 <> 0 GROUP BY p_partkey % 97"""
    out["broken_rule_log"] = base + f"""
SELECT path AS filename, r.rule_id, CASE WHEN r.rule_id = 'PY009' OR text = '' THEN 'error' ELSE 'success' END AS status,
  CASE WHEN r.rule_id = 'PY009' THEN 0 ELSE count(e.filename) END AS match_count
FROM py_files CROSS JOIN (VALUES ('PY006'), ('PY009')) r(rule_id) LEFT JOIN enriched e ON e.filename = path AND e.rule_id = r.rule_id
GROUP BY path, r.rule_id, text"""

    # ---------------------------------------------------------------- rules as data
    out["rule_activity"] = base + """
SELECT r.rule_id, r.title, r.severity, r.owasp_category, r.confidence, TRUE AS enabled, count(e.filename) AS finding_count
FROM rule_dim r LEFT JOIN enriched e ON r.rule_id = e.rule_id GROUP BY ALL"""
    out["category_rules_scan"] = base + counted("rule_id, severity", where="rule_id IN ('PY003', 'PY004')")
    out["disabled_rules_scan"] = base + counted("rule_id", where="rule_id NOT IN ('PY001', 'PY006', 'PY015')")
    custom = [("PY006", 0, r"DEBUG\s*=\s*True"), ("X_IMPORT", 0, r"(?i)import\s+os")]
    out["custom_rule_scan"] = base + f"""
SELECT rule_id, owasp_category, owasp_category_name, count(*) AS finding_count FROM enriched WHERE rule_id <> 'PY006' GROUP BY ALL
UNION ALL SELECT owner_id, CASE owner_id WHEN 'PY006' THEN 'A05' ELSE 'GEN' END,
  CASE owner_id WHEN 'PY006' THEN 'A05: {NAMES["A05"]}' ELSE 'GEN: {NAMES["GEN"]}' END, count(*)
FROM ({all_matches('py_files', 'path', custom)}) GROUP BY ALL"""
    opens = values("opens", "template_id, line_number, column_number", [(12, 5, 8), (12, 6, 8), (12, 8, 8)])
    out["custom_rule_threshold"] = with_(CODE_FILES_CTE, opens) + """
SELECT 'X_HIGH' AS rule_id, 'high' AS severity, count(*) AS finding_count FROM code_files JOIN opens USING (template_id)"""
    out["custom_structural_rule"] = with_(CODE_FILES_CTE, opens) + """
SELECT path, 'X_OPEN' AS rule_id, CAST(line_number AS INTEGER) AS line_number, CAST(column_number AS INTEGER) AS column_number
FROM code_files JOIN opens USING (template_id)"""
    out["python_rule"] = with_(CODE_FILES_CTE, PY_FILES) + """
SELECT path AS filename, 'X_LONG' AS rule_id, CAST(i AS INTEGER) AS line_number
FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT path, string_split(text, chr(10)) AS ls FROM py_files))
WHERE length(ls[i]) > 40"""
    language_rows = values("langs", "language, patterns", [
        (lang, sum(lang in row["languages"] for row in PATTERNS.values()))
        for lang in sorted({x for row in PATTERNS.values() for x in row["languages"]})])
    out["patterns_per_language"] = with_(CODE_FILES_CTE, ALL_FILES, language_rows) + """
SELECT language, count(*) AS files, CAST(any_value(patterns) AS BIGINT) AS patterns FROM all_files JOIN langs USING (language) GROUP BY language"""
    tagged = values("tagged", "pattern_id, name", [(i, row["name"]) for i, row in PATTERNS.items()
                                                  if any("injection" in t for t in row["tags"])])
    out["pattern_search"] = with_(*BASE, tagged) + counted("pattern_id, name", "enriched JOIN tagged USING (pattern_id)")
    candidates = """candidates AS (SELECT p_partkey AS part,
  CASE p_partkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'rule!' || p_partkey WHEN 2 THEN repeat('r', 51) ELSE 'R-' || p_partkey END AS rule_id,
  p_name AS title, CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS description,
  ['low', 'medium', 'high', 'critical', 'fatal'][p_partkey % 5 + 1] AS severity,
  ['low', 'medium', 'high', 'sure'][p_partkey % 4 + 1] AS confidence,
  ['A01', 'A10', 'GEN'][p_partkey % 3 + 1] AS owasp_category, p_partkey % 2 = 0 AS enabled,
  CASE WHEN p_partkey % 3 = 0 THEN 'regex' WHEN p_partkey % 3 = 1 THEN 'ast' WHEN p_partkey % 9 = 2 THEN 'semantic'
    ELSE 'hybrid' END AS rule_type FROM part),
checked AS (SELECT *, CAST(description IS NULL AS INTEGER) + CAST(title IS NULL AS INTEGER) + CAST(rule_id = '' AS INTEGER)
  + CAST(length(rule_id) > 50 AS INTEGER) + CAST(severity = 'fatal' AS INTEGER) + CAST(owasp_category = 'GEN' AS INTEGER)
  + CAST(confidence = 'sure' AS INTEGER) AS error_count FROM candidates)"""
    out["rule_validation"] = with_(candidates) + """
SELECT part, rule_type, CAST(error_count AS BIGINT) AS error_count, CAST(contains(rule_id, '!') AS BIGINT) AS warning_count,
  error_count = 0 AS is_valid FROM checked"""
    out["rule_upsert"] = with_(candidates) + """
, mine AS (SELECT * FROM checked WHERE rule_id LIKE 'R-%'),
changed AS (SELECT * FROM mine WHERE part % 4 <> 1 AND error_count = 0),
merged AS (SELECT owasp_category, enabled FROM mine WHERE part % 2 = 0 AND part NOT IN (SELECT part FROM changed)
  UNION ALL SELECT owasp_category, FALSE FROM changed)
SELECT owasp_category, enabled, count(*) AS rules FROM merged GROUP BY ALL"""
    out["derived_rule_statistics"] = with_(candidates) + """
SELECT count(*) AS total_rules, count(*) FILTER (enabled) AS enabled_rules, count(*) FILTER (rule_type = 'regex') AS regex_rules,
  count(*) FILTER (rule_type = 'ast') AS ast_rules, count(*) FILTER (rule_type = 'semantic') AS semantic_rules,
  count(*) FILTER (rule_type = 'hybrid') AS hybrid_rules, string_agg(DISTINCT owasp_category, ',' ORDER BY owasp_category) AS categories,
  count(DISTINCT rule_id) AS distinct_ids FROM candidates"""
    out["derived_rules_by_type"] = with_(candidates) + """
SELECT t.rule_type, count(c.part) AS rule_count FROM (VALUES ('regex'), ('ast'), ('semantic'), ('hybrid')) t(rule_type)
LEFT JOIN candidates c ON t.rule_type = c.rule_type GROUP BY ALL"""
    out["derived_rules_by_category"] = with_(candidates) + counted("owasp_category", "candidates", name="rule_count")
    out["source_table"] = (f"SELECT 'p/' || page_id || '.html' AS path, CAST(strlen(html) AS BIGINT) AS size, "
                           f"CAST({loc_of('html')} AS BIGINT) AS loc FROM pages")
    return out


ORACLES = build()
