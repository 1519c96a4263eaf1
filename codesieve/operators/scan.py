"""Scan operators: from file tables to matches.

Every operator works inside the file's own row.  A text is never copied per match, never
shuffled and never leaves the JVM except for the single Arrow transfer to the Python parser.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.catalog import fixed_values as V
from codesieve.catalog import specs as S
from codesieve.catalog import tables
from codesieve.functions.expressions import bind, let
from codesieve.functions.facts import code_facts
from codesieve.functions.paths import base_name
from codesieve.functions.pymatch import PythonRule, python_findings
from codesieve.functions.regex import RegexSpec, by_engine, folded, locate_hits, python_hits, regex_hits
from codesieve.functions.structural import STRUCTURAL_RULES, STRUCTURAL_VALUES, structural_matches
from codesieve.functions.text import nonblank_lines, severity_score

StructuralRule = Callable[[Column], Column]

# Rules of one expression that a match meets together; a multiple of eight, as files pack numbers by eights.
RULE_BLOCK = 1024

# Shares of the work, at least, for each task of a join of matches with their rules.
TASK_SHARES = 4


# ------------------------------------------------------------------ regex operators
def regex_scan(texts: DataFrame, specs: list[RegexSpec], key: list[str], text: str = "text",
               language: str | None = None, with_groups: bool = False, indexed: bool = False) -> DataFrame:
    """One row per match of any expression: key, owner, position, matched text, groups, rule values.

    ``indexed`` sends all expressions through the word index, however few they are.
    """
    extra = [F.col(language).alias("_language")] if language else []
    base = bind(texts.select(*key, *extra, F.col(text).alias("_raw")), "_text", F.col("_raw")) \
        .withColumn("_fold", folded(F.col("_text")))
    native, python = ([], specs) if indexed else by_engine(specs, with_groups)
    parts = []
    if native or not python:
        hits = regex_hits("_text", "_fold", native, "_language" if language else None)
        parts.append(locate_hits(F.col("_text"), hits, native, with_groups))
    if python:
        sent = python_hits(F.col("_text"), python, F.col("_language") if language else None, with_groups,
                           sorted({k for s in specs for k in s.attributes}))
        base = bind(base.withColumn("_sent", sent), "_python", F.col("_sent")).drop("_sent")
        parts.append(F.coalesce("_python", F.array()))
    found = base.select(*key, F.explode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("m"))
    matches = found.select(*key, "m.rule.*", "m.*").drop("rule")
    return matches if with_groups else matches.drop("groups")  # named_groups come with_groups alone


def rule_scan(texts: DataFrame, key: list[str], rule_ids: list[str] | None = None, **kwargs) -> DataFrame:
    """Matches of the built-in regex rules (all, or some by id)."""
    specs = [s for s in S.rule_specs() if rule_ids is None or s.owner_id in rule_ids]
    return regex_scan(texts, specs, key, **kwargs).withColumnRenamed("owner_id", "rule_id")


def rule_table_scan(texts: DataFrame, rules: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Matches of the enabled rules of a table, which may have very many rules.

    An expression that several rules share runs once; its matches find their rules in a join. So the plan grows with the
    distinct expressions, not with the rules, and only the result with both.

    The result has a row for each match and rule of its expression. Rules come in blocks: a task takes a block and goes
    through its matches, each with the rules of the block in the same order, so the rows are never shuffled and a written result
    takes a small part of a byte a row. An expression of few rules is shared among tasks by the key of its matches.
    """
    owners = rules.filter(F.col("enabled") & (F.size("regexes") > 0)).select(
        F.col("rule_id").alias("owner_id"), *[F.col(k if k != "detail" else "description").alias(k) for k in S.RULE_ATTRIBUTES],
        F.posexplode("regexes").alias("pattern_no", "pattern"))
    specs = S.expression_specs(owners)
    if not specs:  # none compiles: no match, with the columns of one
        specs = [RegexSpec("", 0, "(?!)")]
    found = regex_scan(texts, specs, key, text, indexed=True).drop("owner_id", "pattern_no")
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = ["pattern", "_block", "_part"]
    # one row per expression, which the plan holds anyway
    counts = owners.groupBy("pattern").agg(F.ceil(F.count("*") / RULE_BLOCK).cast("int").alias("_blocks")) \
        .withColumn("_parts", F.ceil(F.lit(-(-TASK_SHARES * tasks // len(specs))) / F.col("_blocks")).cast("int"))
    spread = found.join(F.broadcast(counts), "pattern").withColumn("_part", F.pmod(F.xxhash64(*key), F.col("_parts")).cast("int")) \
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).repartition(tasks, *share)
    values = ["owner_id", *S.RULE_ATTRIBUTES, "pattern_no"]
    place = F.row_number().over(Window.partitionBy("pattern").orderBy(*values))  # by all values: the same blocks if a task runs again
    blocks = owners.withColumn("_block", F.floor((place - 1) / RULE_BLOCK).cast("int")) \
        .groupBy("pattern", "_block").agg(F.collect_list(F.struct(*values)).alias("_rules")) \
        .join(F.broadcast(counts.select("pattern", "_parts")), "pattern") \
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts").repartition(tasks, *share)
    # a merge join goes through the matches by block; joined by hash, they would meet all blocks one after another
    return spread.join(blocks.hint("merge"), share).withColumn("_rule", F.explode("_rules")).select(
        *key, "_rule.owner_id", *[f"_rule.{k}" for k in S.RULE_ATTRIBUTES], "_rule.pattern_no", "match_no", "line_number", "column_number",
        "matched_text", "pattern")


def catalogue_scan(files: DataFrame, key: list[str], patterns: DataFrame | None = None, **kwargs) -> DataFrame:
    """Matches of every catalogue expression that applies to the file's language."""
    return regex_scan(files, S.pattern_specs(patterns), key, language="language", **kwargs) \
        .withColumnRenamed("owner_id", "pattern_id")


def dependency_audit(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """At most one warning per expression for each requirements file, with its first matching line."""
    audited = files.filter(base_name(F.col(path)) == V.REQUIREMENTS_FILE)
    matches = regex_scan(audited, S.dependency_specs(), [path], text=text)
    return matches.filter("match_no = 1").select(
        path, "pattern_no", "line_number", "matched_text",
        F.concat(F.lit("outdated dependency in "), F.col(path)).alias("warning"))


# ------------------------------------------------------------------ code facts
def facts_of(text: str = "text", language: str = "language") -> Column:
    """Facts of a Python text; null for texts of other languages, which are not sent to the parser."""
    return code_facts(F.when((F.col(language) == "python") & (F.length(text) > 0), F.col(text)))


def with_facts(files: DataFrame, text: str = "text", language: str = "language") -> DataFrame:
    """Add the facts of Python files; files of other languages are not sent to the parser."""
    parsed = files.withColumn("_facts", facts_of(text, language))
    # bound, or a filter the optimizer derives from a later explode would run the parser twice
    return bind(parsed, "facts", F.col("_facts")).drop("_facts")


def structural_scan(facts: DataFrame, rules: list[str | StructuralRule], key: list[str]) -> DataFrame:
    """One row per match of structural rules, given by name or as an expression over facts."""
    expressions = [STRUCTURAL_RULES[r][2] if isinstance(r, str) else r for r in rules]
    return facts.select(*key, F.explode(structural_matches(F.col("facts"), expressions)).alias("m")) \
        .select(*key, F.col("m.rule.owner_id").alias("rule_id"), "m.rule.*", "m.detail", "m.line_number",
                "m.column_number").drop("owner_id")


def code_imports(facts: DataFrame, key: list[str]) -> DataFrame:
    """Distinct modules imported by each file; distinct within the row, hence no shuffle."""
    return facts.select(*key, F.explode(F.array_distinct("facts.imports")).alias("module"))


def risky_imports(facts: DataFrame, key: list[str]) -> DataFrame:
    dim = tables.risky_imports(facts.sparkSession)  # five fixed rows
    return code_imports(facts, key).join(F.broadcast(dim), "module").select(*key, "module", "reason")


def code_functions(facts: DataFrame, key: list[str]) -> DataFrame:
    """Functions with arguments, decorators, docstring flag and complexity."""
    return facts.select(*key, F.explode("facts.functions").alias("f")).select(*key, "f.*")


def function_quality(facts: DataFrame, key: list[str],
                     max_complexity: int = V.MAX_FUNCTION_COMPLEXITY) -> DataFrame:
    """Functions that are too complex, or public without a docstring."""
    return code_functions(facts, key) \
        .withColumn("too_complex", F.col("complexity") > max_complexity) \
        .withColumn("undocumented", ~F.col("has_docstring") & ~F.col("name").startswith("_")) \
        .filter("too_complex or undocumented")


# ------------------------------------------------------------------ the whole scan of a file
# The type of one finding inside a file result.
FINDING_TYPE = ("struct<rule_id:string,title:string,severity:string,confidence:string,owasp_category:string,"
                "detail:string,line_number:int,column_number:int,seq:int,matched_text:string>")
_RULE_TYPE = ("struct<owner_id:string,title:string,severity:string,confidence:string,owasp_category:string>")
_NO_REGEX = ("struct<rule:struct<owner_id:string,confidence:string,detail:string,owasp_category:string,"
             "severity:string,title:string>,pattern_no:int,match_no:int,line_number:int,column_number:int,"
             "matched_text:string,pattern:string,groups:array<string>>")
_NO_STRUCTURE = f"struct<rule:{_RULE_TYPE},detail:string,line_number:int,column_number:int,seq:int>"


def _finding(match: Column, detail: Column, seq: Column, matched_text: Column) -> Column:
    rule = match["rule"]
    return F.struct(
        rule["owner_id"].alias("rule_id"), rule["title"].alias("title"), rule["severity"].alias("severity"),
        rule["confidence"].alias("confidence"), rule["owasp_category"].alias("owasp_category"),
        detail.alias("detail"), match["line_number"].alias("line_number"),
        match["column_number"].alias("column_number"), seq.alias("seq"), matched_text.alias("matched_text"))


def _retuned(rule: StructuralRule, row: dict) -> StructuralRule:
    """A built-in rule with the values of its table row, where these differ from the built-in ones."""
    built_in = dict(zip(("rule_id", "title", "severity", "confidence", "owasp_category"), STRUCTURAL_VALUES[row["rule_id"]]))
    changed = {k: row[k] for k in ("title", "severity", "confidence", "owasp_category") if row[k] != built_in[k]}

    def matches(facts: Column) -> Column:
        def one(m: Column) -> Column:
            values = m["rule"]
            for name, value in changed.items():
                values = values.withField(name, F.lit(value).cast("string"))
            return m.withField("rule", values)

        return F.transform(rule(facts), one)

    return matches if changed else rule


def _structural_rules(rules: DataFrame | None, min_severity: str) -> list[StructuralRule]:
    """Built-in checks whose rule the table has as an enabled rule of its own kind, with the table's values."""
    rows = S.structural_rows(rules)
    out = []
    for rule_id, severity, rule in STRUCTURAL_RULES.values():
        row = rows.get(rule_id)
        if row is not None:
            retuned = row["severity"] != STRUCTURAL_VALUES[rule_id][2]
            if S.reaches(row["severity"] if retuned else severity, min_severity):
                out.append(_retuned(rule, row))
    return out


def _at_least(rule: StructuralRule, min_severity: str) -> StructuralRule:
    """A custom rule without its matches below a severity."""
    floor = S.severity_rank(min_severity)
    return lambda facts: F.filter(rule(facts), lambda m: severity_score(m["rule"]["severity"]) >= floor)


def scan_files(files: DataFrame, min_severity: str = "low", rules: DataFrame | None = None,
               custom_rules: list[StructuralRule] = (), text: str = "text", python_rules: list[PythonRule] = ()) -> DataFrame:
    """One row per file with the positions of all its findings and its text.

    ``files`` has path, language, text and size.  Rules below ``min_severity`` or switched off are
    left out of the plan, so they cost nothing.  ``read_error``, if there, is why a text is missing.  Snippets are cut where findings are flattened.
    With ``python_rules`` there is a column rule_errors: the rules that raised on the file, and why.
    """
    specs = S.rule_specs(rules, min_severity)
    native, python = by_engine(specs)
    structural = _structural_rules(rules, min_severity)
    custom = [_at_least(rule, min_severity) for rule in custom_rules]
    if structural or custom:  # the parser's workers have the text anyway: they run the expressions in the same pass
        native, python = [], specs
    why = "read_error" if "read_error" in files.columns else None
    other = [c for c in files.columns if c not in ("path", "language", text, "size", why)]

    # the text may be a decoding expression; bound, it is decoded once
    base = bind(files.select("path", "language", "size", *other, F.col(text).alias("_raw"), (
        F.col(why) if why else F.lit(None).cast("string")).alias("_why")), "_text", F.col("_raw"))
    body = F.col("_text")
    by_regex = by_structure = None
    if native:
        base = base.withColumn("_fold", folded(body))
        by_regex = locate_hits(body, regex_hits("_text", "_fold", native), native)
    # what Python workers tell of a file, in one pass of them
    sent = {}
    if python:
        sent["regex"] = python_hits(body, python, names=sorted(S.RULE_ATTRIBUTES))
        more = F.coalesce(F.col("_told.regex"), F.array().cast(f"array<{_NO_REGEX}>"))
        by_regex = more if by_regex is None else F.concat(by_regex, more)
    if structural or custom:
        sent["facts"] = facts_of("_text")
        by_structure = F.when(F.col("_told.facts.parsed"), structural_matches(F.col("_told.facts"), structural + custom))
    if python_rules:
        floor = S.severity_rank(min_severity)
        checked = python_findings(list(python_rules), lambda severity: S.severity_rank(severity) >= floor)
        sent["checked"] = checked(F.col("path"), F.when(F.length(body) > 0, body), F.col("language"))
    if sent:
        asked = base.withColumns({f"_{name}": column for name, column in sent.items()})
        base = bind(asked, "_told", F.struct(*[F.col(f"_{name}").alias(name) for name in sent])).drop(*[f"_{name}" for name in sent])

    empty = F.array().cast(f"array<{FINDING_TYPE}>")

    def all_findings(regex: Column, structure: Column) -> Column:
        return F.concat(
            F.transform(regex, lambda m, i: _finding(m, m["rule"]["detail"], i, m["matched_text"])),
            F.transform(structure, lambda m: _finding(m, m["detail"], m["seq"], F.lit(""))))

    no_structure = F.array().cast(f"array<{_NO_STRUCTURE}>")
    no_regex = F.array().cast(f"array<{_NO_REGEX}>")
    readable = F.coalesce(F.length(body), F.lit(0)) > 0
    findings = let(by_regex if by_regex is not None else no_regex, lambda r: let(
        F.coalesce(by_structure, no_structure) if by_structure is not None else no_structure,
        lambda t: F.when(F.size(r) + F.size(t) > 0, all_findings(r, t)).otherwise(empty)))
    if python_rules:
        findings = F.concat(findings, F.coalesce(F.col("_told.checked.findings"), empty))
        other.append(F.col("_told.checked.errors").alias("rule_errors"))
    parsed = F.col("_told.facts.parsed") if structural or custom else F.lit(None).cast("boolean")
    return bind(base.select(
        F.col("path").alias("filename"), "language",
        F.when(~readable, F.coalesce("_why", F.lit(V.UNREADABLE_FILE_ERROR))).alias("error"),
        F.col("size").alias("file_size"),
        F.when(readable, nonblank_lines(body)).otherwise(0).alias("lines_of_code"),
        parsed.alias("parsed"), *other, body.alias("text"), findings.alias("_findings")),
        "findings", F.col("_findings")).drop("_findings")


_PYTHON_RULE_FIELDS = ["filename string", "rule_id string", "title string", "severity string", "confidence string",
                       "owasp_category string", "detail string", "line_number int", "column_number int",
                       "matched_text string", "error string"]


def python_rule(files: DataFrame, check: Callable, path: str = "path", text: str = "text",
                rule_id: str | None = None) -> DataFrame:
    """Matches of an arbitrary Python rule, ``check(path, text) -> iterable of match dicts``.

    Only the two columns the rule reads are sent to the workers, in Arrow batches.  A rule that
    raises on a file gives one row with ``error`` set, and the other files are still checked.
    """
    def one_file(filename: str, source: str) -> list[dict]:
        try:
            return [{"filename": filename, "rule_id": rule_id, "matched_text": "", "column_number": 0} | match
                    for match in check(filename, source)]
        except Exception as problem:
            return [{"filename": filename, "rule_id": rule_id, "error": str(problem)}]

    def run(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "int": pa.int32()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, _PYTHON_RULE_FIELDS)])
        for batch in batches:
            columns = batch.to_pydict()
            rows = [row for filename, source in zip(columns["path"], columns["text"])
                    for row in one_file(filename, source)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select(F.col(path).alias("path"), F.col(text).alias("text")) \
        .mapInArrow(run, ", ".join(_PYTHON_RULE_FIELDS))
