"""Structural rules as column expressions over code facts.

Each rule maps the facts of one file to an array of matches, so a file is judged inside its own
row: no join, no shuffle.  Matches carry the rule's values and a specific ``detail``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesieve.catalog import fixed_values as V
from codesieve.functions.expressions import contains_any, let, literals, sql_literal

#: Built-in values by rule id: id, title, severity, confidence, category, kind.
STRUCTURAL_VALUES = {r[0]: r for r in V.RULES}
_RULES = STRUCTURAL_VALUES


def match(rule_id: str, title: str, severity: str, confidence: str, owasp_category: str,
          at: Column, detail: Column) -> Column:
    """A match at the position of a fact; custom structural rules build theirs with it."""
    rule = {"owner_id": rule_id, "title": title, "severity": severity, "confidence": confidence,
            "owasp_category": owasp_category}
    return F.struct(F.expr(sql_literal(rule)).alias("rule"), detail.alias("detail"), at["line"].alias("line_number"),
                    at["col"].alias("column_number"), at["seq"].alias("seq"))


def _match(rule_id: str, at: Column, detail: Column, severity: str | None = None,
           confidence: str | None = None, title: str | None = None) -> Column:
    _, rule_title, rule_severity, rule_confidence, category, _ = _RULES[rule_id]
    return match(rule_id, title or rule_title, severity or rule_severity,
                 confidence or rule_confidence, category, at, detail)


def _one_per(items: Column, keep: Callable[[Column], Column], match: Callable[[Column], Column]) -> Column:
    """One match per fact that satisfies a predicate."""
    return F.transform(F.filter(items, keep), match)


def _one_per_argument(calls: Column, keep_call: Callable[[Column], Column],
                      keep_arg: Callable[[Column, Column], Column], match: Callable[[Column], Column]) -> Column:
    """One match per qualifying argument of a qualifying call."""
    return F.flatten(F.transform(F.filter(calls, keep_call), lambda c: F.transform(
        F.filter(c["args"], lambda a: keep_arg(c, a)), lambda a: match(c))))


def sql_call(facts: Column) -> Column:
    def formatted_sql(_, arg: Column) -> Column:
        return F.coalesce(contains_any(F.upper(arg["const_str"]), V.SQL_CALL_KEYWORDS)
                          & contains_any(arg["const_str"], V.SQL_FORMAT_MARKERS), F.lit(False))

    return _one_per_argument(
        facts["calls"], lambda c: c["attr"].isin(*V.SQL_CALL_ATTRS), formatted_sql,
        lambda c: _match("PY001", c, F.format_string("formatted query text passed to %s()", c["attr"])))


def sql_concatenation(facts: Column) -> Column:
    def has_keyword(text: Column) -> Column:
        return text.isNotNull() & contains_any(F.upper(text), V.SQL_CONCAT_KEYWORDS)

    return _one_per(
        facts["concats"], lambda c: has_keyword(c["left_str"]) | has_keyword(c["right_str"]),
        lambda c: _match("PY001", c, F.lit("query text concatenated with +"), confidence="medium"))


def command_injection(facts: Column) -> Column:
    def with_shell(call: Column) -> Column:
        return F.exists(call["kwargs"], lambda k: F.coalesce(
            (k["arg"] == "shell") & (k["const"] == "true"), F.lit(False)))

    def with_dynamic_input(call: Column) -> Column:
        return F.exists(call["args"], lambda a: a["kind"].isin("name", "fstring", "format_call")
                        | F.coalesce(a["op"].isin("Add", "Mod"), F.lit(False)))

    return _one_per(
        facts["calls"],
        lambda c: contains_any(c["name2"], V.COMMAND_FUNCTIONS) & (with_shell(c) | with_dynamic_input(c)),
        lambda c: _match("PY002", c, F.concat(
            F.lit("system command run by "), c["name2"],
            F.when(with_shell(c), " through a shell").otherwise(""),
            F.when(with_dynamic_input(c), " with a computed argument").otherwise(""))))


def weak_hash(facts: Column) -> Column:
    """One match per weak algorithm named, so 'hashlib.3des' gives two."""
    def named(call: Column) -> Column:
        return F.when(F.lower(call["name2"]).contains("hashlib."), F.filter(
            literals(V.WEAK_ALGORITHMS), lambda w: F.lower(call["name2"]).contains(w)))

    return F.flatten(F.transform(
        F.filter(facts["calls"], lambda c: F.lower(c["name2"]).contains("hashlib.")),
        lambda c: F.transform(named(c), lambda w: _match("PY004", c, F.concat(F.lit("weak hash "), w)))))


def weak_random(facts: Column) -> Column:
    return _one_per(
        facts["calls"], lambda c: F.lower(c["name2"]).isin(*V.WEAK_RANDOM_FUNCTIONS),
        lambda c: _match("PY004", c, F.lit("predictable random generator"), severity="medium",
                         title=V.WEAK_RANDOM_TITLE))


def unsafe_deserialization(facts: Column) -> Column:
    def detail(name: Column) -> Column:
        return F.when(name.contains("pickle"), "pickled data can run code when loaded") \
            .when(name == "yaml.load", "the full YAML loader builds arbitrary objects") \
            .when(name.isin("eval", "exec"), F.concat(F.lit("text run as code by "), name)) \
            .otherwise(F.concat(F.lit("text turned into code by "), name))

    return _one_per(facts["calls"], lambda c: c["name2_strict"].isin(*V.DESERIALIZERS),
                    lambda c: _match("PY005", c, detail(c["name2_strict"])))


def always_true(facts: Column) -> Column:
    return F.transform(facts["true_ifs"], lambda c: _match("PY010", c, F.lit("condition is the constant True")))


def constant_session(facts: Column) -> Column:
    return _one_per(facts["attr_assigns"], lambda a: (a["attr"] == "session") & a["is_const"],
                    lambda a: _match("PY011", a, F.lit("session set to a constant")))


def path_traversal(facts: Column) -> Column:
    def from_user(arg: Column) -> Column:
        return F.when(arg["kind"] == "name", contains_any(F.lower(arg["name_id"]), V.USER_NAME_WORDS)) \
            .when(arg["kind"] == "attribute", contains_any(F.lower(arg["attr_full"]), V.USER_ATTRIBUTE_WORDS)) \
            .otherwise(arg["kind"].isin("binop", "fstring"))

    return _one_per(
        facts["calls"], lambda c: c["name_full"].isin(*V.PATH_FUNCTIONS) & F.exists(c["args"], from_user),
        lambda c: _match("PY012", c, F.concat(F.lit("path taken from input in "), c["name_full"])))


def template_xss(facts: Column) -> Column:
    def unescaped(keyword: Column) -> Column:
        return F.coalesce(F.lower(keyword["arg"]).contains(V.UNESCAPED_KEYWORD_WORD), F.lit(False))

    return _one_per(
        facts["calls"],
        lambda c: F.lower(c["name_full"]).contains(V.RENDER_WORD) & F.exists(c["kwargs"], unescaped),
        lambda c: _match("PY013", c, F.lit("template rendered with escaping switched off")))


def exception_disclosure(facts: Column) -> Column:
    """One match per enclosing handler and argument that names the caught exception."""
    def shown(call: Column) -> Column:
        return F.flatten(F.transform(call["handlers"], lambda h: F.filter(
            call["args"], lambda a: F.coalesce(a["name_id"] == h, F.lit(False)))))

    return F.flatten(F.transform(
        F.filter(facts["calls"], lambda c: c["is_bare"] & c["name2"].isin(*V.DISCLOSING_CALLS)),
        lambda c: F.transform(shown(c), lambda a: _match("PY014", c, F.lit("caught exception shown to the user")))))


def debug_print(facts: Column) -> Column:
    return _one_per_argument(
        facts["calls"], lambda c: c["is_bare"] & (c["name2"] == "print"),
        lambda c, a: F.coalesce(contains_any(F.lower(a["name_id"]), V.SENSITIVE_WORDS), F.lit(False)),
        lambda c: _match("PY015", c, F.lit("sensitive value printed")))


# name -> (rule id, severity of its matches, expression); rule severity is known before scanning.
STRUCTURAL_RULES: dict[str, tuple[str, str, Callable[[Column], Column]]] = {
    "sql_call": ("PY001", "critical", sql_call),
    "sql_concatenation": ("PY001", "critical", sql_concatenation),
    "command_injection": ("PY002", "critical", command_injection),
    "weak_hash": ("PY004", "high", weak_hash),
    "weak_random": ("PY004", "medium", weak_random),
    "unsafe_deserialization": ("PY005", "critical", unsafe_deserialization),
    "always_true": ("PY010", "critical", always_true),
    "constant_session": ("PY011", "medium", constant_session),
    "path_traversal": ("PY012", "high", path_traversal),
    "template_xss": ("PY013", "high", template_xss),
    "exception_disclosure": ("PY014", "medium", exception_disclosure),
    "debug_print": ("PY015", "medium", debug_print),
}


def structural_matches(facts: Column, rules: list[Callable[[Column], Column]]) -> Column:
    """Matches of structural rules in the facts of one file, as one array."""
    return let(facts, lambda f: F.flatten(F.array(*[rule(f) for rule in rules])))
