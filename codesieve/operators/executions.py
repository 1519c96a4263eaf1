"""Rule-execution log: one row per file and rule, with status, matches and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.catalog import fixed_values as V
from codesieve.catalog import specs as S
from codesieve.functions.expressions import let, literals
from codesieve.functions.pymatch import PythonRule


def cap_matches(matches: Column, limit: int) -> Column:
    """First ``limit`` matches of one rule in one file, in match order (the limit is the feature)."""
    in_order = F.array_sort(matches, lambda a, b: a["seq"] - b["seq"])
    return F.when(F.size(matches) > limit, F.slice(in_order, F.lit(1), F.lit(limit))).otherwise(matches)


def by_rule(findings: Column, rule_ids: list[str]) -> Column:
    """Per rule id: rule_id and its matches in order, empty for rules without any.

    One sort brings a file's findings together by rule; ids that are missing come from one hash lookup. So the cost is that
    of the findings plus that of the rules, not their product.
    """
    ordered = F.array_sort(F.transform(findings, lambda f, i: F.struct(f["rule_id"].alias("rule_id"), i.alias("i"), f.alias("match"))))

    def grouped(rows: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: (i == 0) | (F.get(rows, i)["rule_id"] != F.get(rows, i - 1)["rule_id"]))
        return let(starts, lambda s: F.transform(s, lambda start, k: F.struct(
            F.get(rows, start)["rule_id"].alias("rule_id"),
            F.transform(F.slice(rows, start + 1, F.coalesce(F.get(s, k + 1), F.size(rows)) - start), lambda r: r["match"]).alias("matches"))))

    none = F.slice(findings, F.lit(1), F.lit(0))
    hit = let(ordered, lambda rows: F.when(F.size(rows) > 0, grouped(rows)).otherwise(F.array()))
    return let(hit, lambda groups: F.concat(groups, F.transform(
        F.array_except(literals(rule_ids), F.transform(groups, lambda g: g["rule_id"])),
        lambda rule: F.struct(rule.alias("rule_id"), none.alias("matches")))))


def rule_executions(file_results: DataFrame, rules: DataFrame, max_matches: int | None = None,
                    include_disabled: bool = True, python_rules: list[PythonRule] = ()) -> DataFrame:
    """Log of every rule on every file, ``python_rules`` of the scan included.

    The matches are in the file's row and are brought together by rule there; what is known of a rule comes from a
    table that is as small as the plan.  That table is the side that is sent around, whatever Spark takes the size of the log
    for: files that are derived from a few bytes of key look smaller than it.  ``match_count`` is the true count; ``matches`` are cut, with a
    warning, only if ``max_matches`` is given.  A rule with an expression that does not compile has status error, and so
    has a Python rule on a file on which it raised.
    """
    chosen = rules if include_disabled else rules.filter("enabled")
    rows = S._collect(chosen.select("rule_id", "rule_type", "enabled", "regexes").orderBy("rule_id"))
    known = [(r["rule_id"], r["rule_type"], r["enabled"], next(filter(None, map(S.compile_error, r["regexes"] or [])), None)) for r in rows]
    known += [(r.rule_id, "python", True, None) for r in python_rules]
    table = file_results.sparkSession.createDataFrame(known, "rule_id string, rule_type string, enabled boolean, broken string")
    why = F.get(F.filter("rule_errors", lambda e: e["rule_id"] == F.col("e.rule_id")), 0)["message"] \
        if "rule_errors" in file_results.columns else F.lit(None).cast("string")
    entries = file_results.select("filename", "error", "parsed", *[c for c in ("rule_errors",) if c in file_results.columns],
                                  F.explode(by_rule(F.col("findings"), list(dict.fromkeys(r[0] for r in known)))).alias("e"))
    found = entries.withColumn("raised", why).select("filename", "error", "parsed", "raised", "e.*").join(F.broadcast(table), "rule_id")
    # a disabled rule has no matches, whatever the scan was given
    mine = F.when(F.col("enabled"), F.col("matches")).otherwise(F.slice("matches", F.lit(1), F.lit(0)))
    count = F.when(F.col("enabled"), F.size("matches")).otherwise(0)
    fault = F.coalesce("error", "broken", "raised")
    status = F.when(~F.col("enabled"), "skipped").when(fault.isNotNull(), "error") \
        .when((F.col("rule_type") == "ast") & ~F.coalesce("parsed", F.lit(True)), "failed").otherwise("success")
    over = (count > max_matches) if max_matches else F.lit(False)
    return found.select(
        "filename", "rule_id", status.alias("status"), count.alias("match_count"),
        (cap_matches(mine, max_matches) if max_matches else mine).alias("matches"),
        F.when(status == "error", fault).when(status == "failed", "source does not parse").alias("error_message"),
        F.when(over, F.array(F.format_string("rule %s has too many matches, limited to %d", F.col("rule_id"), F.lit(max_matches or 0))))
        .otherwise(F.array().cast("array<string>")).alias("warnings"))


def execution_summary(executions: DataFrame) -> DataFrame:
    """One row over the log; zero everywhere when the log is empty."""
    total, with_matches = F.count("*"), F.count_if(F.col("match_count") > 0)
    return executions.agg(
        total.alias("total_rules_executed"),
        F.count_if(F.col("status") == "success").alias("successful_rules"),
        F.coalesce(F.sum(F.col("match_count").cast("long")), F.lit(0)).alias("total_matches_found"),
        *[F.count_if(F.col("status") == s).alias(f"status_{s}") for s in V.EXECUTION_STATUSES],
        with_matches.alias("rules_with_matches"),
        F.coalesce(F.try_divide(with_matches, total), F.lit(0.0)).alias("match_rate"))


def executions_of_category(executions: DataFrame, rules: DataFrame, category: str) -> DataFrame:
    """Log of the enabled rules of one category."""
    ids = [r["rule_id"] for r in S._collect(
        rules.filter((F.col("owasp_category") == category) & F.col("enabled")).select("rule_id"))]
    return executions.filter(F.col("rule_id").isin(*ids)) if ids else executions.filter(F.lit(False))


def status_breakdown(executions: DataFrame) -> DataFrame:
    """Log rows by status, every status present."""
    dim = executions.sparkSession.range(1).select(F.explode(literals(V.EXECUTION_STATUSES)).alias("status"))
    counts = executions.groupBy("status").agg(F.count("*").alias("n"))
    return dim.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("executions"))
