"""Rules as data: lookup, search, validation, upsert, enable/disable, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.catalog import fixed_values as V
from codesieve.catalog.specs import compile_errors
from codesieve.functions.expressions import literals

CATALOGUE_CATEGORIES = [c for c, _ in V.CATEGORIES if c != "GEN"]


# ------------------------------------------------------------------ lookup and filters
def enabled_rules(rules: DataFrame) -> DataFrame:
    return rules.filter("enabled")


def select_rules(rules: DataFrame, predicate: Column | None = None, rule_id: str | None = None,
                 category: str | None = None, rule_type: str | None = None,
                 enabled_only: bool = False) -> DataFrame:
    """Rules by id, category, type, enabled flag or any predicate."""
    for column, value in (("rule_id", rule_id), ("owasp_category", category), ("rule_type", rule_type)):
        if value is not None:
            rules = rules.filter(F.col(column) == value)
    if enabled_only:
        rules = enabled_rules(rules)
    return rules if predicate is None else rules.filter(predicate)


def select_patterns(patterns: DataFrame, pattern_id: str | None = None, category: str | None = None,
                    language: str | None = None) -> DataFrame:
    if pattern_id is not None:
        patterns = patterns.filter(F.col("pattern_id") == pattern_id)
    if category is not None:
        patterns = patterns.filter(F.col("owasp_category") == category)
    if language is not None:
        patterns = patterns.filter(F.array_contains("languages", language))
    return patterns


def search_patterns(patterns: DataFrame, query: str, field: str = "name") -> DataFrame:
    """Patterns whose name, description or tags contain a text; other fields find nothing."""
    q = F.lit(query.lower())
    tests = {"name": F.lower("name").contains(q), "description": F.lower("description").contains(q),
             "tags": F.exists("tags", lambda t: t.contains(q))}
    return patterns.filter(tests.get(field, F.lit(False)))


def patterns_by_language(patterns: DataFrame) -> DataFrame:
    """One row per pattern and language: the join table of file languages and patterns."""
    return patterns.withColumn("language", F.explode("languages")).drop("languages")


# ------------------------------------------------------------------ validation
def rule_type() -> Column:
    """Type by what the rule has: expressions, a structural or a semantic check."""
    return F.when(F.size("regexes") > 0, "regex").when(F.col("structural"), "ast") \
        .when(F.col("semantic"), "semantic").otherwise("hybrid")


def validate_rules(rules: DataFrame) -> DataFrame:
    """Adds ``errors`` and ``warnings`` arrays and ``is_valid`` to each rule."""
    rule_id = F.col("rule_id")
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing field {c}"))
               for c in ("rule_id", "title", "description", "severity", "owasp_category")]
    empty_id = rule_id.isNull() | (F.trim(rule_id) == "")
    too_long = ~empty_id & (F.length(rule_id) > V.MAX_RULE_ID_LENGTH)
    bare_id = F.regexp_replace(rule_id, "[_-]", "")
    odd_id = ~empty_id & ~too_long & ~bare_id.rlike(r"\A[\p{L}\p{N}]+\z")

    def outside(column: str, domain: list[str]) -> Column:
        return F.coalesce(~F.col(column).isin(*domain), F.lit(True))

    errors = missing + [
        F.when(empty_id, "rule id is empty"),
        F.when(too_long, f"rule id is longer than {V.MAX_RULE_ID_LENGTH} characters"),
        F.when(outside("severity", [s[0] for s in V.SEVERITIES]), "unknown severity"),
        F.when(outside("owasp_category", CATALOGUE_CATEGORIES), "unknown category"),
        F.when(outside("confidence", V.CONFIDENCES), "unknown confidence"),
        F.when((F.col("rule_type") == "regex") & (F.coalesce(F.size("regexes"), F.lit(0)) <= 0),
               "regex rule without expressions"),
        F.get(F.array_compact(compile_errors("regexes")), 0),
    ]
    warnings = [F.when(odd_id, "rule id has characters other than letters, digits, - and _")]
    return rules.withColumn("errors", F.array_compact(F.array(*errors))) \
        .withColumn("warnings", F.array_compact(F.array(*warnings))) \
        .withColumn("is_valid", F.size("errors") == 0)


# ------------------------------------------------------------------ changes
def latest(rows: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """The row of each key with the highest version; without a version column, the last one as the table is read.

    Partial aggregation leaves one row per key and task, so a key with a third of all rows fills no task.
    """
    order = F.col(version) if version else F.monotonically_increasing_id()
    numbered = rows.withColumn("_version", order)
    last = F.max_by(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), F.col("_version"))
    return numbered.groupBy(F.col(key).alias("_key")).agg(last.alias("_row")).select("_row.*")


def upsert_rules(rules: DataFrame, new_rules: DataFrame, version: str | None = None) -> DataFrame:
    """Valid new rules replace rules of the same id or are added; invalid ones are dropped.

    Of several valid rules of one id the latest counts: the highest ``version``, else the last row.
    """
    valid = latest(validate_rules(new_rules).filter("is_valid"), "rule_id", version).select(*rules.columns)
    return rules.join(valid.select("rule_id"), "rule_id", "left_anti") \
        .select(*rules.columns).unionByName(valid)


def remove_rules(rules: DataFrame, *rule_ids: str) -> DataFrame:
    return rules.filter(~F.col("rule_id").isin(*rule_ids))


def set_enabled(rules: DataFrame, enabled: bool, *rule_ids: str) -> DataFrame:
    """Switch rules on or off; ids that do not exist change nothing."""
    return rules.withColumn("enabled", F.when(
        F.col("rule_id").isin(*rule_ids), F.lit(enabled)).otherwise(F.col("enabled")))


def add_patterns(patterns: DataFrame, new_patterns: DataFrame, version: str | None = None) -> DataFrame:
    """New patterns replace patterns of the same id or are added; the latest of an id counts, as with rules."""
    new = latest(new_patterns, "pattern_id", version).select(*patterns.columns)
    return patterns.join(new.select("pattern_id"), "pattern_id", "left_anti").select(*patterns.columns).unionByName(new)


def rule_metadata(rules: DataFrame) -> DataFrame:
    return rules.select("rule_id", "title", "description", "severity", "owasp_category",
                        "confidence", "enabled")


# ------------------------------------------------------------------ statistics
def rules_by_category(rules: DataFrame) -> DataFrame:
    return rules.groupBy("owasp_category").agg(F.count("*").alias("rule_count"))


def supported_categories(rules: DataFrame) -> DataFrame:
    return rules.select("owasp_category").distinct().orderBy("owasp_category")


def rule_statistics(rules: DataFrame) -> DataFrame:
    """One row: totals by state and kind, with the sorted categories and the number of different rule ids.

    The ids themselves are rows (``rule_ids``): a table of rules has no bound.
    """
    kinds = [F.count_if(F.col("rule_type") == t).alias(f"{t}_rules") for t in V.RULE_TYPES]
    return rules.agg(
        F.count("*").alias("total_rules"), F.count_if("enabled").alias("enabled_rules"), *kinds,
        F.sort_array(F.collect_set("owasp_category")).alias("categories"),
        F.count_distinct("rule_id").alias("distinct_ids"))


def rule_ids(rules: DataFrame) -> DataFrame:
    """The different rule ids, sorted."""
    return rules.select("rule_id").distinct().orderBy("rule_id")


def rules_by_type(rules: DataFrame) -> DataFrame:
    """Rule count of every type, zero included."""
    types = rules.sparkSession.range(1).select(F.explode(literals(V.RULE_TYPES)).alias("rule_type"))
    counts = rules.groupBy("rule_type").agg(F.count("*").alias("n"))
    return types.join(counts, "rule_type", "left").select(
        "rule_type", F.coalesce("n", F.lit(0)).alias("rule_count"))


def pattern_statistics(patterns: DataFrame, severities: DataFrame) -> DataFrame:
    """Pattern counts by severity (zero included), category and language."""
    def counted(kind: str, df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(F.col(key).alias("value")).agg(F.count("*").alias("pattern_count")) \
            .select(F.lit(kind).alias("dimension"), "value", "pattern_count")

    by_severity = severities.select(F.col("severity").alias("value")).join(
        patterns.groupBy(F.col("severity").alias("value")).agg(F.count("*").alias("n")), "value", "left") \
        .select(F.lit("severity").alias("dimension"), "value", F.coalesce("n", F.lit(0)).alias("pattern_count"))
    return by_severity.unionByName(counted("category", patterns, "owasp_category")) \
        .unionByName(counted("language", patterns_by_language(patterns), "language"))
