"""Small column helpers shared by the other function modules."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    A lambda variable is the only binding that no optimizer rule re-inlines, so a costly
    value (a split text, a list of matches) is computed once per row, not once per use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sql_literal(value) -> str:
    """A Python value as Spark SQL text.

    Long literal tables are built from one SQL expression instead of a call per element.
    """
    if value is None:
        return "CAST(NULL AS STRING)"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(map(sql_literal, value)) + ")"
    if isinstance(value, dict):
        return "named_struct(" + ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in value.items()) + ")"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r") + "'"
    return str(value).lower() if isinstance(value, bool) else str(value)


def literals(values: Iterable[str]) -> Column:
    values = list(values)
    return F.expr(sql_literal(values)) if values else F.array().cast("array<string>")


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True when ``text`` contains at least one of a fixed list of words."""
    return F.exists(literals(words), lambda w: F.coalesce(text.contains(w), F.lit(False)))


def occurrences(text: Column, word: str) -> Column:
    """Number of non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed exactly once per row.

    A projected column may be inlined into each of its uses, and a filter on it is pushed below the
    projection and computes it again.  The output of a generator is a real attribute, so neither
    happens; worth it for costly values only.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))

