"""Regular-expression scan as one native column expression.

For each text the result is an array of matches with line, column and matched text.  A text is
read once: cheap literal tests decide which expressions can match at all, ``rlike`` decides
which do, and only those are located.  Nothing is exploded and nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesieve.functions.dialect import groups_of, java_spelling, needed_words, only_python
from codesieve.functions.expressions import let, sql_literal
from codesieve.functions.fold import FOLD_FROM, FOLD_TO
from codesieve.functions.pymatch import Expression, python_matches

# Matches folded together before their result is appended; keeps dense texts near linear.
FOLD_BLOCK = 256

# Expressions that one projection holds; a plan with thousands of them would not compile.
MOST_NATIVE = 256

MATCH_TYPE = "struct<line:int,col:int,text:string,groups:array<string>>"

# Marks the places of matches; of the two, the one that a text does not hold is used.
MARKS = ("\uffff\ufdd0\ufffe", "\ufffe\ufdd1\uffff\ufdd2")


@dataclass(frozen=True)
class RegexSpec:
    """One expression of one rule, with the values its matches carry."""

    owner_id: str
    pattern_no: int
    pattern: str
    ignore_case: bool = False
    # Lists of words; each list must have one word in the (case-folded) text for a match to exist.
    needs: tuple[tuple[str, ...], ...] = ()
    attributes: dict[str, str] = field(default_factory=dict, hash=False)
    # Language the expression applies to; None means every text.
    languages: tuple[str, ...] | None = None

    @property
    def java(self) -> str:
        return java_spelling(self.pattern, self.ignore_case)

    @property
    def only_python(self) -> bool:
        """Whether Java cannot run the expression with the same result."""
        return only_python(self.pattern, self.ignore_case) is not None

    @property
    def words(self) -> tuple[tuple[str, ...], ...]:
        """``needs``, or what the expression itself tells of them."""
        return self.needs or needed_words(self.pattern, self.ignore_case)

    @property
    def group_count(self) -> int:
        return re.compile(self.pattern).groups

    @property
    def group_names(self) -> list[str | None]:
        """Name of each group, None where it has none."""
        names = {number: name for name, number in re.compile(self.pattern).groupindex.items()}
        return [names.get(k + 1) for k in range(self.group_count)]

    @property
    def nullable_groups(self) -> list[bool]:
        """Whether each group can match the empty text; where it cannot, an empty value is a group that took no part."""
        return [nullable for nullable, _ in groups_of(self.pattern)]

    @property
    def unclear_groups(self) -> bool:
        """Whether a match tries a group other than once: Java does not always forget what it tried, nor tell a group that took
        no part from an empty one."""
        return any(unsure for _, unsure in groups_of(self.pattern))


def folded(text: Column) -> Column:
    """Lower-case text for literal tests; folds every character that matches an ASCII letter."""
    special = F.lit(False)
    for char in FOLD_FROM:  # rare, and translating is far slower than searching
        special = special | text.contains(char)
    return F.lower(F.when(special, F.translate(text, FOLD_FROM, FOLD_TO)).otherwise(text))


def _pieces(text: Column, pattern: Column) -> Column:
    """What lies between the matches of an expression, empty matches included: marks put in their places, then split.

    (A split by the expression itself drops empty matches.)
    """
    mark = F.when(text.contains(MARKS[0]), MARKS[1]).otherwise(MARKS[0])
    return let(mark, lambda m: F.split(F.regexp_replace(text, pattern, m), m, -1))


def locate_matches(text: Column, pattern: Column, group_count: Column | None = None,
                   nullable: Column | None = None) -> Column:
    """Array of all matches of one expression in one text, in order.

    The text is the concatenation of the pieces between matches and the matches, so the position of a match
    follows from the newlines and lengths of what precedes it.  Positions are folded in blocks.  A group that took
    no part is null; expressions in which that cannot be told from an empty group are left to Python.
    """
    newline = F.lit("\n")

    def step(segment: Column) -> Column:
        return F.struct(
            (F.length(segment) - F.length(F.replace(segment, newline, F.lit("")))).alias("nl"),
            F.length(F.substring_index(segment, "\n", -1)).alias("tail"),
        )

    def located(matches: Column) -> Column:
        before = F.slice(F.concat(F.array(F.lit("")), matches), F.lit(1), F.size(matches))
        pieces = F.slice(_pieces(text, pattern), F.lit(1), F.size(matches))
        steps = F.zip_with(before, pieces, lambda m, p: step(F.concat(m, p)))
        if group_count is None:
            groups = F.transform(matches, lambda m: F.lit(None).cast("array<string>"))
        else:
            by_group = F.when(group_count > 0, F.transform(
                F.sequence(F.lit(1), group_count), lambda g: F.regexp_extract_all(text, pattern, g)))
            groups = let(by_group, lambda all_groups: F.transform(
                matches, lambda _, i: F.coalesce(
                    F.transform(all_groups, lambda g, k: F.when((F.get(g, i) != "") | F.get(nullable, k), F.get(g, i))),
                    F.array().cast("array<string>"))))
        return F.zip_with(F.zip_with(steps, matches, lambda s, m: F.struct(
            s["nl"].alias("nl"), s["tail"].alias("tail"), m.alias("text"))), groups,
            lambda e, g: F.struct(e["nl"].alias("nl"), e["tail"].alias("tail"),
                                  e["text"].alias("text"), g.alias("groups")))

    def start(line: Column, col: Column) -> Column:
        return F.struct(line.cast("int").alias("line"), col.cast("int").alias("col"),
                        F.array().cast(f"array<{MATCH_TYPE}>").alias("out"))

    def place(acc: Column, entry: Column) -> Column:
        line = acc["line"] + entry["nl"]
        col = F.when(entry["nl"] > 0, entry["tail"]).otherwise(acc["col"] + entry["tail"])
        return F.struct(line.alias("line"), col.alias("col"), F.concat(acc["out"], F.array(F.struct(
            line.alias("line"), col.alias("col"), entry["text"].alias("text"),
            entry["groups"].alias("groups")))).alias("out"))

    def fold(entries: Column) -> Column:
        def block(acc: Column, first: Column) -> Column:
            part = F.aggregate(F.slice(entries, first, F.lit(FOLD_BLOCK)),
                               start(acc["line"], acc["col"]), place)
            return let(part, lambda p: F.struct(
                p["line"].alias("line"), p["col"].alias("col"),
                F.concat(acc["out"], p["out"]).alias("out")))

        firsts = F.when(F.size(entries) > 0, F.sequence(F.lit(1), F.size(entries), F.lit(FOLD_BLOCK))) \
            .otherwise(F.array().cast("array<int>"))
        return F.aggregate(firsts, start(F.lit(1), F.lit(0)), block, lambda acc: acc["out"])

    return let(F.regexp_extract_all(text, pattern, F.lit(0)),
               lambda matches: let(located(matches), fold))


def could_match(spec: RegexSpec, text: str, fold: str, language: str | None) -> str:
    """SQL condition; cheap tests first (language, literals), the expression itself last."""
    tests = []
    if spec.languages is not None and language is not None:
        tests.append(f"{language} IN ({', '.join(map(sql_literal, spec.languages))})")
    for words in spec.words:
        tests.append("(" + " OR ".join(f"contains({fold}, {sql_literal(w)})" for w in words) + ")")
    return " AND ".join(tests + [f"{text} RLIKE {sql_literal(spec.java)}"])


def regex_hits(text: str, fold: str, specs: list[RegexSpec], language: str | None = None) -> Column:
    """Numbers of the expressions that match a text, given by column name."""
    cases = [f"CASE WHEN {could_match(spec, text, fold, language)} THEN {number} END"
             for number, spec in enumerate(specs)]
    return F.expr(f"array_compact(array({', '.join(cases)}))")


def _named(names: Column, groups: Column) -> Column:
    """The named groups of a match as a map."""
    pairs = F.filter(F.arrays_zip(names.alias("name"), groups.alias("value")), lambda p: p["name"].isNotNull())
    return F.map_from_entries(pairs)


def locate_hits(text: Column, hits: Column, specs: list[RegexSpec], with_groups: bool = False) -> Column:
    """All matches of the expressions numbered in ``hits``, as one flat array.

    ``rule`` holds the values of the rule an expression belongs to.
    """
    names = sorted({k for s in specs for k in s.attributes})
    known = F.expr(sql_literal([{
        "pattern_no": s.pattern_no, "java": s.java, "pattern": s.pattern,
        "group_count": s.group_count, "nullable": s.nullable_groups or [False], "names": s.group_names or [None],
        "rule": {"owner_id": s.owner_id} | {n: s.attributes.get(n) for n in names}} for s in specs]))

    def one(spec: Column) -> Column:
        found = locate_matches(text, spec["java"], spec["group_count"] if with_groups else None, spec["nullable"])
        return F.transform(found, lambda m, i: F.struct(
            spec["rule"].alias("rule"), spec["pattern_no"].alias("pattern_no"), (i + 1).alias("match_no"),
            m["line"].alias("line_number"), m["col"].alias("column_number"), m["text"].alias("matched_text"),
            spec["pattern"].alias("pattern"), m["groups"].alias("groups"),
            *([_named(spec["names"], m["groups"]).alias("named_groups")] if with_groups else [])))

    return F.flatten(F.transform(hits, lambda number: let(F.get(known, number), one)))


def python_hits(text: Column, specs: list[RegexSpec], language: Column | None = None, with_groups: bool = False,
                names: list[str] | None = None) -> Column:
    """The same array as ``locate_hits`` gives, by Python's engine; ``names``: the rule values that it has."""
    names = sorted({k for s in specs for k in s.attributes}) if names is None else names
    run = python_matches([
        Expression(k, s.pattern, s.ignore_case, s.words, s.languages if language is not None else None, s.owner_id, s.pattern_no,
                   tuple((n, s.attributes.get(n)) for n in names)) for k, s in enumerate(specs)], with_groups)
    return run(text, F.lit(None).cast("string") if language is None else language)


def by_engine(specs: list[RegexSpec], with_groups: bool = False) -> tuple[list[RegexSpec], list[RegexSpec]]:
    """Expressions for Java and for Python. Beyond ``MOST_NATIVE`` all go to Python, whose word index reads a text once."""
    many = len(specs) > MOST_NATIVE
    sent = [many or s.only_python or with_groups and s.unclear_groups for s in specs]
    return [s for s, out in zip(specs, sent) if not out], [s for s, out in zip(specs, sent) if out]
