"""Matches by Python's own engine, for expressions that Java cannot run and for rule sets of any size.

A text goes to the workers once, in Arrow batches. One automaton over the words that the expressions cannot do without
reads it in one pass, and only expressions whose words occur are run; so the time grows with the text and its hits, not
with the number of rules. Positions come from the sorted offsets of the line feeds.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from codesieve.functions.fold import FOLD_FROM, FOLD_TO

#: Texts matched together before their rows are built.
CHUNK_ROWS = 64
_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)


class LinePlaces:
    """Line (from 1) and column (from 0) of offsets into a text."""

    def __init__(self, text: str):
        self.feeds = [m.start() for m in re.finditer("\n", text)]

    def of(self, offset: int) -> tuple[int, int]:
        line = bisect_left(self.feeds, offset)
        return line + 1, offset - (self.feeds[line - 1] + 1 if line else 0)


class WordIndex:
    """Which lists of needed words a text satisfies, by one automaton over all words and one pass over the text."""

    def __init__(self, needs: dict[int, tuple[tuple[str, ...], ...]]):
        import ahocorasick

        self.needs, self.automaton, self.by_word = needs, None, {}
        users = Counter(word for lists in needs.values() for word in {w for words in lists for w in words})
        for number, lists in needs.items():
            # the list whose words the fewest others need leads to the number; the other lists are tested then
            for word in min(lists, key=lambda words: (max(users[w] for w in words), -min(map(len, words)))):
                self.by_word.setdefault(word, []).append(number)
        if users:
            self.automaton = ahocorasick.Automaton()
            for word in users:
                self.automaton.add_word(word, word)
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[int]:
        found = {word for _, word in self.automaton.iter(folded)} if self.automaton is not None else set()
        near = {number for word in found for number in self.by_word.get(word, ())}
        return [n for n in near if all(not found.isdisjoint(words) for words in self.needs[n])]


@dataclass(frozen=True)
class Expression:
    """What a worker has to know of one expression; ``values`` are those of its rule, by name."""

    number: int
    pattern: str
    ignore_case: bool
    words: tuple[tuple[str, ...], ...]
    languages: tuple[str, ...] | None = None
    owner_id: str = ""
    pattern_no: int = 0
    values: tuple[tuple[str, str | None], ...] = ()


@dataclass(frozen=True)
class PythonRule:
    """A rule written in Python: ``check(path, text)`` gives matches as dicts.

    A match may have line_number (default 1), column_number (0), matched_text and detail, and other values than the
    rule's for title, severity, confidence and owasp_category. A rule that raises on a file has no match there, and its error
    is kept. ``languages``: the languages it runs on, all by default.
    """

    rule_id: str
    check: Callable[[str, str], Iterable[dict]]
    title: str = ""
    severity: str = "medium"
    confidence: str = "medium"
    owasp_category: str = "GEN"
    languages: tuple[str, ...] | None = None

    def findings(self, path: str | None, text: str) -> list[dict]:
        out = []
        for match in self.check(path, text):
            unknown = set(match) - _RULE_VALUES - {"line_number", "column_number", "matched_text", "detail", "rule_id"}
            if unknown or match.get("rule_id", self.rule_id) != self.rule_id:
                raise ValueError(f"a match of {self.rule_id} has {sorted(unknown) or match['rule_id']}")
            found = {"rule_id": self.rule_id, "detail": "", "matched_text": "", "line_number": 1, "column_number": 0, "seq": len(out)}
            found |= {name: getattr(self, name) for name in _RULE_VALUES} | dict(match)
            for name, kind in (("line_number", int), ("column_number", int), ("severity", str), ("matched_text", str), ("detail", str)):
                if not isinstance(found[name], kind):
                    raise TypeError(f"{name} of a match of {self.rule_id} is {found[name]!r}")
            out.append(found)
        return out


_RULE_VALUES = {"title", "severity", "confidence", "owasp_category"}


class Matcher:
    def __init__(self, expressions: list[Expression]):
        self.expressions = {x.number: x for x in expressions}
        self.compiled: dict[int, re.Pattern] = {}
        self.always = sorted(x.number for x in expressions if not x.words)
        self.index = WordIndex({x.number: x.words for x in expressions if x.words})

    def candidates(self, text: str, language: str | None) -> Iterator[Expression]:
        folded = text.translate(_FOLD).lower() if not text.isascii() else text.lower()
        for number in sorted([*self.always, *self.index.hits(folded)]):
            x = self.expressions[number]
            if x.languages is None or language in x.languages:
                yield x

    def matches(self, text: str, language: str | None = None) -> list[tuple]:
        """(number, match_no, line, column, text, groups), by expression and place."""
        out, places = [], None
        for x in self.candidates(text, language):
            if x.number not in self.compiled:
                self.compiled[x.number] = re.compile(x.pattern, re.M | (re.I if x.ignore_case else 0))
            for k, m in enumerate(self.compiled[x.number].finditer(text), 1):
                places = places or LinePlaces(text)
                out.append((x.number, k, *places.of(m.start()), m[0], list(m.groups())))
        return out


_matchers: dict[tuple, Matcher] = {}


def _matcher(key: tuple[Expression, ...]) -> Matcher:
    if key not in _matchers:
        _matchers.clear()  # a worker serves one rule set at a time
        _matchers[key] = Matcher(list(key))
    return _matchers[key]


def match_type(expressions: list[Expression], with_groups: bool) -> pa.DataType:
    """Matches of expressions, as the scan has them."""
    names = ["owner_id", *(name for name, _ in expressions[0].values)]
    named = [("named_groups", pa.map_(pa.string(), pa.string()))] if with_groups else []
    return pa.list_(pa.struct([
        ("rule", pa.struct([(name, pa.string()) for name in names])), ("pattern_no", pa.int32()), ("match_no", pa.int32()),
        ("line_number", pa.int32()), ("column_number", pa.int32()), ("matched_text", pa.string()), ("pattern", pa.string()),
        ("groups", pa.list_(pa.string())), *named]))


def _rows(matcher: Matcher, text: str, language: str | None, with_groups: bool) -> list[dict]:
    out = []
    for number, match_no, line, col, found, groups in matcher.matches(text, language):
        x = matcher.expressions[number]
        row = {"rule": {"owner_id": x.owner_id} | dict(x.values), "pattern_no": x.pattern_no, "match_no": match_no, "line_number": line,
               "column_number": col, "matched_text": found, "pattern": x.pattern, "groups": groups if with_groups else None}
        if with_groups:
            row["named_groups"] = [(name, groups[k - 1]) for name, k in matcher.compiled[number].groupindex.items()]
        out.append(row)
    return out


def python_matches(expressions: list[Expression], with_groups: bool = False):
    """A column function of text and language: array of matches, null for a null text."""
    key, kind = tuple(expressions), match_type(expressions, with_groups)

    @F.arrow_udf(from_arrow_type(kind))
    def run(texts: pa.Array, languages: pa.Array) -> pa.Array:
        matcher, parts = _matcher(key), []
        for low in range(0, len(texts), CHUNK_ROWS):
            rows = zip(texts.slice(low, CHUNK_ROWS).to_pylist(), languages.slice(low, CHUNK_ROWS).to_pylist())
            parts.append(pa.array([None if t is None else _rows(matcher, t, language, with_groups) for t, language in rows], type=kind))
        return pa.concat_arrays(parts) if parts else pa.array([], type=kind)

    return run


FINDINGS = pa.list_(pa.struct([
    (name, pa.string()) for name in ("rule_id", "title", "severity", "confidence", "owasp_category", "detail")]
    + [(name, pa.int32()) for name in ("line_number", "column_number", "seq")] + [("matched_text", pa.string())]))
ERRORS = pa.list_(pa.struct([("rule_id", pa.string()), ("message", pa.string())]))


def python_findings(rules: list[PythonRule], least: Callable[[str], bool]):
    """A column function of path, text and language: findings of Python rules and the errors of rules that raised.
    ``least``: whether a severity is reported."""
    kind = pa.struct([("findings", FINDINGS), ("errors", ERRORS)])

    def one(path: str | None, text: str | None, language: str | None) -> dict:
        findings, errors = [], []
        for rule in rules if text is not None else []:
            if rule.languages is None or language in rule.languages:
                try:
                    findings += [x for x in rule.findings(path, text) if least(x["severity"])]
                except Exception as problem:  # one rule's fault on one file, kept as a row
                    errors.append({"rule_id": rule.rule_id, "message": f"{type(problem).__name__}: {problem}"})
        return {"findings": findings, "errors": errors}

    @F.arrow_udf(from_arrow_type(kind))
    def run(paths: pa.Array, texts: pa.Array, languages: pa.Array) -> pa.Array:
        parts = []
        for low in range(0, len(texts), CHUNK_ROWS):
            columns = (x.slice(low, CHUNK_ROWS).to_pylist() for x in (paths, texts, languages))
            parts.append(pa.array([one(*row) for row in zip(*columns)], type=kind))
        return pa.concat_arrays(parts) if parts else pa.array([], type=kind)

    return run
