r"""Python expressions told to the engine that runs them.

An expression is read with Python's own parser. From its syntax tree come

* its spelling for Java, where Java finds the same matches: classes, anchors, word borders, flags, groups and repeats are
  written out, so no flag of Java decides their meaning;
* the reason why only Python can run it, where Java cannot say it (conditions) or would go on differently after an empty
  match;
* the words that a match cannot do without.

Expressions are matched with ``re.MULTILINE``, as rules of this kind are.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as C
from re import _parser

from codesieve.functions.fold import SPACE_CLASS, WORD_CLASS

_ASCII = {"SPACE": r" \t-\r", "WORD": "a-zA-Z0-9_", "DIGIT": "0-9"}
_UNICODE = {"SPACE": SPACE_CLASS, "WORD": WORD_CLASS, "DIGIT": r"\p{Nd}"}
#: Shorter words rule out too little to be worth a test.
LEAST_WORD = 3


class OnlyPython(Exception):
    """Java cannot run this expression with the same result."""


@lru_cache(maxsize=4096)
def _parsed(pattern: str, ignore_case: bool):
    return _parser.parse(pattern, re.M | (re.I if ignore_case else 0))


@lru_cache(maxsize=4096)
def java_spelling(pattern: str, ignore_case: bool = False) -> str:
    """The expression for Java; raises ``OnlyPython`` with the reason if there is none, ``re.error`` if it is broken."""
    tree = _parsed(pattern, ignore_case)
    if not _empty_last(tree):
        raise OnlyPython("may match nothing before it matches something at the same place")
    flags = tree.state.flags
    head = "" if not flags & re.I else "(?i)" if flags & re.A else "(?iu)"
    return head + _Spelling(flags).sequence(tree, flags)


def only_python(pattern: str, ignore_case: bool = False) -> str | None:
    """Why Python has to run the expression; None if Java can."""
    try:
        java_spelling(pattern, ignore_case)
    except OnlyPython as reason:
        return str(reason)
    return None


# ------------------------------------------------------------------ spelling
def _char(code: int) -> str:
    if 0xD800 <= code <= 0xDFFF:
        raise OnlyPython("half of a surrogate pair")
    char = chr(code)
    return char if char.isascii() and char.isalnum() else f"\\x{{{code:x}}}"


class _Spelling:
    """Writes the nodes of a syntax tree; ``flags`` are those of the whole expression."""

    def __init__(self, flags: int):
        self.flags = flags

    def sequence(self, items, flags: int) -> str:
        return "".join(self.item(op, value, flags) for op, value in items)

    def folded(self, piece: str, flags: int) -> str:
        """``piece`` under the case folding of its place, where that is not the one of the whole."""
        if not (flags ^ self.flags) & (re.I | re.A):
            return piece
        on = "" if not flags & re.I else "i" if flags & re.A else "iu"
        off = "".join(x for x in "iu" if x not in on)
        return f"(?{on}{'-' + off if off else ''}:{piece})"

    def group(self, items, flags: int) -> str:
        """A class of single characters and ranges, and of opposites of classes."""
        table, negated, plain, opposite = _ASCII if flags & re.A else _UNICODE, False, [], []
        for op, value in items:
            if op is C.NEGATE:
                negated = True
            elif op is C.LITERAL:
                plain.append(_char(value))
            elif op is C.RANGE:
                plain.append(f"{_char(value[0])}-{_char(value[1])}")
            elif op is C.CATEGORY:
                name = str(value).removeprefix("CATEGORY_")
                kind = table[name.removeprefix("NOT_")]
                (opposite if name.startswith("NOT_") else plain).append(f"[^{kind}]" if name.startswith("NOT_") else kind)
            else:
                raise OnlyPython(f"class item {op}")
        if negated and not opposite:
            return self.folded(f"[^{''.join(plain)}]", flags)
        parts = ([f"[{''.join(plain)}]"] if plain else []) + opposite
        either = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
        return self.folded(f"(?:(?!{either})(?s:.))" if negated else either, flags)

    def place(self, value, flags: int) -> str:
        word = (_ASCII if flags & re.A else _UNICODE)["WORD"]
        behind, ahead, not_behind, not_ahead = f"(?<=[{word}])", f"(?=[{word}])", f"(?<![{word}])", f"(?![{word}])"
        return {
            "AT_BEGINNING": r"(?:\A|(?<=\n))" if flags & re.M else r"\A", "AT_BEGINNING_STRING": r"\A",
            "AT_END": r"(?=\n|\z)" if flags & re.M else r"(?=\n?\z)", "AT_END_STRING": r"\z",
            "AT_BOUNDARY": f"(?:{behind}{not_ahead}|{not_behind}{ahead})",
            # an empty text has no place that is no border
            "AT_NON_BOUNDARY": rf"(?:{behind}{ahead}|{not_behind}{not_ahead}(?!\A\z))"}[str(value)]

    def repeat(self, value, flags: int, mark: str) -> str:
        low, high, body = value
        if not body.getwidth()[0] and body.getwidth()[1] and high != 1:
            raise OnlyPython("repeats what may match nothing")
        text = self.sequence(body, flags)
        if not re.fullmatch(r"[A-Za-z0-9]|\[[^\[\]]*\]", text):
            text = f"(?:{text})"
        if (low, high) == (0, 1):
            return f"{text}?{mark}"
        most = "" if high == C.MAXREPEAT else int(high)
        times = {(0, ""): "*", (1, ""): "+"}.get((int(low), most)) or f"{{{int(low)},{most}}}"
        return f"{text}{times}{mark}"

    def item(self, op, value, flags: int) -> str:
        if op is C.LITERAL:
            return self.folded(_char(value), flags)
        if op is C.NOT_LITERAL:
            return self.folded(f"[^{_char(value)}]", flags)
        if op is C.ANY:
            return "(?s:.)" if flags & re.S else r"[^\n]"
        if op is C.IN:
            return self.group(value, flags)
        if op is C.BRANCH:
            return f"(?:{'|'.join(self.sequence(x, flags) for x in value[1])})"
        if op is C.AT:
            return self.place(value, flags)
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            return self.repeat(value, flags, {C.MAX_REPEAT: "", C.MIN_REPEAT: "?", C.POSSESSIVE_REPEAT: "+"}[op])
        if op is C.SUBPATTERN:
            number, more, less, body = value
            inner = self.sequence(body, (flags | more) & ~less)
            return f"(?:{inner})" if number is None else f"(?<g{number}>{inner})"
        if op is C.ATOMIC_GROUP:
            return f"(?>{self.sequence(value, flags)})"
        if op is C.GROUPREF:
            return self.folded(rf"\k<g{value}>", flags)
        if op in (C.ASSERT, C.ASSERT_NOT):
            sign = "=" if op is C.ASSERT else "!"
            return f"(?{'<' if value[0] < 0 else ''}{sign}{self.sequence(value[1], flags)})"
        raise OnlyPython("a condition on a group" if op is C.GROUPREF_EXISTS else f"{op}")


def _empty_last(items) -> bool:
    """Whether the expression, where it may match nothing, does so only when it can match nothing else there.

    After an empty match Java goes on at the next place, Python looks for a longer match at the same one. That makes no
    difference if the empty match is what every part tries last: a row of greedy repeats.
    """
    if items.getwidth()[0] or not items.getwidth()[1]:
        return True
    for op, value in items:
        if op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
            continue
        if op is C.MAX_REPEAT and value[2].getwidth()[0]:
            continue
        if op is C.SUBPATTERN and _empty_last(value[3]):
            continue
        return False
    return True


# ------------------------------------------------------------------ groups
@lru_cache(maxsize=4096)
def groups_of(pattern: str) -> list[tuple[bool, bool]]:
    """Per group: whether it can match the empty text, and whether a match tries it other than once."""
    tree, found = _parsed(pattern, False), {}

    def walk(items, optional: bool) -> None:
        for op, value in items:
            if op is C.SUBPATTERN:
                if value[0] is not None:
                    found[value[0]] = (not value[3].getwidth()[0], optional)
                walk(value[3], optional)
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
                walk(value[2], optional or (value[0], value[1]) != (1, 1))
            elif op is C.BRANCH:
                for branch in value[1]:
                    walk(branch, True)
            elif op is C.GROUPREF_EXISTS:
                for branch in value[1:]:
                    walk(branch or [], True)
            elif op is C.ATOMIC_GROUP:
                walk(value, optional)
            elif op in (C.ASSERT, C.ASSERT_NOT):
                walk(value[1], optional or op is C.ASSERT_NOT)

    walk(tree, False)
    return [found[k] for k in sorted(found)]


# ------------------------------------------------------------------ words
def needed_words(pattern: str, ignore_case: bool = False) -> tuple[tuple[str, ...], ...]:
    """Lists of lower-case words: a text with a match has, after case folding, at least one word of each list."""
    return tuple(sorted({tuple(sorted(set(x))) for x in _needs(_parsed(pattern, ignore_case)) if x}))


def _needs(items) -> list[list[str]]:
    """Requirements of a sequence; a requirement is a list of words of which one occurs."""
    out, run = [], []

    def flush() -> None:
        if len(run) >= LEAST_WORD:
            out.append(["".join(run)])
        run.clear()

    for op, value in items:
        if op is C.LITERAL and value < 128:
            run.append(chr(value).lower())
            continue
        if op is C.AT:  # takes no room
            continue
        flush()
        if op is C.SUBPATTERN:
            out += _needs(value[3])
        elif op is C.ATOMIC_GROUP:
            out += _needs(value)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
            out += _needs(value[2])
        elif op is C.BRANCH:
            each = [_needs(x) for x in value[1]]
            if all(each):
                out.append([word for needs in each for word in max(needs, key=lambda words: min(map(len, words)))])
    flush()
    return out
