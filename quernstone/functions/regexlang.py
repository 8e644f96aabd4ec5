"""The regular-expression dialect (linear-time, Unicode, no look-around) translated for Spark, and what can be told of a pattern."""

from __future__ import annotations

import re
from re import _constants as C, _parser as P  # type: ignore[attr-defined]

FLAGS = "(?dU)"


class PatternError(ValueError):
    """A pattern that the dialect doesn't have."""


def translate(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for Spark: Unicode classes, . but for newline, $ only at the end, (?<name>. Rejects what the dialect lacks."""
    out, i, in_class = [], 0, 0
    while i < len(pattern):
        two, c = pattern[i : i + 2], pattern[i]
        if c == "\\":
            if len(two) < 2:
                raise PatternError("the pattern ends in a backslash")
            if (two[1].isdigit() and not in_class) or two[1] in "QEkGRXZ":
                raise PatternError(f"{two} isn't supported")
            out.append("\\z" if two == "\\z" else two)
            i += 2
            continue
        if in_class:
            in_class += (c == "[") - (c == "]")
            if two in ("--", "~~"):
                raise PatternError("set operations other than && aren't supported")
        elif c == "[":
            in_class = 1
            if pattern[i + 1 : i + 2] == "]" or pattern[i + 1 : i + 3] == "^]":
                n = 2 if pattern[i + 1] == "]" else 3
                out.append(pattern[i : i + n - 1] + "\\]")
                i += n
                continue
        elif pattern.startswith(("(?=", "(?!", "(?<=", "(?<!", "(?>"), i):
            raise PatternError("look-around and atomic groups aren't supported")
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        elif c == "$":
            out.append("\\z")
            i += 1
            continue
        elif c in "*+?}" and pattern[i + 1 : i + 2] == "+":
            raise PatternError("possessive quantifiers aren't supported")
        out.append(c)
        i += 1
    if in_class:
        raise PatternError("a class isn't closed")
    return ("(?diuU)" if ignore_case else FLAGS) + "".join(out)


def literal(needle: str, ignore_case: bool = False) -> str:
    """A pattern for just this text; case is folded for all letters."""
    quoted = re.sub(r"([^\w\s])", r"\\\1", needle)
    return ("(?iu)" if ignore_case else "") + quoted


def _parse(pattern: str):
    try:
        return P.parse(re.sub(r"\(\?<(?![=!])", "(?P<", pattern))
    except (re.error, OverflowError):
        return None


def stays_in_line(pattern: str) -> bool:
    """Whether no match can hold a newline nor depend on where the text begins or ends. False if unsure."""
    tree = _parse(pattern)

    def ok(t) -> bool:
        for op, arg in t:
            if op is C.LITERAL:
                if arg == 10:
                    return False
            elif op is C.IN:
                if arg[0][0] is C.NEGATE:
                    return False
                for o, a in arg:
                    if o is C.LITERAL and a == 10 or o is C.RANGE and a[0] <= 10 <= a[1] or o is C.CATEGORY and a not in (C.CATEGORY_DIGIT, C.CATEGORY_WORD):
                        return False
            elif op is C.ANY:
                continue
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                if not ok(arg[2]):
                    return False
            elif op is C.SUBPATTERN:
                if not ok(arg[3]) or arg[1] or arg[2]:
                    return False
            elif op is C.BRANCH:
                if not all(ok(b) for b in arg[1]):
                    return False
            elif op is C.AT and arg in (C.AT_BOUNDARY, C.AT_NON_BOUNDARY):
                continue
            else:
                return False
        return True

    return tree is not None and not tree.state.flags & (re.S | re.M | re.I | re.X) and ok(tree)


def required_literals(pattern: str) -> list[str]:
    """Runs of characters that every match holds, for a filter that the scan can push down. May be none."""
    tree, out, run = _parse(pattern), [], []

    def flush() -> None:
        if run:
            out.append("".join(run))
            run.clear()

    def walk(t) -> None:
        for op, arg in t:
            if op is C.LITERAL:
                run.append(chr(arg))
            elif op is C.SUBPATTERN and not arg[1] and not arg[2]:
                walk(arg[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1 and arg[1] == arg[0]:
                for _ in range(min(arg[0], 8)):
                    walk(arg[2])
                if arg[0] > 8:
                    flush()
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                walk(arg[2])
                flush()
            elif op is not C.AT:
                flush()

    if tree is not None and not tree.state.flags & (re.I | re.X):
        walk(tree)
        flush()
    return [x for x in out if len(x.encode()) >= 3]
