"""Patterns given by callers, turned once into expressions of Spark."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import line_patterns

#: Literals looked for before a pattern is tried; with more of them, or shorter ones, the pattern is tried at once.
MOST_LITERALS, SHORTEST_LITERAL = 16, 3


def glob_regex(glob: str) -> str:
    """A glob as an expression for the whole text: `*` any run, `?` one character, `[set]`, `[^set]`; `]` first in a set is itself."""
    out, at = [], 0
    while at < len(glob):
        c = glob[at]
        at += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            negated = glob.startswith("^", at)
            begin = at + negated
            end = glob.find("]", begin + 1)
            if end < 0:
                raise ValueError(f"{glob!r}: a set has no end")
            members = re.sub(r"([\\\[\]&^~])", r"\\\1", glob[begin:end])
            out.append(f"[{'^' * negated}{members}]")
            at = end + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + r"\z"


def glob_match(text: Column, globs: list[str]) -> Column:
    """True if any glob matches the whole text, case and all."""
    return text.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))


def line_regex(pattern: str, ignore_case: bool = False, fixed: bool = False) -> str:
    """A search pattern as Java's expression for one line; ValueError if it is no pattern, or matches a line feed."""
    text = "(?s)" + line_patterns.java(line_patterns.parse(pattern, ignore_case, fixed))
    session = SparkSession.getActiveSession()
    if session is not None:  # names of classes that Java doesn't know are refused here, not in the tasks
        try:
            session._jvm.java.util.regex.Pattern.compile(text)
        except IllegalArgumentException as e:
            raise line_patterns.PatternError(f"{pattern!r}: {e}") from None
    return text


def required_literals(pattern: str, ignore_case: bool = False, fixed: bool = False) -> tuple[list[str], bool]:
    """Strings of which each matching line holds one, and whether case is ignored (they are in lower case then)."""
    return line_patterns.required_literals(line_patterns.parse(pattern, ignore_case, fixed))


def line_predicate(text: Column, pattern: str, fixed: bool = False, ignore_case: bool = False) -> Column:
    """True where a line holds the pattern. A fixed string that keeps case needs no expression engine.

    Lines without one of the literals that every match holds are passed over: a search for a string is far cheaper.
    """
    if fixed and not ignore_case:
        line_patterns.parse(pattern, fixed=True)
        return F.contains(text, F.lit(pattern))
    found = text.rlike(line_regex(pattern, ignore_case, fixed))
    literals, fold = required_literals(pattern, ignore_case, fixed)
    if not literals or len(literals) > MOST_LITERALS or min(map(len, literals)) < SHORTEST_LITERAL:
        return found
    own = F.lower(text) if fold else text
    held = reduce(Column.__or__, [F.contains(own, F.lit(x)) for x in literals])
    if fold and any("s" in x for x in literals):  # the long s is in lower case already
        held = held | F.contains(text, F.lit("\u017f"))
    return held & found
