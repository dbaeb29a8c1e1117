"""Regular expressions with the semantics that the model's patterns assume."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: An edge before what can only be a word character, and one after it.
_BEFORE, _AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def _alternatives(group: str) -> list[str]:
    """Alternatives of a group that is given without its parentheses."""
    out, depth = [""], 0
    for token in re.findall(r"\\.|\[(?:\\.|[^\]])*\]|.", group):
        depth += (token == "(") - (token == ")")
        if token == "|" and not depth:
            out.append("")
        else:
            out[-1] += token
    return out


def _begins_with_word(pattern: str) -> bool:
    """Whether every match begins with a word character; False where that is not plain to see."""
    if m := re.match(r"\((?:\?:)?", pattern):
        depth, end = 0, 0
        for t in re.finditer(r"\\.|\[(?:\\.|[^\]])*\]|.", pattern):
            depth += (t[0] == "(") - (t[0] == ")")
            if not depth:
                end = t.end()
                break
        return pattern[end : end + 1] not in ("?", "*", "{") and all(_begins_with_word(x) for x in _alternatives(pattern[m.end() : end - 1]))
    m = re.match(r"[A-Za-z0-9]|\\d", pattern)
    return bool(m) and pattern[m.end() : m.end() + 1] not in ("?", "*", "{", "|")


def _ends_with_word(pattern: str) -> bool:
    """Whether every alternative, wherever it stands, ends in a plain letter or digit, with or without more of such behind it."""
    return all(re.search(r"(?:[A-Za-z0-9]|\\d(?:\{[\d,]+\})?)$", x.rstrip(")?")) for x in pattern.split("|"))


def java(pattern: str, ignore_case: bool = True) -> str:
    r"""``\b`` looks at ASCII word characters only and ``\s`` takes the no-break space too.

    Java's own ``\b`` counts letters beyond ASCII as word characters, so
    "éfree" would not begin a word at "free". Where a word or number stands inside
    an edge at the pattern's ends, a one-sided look is enough.
    """
    p = pattern
    inner = p.removeprefix(r"\b")
    if inner != p and _begins_with_word(inner):
        p = _BEFORE + inner
    inner = p.removesuffix(r"\b")
    if inner != p and _ends_with_word(pattern.removeprefix(r"\b").removesuffix(r"\b")):
        p = inner + _AFTER
    p = p.replace(r"\b", EDGE).replace(r"[-\s]", "[-~]").replace(r"\s", r"[\s\x{A0}]").replace("[-~]", r"[-\s\x{A0}]")
    return ("(?i)" if ignore_case else "") + p


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return text.rlike(java(pattern, ignore_case))


def first_match(text: Column, pattern: str, group: int = 0, ignore_case: bool = True) -> Column:
    """The group of the first match, null where there is none."""
    found = F.regexp_extract(text, java(pattern, ignore_case), group)
    # No pattern matches the empty text, so an empty match is none.
    return F.nullif(found, F.lit("")) if group == 0 else F.when(matches(text, pattern, ignore_case), found)


def first_kind(text: Column, kinds: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The name of the first pattern that matches."""
    out = F.lit(otherwise)
    for name, pattern in reversed(kinds):
        out = F.when(matches(text, pattern), F.lit(name)).otherwise(out)
    return out
